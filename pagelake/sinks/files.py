"""JSON and CSV files. Nulls become missing-value marks in the callers, not here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.nested import array_to_json, fill_nearby, join_list, map_to_json
from pagelake.functions.values import MISSING

# Text without quotes, separators or line breaks needs no escaping; everything else
# is quoted and quotes are doubled.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_json(
    df: DataFrame,
    path: str,
    mode: str = "lines",
    order: Sequence[str] | None = None,
    ignore_nulls: bool = False,
    marked: Sequence[Column] = (),
) -> None:
    """Write UTF-8 JSON, also if there is no row.

    ``lines`` writes one object per line. ``array`` needs ``order`` (a total order,
    not written) and writes part files that, read one after the other in name order,
    are one JSON array: a part opens it, sorted parts hold the records, a part closes
    it, and no task holds more than its own part. Sorting reads ``df`` twice, so hand in
    a stored table. ``marked`` are names of keys, null or not, that a record gets with
    the missing-value mark because its column, left out, holds no text.
    """
    if mode == "lines":
        df.write.mode("overwrite").option("ignoreNullFields", ignore_nulls).json(path)
        return
    if mode != "array":
        raise ValueError(f"unknown mode: {mode}")
    if not order:
        raise ValueError("array mode needs an order")
    fields = [c for c in df.columns if c not in order]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": str(ignore_nulls).lower()})
    if marked:
        extra = F.concat_ws("", *[F.concat(F.lit(',"'), m, F.lit(f'":"{MISSING}"')) for m in marked])
        text = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), extra, F.lit("}"))
    # Ranges begin with a key that occurs: the first record is the first of the first part.
    comma = F.when(F.monotonically_increasing_id() > 0, F.lit(",")).otherwise(F.lit(""))
    ranged = df.select(*order, text.alias("text")).repartitionByRange(*order)
    rows = ranged.sortWithinPartitions(*order).select(F.concat(comma, "text").alias("value"))
    edge = lambda t: df.sparkSession.range(1, numPartitions=1).select(F.lit(t).alias("value"))
    edge("[").union(rows).union(edge("]")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """Write a CSV with a header; nothing is written (and False returned) if empty."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return True


def _cell(name: str, kind: T.DataType) -> Column:
    col = F.col(name)
    if isinstance(kind, T.MapType):
        return map_to_json(col, spaced=True)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        fields = {f.name: f.dataType.typeName() for f in kind.elementType.fields}
        if {"location", "price", "cuisine"} <= set(fields):
            col = fill_nearby(col)
        return array_to_json(col, fields)
    if isinstance(kind, T.ArrayType):
        return join_list(col)
    return col


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as text, columns sorted by name.

    Maps and record lists become JSON text, plain lists are joined by ``; ``. On rows
    without an ``error`` a missing nested value becomes the missing-value mark.
    """
    ok = F.col("error").isNull() if "error" in df.columns else F.lit(True)
    cells = {}
    for field in df.schema.fields:
        cell = _cell(field.name, field.dataType)
        if isinstance(field.dataType, (T.MapType, T.ArrayType)):
            cell = F.coalesce(cell, F.when(ok, F.lit(MISSING)))
        cells[field.name] = cell
    return df.select(*[cells[name].alias(name) for name in sorted(cells)])


def write_csv_flat(df: DataFrame, path: str) -> bool:
    """:func:`flatten`, then :func:`write_csv`."""
    return write_csv(flatten(df), path)
