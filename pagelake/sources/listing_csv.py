"""Listing CSV as a source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.schemas import CARD, ORDER

NA_TOKENS = ("", "N/A")

# The texts pandas reads as missing by default.
PANDAS_NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def read_listing_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CARD,
    na_tokens: Iterable[str] = NA_TOKENS,
    multi_line: bool = True,
    file_order: bool = False,
    rejected: bool = False,
) -> DataFrame | None:
    """A CSV with a header; ``na_tokens`` become null. None if it cannot be read.

    A cell that is no value of its column's type, or too large for it, is null as well;
    with ``rejected`` the rows have a column ``_rejected``, the names of the columns with
    such cells (empty for a good row).

    Columns are matched by header name. Those named in ``schema`` get its type, the
    rest stay text. ``multi_line`` allows line breaks inside cells but keeps each
    file in one task: set it to False for a single huge file without such cells.
    ``file_order`` adds the order columns, should the file lack them: ``page_no`` counts
    the file's splits in the order of their names, ``pos`` rises within a split.
    """
    try:
        raw = (
            spark.read.option("header", True)
            .option("escape", '"')
            .option("multiLine", multi_line)
            .option("encoding", "UTF-8")
            .csv(path)
        )
    except AnalysisException:
        return None
    tokens = list(na_tokens)
    types = {f.name: f.dataType for f in schema.fields}
    columns, bad = [], []
    for name in raw.columns:
        cell = F.col(f"`{name}`")
        cell = F.when(~cell.isin(tokens), cell)
        kind = types.get(name, T.StringType())
        if isinstance(kind, T.IntegerType):
            # "2.0" is how a column with gaps may be written
            value = cell.try_cast("double").try_cast(kind)
        else:
            value = cell.try_cast(kind)
        columns.append(value.alias(name))
        bad.append(F.when(cell.isNotNull() & value.isNull(), F.lit(name)))
    if rejected:
        columns.append(F.array_compact(F.array(*bad)).alias("_rejected"))
    if not file_order or set(ORDER) <= set(raw.columns):
        return raw.select(*columns)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = raw.select(*columns, *place, F.monotonically_increasing_id().alias(ORDER[1]))
    splits = raw.select(*place).distinct()  # few: one row per split
    rank = F.row_number().over(Window.orderBy("_file", "_start")).cast("bigint")
    splits = splits.withColumn(ORDER[0], rank)
    kept = [*raw.columns, "_rejected"] if rejected else raw.columns
    return rows.join(splits, ["_file", "_start"]).select(*ORDER, *kept)
