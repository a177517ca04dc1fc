"""Tables stored in order, with an index of their ranges, so that slices need no sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import discard, exists

_IN_RANGE = (1 << 33) - 1  # Spark numbers a partition's rows in the lower 33 bits


def write_ordered(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Store ``df`` in sorted ranges below ``path``, and an index of them.

    ``order`` must be a total order. The index has one row per range: its number, its
    rows, the rows before it, and its first and last key. It is written last, so a table
    with an index is complete; what a run that failed left behind is replaced.
    """
    spark = df.sparkSession
    discard(spark, path)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns(
        {"_at": F.monotonically_increasing_id().bitwiseAND(_IN_RANGE), "_range": F.spark_partition_id()}
    )
    ranged.write.partitionBy("_range").parquet(f"{path}/rows")
    # A table without rows has no files that would tell its columns.
    spark.createDataFrame([], ranged.schema).coalesce(1).write.parquet(f"{path}/columns")
    key = F.struct(*order)
    ranges = _rows(spark, path).groupBy("_range").agg(
        F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last")
    )
    # One row per range, of which there are as many as shuffle partitions.
    found = ranges.orderBy("_range").collect()
    rows, before = [], 0
    for one in found:
        rows.append((one["_range"], one["rows"], before, one["first"], one["last"]))
        before += one["rows"]
    kind = ranges.schema["first"].dataType.simpleString()
    schema = f"range int, rows long, before long, first {kind}, last {kind}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(schema).parquet(f"{path}/rows")


def is_ordered(spark: SparkSession, path: str) -> bool:
    """Whether a complete table lies at ``path``."""
    return exists(spark, f"{path}/index/_SUCCESS")


def ordered_slice(spark: SparkSession, path: str, start: int = 0, max_rows: int | None = None) -> DataFrame:
    """Rows ``start`` to ``start + max_rows`` (None or 0: all) of a table written by :func:`write_ordered`.

    The index tells which ranges the slice reaches; only their files are read, and rows
    are told by their stored numbers: no sort and no shuffle.
    """
    if start < 0 or (max_rows or 0) < 0:
        raise ValueError("start and max_rows must not be negative")
    end = start + max_rows if max_rows else None
    index = spark.read.parquet(f"{path}/index").collect()
    reached = [r for r in index if r["before"] + r["rows"] > start and (end is None or r["before"] < end)]
    table = _rows(spark, path)
    plain = [c for c in table.columns if c not in ("_at", "_range")]
    if not reached:
        return table.filter(F.lit(False)).select(*plain)
    first, last = reached[0], reached[-1]
    kept = table.filter(F.col("_range").between(first["range"], last["range"])).filter(
        (F.col("_range") > first["range"]) | (F.col("_at") >= start - first["before"])
    )
    if end is not None:
        kept = kept.filter((F.col("_range") < last["range"]) | (F.col("_at") < end - last["before"]))
    return kept.select(*plain)
