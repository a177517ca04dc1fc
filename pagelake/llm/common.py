"""Small helpers the operators share: stored tables, row numbers, tables by name."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelake.session import stage


# Whole texts are wide rows: ten thousand of them, the default, can be gigabytes.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    A cluster whose machines do not have that folder gets the package with --py-files.
    Batches sent to the workers are kept small, unless the session's owner chose a size.
    """
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, "500")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    with_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: a lost executor never repeats the work before this point, and
    joins above read it through a plain exchange, which adaptive execution can split.
    """
    return stage(df, f"llm-{name}")


def numbered(df: DataFrame, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """``df`` with a gapless ``row_no`` from 0 in the order of ``order``, nulls first.

    With ``total``, ``<total>_before`` is the sum of that column over all rows before.

    Rows are dealt into sorted ranges, stored, and numbered by their place in the range
    plus the sizes of the ranges before it. Rows equal in ``order`` are dealt on by a
    running number, so one value may hold any share of the rows.
    """
    keys = [*order, "_tie"]
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    kept = stored(ranged, name).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_rows": F.count(F.lit(1))} | ({"_total": F.sum(total)} if total else {})
    # One row per range: their number is that of the shuffle's partitions.
    starts = kept.groupBy("_part").agg(*[c.alias(n) for n, c in sums.items()])
    starts = starts.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
    out = kept.join(F.broadcast(starts), "_part").withColumn(
        "row_no", F.col("_rows") + F.col("_at").bitwiseAND((1 << 33) - 1)
    )
    if total:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        own = F.coalesce(F.sum(total).over(inside), F.lit(0))
        out = out.withColumn(f"{total}_before", F.col("_total") + own)
    return out.drop("_part", "_at", *sums)
