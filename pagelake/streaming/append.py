"""Page-by-page collection as a stream: a store of first cards per key, merged by batch.

Rows lie in buckets by the hash of their key. A batch reads the buckets it touches,
writes them anew with its own rows merged in, and then a commit: for every bucket the
folder that holds its rows. A commit is one file, so readers see a batch whole or not at
all; merging is idempotent, so a batch that runs again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagelake.operators.cards import listing_cards, require
from pagelake.operators.relational import first_wins, stop_at_first_gap
from pagelake.plans.rules import LISTING_CARDS, CardRules
from pagelake.schemas import ORDER
from pagelake.session import exists

BUCKETS = 16
NONE = -1  # the bucket of a commit without rows, which keeps the columns
_COMMIT = "bucket int, folder string, columns string"


def _committed(spark: SparkSession, table: str) -> tuple[int, dict[int, str], StructType | None]:
    """The last commit: its number (-1 without any), folders by bucket, and the columns."""
    if not exists(spark, f"{table}/commits"):
        return -1, {}, None
    commits = spark.read.schema(f"{_COMMIT}, number long").parquet(f"{table}/commits")
    last = commits.agg(F.max("number")).first()[0]
    if last is None:
        return -1, {}, None
    rows = commits.filter(F.col("number") == last).collect()  # at most one per bucket
    folders = {r["bucket"]: r["folder"] for r in rows if r["bucket"] != NONE}
    return last, folders, StructType.fromJson(json.loads(rows[0]["columns"]))


def _read(spark: SparkSession, table: str, folders: dict[int, str], schema: StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    paths = [f"{table}/{folder}/_bucket={bucket}" for bucket, folder in sorted(folders.items())]
    return spark.read.schema(schema).parquet(*paths)


def append_batch(
    table: str, keys: Sequence[str] = ("name",), order: Sequence[str] = ORDER, buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges a batch's first row per key into ``table``.

    Only the buckets that the batch's keys fall into are read and written. ``buckets``
    must not change during a table's life.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"rows/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        firsts = first_wins(batch, keys, order).withColumn("_bucket", bucket)
        firsts.write.partitionBy("_bucket").parquet(f"{table}/{folder}-batch")
        schema = batch.schema
        new = spark.read.schema(firsts.schema).parquet(f"{table}/{folder}-batch")
        touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]
        last, folders, _ = _committed(spark, table)
        if not touched and folders:
            return
        known = {b: folders[b] for b in touched if b in folders}
        if known:
            old = _read(spark, table, known, schema).withColumn("_bucket", bucket)
            merged = first_wins(old.unionByName(new), keys, order)
            merged.write.partitionBy("_bucket").parquet(f"{table}/{folder}")
        else:
            folder += "-batch"
        columns = schema.json()
        now = folders | dict.fromkeys(touched or [NONE], folder)
        rows = [(b, f, columns) for b, f in now.items()]
        commit = spark.createDataFrame(rows, _COMMIT).withColumn("number", F.lit(last + 1))
        commit.coalesce(1).write.mode("append").parquet(f"{table}/commits")

    return add


def collect_listing(
    pages: DataFrame,
    table: str,
    checkpoint: str,
    rules: CardRules = LISTING_CARDS,
    keys: Sequence[str] = ("name",),
) -> StreamingQuery:
    """Turn a stream of result pages into a growing table of first cards.

    Takes what is available and ends; start it again to go on where it stopped. Read the
    listing with :func:`collected`.
    """
    cards = require(listing_cards(pages, rules))
    return (
        cards.writeStream.foreachBatch(append_batch(table, keys))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def collected(
    spark: SparkSession,
    table: str,
    until_stop: bool = False,
    max_pages: int | None = None,
    first_page: int = 1,
) -> DataFrame | None:
    """The listing so far: per key its first row, whichever batch brought it. None before any.

    A larger ``buckets`` in :func:`append_batch` makes a large table's batches cheaper.
    Every key is stored once and read once. With ``until_stop`` the listing ends before
    the first page that adds nothing, as a crawl page by page would.
    """
    _, folders, schema = _committed(spark, table)
    if schema is None:
        return None
    rows = _read(spark, table, folders, schema)
    if not until_stop:
        return rows
    return stop_at_first_gap(rows, ORDER[0], max_pages, first_page)
