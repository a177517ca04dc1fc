"""Listing and details stored by the hash of their link, so that joining them shuffles nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.relational import enrich, hot_keys
from pagelake.schemas import CARRIED_FIELDS, ORDER

APART = "_apart"  # added to a table's name: its rows without a key or with a hot one


def write_bucketed(
    df: DataFrame, name: str, path: str, key: str = "url", buckets: int = 200, hot_rows: int = 100_000
) -> None:
    """Store ``df`` as the tables ``name`` and ``name`` + :data:`APART`, with files below ``path``.

    The first is in ``buckets`` files by the hash of ``key``, each sorted by it; take
    enough for buckets of about 128 MB, and the same number for tables to be joined. Keys
    with ``hot_rows`` rows or more, if they hold more than 1 row in 1024, and rows without
    a key go to the second, spread as they come, so no bucket grows with a single key.
    """
    hot = df.join(F.broadcast(hot_keys(df, key, hot_rows)), F.xxhash64(key) == F.col("_hash"), "left")
    spread = F.col(key).isNull() | F.coalesce("_hot", F.lit(False))
    rest = hot.filter(~spread).select(*df.columns)
    (
        rest.repartition(buckets, key)
        .write.bucketBy(buckets, key).sortBy(key)
        .mode("overwrite").option("path", f"{path}/buckets").saveAsTable(name)
    )
    hot.filter(spread).select(*df.columns).write.mode("overwrite").option(
        "path", f"{path}/apart").saveAsTable(name + APART)


def enrich_bucketed(
    spark: SparkSession,
    listing: str,
    details: str,
    carried: Sequence[str] = CARRIED_FIELDS,
    key: str = "url",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """:func:`enrich` for two tables of :func:`write_bucketed` with as many buckets.

    ``details`` must be unique by ``key``. Buckets meet where they are read: neither
    table is shuffled, however often they are joined. Listing rows kept apart, if there are
    any, are joined by salt with the details of their keys, of which there are fewer than
    1024.
    """
    whole = spark.table(details)
    joined = enrich(spark.table(listing), whole.hint("merge"), carried, key, order)
    apart = spark.table(listing + APART)
    if apart.isEmpty():
        return joined
    hashes = apart.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_hash")).distinct()
    few = whole.join(F.broadcast(hashes), F.xxhash64(key) == F.col("_hash"), "left_semi")
    return joined.union(enrich(apart, few, carried, key, order, salted=True))
