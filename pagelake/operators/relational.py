"""Dedup, append, stop, slice, enrich, union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.values import MISSING
from pagelake.schemas import CARRIED_FIELDS, ORDER
from pagelake.session import stage

# A key is hot if it holds more than 1/HOT_SHARE of the rows, so there are fewer
# than HOT_SHARE hot keys whatever the size of the data.
HOT_SHARE = 1024
SALTS = 256

NOT_FOUND = "page not found"


def first_wins(
    df: DataFrame, keys: Sequence[str] = ("name",), order: Sequence[str] = ORDER
) -> DataFrame:
    """Keep the first row per key in the given order.

    Spark turns the rank-1 filter into a partial group limit ahead of the shuffle:
    every task sends at most one row per key, so a hot key costs one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def append_new(
    existing: DataFrame,
    batch: DataFrame,
    keys: Sequence[str] = ("name",),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The batch rows to add: first per key, and only keys not collected yet.

    Both sides are reduced to one row per key and task before they are shuffled on
    the keys, so no key is hot in the join.
    """
    collected = existing.select(*keys).distinct()
    fresh = first_wins(batch, keys, order).join(collected, list(keys), "left_anti")
    return fresh.select(*batch.columns)


def cap_pages(
    df: DataFrame, max_pages: int | None = 20, page_col: str = "page_no", first_page: int = 1
) -> DataFrame:
    """Pages ``first_page`` and following, at most ``max_pages``.

    Apply it to the pages themselves: there the filter reaches the scan.
    """
    capped = df.filter(F.col(page_col) >= first_page)
    if max_pages is None:
        return capped
    return capped.filter(F.col(page_col) <= first_page + max_pages - 1)


def first_gap(df: DataFrame, page_col: str = "page_no", first_page: int = 1) -> DataFrame:
    """One row, ``stop``: the first page from ``first_page`` on without a row in ``df``.

    Every page present rules itself out and proposes its successor; the smallest
    proposal left is the gap. One aggregation over the pages that occur, combined
    before the shuffle.
    """
    page = F.col(page_col).cast("bigint")
    marks = F.inline(
        F.array(
            F.struct(page.alias("page"), F.lit(1).alias("present")),
            F.struct((page + 1).alias("page"), F.lit(0).alias("present")),
        )
    )
    per_page = (
        df.filter(F.col(page_col) >= first_page)
        .select(marks)
        .groupBy("page")
        .agg(F.max("present").alias("present"))
    )
    ends = per_page.agg(
        F.min(F.when(F.col("present") == 0, F.col("page"))).alias("gap"),
        F.bool_or((F.col("page") == first_page) & (F.col("present") == 1)).alias("begun"),
    )
    return ends.select(
        F.when(F.col("begun"), F.col("gap"))
        .otherwise(F.lit(first_page).cast("bigint"))
        .alias("stop")
    )


def stop_at_first_gap(
    df: DataFrame,
    page_col: str = "page_no",
    max_pages: int | None = 20,
    first_page: int = 1,
) -> DataFrame:
    """Keep the pages before the first one without new rows, at most ``max_pages``.

    ``df`` holds new rows only (see :func:`first_wins`). It is read twice, for the
    stop and for the result, so hand in a stored table if it is costly to compute.
    """
    capped = cap_pages(df, max_pages, page_col, first_page)
    # In the column's own type, so that the comparison can reach the scan.
    stop = first_gap(capped, page_col, first_page).select(
        F.col("stop").cast(df.schema[page_col].dataType)
    )
    return capped.filter(F.col(page_col) < stop.scalar())


def valid_url(df: DataFrame, column: str = "url") -> DataFrame:
    """Rows with a link."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != MISSING))


def slice_rows(
    df: DataFrame,
    order: Sequence[str] = ORDER,
    start: int = 0,
    max_rows: int | None = None,
    work: str | None = None,
) -> DataFrame:
    """Rows ``start`` to ``start + max_rows`` in the given order (None or 0: all).

    ``order`` must be a total order. Rows are dealt into sorted ranges and stored (below
    ``work``); the ranges' sizes tell which of them the slice reaches, and only in those
    are rows numbered. No task sees more than one range.
    """
    if start < 0 or (max_rows or 0) < 0:
        raise ValueError("start and max_rows must not be negative")
    if start == 0 and not max_rows:
        return df
    end = F.lit(start + max_rows) if max_rows else F.lit(None).cast("bigint")
    ranged = stage(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "slice", work
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, of which there are as many as shuffle partitions.
    reached = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .filter((F.col("_before") + F.col("_rows") > start) & F.coalesce(F.col("_before") < end, F.lit(True)))
        .drop("_rows")
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return (
        ranged.join(F.broadcast(reached), "_range")
        .withColumn("_place", place)
        .filter((F.col("_place") > start) & F.coalesce(F.col("_place") <= end, F.lit(True)))
        .select(*df.columns)
    )


def hot_keys(df: DataFrame, key: str, min_rows: int = 100_000) -> DataFrame:
    """Hashes (``_hash``) of the keys that hold more than 1/HOT_SHARE of the rows.

    Fewer than HOT_SHARE rows of eight bytes, whatever the data and the key.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n"))
    return (
        counts.filter((F.col("_n") >= min_rows) & (F.col("_n") * HOT_SHARE > total.scalar()))
        .select(F.xxhash64(key).alias("_hash"), F.lit(True).alias("_hot"))
        .distinct()
    )


def left_join_salted(
    left: DataFrame, right: DataFrame, key: str, min_rows: int = 100_000
) -> DataFrame:
    """Left equi-join against a side that is unique by ``key``; hot keys are split.

    Rows with a hot key spread over ``SALTS`` tasks and only the matching rows on the
    right are copied to them; rows without a key spread as well. Both sides tell hot
    keys by the same hash, so two keys with one hash are merely split alike. The salt
    is a hash of the row: a task that runs again sends every row to the same place.
    """
    hot = F.broadcast(hot_keys(left, key, min_rows))
    hashed = F.xxhash64(key)
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_left = (
        left.withColumn("_hash", hashed)
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), spread).otherwise(0))
        .drop("_hash", "_hot")
    )
    salted_right = (
        right.withColumn("_hash", hashed)
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_hash", "_hot")
    )
    return salted_left.join(salted_right, [key, "_salt"], "left").drop("_salt")


def enrich(
    listing: DataFrame,
    details: DataFrame,
    carried: Sequence[str] = CARRIED_FIELDS,
    key: str = "url",
    order: Sequence[str] = ORDER,
    salted: bool = False,
    hot_rows: int = 100_000,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Details for every listing row, with the carried listing columns.

    Listing rows without details stay and get an ``error`` (see :func:`with_error`), that
    of ``errors(key, message)`` if there is one; repeated listing rows stay too.
    ``details`` and ``errors`` must be unique by ``key``. Adaptive execution splits
    skewed keys of the join; ``salted`` splits keys with ``hot_rows`` rows or more up
    front instead, for the price of one more look at the listing.
    """
    kept = [c for c in (*order, *carried) if c in listing.columns]
    left = listing.select(key, *kept)
    right = details.withColumn("_found", F.lit(True))
    if salted:
        joined = left_join_salted(left, right, key, hot_rows)
    else:
        joined = left.join(right, key, "left")
    fields = [c for c in details.columns if c != key and c not in kept]
    message = F.lit(NOT_FOUND)
    if errors is not None:
        joined = joined.join(errors, key, "left")
        message = F.coalesce("message", message)
    return with_error(joined, F.col("_found"), message).select(
        *[c for c in order if c in kept],
        key,
        *fields,
        *[c for c in carried if c in kept],
        "error",
    )


def with_error(df: DataFrame, found: Column, message: Column | str = NOT_FOUND) -> DataFrame:
    """Set ``error`` on rows whose page failed; the row itself stays."""
    return df.withColumn("error", F.when(found.isNull(), F.lit(message)))


def union_records(*dfs: DataFrame) -> DataFrame:
    """All rows of differing tables; the columns are the union, sorted by name."""
    result = dfs[0]
    for df in dfs[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result.select(*sorted(result.columns))
