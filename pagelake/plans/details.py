"""Listing rows and captured detail pages to detail records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.bloom import may_hold
from pagelake.operators.cards import extract_details
from pagelake.operators.ordered import is_ordered, ordered_slice, write_ordered
from pagelake.operators.relational import enrich, first_wins, slice_rows, valid_url
from pagelake.plans.rules import DETAILS, DetailRules
from pagelake.schemas import DETAIL, ORDER


def wanted_pages(
    pages: DataFrame, links: DataFrame, capture_order: Sequence[str] = (), work: str | None = None
) -> DataFrame:
    """The pages worth parsing: those of ``links(url)``, and of each its first capture.

    They are chosen by a Bloom filter (see :func:`may_hold`), so what is sent to the
    executors is bounded whatever the size of the listing; the few pages that pass by
    chance are dropped by the join with the listing. Pages themselves are not shuffled.
    """
    kept = ["url", *capture_order]
    chosen = links.select("url").distinct()
    if capture_order:
        first = F.min(F.struct(*capture_order)).alias("first")
        captures = pages.filter(F.col("html").isNotNull()).select(*kept).groupBy("url").agg(first)
        chosen = chosen.join(captures, "url").select("url", "first.*")
    return may_hold(pages, chosen, kept, work)


def build_details(
    listing: DataFrame,
    pages: DataFrame,
    start: int = 0,
    max_rows: int | None = None,
    rules: DetailRules = DETAILS,
    order: Sequence[str] = ORDER,
    capture_order: Sequence[str] = (),
    work: str | None = None,
    index: str | None = None,
) -> DataFrame:
    """Detail records for a slice of the listing, in the form of the detail schema.

    Rows keep the order columns of the listing. A listing without a ``url`` column
    gives no rows. If a URL was captured more than once, the first capture by
    ``capture_order`` counts, and of equal ones that whose page has the smallest hash.
    A listing row without a captured page gets an error: the ``error`` of its failed
    capture (one without ``html``), if ``pages`` has that column, else a fixed one.

    With ``index``, a path, the listing is stored there in order by the first slice, and
    later slices of the same listing read only the files they reach.

    Only pages the slice asks for are parsed (see :func:`wanted_pages`), where they are
    read; records, not pages, are shuffled to the listing.
    """
    spark = pages.sparkSession
    if "url" not in listing.columns:
        return spark.createDataFrame([], DETAIL)
    if index is None or not (start or max_rows):
        wanted = slice_rows(valid_url(listing), order, start, max_rows, work)
    else:
        if not is_ordered(spark, index):
            write_ordered(valid_url(listing), index, order)
        wanted = ordered_slice(spark, index, start, max_rows)
    asked = wanted_pages(pages, wanted, capture_order, work)
    captured = asked.withColumn("_capture", F.xxhash64("html"))
    by = [*capture_order, "_capture"]
    details = first_wins(extract_details(captured, rules, keep=tuple(by)), ["url"], by).drop(*by)
    errors = None
    if "error" in pages.columns:
        failed = pages.filter(F.col("html").isNull() & F.col("error").isNotNull())
        errors = failed.groupBy("url").agg(F.min("error").alias("message"))
    return enrich(wanted, details, order=order, errors=errors)
