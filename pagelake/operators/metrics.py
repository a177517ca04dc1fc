"""Counts over listings and details."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.values import BIB_LABEL, MISSING
from pagelake.operators.cards import require
from pagelake.operators.relational import first_gap, first_wins
from pagelake.schemas import ORDER

DETAIL_CHECKS = ("phone", "address", "description", "website")
SHORT_CHECKS = ("phone", "address", "description")
STARS = (3, 2, 1)


def summary_counts() -> list[Column]:
    """The aggregates of :func:`listing_summary`."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("stars") > 0).alias("starred"),
        F.count_if(F.col("distinction") == BIB_LABEL).alias("bib"),
    ]


def listing_summary(listing: DataFrame) -> DataFrame:
    """One row: total, starred and Bib rows."""
    return listing.agg(*summary_counts())


def star_counts() -> list[Column]:
    """Rows per star count as aggregates, to be taken while a listing is written."""
    return [F.count_if(F.col("stars") == n).alias(f"stars_{n}") for n in STARS]


def breakdown_of(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """:func:`star_breakdown` from the values of :func:`star_counts`."""
    rows = [(n, counts[f"stars_{n}"]) for n in STARS if counts[f"stars_{n}"]]
    return spark.createDataFrame(rows, "stars int, n long")


def star_breakdown(listing: DataFrame) -> DataFrame:
    """Rows per star count 3, 2, 1; counts of zero have no row."""
    return (
        listing.filter(F.col("stars").isin(*STARS))
        .groupBy("stars")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("stars"))
    )


def top_locations(
    listing: DataFrame,
    k: int = 10,
    column: str = "location",
    page_col: str = "page_no",
    pos_col: str = "pos",
) -> DataFrame:
    """The ``k`` most frequent values; ties go to the one that appears first.

    Page and position are packed into one number, which keeps the aggregation a hash
    aggregation with a map-side part. A missing value is a group of its own.
    """
    wide = F.lit(Decimal(1 << 63))
    place = (F.col(page_col).cast("decimal(19,0)") * wide + F.col(pos_col)).cast("decimal(38,0)")
    return (
        listing.groupBy(column)
        .agg(F.count("*").alias("n"), F.min(place).alias("_first"))
        .orderBy(F.desc("n"), "_first")
        .limit(k)
        .drop("_first")
    )


def completeness_counts(
    fields: Sequence[str] = DETAIL_CHECKS, reference_compat: bool = False
) -> list[Column]:
    """The aggregates of :func:`completeness`: ``total``, and present rows by field."""
    checks = []
    for name in fields:
        value = F.col(name)
        present = value.isNotNull() & (value != MISSING)
        if reference_compat:
            present = F.coalesce(value != MISSING, F.col("error").isNotNull())
        checks.append(F.count_if(present).alias(name))
    return [F.count(F.lit(1)).alias("total"), *checks]


def completeness_of(counts: DataFrame, fields: Sequence[str] = DETAIL_CHECKS) -> DataFrame:
    """:func:`completeness` from one row of :func:`completeness_counts`."""
    rows = F.inline(
        F.array(
            *[F.struct(F.lit(n).alias("field"), F.col(n).alias("present")) for n in fields]
        )
    )
    percent = F.try_divide(F.col("present") * 100.0, F.col("total"))
    return (
        counts.select("total", rows)
        .withColumn("percent", percent)
        .withColumn("percent_1dp", F.round("percent", 1))
        .select("field", "present", "total", "percent", "percent_1dp")
    )


def completeness(
    details: DataFrame,
    fields: Sequence[str] = DETAIL_CHECKS,
    reference_compat: bool = False,
) -> DataFrame:
    """Per field: present and total rows and the percentage, exact and to one digit.

    A null counts as missing. With ``reference_compat`` a field that an error row
    does not have counts as present, which is how the plain count of values other
    than the missing mark behaves. An empty text is present either way.
    """
    return completeness_of(details.agg(*completeness_counts(fields, reference_compat)), fields)


def page_tallies(
    cards: DataFrame,
    keys: Sequence[str] = ("name",),
    order: Sequence[str] = ORDER,
    first_page: int = 1,
    until_stop: bool = True,
) -> DataFrame:
    """Per page: cards found, new, duplicate and nameless.

    ``cards`` holds all cards, nameless ones included; a page without cards is a row
    with a null position. It is read more than once, so hand in a stored table if it
    is costly. With ``until_stop`` the pages after the stop page are left out. Cards
    are counted per page and first rows per key, never all rows of a key in one task.
    """
    page, pos = order
    name = F.col(keys[0])
    found = cards.groupBy(page).agg(
        F.count(pos).alias("found"),
        F.count_if(F.col(pos).isNotNull() & (name.isNull() | (name == ""))).alias("nameless"),
    )
    new_rows = first_wins(require(cards, keys[0]), keys, order).select(page)
    new = new_rows.groupBy(page).agg(F.count("*").alias("new"))
    tallies = found.join(new, page, "left").select(
        page,
        "found",
        F.coalesce("new", F.lit(0)).alias("new"),
        (F.col("found") - F.col("nameless") - F.coalesce("new", F.lit(0))).alias("duplicate"),
        "nameless",
    )
    if until_stop:
        tallies = tallies.filter(F.col(page) <= first_gap(new_rows, page, first_page).scalar())
    return tallies
