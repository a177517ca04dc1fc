"""The two stages one after the other, handing over through a stored table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.values import fill_sentinels
from pagelake.operators.metrics import (
    DETAIL_CHECKS,
    breakdown_of,
    completeness_counts,
    completeness_of,
    star_counts,
    summary_counts,
    top_locations,
)
from pagelake.plans.details import build_details
from pagelake.plans.listing import build_listing
from pagelake.plans.publish import Publication, identity, published, recover
from pagelake.plans.rules import DETAILS, LISTING_CARDS, CardRules, DetailRules
from pagelake.schemas import CARRIED_FIELDS, DETAIL_FIELDS, LISTING, LISTING_FIELDS, ORDER
from pagelake.session import discard, exists
from pagelake.sinks.files import write_csv, write_csv_flat, write_json
from pagelake.sources.listing_csv import read_listing_csv

STAGES = ("global", "details", "both")


@dataclass
class Outcome:
    """What a run did: success, and the tables and reports of the stages that ran."""

    ok: bool
    message: str = ""
    listing: DataFrame | None = None
    summary: DataFrame | None = None
    stars: DataFrame | None = None
    locations: DataFrame | None = None
    details: DataFrame | None = None
    report: DataFrame | None = None


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def save_listing(listing: DataFrame, out: str) -> None:
    """Listing files: JSON array parts and CSV, with the missing-value marks."""
    _listing_json(listing, f"{out}/listing_json")
    _listing_csv(listing, f"{out}/listing_csv")


def _listing_json(listing: DataFrame, path: str) -> None:
    write_json(fill_sentinels(listing).select(*ORDER, *LISTING_FIELDS), path, "array", ORDER)


def _listing_csv(listing: DataFrame, path: str) -> None:
    write_csv(fill_sentinels(listing).orderBy(*ORDER).select(*LISTING_FIELDS), path)


def save_details(details: DataFrame, out: str) -> None:
    """Detail files: JSON array parts and flat CSV.

    A failed page has only its link, the carried columns and the error; the other
    records have no ``error``. Missing opening hours and nearby venues, whose columns
    hold no text, are the missing-value mark in both files. Columns that no record has
    are left out of the CSV.
    """
    _details_json(details, f"{out}/details_json")
    _details_csv(details, f"{out}/details_csv", details.agg(*_outcomes()).first().asDict())


def _outcomes() -> list[Column]:
    ok = F.col("error").isNull()
    return [F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed")]


def _marked_details(details: DataFrame) -> DataFrame:
    marked = fill_sentinels(details, CARRIED_FIELDS)
    return fill_sentinels(marked, DETAIL_FIELDS, only_if=F.col("error").isNull())


def _details_json(details: DataFrame, path: str) -> None:
    ok = F.col("error").isNull()
    nested = [F.when(ok & F.col(n).isNull(), F.lit(n)) for n in ("opening_hours", "nearby_restaurants")]
    write_json(_marked_details(details), path, "array", ORDER, ignore_nulls=True, marked=nested)


def _details_csv(details: DataFrame, path: str, seen: dict[str, int]) -> None:
    absent = ([] if seen["failed"] else ["error"]) + ([] if seen["ok"] else list(DETAIL_FIELDS))
    write_csv_flat(_marked_details(details).orderBy(*ORDER).drop(*ORDER, *absent), path)


def _write_counted(df: DataFrame, path: str, counts: Sequence[Column]) -> dict[str, int]:
    """Write ``df`` and return the aggregates ``counts``, taken on the way by the same tasks."""
    seen = Observation()
    df.observe(seen, *counts).write.parquet(path)
    return dict(seen.get)


def _listing_stage(
    spark: SparkSession,
    pages: DataFrame,
    out: str,
    max_pages: int | None,
    rules: CardRules,
    first_page: int,
    work: str,
    inputs: str | None,
) -> Outcome:
    facts = published(spark, out, "global", inputs)
    if facts is None:
        results = Publication(spark, out, "global", inputs)
        results.part("listing", lambda path: _write_counted(
            build_listing(pages, max_pages, rules, first_page=first_page, work=work),
            path, [*summary_counts(), *star_counts()]))
        if not results.facts["total"]:
            results.abandon()
            return Outcome(False, "no listing rows found")
        aside = spark.read.parquet(results.path("listing"))
        results.part("listing_json", lambda path: _listing_json(aside, path))
        results.part("listing_csv", lambda path: _listing_csv(aside, path))
        results.commit(["listing", "listing_json", "listing_csv"], outdated=["listing_order"])
        facts = results.facts
    listing = spark.read.parquet(f"{out}/listing")
    names = ("total", "starred", "bib")
    return Outcome(
        True,
        listing=listing,
        summary=spark.createDataFrame([tuple(facts[n] for n in names)], "total long, starred long, bib long"),
        stars=breakdown_of(spark, facts),
        locations=top_locations(listing),
    )


def _detail_stage(
    spark: SparkSession,
    pages: DataFrame,
    out: str,
    listing_csv: str | None,
    start: int,
    max_rows: int | None,
    rules: DetailRules,
    capture_order: Sequence[str],
    work: str,
    resume: bool,
    version: str | None,
) -> Outcome:
    if listing_csv is None:
        listing = _stored(spark, f"{out}/listing")
    else:
        listing = read_listing_csv(spark, listing_csv, LISTING, file_order=True)
    if listing is None:
        return Outcome(False, "no stored listing: run the listing stage first")
    settings = ("details", start, max_rows, rules, tuple(capture_order))
    inputs = identity(spark, [pages, listing], settings, version) if resume else None
    facts = published(spark, out, "details", inputs)
    if facts is None:
        # A stored listing is kept in order for later slices; a CSV file may change.
        index = f"{out}/listing_order" if listing_csv is None else None
        results = Publication(spark, out, "details", inputs)
        results.part("details", lambda path: _write_counted(
            build_details(
                listing, pages, start, max_rows, rules, capture_order=capture_order, work=work, index=index
            ),
            path, [*completeness_counts(), *_outcomes()]))
        facts = results.facts
        if not facts["total"]:
            results.abandon()
            return Outcome(False, "no details collected")
        aside = spark.read.parquet(results.path("details"))
        results.part("details_json", lambda path: _details_json(aside, path))
        results.part("details_csv", lambda path: _details_csv(aside, path, facts))
        results.commit(["details", "details_json", "details_csv"])
    names = ["total", *DETAIL_CHECKS]
    counts = spark.createDataFrame([tuple(facts[n] for n in names)], ", ".join(f"{n} long" for n in names))
    details = spark.read.parquet(f"{out}/details")
    return Outcome(True, listing=listing, details=details, report=completeness_of(counts))


def run(
    spark: SparkSession,
    out: str,
    result_pages: DataFrame | None = None,
    detail_pages: DataFrame | None = None,
    stage: str = "both",
    max_pages: int | None = 20,
    start: int = 0,
    max_rows: int | None = None,
    listing_csv: str | None = None,
    card_rules: CardRules = LISTING_CARDS,
    detail_rules: DetailRules = DETAILS,
    first_page: int = 1,
    capture_order: Sequence[str] = (),
    resume: bool = False,
    version: str | None = None,
) -> Outcome:
    """Run the listing stage, the detail stage, or both; files go below ``out``.

    A stage without rows fails, and a failed listing stage ends the run. The detail
    stage reads the stored listing, or ``listing_csv``, whose rows count in the order of
    the file if it has no order columns. The first slice of a stored listing leaves it in
    order below ``out``, where later slices read only what they reach. Intermediate tables lie below ``out`` and are
    removed in the end.

    A stage's results appear together when all are complete (see :class:`Publication`);
    a stage that fails, or finds nothing, leaves the earlier ones as they are. Reports are counted
    while the tables are written. With ``resume`` a stage whose inputs and settings are
    those of its published results is not run again, and one that died goes on with the
    tables it had finished; ``version`` names inputs that file names do not tell apart
    (see :func:`identity`). One run at a time may write below ``out``.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    work = f"{out}/_work"
    for name in ("global", "details"):
        recover(spark, out, name)
    try:
        return _run_stages(
            spark, out, result_pages, detail_pages, stage, max_pages, start, max_rows,
            listing_csv, card_rules, detail_rules, first_page, capture_order, work, resume, version,
        )
    finally:
        discard(spark, work)


def _run_stages(
    spark, out, result_pages, detail_pages, stage, max_pages, start, max_rows,
    listing_csv, card_rules, detail_rules, first_page, capture_order, work, resume, version,
) -> Outcome:
    outcome = Outcome(False)
    if stage in ("global", "both"):
        settings = ("global", max_pages, card_rules, first_page)
        inputs = identity(spark, [result_pages], settings, version) if resume else None
        outcome = _listing_stage(
            spark, result_pages, out, max_pages, card_rules, first_page, work, inputs
        )
        if not outcome.ok:
            return outcome
    if stage in ("details", "both"):
        second = _detail_stage(
            spark, detail_pages, out, listing_csv, start, max_rows, detail_rules,
            capture_order, work, resume, version,
        )
        second.summary, second.stars = outcome.summary, outcome.stars
        second.locations = outcome.locations
        second.listing = second.listing if second.listing is not None else outcome.listing
        outcome = second
    return outcome
