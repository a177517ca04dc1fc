"""Runs that die, go on, or change nothing; reports counted while tables are written."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_plans import LISTING_ROWS, detail_pages, listing_pages

from pagelake.operators import metrics
from pagelake.plans import publish
from pagelake.plans import run as plan
from pagelake.plans.run import run
from pagelake.session import read_text, work_path, write_text


@pytest.fixture
def pages(spark):
    """Result and detail pages that come from files."""
    near = detail_pages(spark).withColumn(
        "url", F.when(F.col("url").endswith("a"), LISTING_ROWS[0][3]).otherwise(LISTING_ROWS[1][3])
    )
    frames = []
    for df in (listing_pages(spark), near):
        path = work_path(spark, "test")
        df.write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


@pytest.fixture
def made(monkeypatch):
    """The costly steps that ran."""
    calls = []
    for name in ("build_listing", "build_details", "_listing_json", "_details_json"):
        whole = getattr(plan, name)

        def step(*args, _whole=whole, _name=name, **kwargs):
            calls.append(_name)
            return _whole(*args, **kwargs)

        monkeypatch.setattr(plan, name, step)
    return calls


def rows(df):
    return [tuple(r) for r in df.collect()]


def dies(*args, **kwargs):
    raise RuntimeError("lost")


def test_reports_are_those_of_the_stored_tables(spark, pages):
    done = run(spark, work_path(spark, "test"), *pages)
    assert rows(done.summary) == rows(metrics.listing_summary(done.listing))
    assert done.summary.schema.simpleString() == metrics.listing_summary(done.listing).schema.simpleString()
    assert rows(done.stars) == rows(metrics.star_breakdown(done.listing))
    want = metrics.completeness(done.details)
    assert rows(done.report) == rows(want) and done.report.schema.simpleString() == want.schema.simpleString()
    for report in (done.summary, done.stars, done.report):
        assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString()
    assert done.locations._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_goes_on_after_the_listing(spark, pages, made, monkeypatch):
    out = work_path(spark, "test")
    with monkeypatch.context() as broken:
        broken.setattr(plan, "_details_csv", dies)
        with pytest.raises(RuntimeError):
            run(spark, out, *pages, resume=True)
    assert made == ["build_listing", "_listing_json", "build_details", "_details_json"]
    assert os.path.exists(f"{out}/listing_csv") and not os.path.exists(f"{out}/details")
    made.clear()
    done = run(spark, out, *pages, resume=True)
    assert made == []  # neither result pages nor detail pages are parsed again
    plain = run(spark, work_path(spark, "test"), *pages)
    for name in ("listing", "summary", "stars", "locations", "details", "report"):
        assert rows(getattr(done, name)) == rows(getattr(plain, name)), name
    assert not os.path.exists(f"{out}/_pending") and not os.path.exists(f"{out}/_work")


def test_goes_on_within_a_stage(spark, pages, made, monkeypatch):
    out = work_path(spark, "test")
    with monkeypatch.context() as broken:
        broken.setattr(plan, "_listing_csv", dies)
        with pytest.raises(RuntimeError):
            run(spark, out, *pages, stage="global", resume=True)
    assert not os.path.exists(f"{out}/listing")
    made.clear()
    assert run(spark, out, *pages, stage="global", resume=True).listing.count() == 4
    assert made == []


def test_other_inputs_or_settings_run_again(spark, pages, made):
    out = work_path(spark, "test")
    run(spark, out, *pages, resume=True)
    made.clear()
    assert run(spark, out, *pages, resume=True).ok and made == []
    run(spark, out, *pages, resume=True, max_rows=1)
    assert made == ["build_details", "_details_json"]
    made.clear()
    some = pages[0].filter("page_no < 2")
    assert run(spark, out, some, pages[1], resume=True, max_rows=1).ok
    assert made == ["build_listing", "_listing_json", "build_details", "_details_json"]
    made.clear()
    assert run(spark, out, some, pages[1], resume=True, max_rows=1, version="new").ok
    assert made[0] == "build_listing"
    made.clear()
    assert run(spark, out, some, pages[1]).ok and made[0] == "build_listing"
    assert not os.path.exists(f"{out}/_manifest")


def test_moving_into_place_goes_on(spark, pages, monkeypatch):
    """A run that dies while its results are moved: the next run of any kind finishes it."""
    out = work_path(spark, "test")
    run(spark, out, *pages)
    whole, moved = publish.rename, []

    def rename(spark, path, to):
        if moved:
            raise RuntimeError("lost")
        moved.append(to)
        whole(spark, path, to)

    with monkeypatch.context() as broken:
        broken.setattr(publish, "rename", rename)
        with pytest.raises(RuntimeError):
            run(spark, out, *pages, stage="global", max_pages=1, resume=True)
    assert moved == [f"{out}/listing"] and not os.path.exists(f"{out}/listing_json")
    done = run(spark, out, detail_pages=pages[1], stage="details")
    assert done.ok and done.listing.agg(F.max("page_no")).first()[0] == 1
    assert os.path.exists(f"{out}/listing_json") and os.path.exists(f"{out}/listing_csv")
    assert not os.path.exists(f"{out}/_pending")


def test_nothing_found_leaves_results(spark, pages):
    out = work_path(spark, "test")
    run(spark, out, *pages)
    before = sorted(os.listdir(out))
    empty = [df.limit(0) for df in pages]
    assert not run(spark, out, *empty).ok
    assert sorted(os.listdir(out)) == before
    assert spark.read.parquet(f"{out}/listing").count() == 4


def test_inputs_without_files_need_a_version(spark):
    frame = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        publish.identity(spark, [frame], ())
    assert publish.identity(spark, [frame], (), "1") != publish.identity(spark, [frame], (), "2")


def test_text_files(spark):
    path = work_path(spark, "test")
    assert read_text(spark, path) is None
    for text in ("", json.dumps({"a": "é"})):
        write_text(spark, path, text)
        assert read_text(spark, path) == text
