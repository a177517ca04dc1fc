"""Tables stored by the hash of their link, and joins of them that shuffle nothing."""

import uuid

from pagelake.operators.bucketed import APART, enrich_bucketed, write_bucketed
from pagelake.operators.relational import enrich
from pagelake.session import work_path


def saved(spark, df, **kwargs):
    name = f"t_{uuid.uuid4().hex}"
    write_bucketed(df, name, work_path(spark, "test"), buckets=4, **kwargs)
    return name


def tables(spark, urls):
    listing = spark.createDataFrame(
        [(1, n, f"v{n}", u) for n, u in enumerate(urls)], "page_no int, pos int, name string, url string")
    details = spark.createDataFrame([(f"u{n}", f"p{n}") for n in range(0, 60, 2)], "url string, phone string")
    return listing, details


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange(spark):
    listing, details = tables(spark, [f"u{n % 50}" for n in range(200)])
    got = enrich_bucketed(spark, saved(spark, listing), saved(spark, details))
    assert rows(got) == rows(enrich(listing, details))
    plan = plan_of(got)
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_hot_links_and_rows_without_one(spark):
    listing, details = tables(spark, ["u4"] * 150 + [None] * 50 + [f"u{n}" for n in range(50)])
    name = saved(spark, listing, hot_rows=100)
    assert spark.table(name + APART).count() == 151 + 50
    assert spark.table(name).count() == 49
    got = enrich_bucketed(spark, name, saved(spark, details))
    assert rows(got) == rows(enrich(listing, details))


def test_empty(spark):
    listing, details = tables(spark, ["u1", "u2"])
    none = listing.limit(0)
    assert enrich_bucketed(spark, saved(spark, none), saved(spark, details)).count() == 0
    got = enrich_bucketed(spark, saved(spark, listing), saved(spark, details.limit(0)))
    assert [r["error"] for r in got.collect()] == ["page not found"] * 2
