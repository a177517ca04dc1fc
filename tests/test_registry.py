"""Registered queries against DuckDB, and the shape of their plans."""

import re

import pytest
from compare import compare, connect

import __spark_entry__ as entry
import fixture_oracles
import fixture_queries
from pagelake.session import work_path
from pagelake.streaming.append import collect_listing, collected

QUERIES = fixture_queries.QUERIES
SQL = fixture_oracles.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def built(spark, sf):
    """Each query's DataFrame, built once for all tests of its plan."""
    made = {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name](spark, sf)
        return made[name]

    return get


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    equal, note, _ = compare(spark, con, sf, QUERIES[name], SQL[name])
    assert equal, note


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES)))
def test_plan(built, name):
    """No Python worker, no cross join, no sort or window of everything in one task."""
    plan = plan_of(built(name))
    assert not re.search(r"Python|InPandas|CartesianProduct|BroadcastNestedLoop", plan)
    for window in re.findall(r"Window \[.*", plan):
        assert re.search(r"\], \[[a-z_]+#", window), window


def test_pushdown(built):
    plan = plan_of(built("single_page"))
    assert "EqualTo(page_id,3)" in plan
    plan = plan_of(built("stop_at_gap_capped"))
    assert "LessThanOrEqual(page_id,4)" in plan and "html" not in plan


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_pages_are_not_shuffled(built, name):
    """No exchange at any depth carries a page, whatever becomes of it later."""
    blocks = formatted(built(name)).split("\n\n")
    for block in blocks:
        if re.match(r"\(\d+\) (Exchange|BroadcastExchange)", block):
            assert not re.search(r"\b_?html#", block), block


def test_only_wanted_pages_are_parsed(built):
    """A Bloom filter of bounded size is tested below the extraction, for any slice."""
    for name in ("build_details", "build_details_slice"):
        plan = plan_of(built(name))
        tested = re.search(r"Filter .*getbit\(.*Subquery", plan)
        extraction = plan.index("AS opening_hours#")
        assert tested and extraction < tested.start()


def test_joins_read_each_table_once(built):
    plan = plan_of(built("enrich_left"))
    assert plan.count("Scan parquet") == 2


def test_stream_goes_on_where_it_stopped(spark, sf):
    import fixture_queries as fq

    pages = fq._numbered(spark, sf)
    source, table, progress = (work_path(spark, n) for n in ("src", "tab", "cp"))
    for low, high in ((20, 1000), (10, 20), (0, 10)):
        pages.filter(f"page_id >= {low} and page_id < {high}").write.mode("append").parquet(source)
        stream = spark.readStream.schema(pages.schema).parquet(source)
        collect_listing(stream, table, progress, fq.NAV_CARDS).awaitTermination()
    got = collected(spark, table)
    want = fq.first_wins(fq.require(fq.listing_cards(pages, fq.NAV_CARDS)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
