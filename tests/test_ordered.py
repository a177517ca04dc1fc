"""Tables in stored order: slices without a sort, and runs that go on slice by slice."""

import random
import re

import pytest
from markup import detail_listing, detail_pages

from pagelake.operators import ordered
from pagelake.operators.relational import slice_rows
from pagelake.plans.details import build_details
from pagelake.schemas import ORDER
from pagelake.session import work_path

KEYS = [(i // 7, i % 7) for i in range(100)]


@pytest.fixture(scope="module")
def table(spark):
    shuffled = KEYS[:]
    random.Random(2).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "page_no int, pos int").repartition(5)


@pytest.fixture(scope="module")
def path(spark, table):
    at = work_path(spark, "order")
    assert not ordered.is_ordered(spark, at)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merged)
    spark.conf.set(merged, "false")  # else a table this small is one range
    ordered.write_ordered(table, at, ORDER)
    spark.conf.set(merged, before)
    assert ordered.is_ordered(spark, at)
    assert len(spark.read.parquet(f"{at}/index").collect()) > 4
    return at


@pytest.mark.parametrize(
    "start, size", [(0, None), (0, 1), (3, 4), (90, 20), (5, None), (99, 1), (100, 5), (0, 500), (250, None), (40, 35)]
)
def test_slices_equal_sorted_ones(spark, table, path, start, size):
    got = sorted(map(tuple, ordered.ordered_slice(spark, path, start, size).collect()))
    assert got == KEYS[start : start + size if size else None]
    assert got == sorted(map(tuple, slice_rows(table, ORDER, start, size).collect()))


def test_a_slice_sorts_and_shuffles_nothing(spark, path):
    plan = ordered.ordered_slice(spark, path, 40, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan
    filters = re.search(r"PartitionFilters: \[([^]]*)\]", plan)[1]
    low, high = (int(n) for n in re.findall(r"_range#\d+ [<>]= (\d+)", filters))
    assert 0 < low <= high < 7


def test_odd_tables(spark):
    at = work_path(spark, "order")
    ordered.write_ordered(spark.range(0), at, ["id"])
    assert ordered.ordered_slice(spark, at, 0, 5).collect() == []
    rows = spark.createDataFrame([(None, "x"), (2, "y"), (1, "z")], "id int, rows string")
    ordered.write_ordered(rows, at, ["id"])  # replaces what lies there
    assert [r["rows"] for r in ordered.ordered_slice(spark, at, 0, 2).collect()] == ["x", "z"]
    for start, size in ((-1, None), (0, -1)):
        with pytest.raises(ValueError):
            ordered.ordered_slice(spark, at, start, size)


def test_details_slice_by_slice(spark):
    """The slices make up the whole, and only the first one orders the listing."""
    index = work_path(spark, "order")
    whole = build_details(detail_listing(spark), detail_pages(spark))
    parts = []
    for start in range(3):
        part = build_details(detail_listing(spark), detail_pages(spark), start, 1, index=index)
        parts += [r["name"] for r in part.collect()]
        assert ordered.is_ordered(spark, index)
    assert parts == ["Alpha", "Beta", "Gamma"]
    assert sorted(parts) == sorted(r["name"] for r in whole.collect())
