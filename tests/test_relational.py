"""Dedup, append, stop, slice, enrich, union: properties and skewed inputs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pagelake.operators.relational as rel
from pagelake.operators.entries import last_wins_map
from pagelake.operators.metrics import page_tallies
from pagelake.session import work_path
from pagelake.streaming.append import append_batch, collected

CARDS = "page_no int, pos int, name string"
SLOW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
cards_of = st.lists(
    st.lists(st.sampled_from(["a", "b", "c", "d", "", None]), max_size=4), min_size=1, max_size=6
)


def frame(spark, pages, first=1):
    rows = [(n, i, name) for n, names in enumerate(pages, first) for i, name in enumerate(names)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, CARDS).repartition(4)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or rel.ORDER)).collect()]


def crawl(pages, max_pages=None):
    """Page by page, as a loop: what is kept, and per page (found, new, dup, nameless)."""
    seen, kept, tallies = set(), [], []
    for n, names in enumerate(pages[:max_pages], 1):
        new = []
        for i, name in enumerate(names):
            if name and name not in seen:
                seen.add(name)
                new.append((n, i, name))
        nameless = sum(not x for x in names)
        tallies.append((n, len(names), len(new), len(names) - len(new) - nameless, nameless))
        kept += new
        if not new:
            break
    return kept, tallies


@SLOW
@given(pages=cards_of, cap=st.integers(1, 7))
def test_crawl(spark, pages, cap):
    named = frame(spark, pages).filter("name <> ''")
    new = rel.first_wins(named)
    assert rows(rel.stop_at_first_gap(new, max_pages=cap)) == crawl(pages, cap)[0]
    assert rows(rel.first_wins(new)) == rows(new)


@SLOW
@given(pages=cards_of)
def test_tallies(spark, pages):
    cards = frame(spark, pages).unionByName(
        spark.createDataFrame([(n, None, None) for n, p in enumerate(pages, 1) if not p], CARDS)
    )
    assert rows(page_tallies(cards), "page_no") == crawl(pages)[1]


@settings(SLOW, max_examples=3)
@given(pages=cards_of)
def test_append_page_by_page(spark, pages):
    """Adding page after page, in any order, gives the same as one dedup of the whole."""
    whole = frame(spark, pages).filter("name <> ''")
    table = work_path(spark, "test")
    for n in range(len(pages), 0, -1):
        add = append_batch(table)
        add(whole.filter(F.col("page_no") == n), n)
        add(whole.filter(F.col("page_no") == n), n)  # a batch may run again
    got = collected(spark, table)
    assert rows(got.select(*whole.columns)) == rows(rel.first_wins(whole))


def test_first_wins_prefers_order_over_place(spark):
    df = spark.createDataFrame([(2, 0, "a"), (1, 5, "a"), (1, 7, "a"), (3, 0, None)], CARDS)
    assert rows(rel.first_wins(df)) == [(1, 5, "a"), (3, 0, None)]


def test_first_wins_by_several_keys(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "a")], CARDS)
    assert rows(rel.first_wins(df, ["name", "page_no"])) == [(1, 0, "a"), (2, 0, "a")]


def test_hot_name(spark):
    """A third of all cards share a name; one row of it reaches the last step."""
    df = spark.range(0, 300_000, 1, 8).select(
        F.expr("cast(id / 30 as int) + 1").alias("page_no"),
        F.expr("cast(id % 30 as int)").alias("pos"),
        F.expr("if(id % 3 = 0, 'hot', concat('n', id))").alias("name"),
    )
    got = rel.first_wins(df)
    assert got.count() == 200_001
    assert got.filter("name = 'hot'").first()["pos"] == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle


@pytest.mark.parametrize("first, pages, stop", [(1, [], 1), (1, [2, 3], 1), (1, [1, 2, 4], 3), (0, [0, 1], 2), (5, [1, 5, 6], 7)])
def test_first_gap(spark, first, pages, stop):
    df = spark.createDataFrame([(p,) for p in pages], "page_no int")
    assert rel.first_gap(df, "page_no", first).first()["stop"] == stop


@pytest.mark.parametrize(
    "start, size", [(0, None), (0, 0), (0, 1), (3, 4), (90, 20), (5, None), (99, 1), (100, 5), (0, 500), (250, None)]
)
def test_slice(spark, start, size):
    """A slice over sorted ranges matches a list slice."""
    keys = [(i // 7, i % 7) for i in range(100)]
    shuffled = keys[:]
    random.Random(2).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "page_no int, pos int").repartition(5)
    end = start + size if size else None
    assert rows(rel.slice_rows(df, rel.ORDER, start, size)) == keys[start:end]


def test_slice_rejects_negatives(spark):
    for start, size in ((-1, None), (0, -1)):
        with pytest.raises(ValueError):
            rel.slice_rows(spark.range(3), ["id"], start, size)


def test_valid_url(spark):
    df = spark.createDataFrame([("u",), ("N/A",), (None,), ("",)], "url string")
    assert [r["url"] for r in rel.valid_url(df).collect()] == ["u", ""]


def test_salted_join_equals_plain_join(spark):
    """A third of the rows share a key, another one is missing on the right."""
    left = spark.range(30_000).select(
        F.col("id").alias("ord"),
        F.expr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then 'gone' "
               "when id % 71 = 0 then null else concat('k', id % 500) end").alias("url"),
    )
    right = spark.range(500).select(
        F.expr("if(id = 7, 'hot', concat('k', id))").alias("url"), F.col("id").alias("n")
    )
    hot = {r["_hash"] for r in rel.hot_keys(left, "url", 100).collect()}
    named = spark.createDataFrame([("hot",), ("gone",)], "url string")
    assert {r[0] for r in named.select(F.xxhash64("url")).collect()} <= hot
    assert len(hot) < rel.HOT_SHARE
    want = rows(left.join(right, "url", "left"), "ord")
    got = rel.left_join_salted(left, right, "url", 100)
    assert rows(got, "ord") == want
    spread = left.filter("url = 'hot'").select(
        F.countDistinct(F.pmod(F.xxhash64("ord", "url"), F.lit(rel.SALTS)))
    )
    assert spread.first()[0] == rel.SALTS


def test_enrich_keeps_duplicates_and_misses(spark):
    listing = spark.createDataFrame(
        [(1, 0, "a", "u", "x"), (1, 1, "b", "u", "y"), (1, 2, "c", "v", "z")],
        "page_no int, pos int, name string, url string, price string",
    )
    details = spark.createDataFrame([("u", "p")], "url string, phone string")
    for salted in (True, False):
        got = rel.enrich(listing, details, salted=salted)
        assert got.columns == ["page_no", "pos", "url", "phone", "name", "error"]
        assert rows(got) == [
            (1, 0, "u", "p", "a", None),
            (1, 1, "u", "p", "b", None),
            (1, 2, "v", None, "c", "page not found"),
        ]


def test_union_records(spark):
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    b = spark.createDataFrame([("y", 2)], "a string, c int")
    got = rel.union_records(a, b)
    assert got.columns == ["a", "b", "c"]
    assert rows(got, "a") == [("x", 1, None), ("y", None, 2)]


def test_last_wins_rows(spark):
    df = spark.createDataFrame(
        [(1, "b", "1", 0), (1, "a", "2", 1), (1, "b", "3", 2), (2, "a", "4", 0)],
        "k int, day string, hours string, pos int",
    ).repartition(3)
    got = last_wins_map(df, ["k"], "day", "hours", "pos").select("k", F.map_entries("entries").alias("m"))
    assert {r["k"]: [tuple(e) for e in r["m"]] for r in got.collect()} == {
        1: [("b", "3"), ("a", "2")],
        2: [("a", "4")],
    }


def test_rejected_csv_cells(spark):
    """Cells that are no number or too large give null and a marked row; the job ends well."""
    from pagelake.session import work_path
    from pagelake.sources.listing_csv import read_listing_csv

    path = work_path(spark, "csv")
    lines = ["name,stars,url", "a,two,u", "b,99999999999,u", "c,2.0,N/A", "d,,u", "e,1,u"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    got = read_listing_csv(spark, path, rejected=True)
    assert [tuple(r) for r in got.orderBy("name").collect()] == [
        ("a", None, "u", ["stars"]), ("b", None, "u", ["stars"]), ("c", 2, None, []), ("d", None, "u", []), ("e", 1, "u", []),
    ]
    assert read_listing_csv(spark, path).columns == ["name", "stars", "url"]
    placed = read_listing_csv(spark, path, file_order=True, rejected=True)
    assert placed.columns == ["page_no", "pos", "name", "stars", "url", "_rejected"] and placed.count() == 5


def test_key_store(spark):
    """Batches in any order and replayed: every key once, its first row, untouched buckets left alone."""
    from pagelake.session import work_path
    from pagelake.streaming.append import _committed

    draw = random.Random(7)
    rows_ = [(page, pos, f"n{draw.randrange(60)}") for page in range(12) for pos in range(10)]
    df = spark.createDataFrame(rows_, "page_no int, pos int, name string")
    table = work_path(spark, "store")
    add = append_batch(table, buckets=8)
    assert collected(spark, table) is None
    add(df.limit(0), 0)
    assert collected(spark, table).collect() == [] and collected(spark, table).columns == df.columns
    for number, low in enumerate((9, 3, 0, 3, 6, 9)):  # 3 and 9 come twice
        add(df.filter(f"page_no between {low} and {low + 2}"), number)
    got = collected(spark, table)
    assert rows(got) == rows(rel.first_wins(df))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    last, folders, _ = _committed(spark, table)
    add(spark.createDataFrame([(0, 0, "n1")], df.schema), 99)
    again, changed, _ = _committed(spark, table)
    assert again == last + 1 and sum(folders[b] != changed[b] for b in folders) == 1
    stopped = collected(spark, table, until_stop=True, first_page=0)
    assert rows(stopped) == rows(rel.stop_at_first_gap(rel.first_wins(df.union(spark.createDataFrame([(0, 0, "n1")], df.schema))), "page_no", None, 0))
