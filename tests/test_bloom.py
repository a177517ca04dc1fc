"""The Bloom filter: nothing wanted is lost, few others pass, any number of rounds."""

import pytest
from pyspark.sql import functions as F

from pagelake.operators.bloom import BITS_PER_KEY, BUCKET, may_hold


def pages(spark, rows):
    return spark.range(rows).select(F.concat(F.lit("https://x.example/"), "id").alias("url"), "id")


@pytest.mark.parametrize("max_bits, rounds", [(1 << 28, 1), (BUCKET, 13)])
def test_wanted_rows_and_few_others(spark, max_bits, rounds):
    """40,000 links among 2 million pages; the same bits per link as 20 million links get in 32 MB."""
    df, links = pages(spark, 2_000_000), 40_000
    wanted = df.filter(F.col("id") % 50 == 7)
    got = may_hold(df, wanted, ["url"], max_bits=max_bits)
    counts = got.agg(F.count_if(F.col("id") % 50 == 7), F.count_if(F.col("id") % 50 != 7)).first()
    assert counts[0] == links
    assert counts[1] <= 0.01 * (2_000_000 - links)
    assert got.columns == df.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 2000000") == rounds
    assert "Join" not in plan.split("Subquery")[0].split("scalar-subquery")[0]
    assert -(-BITS_PER_KEY * links // max_bits) == rounds


def test_few_none_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), ("b", None)], "url string, at int")
    same = lambda wanted, keys: sorted(map(str, may_hold(df, wanted, keys).collect()))
    assert same(df.limit(0), ["url"]) == []
    assert same(df.filter("url = 'a'"), ["url"]) == sorted(map(str, df.filter("url = 'a'").collect()))
    assert same(df.filter("at = 2"), ["url", "at"]) == [str(df.filter("at = 2").first())]
    assert same(df.filter("url is null or at is null"), ["url", "at"]) == sorted(
        map(str, df.filter("url is null or at is null").collect())
    )
    assert may_hold(df.limit(0), df, ["url"]).collect() == []
