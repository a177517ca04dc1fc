"""Captured pages as a source, page numbering, single-page selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages, one row per page, with at least ``url`` and ``html``.

    Pages are parsed where they are read. How many tasks that are is a matter of the
    split size (``spark.sql.files.maxPartitionBytes``) and of the files' row groups.
    """
    return spark.read.parquet(path)


def page_sequence(spark: SparkSession, max_pages: int = 20) -> DataFrame:
    """Page numbers 1..max_pages."""
    return spark.range(1, max_pages + 1).select(F.col("id").cast("int").alias("page_no"))


def page_url(base: str | Column, n: Column) -> Column:
    """URL of a result page: the base for page 1, ``base/page/n`` for the others."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit("/page/"), n.cast("string")))


def listing_pages(pages: DataFrame, base: str, max_pages: int | None = 20) -> DataFrame:
    """The captured result pages 1..max_pages of ``base`` (None: all), with their ``page_no``.

    The number is read off the URL, so no join with the page sequence is needed,
    and the URL prefix reaches the Parquet scan.
    """
    number = F.regexp_extract("url", "^" + re.escape(f"{base}/page/") + r"([0-9]+)$", 1)
    numbered = (
        pages.filter(F.col("url").startswith(base))
        .withColumn(
            "page_no",
            F.when(F.col("url") == base, F.lit(1)).when(number != "", number.try_cast("bigint")),
        )
        .filter(F.col("page_no") >= 1)
    )
    return numbered if max_pages is None else numbered.filter(F.col("page_no") <= max_pages)


def only_page(df: DataFrame, n: int, page_col: str = "page_no") -> DataFrame:
    """Records of one page."""
    return df.filter(F.col(page_col) == n)


def only_url(df: DataFrame, url: str) -> DataFrame:
    """Records of one URL."""
    return df.filter(F.col("url") == url)
