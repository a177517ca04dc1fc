"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import stored, table, whole_text
from pagelake.llm.packing import packed_digest
from pagelake.llm.pii import pseudonymised
from pagelake.llm.simhash import fingerprint_column, hexadecimal, linked
from pagelake.llm.toxicity import fit, scores
from pagelake.session import work_path

KEY = "pseudonyms-1"  # of the pseudonyms; a real run brings its own
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not predict as toxic; it learns from ``labels``."""
    docs = docs.select(*COLUMNS)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, or any if none has an id.

    Fingerprints are computed once and stored beside the rows. The row to keep is chosen
    by its number, on narrow columns; whole texts move in the last join only.
    """
    prints = docs.select(*COLUMNS, fingerprint_column(whole_text()).alias("fp"))
    marked = stored(prints.withColumn("row", F.monotonically_increasing_id()), "pipeline-marked")
    groups = linked(marked.select("doc_id", "fp", "row"), name="pipeline-simhash")
    choice = F.min(F.struct(hexadecimal(F.col("fp")), "row"))
    first = groups.filter("doc_id <=> component_id").groupBy("group").agg(choice.alias("first"))
    return marked.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keyed pseudonyms in place of personal data; ``n_chars`` follows the text."""
    hidden = pseudonymised(docs.select(*COLUMNS), KEY)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return packed_digest(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: A trained classifier, SimHash, keyed pseudonyms and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that its predecessor kept, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
