"""Toxicity: a linear classifier over character n-grams scaled by log-count ratios.

Every distinct character n-gram of the whole text is a feature whose value is its naive
Bayes log-count ratio between the two classes. A logistic regression weighs them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import stored, whole_text

SIZES = (3, 4, 5)  # n-gram lengths in characters
BUCKET_BITS = 22  # n-grams are hashed to 2**22 numbers
ROWS_PER_CLASS = (2000, 4000)  # bound of the fitting sample: label 1, label 0
FEATURES = 1 << 14  # kept: the largest |ratio| times document count
LEAST_DOCS = 3  # documents of the sample a kept n-gram occurs in
SMOOTHING = 1.0
PENALTY = 0.03
ITERATIONS = 60
THRESHOLD = 0.7
WINDOW = 1 << 20  # characters hashed at once

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0x2545F4914F6CDD1D)


def buckets_of(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct n-gram buckets of a whole text, only those marked in ``wanted``.

    Letters are lower-cased; white space counts as one blank, also at both ends.
    """
    line = " " + " ".join((text or "").lower().split()) + " "
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = []
    for start in range(0, len(codes), WINDOW):
        piece = codes[start : start + WINDOW + max(SIZES) - 1]
        mixed = np.full(len(piece), _SEED)
        for size in range(1, max(SIZES) + 1):
            if size > len(piece):
                break
            mixed = (mixed[: len(piece) - size + 1] ^ piece[size - 1 :]) * _STEP
            mixed ^= mixed >> np.uint64(29)
            if size in SIZES:
                bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                found.append(bucket if wanted is None else bucket[wanted[bucket]])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


@dataclass(frozen=True)
class Model:
    """Weights by bucket, already multiplied with the ratios, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self):
        """A function from a text to a number from 0 to 1."""
        dense = np.zeros(1 << BUCKET_BITS, np.float32)
        dense[self.buckets] = self.weights
        wanted = dense != 0

        def score(text: str | None) -> float:
            total = self.intercept + float(dense[buckets_of(text, wanted)].sum(dtype=np.float64))
            return round(1.0 / (1.0 + float(np.exp(-np.clip(total, -50, 50)))), 6)

        return score


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, label, weight)`` of at most ``ROWS_PER_CLASS`` labelled documents.

    A document with several labels counts as toxic if one says so. Rows are chosen by a
    hash of the id; weights restore the classes' shares. The chosen ids, bounded by the
    two numbers, are broadcast to the scan of the texts. Repeated rows count once.
    """
    known = (
        labels.filter("toxic is not null and doc_id is not null")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
    )
    known = known.withColumn("order", F.xxhash64("doc_id"))
    picked = None
    for label, most in ((1, ROWS_PER_CLASS[0]), (0, ROWS_PER_CLASS[1])):
        own = known.filter(F.col("label") == label)
        count = own.count()
        part = own.orderBy("order", "doc_id").limit(most)
        part = part.select("doc_id", "label", F.lit(max(1.0, count / most)).alias("weight"))
        picked = part if picked is None else picked.union(part)
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.dropDuplicates(["doc_id"]).select("text", "label", "weight")


def fit(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> Model:
    """Learn from the labelled rows that are not held out.

    Without rows of both classes the model gives every text the share of label 1, or one
    half if there is no label at all.
    """
    sample = stored(training_rows(docs, labels), f"{name}-sample")
    shares = {r["label"]: (r["n"], r["w"]) for r in sample.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    nothing = np.empty(0, np.int64), np.empty(0, np.float32)
    if len(shares) < 2:
        constant = 0.0 if not shares else (50.0 if 1 in shares else -50.0)
        return Model(*nothing, constant)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                sums[int(label), buckets_of(text)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        for start in range(0, len(at), 1 << 16):
            part = at[start : start + (1 << 16)]
            yield pd.DataFrame({"bucket": part, "n0": sums[0, part], "n1": sums[1, part]})

    counts = (
        sample.mapInPandas(count, "bucket long, n0 long, n1 long")
        .groupBy("bucket")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    per_class = {label: n for label, (n, _) in shares.items()}
    # Smoothed share of the class's documents with the n-gram, over that of the other class.
    ratio = F.log((F.col("n1") + SMOOTHING) / (per_class[1] + 2 * SMOOTHING)) - F.log(
        (F.col("n0") + SMOOTHING) / (per_class[0] + 2 * SMOOTHING)
    )
    kept = (
        counts.filter(F.col("n0") + F.col("n1") >= LEAST_DOCS)
        .withColumn("ratio", ratio)
        .withColumn("worth", F.abs("ratio") * (F.col("n0") + F.col("n1")))
        .orderBy(F.desc("worth"), "bucket")
        .limit(FEATURES)
        .select("bucket", "ratio")
        .toPandas()
        .sort_values("bucket")
    )
    if kept.empty:
        one, zero = shares[1][1], shares[0][1]
        return Model(*nothing, float(np.log(one / zero)))
    buckets, ratios = kept["bucket"].to_numpy(np.int64), kept["ratio"].to_numpy(np.float64)
    wide = len(buckets)

    def vector(text: str):
        marked = np.zeros(1 << BUCKET_BITS, bool)
        marked[buckets] = True
        at = np.searchsorted(buckets, buckets_of(text, marked))
        return Vectors.sparse(wide, at, ratios[at])

    features = F.udf(vector, VectorUDT())
    train = sample.select(features("text").alias("features"), F.col("label").cast("double"), "weight")
    model = LogisticRegression(
        maxIter=ITERATIONS, regParam=PENALTY, elasticNetParam=0.0, standardization=False,
        weightCol="weight",
    ).fit(train)
    weights = (model.coefficients.toArray() * ratios).astype(np.float32)
    return Model(buckets, weights, float(model.intercept))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on).

    Only the text is read. A null or empty text has no n-grams of its own and scores by
    the intercept. Columns of ``docs`` named ``score`` or ``predicted`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for batch in texts:
            yield batch.map(of).astype("float64")

    scored = docs.withColumn("score", score(whole_text()))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    A null ``doc_id`` counts as an empty id for ``held_out``. Repeated rows are all
    scored. An empty table of documents gives no rows.
    """
    model = fit(docs, labels)
    narrow = docs.select("doc_id", F.col("text"))
    return scores(narrow, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
