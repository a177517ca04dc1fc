"""Exact top-k inner products by branch and bound over columns.

Candidates are kept column by column. A query adds its dimensions block by block, those
in which it is longest first. What a candidate can still gain is at most the product of
the lengths that the two vectors have left, so candidates that cannot reach the query's
k-th score so far go, and the columns are compacted before the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelake.llm.common import stored
from pagelake.session import work_path

STEPS = (16, 24, 36)  # dimensions added before each compaction, of 64
FIRST = 512  # candidates that are compared in full, for a first k-th score
CHUNK = 4096  # candidates that are compared at once
CHUNK_BYTES = 32 << 20  # and their size, at most
QUERY_BYTES = 8 << 20  # of the queries that are broadcast at once
EXACT = float(1 << 53)  # whole numbers below are exact in double precision
_LEAST = np.iinfo(np.int64).min + 1


def whole_numbers(vector: Column) -> Column:
    """``floor(256 * x)`` of each component, or null for a vector that takes no part."""
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, values)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors):
        row[: len(vector)] = vector
    return out


class Search:
    """The best ``k`` candidates so far for each of some queries.

    ``done`` counts multiplications, ``full`` those that whole products would take.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, first: int = FIRST):
        self.ids, self.queries, self.k, self.first = ids, queries, k, first
        self.scores = np.full((len(ids), k), _LEAST)
        self.found = np.full((len(ids), k), _LEAST)
        self.seen = self.done = self.full = 0
        width = queries.shape[1]
        self.order = np.argsort(-np.abs(queries), axis=1, kind="stable")
        squares = np.square(np.take_along_axis(queries, self.order, 1).astype(np.float64))
        self.cuts = sorted({max(1, width * step // 64) for step in STEPS if width * step // 64 < width})
        # Length of what is left of each query after each cut.
        self.rest = [np.sqrt(squares[:, cut:].sum(axis=1)) for cut in self.cuts]
        self.length = float(np.sqrt(squares.sum(axis=1)).max(initial=0))

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compare all queries with a batch of candidates."""
        columns = np.ascontiguousarray(vectors.T)
        squares = np.square(columns.astype(np.float64))
        length = squares.sum(axis=0)
        longest = length.max(initial=0)
        if longest < 1e30:  # single precision holds it
            squares, length = squares.astype(np.float32), length.astype(np.float32)
        # Rounding must not lose a candidate: a sum errs by a 2**-23 of the length a term, at most.
        slack = longest * 2 * len(columns) * 2.0**-23
        kind = np.float64 if self.length * np.sqrt(longest) < EXACT else np.int64
        columns, queries = columns.astype(kind), self.queries.astype(kind)
        self.full += len(self.ids) * columns.size
        if self.seen < self.first:
            self.done += len(self.ids) * columns.size
            for n, scores in enumerate(queries @ columns):
                self._merge(n, ids, scores)
        else:
            for n in range(len(self.ids)):
                self._merge(n, *self._bounded(n, ids, columns, squares, length, slack, queries[n]))
        self.seen += len(ids)

    def _bounded(self, n, ids, columns, squares, length, slack, query) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that may be among the best of query ``n``, with their scores."""
        least, order, begin = self.scores[n, -1], self.order[n], 0
        margin = 1 + abs(float(least)) * 2.0**-50
        scores, left, alive = np.zeros(len(ids), columns.dtype), length, None
        for cut, rest in zip([*self.cuts, len(order)], [*(r[n] for r in self.rest), 0.0]):
            rows, begin = order[begin:cut], cut
            # Rows that lie together first, then those of their columns that are still alive.
            block = columns[rows] if alive is None else columns[rows].take(alive, 1)
            scores = scores + query[rows] @ block
            self.done += block.size
            if cut == len(order):
                break
            gone = squares[rows] if alive is None else squares[rows].take(alive, 1)
            left = left - gone.sum(axis=0)
            gain = rest * np.sqrt(np.maximum(left, 0) + slack) * (1 + 1e-6) + margin
            able = np.flatnonzero(scores + gain >= least)
            if len(able) < len(scores):
                scores, left = scores[able], left[able]
                alive = able if alive is None else alive[able]
            if not len(able):
                break
        alive = slice(None) if alive is None else alive
        return ids[alive], scores

    def _merge(self, n: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put candidates among the best of query ``n``; ties go to the smaller id."""
        scores = scores.astype(np.int64)
        able = (scores >= self.scores[n, -1]) & (ids != self.ids[n])
        if able.sum() > self.k:
            able &= scores >= np.partition(scores[able], -self.k)[-self.k]
        if able.any():
            scores = np.concatenate([self.scores[n], scores[able]])
            names = np.concatenate([self.found[n], ids[able]])
            best = np.lexsort((names, -scores))[: self.k]
            self.scores[n], self.found[n] = scores[best], names[best]

    def result(self) -> pd.DataFrame:
        query = np.repeat(self.ids, self.k)
        out = pd.DataFrame({"query_id": query, "vec_id": self.found.ravel(), "score": self.scores.ravel()})
        return out[out["score"] != _LEAST]


def search(batches: Iterator[pd.DataFrame], state: Search) -> Iterator[pd.DataFrame]:
    """The best of a partition's candidates for each query."""
    width = state.queries.shape[1]
    most = max(1, min(CHUNK, CHUNK_BYTES // (8 * width)))
    size = lambda: most if state.seen >= state.first else min(most, state.first)
    waiting, held = [], 0

    def compare():
        ids = np.concatenate([w["vec_id"].to_numpy(np.int64) for w in waiting])
        vectors = np.concatenate([_matrix(w["v"], width) for w in waiting])
        start = 0
        while start < len(ids):
            end = start + size()
            state.offer(ids[start:end], vectors[start:end])
            start = end

    for batch in batches:
        waiting.append(batch)
        held += len(batch)
        if held >= size():
            compare()
            waiting, held = [], 0
    if held:
        compare()
    yield state.result()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, first: int = FIRST) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest integer inner products.

    ``vectors(vec_id, embedding)`` are turned into whole numbers; rows for which
    ``is_query`` holds are queries, all rows with another id are candidates. Ties go to
    the smaller id. Null vectors, and those with null or non-finite components, take no
    part, nor do rows without an id; shorter vectors count as ending in zeros. Of rows
    with one id all are candidates and the smallest vector is the query. Scores are
    exact while they fit a long. Fewer candidates than ``k`` give fewer rows.

    Queries are broadcast in blocks of about ``QUERY_BYTES``, one pass over the stored
    candidates each. Candidates stay where they are; tasks return ``k`` rows a query.
    Bounds count after a task's ``first`` candidates.
    """
    spark = vectors.sparkSession
    usable = stored(
        vectors.filter("vec_id is not null").withColumn("v", whole_numbers(F.col("embedding")))
        .filter("v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("asks")),
        "topk-vectors")
    size = usable.agg(F.max(F.size("v")).alias("width"), F.count_if("asks").alias("asking")).first()
    width, asking = max(1, size["width"] or 0), size["asking"] or 0
    parts = max(1, -(-asking * width * 8 // QUERY_BYTES))
    asked = usable.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    asked = stored(asked.repartition("part"), "topk-queries")
    answers = usable.select("vec_id", "v")

    def near(part: int) -> DataFrame:
        block = asked.filter(F.col("part") == part).toPandas()
        shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(np.int64), _matrix(block["v"], width)))
        return answers.mapInPandas(
            lambda batches: search(batches, Search(*shared.value, k, first)), "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if parts == 1:
        found = near(0)
    else:
        path = work_path(spark, "llm-topk-found")
        for part in range(parts):
            near(part).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop(
                "rank").write.mode("append").parquet(path)
        found = spark.read.parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 256) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_inner_product(q.v::double[], c.v::double[]) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5"""
