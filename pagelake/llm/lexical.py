"""Ranked lexical search by best-first intervals of documents.

The index is cut by documents: every task turns the texts it reads into segments, each
with a posting list per term (rising documents and their counts), without a shuffle. A
search weighs the query's terms by counts over all segments, brings the wanted lists of a
segment together, and computes every posting's impact. A sparse table over a list's
impacts gives the place of the greatest one in any interval of documents in two look-ups;
summed over an item's terms that bounds every score in the interval. Intervals are taken
best bound first, the document of the greatest impact is scored and splits its interval
in two, until no bound reaches the item's k-th best score. That score carries over from
segment to segment of a task, so later segments are cut off early.
"""

from __future__ import annotations

import math
import string
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import numbered, stored, whole_text

#: A segment ends at so many documents or postings. Results do not depend on it.
DOCS = 1 << 14
POSTINGS = 1 << 20
#: So many terms of items are searched in one pass over the index, and one item at least.
BLOCK = 1 << 15
#: So many (interval, term) pairs are bounded at once.
PAIRS = 1 << 16
#: So many bytes of a text are cut into terms at once.
CHUNK = 1 << 20

NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last among equals
INDEX = "segment long, term string, df int, docs array<int>, counts array<int>, ids array<long>, lengths array<long>"

_KEPT = (string.ascii_letters + string.digits).encode()
#: Bytes to terms' bytes: A-Z lower-cased, any other ASCII but letters and digits a blank.
_TABLE = bytes(b if b >= 0x80 or b in _KEPT else 0x20 for b in range(256)).lower()


def terms_of(raw: bytes) -> Counter:
    """Terms and their counts: maximal runs of ASCII letters, digits and all non-ASCII."""
    raw = raw.translate(_TABLE)
    found: Counter = Counter()
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + CHUNK)
        end = len(raw) if end < 0 else end
        found.update(raw[begin:end].split())
        begin = end
    return found


class _Segment:
    """Postings of some documents, gathered as flat arrays."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.counts, self.sizes = array("i"), array("q"), array("i")
        self.ids: list[int | None] = []
        self.lengths = array("q")

    def add(self, doc_id: int | None, found: Counter) -> None:
        numbers = self.vocabulary
        self.terms.extend([numbers.setdefault(term, len(numbers)) for term in found])
        self.counts.extend(found.values())
        self.sizes.append(len(found))
        self.ids.append(doc_id)
        self.lengths.append(sum(found.values()))

    def full(self) -> bool:
        return len(self.ids) >= DOCS or len(self.terms) >= POSTINGS

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row with ids and lengths, then one per term."""
        schema = pa.schema(
            [("segment", pa.int64()), ("term", pa.string()), ("df", pa.int32())]
            + [(name, pa.list_(pa.int32())) for name in ("docs", "counts")]
            + [(name, pa.list_(pa.int64())) for name in ("ids", "lengths")]
        )
        none = [None]
        head = [[number], none, none, none, none, [self.ids], [self.lengths.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(head, schema, strict=True)], schema=schema)
        terms = np.frombuffer(self.terms, np.int32)
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.frombuffer(self.sizes, np.int32))
        order = np.argsort(terms, kind="stable")
        docs, counts = docs[order], np.frombuffer(self.counts, np.int64)[order].astype(np.int32)
        ends = np.cumsum(np.bincount(terms, minlength=len(self.vocabulary)))
        words = list(self.vocabulary)
        step = 1 << 13
        for k in range(0, len(words), step):
            edge = np.concatenate([[ends[k - 1] if k else 0], ends[k : k + step]])
            lists = [
                pa.ListArray.from_arrays(pa.array((edge - edge[0]).astype(np.int32)), pa.array(v[edge[0] : edge[-1]]))
                for v in (docs, counts)
            ]
            rows = len(edge) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, number)),
                    pa.array(words[k : k + step], pa.binary()).cast(pa.string()),
                    pa.array(np.diff(edge).astype(np.int32)),
                    *lists,
                    *[pa.nulls(rows, pa.list_(pa.int64()))] * 2,
                ],
                schema=schema,
            )


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of all rows of ``docs(doc_id, text, ...)`` that have a term.

    Per segment one row with its documents' ids and numbers of terms, and one per term
    with its posting list. Segments are bounded in documents and postings, so a task
    holds one of them, and no row leaves the task that reads it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        segment = _Segment()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if found := terms_of(raw.as_py()):
                    segment.add(doc_id, found)
                if segment.full():
                    yield from segment.rows(number)
                    segment, number = _Segment(), number + 1
        if segment.ids:
            yield from segment.rows(number)

    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"))
    return stored(narrow.mapInArrow(work, INDEX), "lexical-index")


class Best(NamedTuple):
    """The best documents of one item so far, best first."""

    scores: np.ndarray
    ids: np.ndarray

    def reach(self, k: int) -> tuple[int, int]:
        """What a document must reach: a score, and at that score an id below the other number."""
        return (int(self.scores[-1]), int(self.ids[-1])) if len(self.scores) == k else (1, NO_ID)

    def merged(self, scores: np.ndarray, ids: np.ndarray, k: int) -> Best:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:k]
        return Best(scores[order], ids[order])


NOTHING = Best(np.zeros(0, np.int64), np.zeros(0, np.int64))


class Postings:
    """The lists of one segment that a block of items asks for, with their sparse table."""

    def __init__(self, lists: list[tuple[int, np.ndarray, np.ndarray]], lengths: np.ndarray, weights: dict[int, int], total: int, docs: int):
        """``lists``: (term, documents, counts); ``total`` terms in ``docs`` documents overall."""
        lists = sorted(lists, key=lambda one: one[0])
        self.place = {term: k for k, (term, _, _) in enumerate(lists)}
        self.documents = len(lengths)
        self.docs = np.concatenate([d for _, d, _ in lists]).astype(np.int64)
        sizes = np.array([len(d) for _, d, _ in lists])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        counts = np.concatenate([c for _, _, c in lists]).astype(np.int64)
        m = 75 + 25 * lengths * docs // total
        weight = np.repeat([weights[term] for term, _, _ in lists], sizes)
        self.impact = weight * (1_000_000_000 * counts // (1000 * counts + 12 * m[self.docs]))
        # One rising number per posting, for finding a document in several lists at once.
        self.keys = np.repeat(np.arange(len(lists)), sizes) * (self.documents + 1) + self.docs
        # Level j: where the greatest impact of 2**j postings from here on is. An interval
        # never leaves its list, so what a level holds across a list's end is not read.
        level = np.arange(len(self.docs), dtype=np.int32)
        self.table = [level]
        for j in range(int(sizes.max()).bit_length() - 1):
            right = np.concatenate([level[1 << j :], level[len(level) - (1 << j) :]])
            level = np.where(self.impact[right] > self.impact[level], right, level).astype(np.int32)
            self.table.append(level)
        self.table = np.concatenate(self.table)

    def at(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Per document (rows) and term the place of the first posting at or behind it."""
        return np.searchsorted(self.keys, terms * (self.documents + 1) + docs[:, None])

    def bounds(self, repeats: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row of list intervals ``a`` to ``b``: the summed greatest impacts, and the
        document of the greatest of them."""
        some = b > a
        level = np.frexp(np.maximum(b - a, 1))[1] - 1
        width = len(self.docs)
        first = self.table[level * width + np.where(some, a, 0)]
        second = self.table[level * width + np.where(some, b - (1 << level), 0)]
        top = np.where(self.impact[second] > self.impact[first], second, first)
        gain = np.where(some, self.impact[top] * repeats, 0)
        best = gain.argmax(axis=1)
        return gain.sum(axis=1), self.docs[top[np.arange(len(top)), best]]


def search(lists: Postings, ids: np.ndarray, wanted: np.ndarray, repeats: np.ndarray, best: Best, k: int) -> tuple[Best, int]:
    """``best`` with one segment's documents, and how many of these were scored.

    ``wanted`` are the item's terms and ``repeats`` how often it has each. Exact: an
    interval is left only if its bound is below the k-th score, or equal to it when the
    segment has no smaller id.
    """
    here = [k for k, term in enumerate(wanted) if term in lists.place]
    if not here:
        return best, 0
    terms = np.array([lists.place[wanted[k]] for k in here])
    repeats = repeats[here]
    smallest = int(ids.min())
    a, b = lists.begins[terms][None], lists.ends[terms][None]
    bound, split = lists.bounds(repeats, a, b)
    lo, hi = np.zeros(1, np.int64), np.full(1, lists.documents)
    batch = max(1, PAIRS // len(terms))
    scored = 0
    while len(bound):
        least, last = best.reach(k)
        least += smallest > last
        able = bound >= max(least, 1)
        bound, split, lo, hi = bound[able], split[able], lo[able], hi[able]
        if not len(bound):
            break
        if len(bound) > batch:
            order = np.argpartition(-bound, batch)
            now, later = order[:batch], order[batch:]
        else:
            now, later = np.arange(len(bound)), np.zeros(0, np.int64)
        doc, begin, end = split[now], lo[now], hi[now]
        at = lists.at(terms, doc)
        there = (at < lists.ends[terms]) & (lists.docs[np.minimum(at, len(lists.docs) - 1)] == doc[:, None])
        score = (np.where(there, lists.impact[np.minimum(at, len(lists.docs) - 1)], 0) * repeats).sum(axis=1)
        scored += len(doc)
        good = score >= max(best.reach(k)[0], 1)
        best = best.merged(score[good], ids[doc[good]], k)
        left, left_split = lists.bounds(repeats, lists.at(terms, begin), at)
        right, right_split = lists.bounds(repeats, at + there, lists.at(terms, end))
        bound = np.concatenate([bound[later], left, right])
        split = np.concatenate([split[later], left_split, right_split])
        lo = np.concatenate([lo[later], begin, doc + 1])
        hi = np.concatenate([hi[later], doc, end])
    return best, scored


def _query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item, text) with the texts' terms and counts; items without terms are left out."""
    kind = items.schema[item_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(raw.as_py()) for raw in batch.column(1)]
            words = [[term.decode() for term in one] for one in found]
            repeats = [list(one.values()) for one in found]
            sizes = pa.array([len(one) for one in found], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(words, pa.list_(pa.string())),
                    pa.array(repeats, pa.list_(pa.int64())),
                    sizes,
                    batch.column(1),
                ],
                names=["item_id", "terms", "repeats", "size", "raw"],
            )

    narrow = items.select(F.col(item_id).alias("item_id"), whole_text(text).cast("binary").alias("raw")).distinct()
    out = narrow.mapInArrow(work, f"item_id {kind}, terms array<string>, repeats array<long>, size int, raw binary")
    return out.filter("size > 0")


def _hits(index: DataFrame, block: list, totals: tuple[int, int], k: int) -> DataFrame:
    """``(row_no, doc_id, score)``: per item of the block and task the ``k`` best documents."""
    spark = index.sparkSession
    documents, all_terms = totals
    numbers: dict[str, int] = {}
    items = [
        (row.row_no, np.array([numbers.setdefault(t, len(numbers)) for t in row.terms]), np.array(row.repeats))
        for row in block
    ]
    words = F.broadcast(spark.createDataFrame(list(numbers.items()), "term string, number int"))
    wanted = index.join(words, "term")
    held = {row.number: row.df for row in wanted.groupBy("number").agg(F.sum("df").alias("df")).collect()}
    weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in held.items()}

    def segments(batches: Iterator[pa.RecordBatch]):
        """(ids, lengths, lists) of one segment after the other."""
        number, ids, lengths, lists = None, None, None, []
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            terms = columns["number"].to_pylist()
            for row, segment in enumerate(columns["segment"].to_pylist()):
                if segment != number:
                    if lists:
                        yield ids, lengths, lists
                    number, lists = segment, []
                if terms[row] is None:
                    found = columns["ids"][row].values.fill_null(int(NO_ID))
                    ids, lengths = found.to_numpy(), columns["lengths"][row].values.to_numpy()
                else:
                    lists.append((terms[row], *(columns[n][row].values.to_numpy() for n in ("docs", "counts"))))
        if lists:
            yield ids, lengths, lists

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: NOTHING for item, _, _ in items}
        for ids, lengths, lists in segments(batches):
            held = Postings(lists, lengths, weights, all_terms, documents)
            for item, terms, repeats in items:
                best[item], _ = search(held, ids, terms, repeats, best[item], k)
        rows = np.repeat(np.array(list(best), np.int64), [len(one.ids) for one in best.values()])
        ids, scores = (np.concatenate([one[j] for one in best.values()]) for j in (1, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["row_no", "doc_id", "score"]
        )

    heads = index.filter("term is null").withColumn("number", F.lit(None).cast("int"))
    columns = ["segment", "number", "docs", "counts", "ids", "lengths"]
    dealt = heads.select(*columns).union(wanted.select(*columns)).repartition("segment")
    return dealt.sortWithinPartitions("segment", "number").mapInArrow(work, "row_no long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: per item its ``k`` best documents with a score above 0.

    A document's score sums, over the item's terms with repeats, a weight that falls with
    the number of documents holding the term times a share that rises with its count in
    the document and falls with the document's length. Equal scores rank by rising
    doc_id, documents without an id last.

    Every row of ``docs`` is a document of its own; a row that is there twice ranks twice.
    Items are the distinct pairs of id and text. Null and empty texts have no terms: such
    documents are never found and do not count, such items have no rows, and neither have
    items without a match. Other columns are left out.
    """
    kind = items.schema[item_id].dataType.simpleString()
    index = build_index(docs)
    spark = index.sparkSession
    lengths = index.filter("term is null").select(F.explode("lengths").alias("n"))
    documents, all_terms = lengths.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    queries = stored(numbered(_query_terms(items, item_id, text), ["item_id", "raw"], "lexical-items", "size"), "lexical-queries")
    blocks = queries.withColumn("block", F.expr(f"size_before div {BLOCK}"))
    hits = spark.createDataFrame([], "row_no long, doc_id long, score long")
    for (number,) in blocks.select("block").distinct().orderBy("block").collect():
        block = blocks.filter(F.col("block") == number).orderBy("row_no").collect()
        hits = hits.union(stored(_hits(index, block, (documents, all_terms), k), "lexical-hits"))
    order = Window.partitionBy("row_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(queries.select("row_no", F.col("item_id").cast(kind)), "row_no").select(
        "item_id", "rank", "doc_id", "score"
    )


ORACLE = r"""
with d as (
  select doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
i as (
  select item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
sizes as (select doc_id, count(*) as n from d group by doc_id),
totals as (select count(*) as docs, cast(sum(n) as bigint) as terms from sizes),
tfs as (select doc_id, term, count(*) as tf from d group by doc_id, term),
weights as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w
            from tfs, totals group by term),
gains as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) as gain
  from tfs join sizes using (doc_id) join weights using (term), totals),
scores as (select item_id, doc_id, cast(sum(gain) as bigint) as score from i join gains using (term) group by all),
placed as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank,
         doc_id, score from scores where score > 0)
select * from placed where rank <= 20
"""
