"""Packing token sequences by non-negative least squares over a histogram of lengths.

Every document gives as many full windows as fit; what is left of it, less than a window,
is packed with others. All ways to fill a window exactly with up to ``DEPTH`` lengths are
enumerated. Non-negative least squares find how often to use each way, given how many
leftovers of each length there are. The rounded counts are used as far as leftovers
last; what remains is laid end to end and cut at the window, the last, incomplete window
at powers of two, which need no padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pagelake.llm.bpe import ranks_of_tokenizer
from pagelake.llm.common import numbered, whole_text
from pagelake.session import work_path

WINDOW = 1024
DEPTH = 3  # lengths in one window
STEPS = 400  # of the solver
END = 0  # id after each document


def fillings(window: int = WINDOW) -> np.ndarray:
    """All multisets of up to three lengths that sum to ``window``, zeros as filler."""
    pairs = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    triples = [
        (a, b, window - a - b)
        for a in range(1, window // 3 + 1)
        for b in range(a, (window - a) // 2 + 1)
    ]
    return np.array(pairs + triples, np.int64).reshape(-1, DEPTH)


def repeats(histogram: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """``x >= 0`` that minimises the squared gap between used and given counts.

    Accelerated projected gradient; lengths weigh by themselves, since a long leftover
    that finds no place costs more. ``histogram[n]`` counts the leftovers of length n.
    """
    size = len(histogram)
    weight = np.arange(size, dtype=np.float64) / size
    use = lambda x: np.bincount(ways.ravel(), np.repeat(x, DEPTH), size)
    scale = max(1.0, float(histogram.max(initial=0)))
    wanted = histogram / scale
    wanted[0] = 0
    # The largest eigenvalue bounds the step; a few power iterations find it.
    probe = np.ones(len(ways))
    for _ in range(20):
        used = use(probe)
        used[0] = 0
        probe = (weight * used)[ways].sum(axis=1)
        norm = float(np.linalg.norm(probe)) or 1.0
        probe /= norm
    step = 1.0 / (1.1 * norm)
    x = y = np.zeros(len(ways))
    t = 1.0
    for _ in range(STEPS):
        gap = weight * (use(y) - wanted)
        gap[0] = 0
        new = np.maximum(0.0, y - step * gap[ways].sum(axis=1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


class Plan:
    """Where the leftover with a given length and rank among its equals goes."""

    def __init__(self, histogram: np.ndarray, window: int, first_sequence: int):
        self.window = window
        ways = fillings(window)
        counts = np.rint(repeats(histogram.astype(np.float64), ways)).astype(np.int64)
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        taken = np.zeros_like(left)
        blocks: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, sequence, offset
        sequence = first_sequence
        for way in np.argsort(-counts, kind="stable"):
            if counts[way] == 0:
                break
            lengths = [int(n) for n in ways[way] if n]
            most = min(int(left[n]) // lengths.count(n) for n in lengths)
            times = min(int(counts[way]), most)
            if not times:
                continue
            offset = 0
            for n in sorted(lengths, reverse=True):
                blocks.append((n, int(taken[n]), times, sequence, offset))
                taken[n] += times
                left[n] -= times
                offset += n
            sequence += times
        self.taken = taken
        table = np.array(sorted(blocks), np.int64).reshape(-1, 5)
        self.first = np.searchsorted(table[:, 0], np.arange(window + 1))
        self.table = table
        # The rest, length by length, is one long line that starts at this sequence.
        self.line_sequence = sequence
        self.line_start = np.concatenate([[0], np.cumsum(left * np.arange(window))])
        total = int(self.line_start[-1])
        tail, self.tail_at = total % window, total - total % window
        cuts, at = [], self.tail_at
        for bit in reversed(range(tail.bit_length())):
            if tail >> bit & 1:
                at += 1 << bit
                cuts.append(at)
        self.tail_ends = cuts
        self.sequences = sequence + self.tail_at // window + len(cuts)

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Parts ``(start, length, sequence, offset)`` of one leftover."""
        if rank < self.taken[length]:
            lo, hi = self.first[length], self.first[length + 1]
            at = lo + int(np.searchsorted(self.table[lo:hi, 1], rank, "right")) - 1
            _, first, _, sequence, offset = self.table[at].tolist()
            return [(0, length, sequence + rank - first, offset)]
        begin = int(self.line_start[length]) + (rank - int(self.taken[length])) * length
        out, at = [], begin
        while at < begin + length:
            if at < self.tail_at:
                number, start = at // self.window, at - at % self.window
                stop = start + self.window
            else:
                nth = next(i for i, e in enumerate(self.tail_ends) if e > at)
                number = self.tail_at // self.window + nth
                start = self.tail_ends[nth - 1] if nth else self.tail_at
                stop = self.tail_ends[nth]
            end = min(stop, begin + length)
            out.append((at - begin, end - at, self.line_sequence + number, at - start))
            at = end
        return out


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tiktoken.Encoding:
    ranks = ranks_of_tokenizer(path)
    with open(path, encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file).get("added_tokens") or ()}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def coded(text: str, path: str, pattern: str) -> bytes:
    """The text's ids, little-endian 32-bit.

    tiktoken fails on about a million white-space characters in a row; such a text is
    left to the tokenizers library, which takes longer.
    """
    try:
        ids = _coder(path, pattern).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        ids = np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return ids.astype("<u4", copy=False).tobytes()


def tokenized(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids`` (little-endian 32-bit, the end id last) and ``tokens``, stored.

    The ids are those of the tokenizers library for the file at ``path``, no special tokens
    put around a text; one that a text spells out has its id. ``row`` tells stored rows apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.uint32(END).tobytes()
        for batch in batches:
            batch["ids"] = [coded(t, path, pattern) + end for t in batch.pop("_text")]
            batch["tokens"] = batch["ids"].map(len) // 4
            yield batch

    fields = [*(docs.schema[k] for k in keep), T.StructField("ids", T.BinaryType()),
              T.StructField("tokens", T.LongType())]
    out = docs.select(*keep, whole_text().alias("_text")).mapInPandas(run, T.StructType(fields))
    spark, at = docs.sparkSession, work_path(docs.sparkSession, "llm-tokens")
    out.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def placed(lengths: DataFrame, window: int = WINDOW, name: str = "packing") -> DataFrame:
    """``(row, start, length, sequence_id, offset)`` for every piece of ``lengths(row, doc_id, tokens)``.

    The driver sees the histogram of leftovers only: at most ``window`` numbers.
    """
    parts = lengths.select(
        "row", "doc_id",
        (F.col("tokens") % window).cast("int").alias("rest"),
        F.expr(f"tokens div {window}").alias("full"),
    )
    rows = numbered(parts, ["rest", "doc_id"], name, total="full")
    counts = parts.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    histogram = np.zeros(window, np.int64)
    for r in counts:
        histogram[r["rest"]] = r["n"]
    class_start = np.concatenate([[0], np.cumsum(histogram)])
    plan = Plan(histogram, window, sum(r["full"] for r in counts))
    shared = lengths.sparkSession.sparkContext.broadcast((plan, class_start))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen, begins = shared.value
        for batch in batches:
            out = []
            for row, rest, full, row_no in zip(*(batch[c].tolist() for c in ("row", "rest", "full", "row_no"))):
                if rest:
                    for start, length, sequence, offset in chosen.places(rest, row_no - int(begins[rest])):
                        out.append((row, full * window + start, length, sequence, offset))
            yield pd.DataFrame(out, columns=["row", "start", "length", "sequence_id", "offset"])

    leftovers = rows.filter("rest > 0").select("row", "rest", "full", "row_no").mapInPandas(
        run, "row long, start long, length long, sequence_id long, offset long")
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("nth")
    whole = rows.filter("full > 0").select("row", "full_before", nth).select(
        "row", (F.col("nth") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        (F.col("full_before") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.union(leftovers)


def packed(docs: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """One row per piece with its ``ids``: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Null and empty texts consist of the end id alone. Repeated rows and null ids of
    documents are packed like any other row; extra columns are ignored; no documents
    give no pieces. Very long texts are cut in full windows.
    """
    tokens = tokenized(docs, path, pattern)
    pieces = placed(tokens.select("row", "doc_id", "tokens"), window)
    slices = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return tokens.join(pieces, "row").select(
        "doc_id", "start", "length", slices.alias("ids"), F.col("tokens").alias("doc_tokens"),
        "sequence_id", "offset")


def packed_digest(docs: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """:func:`packed` with the crc32 of each piece's ids in place of the ids."""
    rows = packed(docs, path, pattern, window)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                       "doc_tokens", "sequence_id", "offset")
