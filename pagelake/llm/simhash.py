"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit masks are built so that any two 64-bit fingerprints within the radius agree on all
bits of at least one mask: every bit position gets a non-zero vector of ``radius + 1``
bits, every non-zero vector ``v`` of that length is a mask that holds the positions whose
vector has an odd product with ``v``. Differing positions, at most ``radius``, span less
than the whole space, so some ``v`` is orthogonal to them all and its mask avoids them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import stored, whole_text
from pagelake.llm.components import components

BITS = 64
SEED = 42
CHUNK = 4096  # members of one bucket compared in one task
SMALL = 8  # buckets of at most so many members are compared by shifting
SLICE = 1 << 16  # shingles whose bits are unpacked at once

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SPACE = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def words_of(text: str) -> list[str]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed, return."""
    return [w for w in text.translate(_LOWER).translate(_SPACE).split(" ") if w]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of all word shingles, repeats counted; 0 for a text without words."""
    words = words_of(text or "")
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    sums = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, SLICE):
        stop = min(count, start + SLICE)
        parts = [words[start + k : stop + k] for k in range(shingle)]
        joined = map(" ".join, zip(*parts)) if count > 1 or len(words) == shingle else [" ".join(words)]
        hashes = np.fromiter((digest(s.encode(), SEED) for s in joined), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > count, bitorder="little").view("<u8")[0])


def masks(radius: int = 3) -> list[int]:
    """The covering masks, as unsigned integers."""
    size = radius + 1
    spread = [1 + position % ((1 << size) - 1) for position in range(BITS)]
    return [
        sum(1 << position for position, code in enumerate(spread) if (code & v).bit_count() % 2)
        for v in range(1, 1 << size)
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    return of(text)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _tree(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``values``: at most one per value."""
    left = np.ones(len(values), bool)
    links: list[tuple[int, int]] = []
    for first in range(len(values)):
        if not left[first]:
            continue
        left[first] = False
        frontier = [first]
        while frontier:
            at = frontier.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(values[rest] ^ values[at]) <= radius]
            left[near] = False
            frontier.extend(near.tolist())
            links.extend((at, int(x)) for x in near)
    return links


def links_of_buckets(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links within each run of equal ``bucket`` values of a sorted partition."""
    held = np.empty(0, np.int64), np.empty(0, np.uint64)

    def work(bucket: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        edges = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(bucket)]
        size = np.repeat(ends - starts, ends - starts)
        us, vs = [], []
        for shift in range(1, SMALL):
            if shift < len(bucket):
                a, b = fp[:-shift], fp[shift:]
                near = (bucket[:-shift] == bucket[shift:]) & (size[shift:] <= SMALL)
                near &= np.bitwise_count(a ^ b) <= radius
                us.append(a[near])
                vs.append(b[near])
        for start, end in zip(starts, ends):
            if end - start > SMALL:
                values = fp[start:end]
                if found := _tree(values, radius):
                    pairs = np.array(found)
                    us.append(values[pairs[:, 0]])
                    vs.append(values[pairs[:, 1]])
        join = lambda xs: np.concatenate(xs).view(np.int64) if xs else np.empty(0, np.int64)
        return pd.DataFrame({"u": join(us), "v": join(vs)})

    for batch in batches:
        bucket = np.r_[held[0], batch["bucket"].to_numpy(np.int64)]
        fp = np.r_[held[1], batch["fp"].to_numpy(np.int64).view(np.uint64)]
        if not len(bucket):
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))
        held = bucket[cut:], fp[cut:]
        if cut:
            yield work(bucket[:cut], fp[:cut])
    if len(held[0]):
        yield work(*held)


def near_links(reps: DataFrame, radius: int, name: str) -> DataFrame:
    """``(u, v)`` links that connect all distinct ``fp`` of ``reps`` within ``radius``.

    Buckets share a mask's bits. A bucket with more than ``CHUNK`` members is cut into
    chunks, and every pair of chunks is compared in a task of its own, so no member is
    left out and no task holds more than two chunks. A task returns a spanning forest.
    """
    table_key = F.explode(
        F.array(*[
            F.struct(
                F.lit(t).alias("mask"),
                F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"),
            )
            for t, m in enumerate(masks(radius))
        ])
    ).alias("k")
    rows = reps.select("fp", table_key).select("fp", "k.mask", "k.key")
    counts = stored(
        rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"),
        f"{name}-buckets",
    )
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    shared = (
        rows.join(counts, ["mask", "key"])
        .withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", other)
        .withColumn("bucket", F.xxhash64(
            "mask", "key", F.least("chunk", "other"), F.greatest("chunk", "other")))
        .select("bucket", "fp")
    )
    # Two buckets of one hash would only be compared together: links are tested exactly.
    dealt = shared.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInPandas(lambda b: links_of_buckets(b, radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, name: str = "simhash") -> DataFrame:
    """``(doc_id, fingerprint, component_id, group)``, one row per row of ``docs``.

    Documents are linked where fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest ``doc_id`` reachable. Null texts are empty and, like
    texts without words, have fingerprint zero and link like any other. A null ``doc_id``
    stays null and is never a ``component_id``, unless its whole component has none;
    ``group``, the component's smallest fingerprint as a signed long, still tells it apart.
    Repeated rows are returned as often as given. Extra columns are ignored.
    """
    prints = docs.select("doc_id", fingerprint_column(whole_text(), shingle).alias("fp"))
    found = linked(stored(prints, f"{name}-fingerprints"), radius, name)
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id", "group")


def linked(marked: DataFrame, radius: int = 3, name: str = "simhash") -> DataFrame:
    """``marked(doc_id, fp, ...)``, a stored table, with ``component_id`` and ``group`` added.

    They are those of :func:`near_duplicates`, for fingerprints the caller has at hand.
    Columns called ``rep``, ``component``, ``component_id`` or ``group`` must not be there.
    """
    reps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{name}-distinct")
    found = components(near_links(reps, radius, name), name)
    roots = reps.join(found, reps.fp == found.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component"))
    roots = stored(roots, f"{name}-roots")
    smallest = stored(roots.groupBy("component").agg(F.min("rep").alias("component_id")), f"{name}-smallest")
    named = stored(roots.join(smallest, "component"), f"{name}-named")
    return marked.join(named.drop("rep"), "fp").withColumnRenamed("component", "group")
