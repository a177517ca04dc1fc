"""Bloom filters from Spark's bitmap aggregates: keep the rows whose key may be in a set.

A filter is one row: an array of bitmaps of 4 KB. It reaches the rows to be tested as a
scalar subquery, so it is computed once and sent to every executor once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.session import stage

HASHES = 7
BITS_PER_KEY = 10  # at least; with seven hashes fewer than 1 in 100 others pass
BUCKET = 1 << 15  # bits of one bitmap, a property of Spark's aggregate
MAX_BITS = 1 << 28  # of one filter: 32 MB on every executor


def _hashes(keys: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of the key columns, without their signs."""
    return [F.shiftrightunsigned(F.xxhash64(*seed, *keys), 1) for seed in ([], [F.lit(1)])]


def _places(first: Column, second: Column, bits: int) -> list[Column]:
    """The bits a key sets, from 0."""
    start, step = first % bits, (second % bits).bitwiseOR(F.lit(1))
    return [(start + n * step) % bits for n in range(HASHES)]


def _filter(hashed: DataFrame, bits: int) -> DataFrame:
    """One row, one column: the bitmaps of all buckets in order, empty where no bit is set."""
    places = [place + 1 for place in _places(F.col("_first"), F.col("_second"), bits)]
    maps = (
        hashed.select(F.explode(F.array(*places)).alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    )
    # As many rows as a filter has buckets: 8,192 at most.
    buckets = hashed.sparkSession.range(1, bits // BUCKET + 1).withColumnRenamed("id", "bucket")
    filled = buckets.join(maps, "bucket", "left").select(
        "bucket", F.coalesce("bitmap", F.lit(b"")).alias("bitmap")
    )
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "bitmap")))
    return filled.agg(F.transform(ordered, lambda b: b["bitmap"]).alias("bitmaps"))


def _held(bitmaps: Column, place: Column) -> Column:
    """Whether a bit is set."""
    bitmap = F.get(bitmaps, F.shiftright(place, 15).cast("int"))
    byte = F.substring(bitmap, F.shiftright(place % BUCKET, 3).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(value, (place % 8).cast("int")), F.lit(0)) == 1


def may_hold(
    df: DataFrame, wanted: DataFrame, keys: Sequence[str], work: str | None = None, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are in ``wanted``, and fewer than 1 in 100 of the others.

    The filter grows with the number of wanted keys up to ``max_bits``. More keys than
    that holds are dealt by hash into several filters of that size; ``df`` is then read
    once for each of them, and every row is tested against one. A null is a key like
    any other. ``wanted`` is computed once and its hashes stored below ``work``.
    """
    names = ["_first", "_second"]
    hashed = stage(wanted.select(*[h.alias(n) for h, n in zip(_hashes(keys), names, strict=True)]), "bloom", work)
    count = hashed.count()
    bits = BUCKET
    while bits < max_bits and bits < BITS_PER_KEY * count:
        bits *= 2
    rounds = max(1, -(-BITS_PER_KEY * count // bits))
    marked = df.withColumns(dict(zip(names, _hashes(keys), strict=True)))
    out = None
    for n in range(rounds):
        # The high half deals the keys, so that it does not follow the bits' places.
        dealt = F.shiftright("_first", 32) % rounds == n
        bitmaps = _filter(hashed.filter(dealt) if rounds > 1 else hashed, bits).scalar()
        test = reduce(and_, [_held(bitmaps, place) for place in _places(F.col("_first"), F.col("_second"), bits)])
        part = marked.filter(dealt & test if rounds > 1 else test).drop(*names)
        out = part if out is None else out.unionAll(part)
    return out
