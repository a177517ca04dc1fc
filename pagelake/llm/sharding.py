"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows get numbers from 0 in the order of their ids. A keyed permutation of these numbers
is the shuffle: place ``p`` goes to shard ``p % shards`` and slot ``p // shards``, so
shards differ by at most one row (the law ``rows``). Either way is computable without the
data: a row's shard and slot from its number, and the number from shard and slot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import numbered

ROUNDS = 6
PRIME = (1 << 31) - 1
FACTOR = 1_103_515_245


def round_keys(seed: str) -> list[int]:
    """One number below ``PRIME`` per round, from the seed."""
    return [int(hashlib.md5(f"{seed}:{n}".encode()).hexdigest(), 16) % PRIME for n in range(ROUNDS)]


def sides(rows: int) -> tuple[int, int]:
    """The two halves' sizes: their product is at least ``rows`` and hardly more."""
    a = max(1, int(np.ceil(np.sqrt(rows))))
    return a, max(1, -(-rows // a))


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    """A keyed cubic; all products stay below 2**62."""
    y = (half % PRIME * FACTOR + key) % PRIME
    return (y * y % PRIME * y + key) % PRIME


def _network(values: np.ndarray, rows: int, seed: str, back: bool) -> np.ndarray:
    a, b = sides(rows)
    left, right = values // b, values % b
    keys = list(enumerate(round_keys(seed)))
    for n, key in reversed(keys) if back else keys:
        sign = -1 if back else 1
        if n % 2 == 0:
            left = (left + sign * _mixed(right, key)) % a
        else:
            right = (right + sign * _mixed(left, key)) % b
    return left * b + right


def permuted(values: np.ndarray, rows: int, seed: str, back: bool = False) -> np.ndarray:
    """The places of row numbers below ``rows``; ``back`` gives the numbers of places.

    Places at or above ``rows`` are permuted again until they fall below it.
    """
    out = _network(np.asarray(values, np.int64), rows, seed, back)
    while (over := out >= rows).any():
        out[over] = _network(out[over], rows, seed, back)
    return out


def shard_and_slot(row_no: int, rows: int, shards: int, seed: str) -> tuple[int, int]:
    place = int(permuted(np.array([row_no]), rows, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, rows: int, shards: int, seed: str) -> int:
    return int(permuted(np.array([slot * shards + shard]), rows, seed, back=True)[0])


def sharded(docs: DataFrame, shards: int = 24, seed: str = "shuffle-1") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row of ``docs``.

    ``size`` is the text's bytes plus 8, a null text having none. Rows are numbered by
    doc_id (nulls first), then size and checksum; rows equal in all three are alike, so
    any order of them gives the same result. Equal texts are rows of their own here: the
    law deals rows, and ``grown_shard`` is null. No documents give no rows.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.length(raw) + 8).cast("long").alias("size"),
                         F.crc32(raw).alias("text_crc32"))
    rows = numbered(narrow, ["doc_id", "size", "text_crc32"], "sharding")
    total = rows.count()

    @F.pandas_udf("long")
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(permuted(row_no.to_numpy(np.int64), total, seed))

    return rows.withColumn("place", place("row_no")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
