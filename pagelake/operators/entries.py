"""Last-wins maps from rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins_map(
    df: DataFrame, keys: Sequence[str], entry: str, value: str, order: str, name: str = "entries"
) -> DataFrame:
    """One map per key group: a repeated entry keeps its first place and last value.

    Rows are first reduced to one per key group and entry, with a map-side part, so
    a hot group costs no more than its distinct entries.
    """
    per_entry = df.groupBy(*keys, entry).agg(
        F.max_by(value, order).alias("_value"), F.min(order).alias("_first")
    )
    listed = F.array_sort(F.collect_list(F.struct("_first", entry, "_value")))
    return (
        per_entry.groupBy(*keys)
        .agg(listed.alias("_entries"))
        .select(
            *keys,
            F.map_from_entries(
                F.transform("_entries", lambda e: F.struct(e[entry], e["_value"]))
            ).alias(name),
        )
    )
