"""Maps and arrays: last-wins maps and their text forms for CSV cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.text import let
from pagelake.functions.values import MISSING


def map_last_wins(entries: Column) -> Column:
    """``array<struct<k, v>>`` to a map: a repeated key keeps its first place and last value.

    Sorts once by key and place and reads off the ends of every run, so a page with
    many entries costs n log n. Null if there is no entry.
    """
    placed = F.transform(
        entries, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))
    )

    def runs(s: Column) -> Column:
        firsts = F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"]))
        lasts = F.filter(s, lambda e, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["k"] != e["k"]))
        merged = F.zip_with(
            firsts,
            lasts,
            lambda a, b: F.struct(a["i"].alias("i"), b["k"].alias("k"), b["v"].alias("v")),
        )
        return F.map_from_entries(
            F.transform(F.array_sort(merged), lambda e: F.struct(e["k"], e["v"]))
        )

    return let(
        F.array_sort(placed),
        lambda s: F.when(F.size(s) > 0, runs(s)),
    )


def json_string(col: Column) -> Column:
    """A JSON string literal."""
    return let(F.to_json(F.array(col)), lambda j: F.substr(j, F.lit(2), F.length(j) - 2))


def map_to_json(col: Column, spaced: bool = False) -> Column:
    """JSON text of a string map; ``spaced`` writes ``, `` and ``: ``."""
    if not spaced:
        return F.to_json(col)
    pairs = F.transform(
        F.map_entries(col),
        lambda e: F.concat(json_string(e["key"]), F.lit(": "), _json_value(e["value"], "string")),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _json_value(col: Column, kind: str) -> Column:
    text = json_string(col) if kind == "string" else F.to_json(F.array(col))
    if kind != "string":
        text = let(text, lambda j: F.substr(j, F.lit(2), F.length(j) - 2))
    return F.when(col.isNull(), F.lit("null")).otherwise(text)


def array_to_json(col: Column, fields: dict[str, str] | None = None) -> Column:
    """JSON text of an array of structs, nulls written out.

    With ``fields`` (name to type) the text has ``, `` and ``: `` between its parts.
    """
    if fields is None:
        return F.to_json(col, {"ignoreNullFields": "false"})

    def one(item: Column) -> Column:
        parts = [
            F.concat(F.lit(f'"{name}": '), _json_value(item[name], kind))
            for name, kind in fields.items()
        ]
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform(col, one), ", "), F.lit("]"))


def join_list(col: Column, sep: str = "; ") -> Column:
    """A list of texts as one text."""
    return F.array_join(col, sep)


def fill_nearby(col: Column) -> Column:
    """Put the missing-value mark into the optional text fields of nearby records."""

    def one(item: Column) -> Column:
        out = item
        for name in ("location", "price", "cuisine"):
            out = out.withField(name, F.coalesce(item[name], F.lit(MISSING)))
        return out

    return F.transform(col, one)
