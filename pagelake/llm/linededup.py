"""Line dedup: lines that occur in many documents go from all of them.

Lines are normalised and hashed where the text is read. Every document counts once for
each of its hashes, a sum with a map-side part, so a line that every document holds costs
one row a task. Lines over the threshold are looked up by a join of hashes and positions
only; the text itself moves once, to meet its document's dropped positions, and is put
together again from the runs of lines between them.

SQL functions only; nothing leaves the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import let
from pagelake.llm.common import stored, whole_text

#: White space that is stripped off a line's ends (a fixed value).
BLANKS = " \t\n\x0b\f\r"
#: At most so many hashes are broadcast; see :func:`_held`.
HOT = 20_000


def lines_of(text: Column) -> Column:
    """The text cut at every line feed; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """The lines stripped and with A-Z in lower case, in order."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.transform(lines_of(lowered), lambda line: F.trim(line, F.lit(BLANKS)))


def _hashes(text: Column, min_chars: int) -> Column:
    """Per line the key's 128-bit hash, null for a key that is too short to count."""
    return F.transform(line_keys(text), lambda key: F.when(F.length(key) >= min_chars, F.md5(key)))


def _held(placed: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose hash is in ``frequent(hash, docs)``.

    A hash that holds at least a ``HOT``-th of all counted rows is one of ``HOT`` at most,
    whatever the size of the data: those are broadcast, so that no task gets all rows of
    a common line. The others have few rows each and meet in a plain join.
    """
    total = frequent.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    hot = F.broadcast(frequent.filter(F.col("docs") * HOT >= total).select("hash"))
    rest = frequent.filter(F.col("docs") * HOT < total).select("hash")
    common = placed.join(hot, "hash", "left_semi")
    return common.union(placed.join(hot, "hash", "left_anti").join(rest, "hash", "left_semi"))


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without those at the positions ``dropped`` (from 0, rising), joined.

    The runs between dropped lines are cut out as slices: linear in the lines.
    """
    begins = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda at: at + 1))
    ends = F.concat(dropped, F.array(F.size(lines)))
    runs = F.zip_with(begins, ends, lambda begin, end: F.slice(lines, begin + 1, end - begin))
    return F.array_join(F.flatten(runs), "\n")


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` per row of ``docs(doc_id, text, ...)``.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of
    at least ``min_chars`` code points that occur in at least ``min_docs`` documents lose
    all their lines in every document; the other lines stay as they are, joined by line
    feeds. ``n_lines`` counts before dropping.

    Every row is a document of its own, so a row that is there ten times counts ten
    times. A null text is an empty one, which is one empty line. Rows without an id are
    documents like others. Other columns are left out; no documents give no rows. Texts
    are told apart by their id and a 128-bit hash, and keys by a 128-bit hash.
    """
    text = whole_text()
    named = docs.select("doc_id", text.alias("text"), F.md5(text).alias("print"))
    hashed = stored(
        named.select("doc_id", "print", _hashes(F.col("text"), min_chars).alias("hashes")), "line-hashes"
    )
    counted = hashed.select(F.explode(F.array_distinct("hashes")).alias("hash")).filter("hash is not null")
    counted = counted.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"))
    frequent = stored(counted.filter(F.col("docs") >= min_docs), "line-counts")
    placed = hashed.select("doc_id", "print", F.posexplode("hashes").alias("pos", "hash"))
    held = _held(placed.filter("hash is not null"), frequent)
    dropped = held.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print"))
    # The narrow side is hashed, so the texts need no sort.
    met = named.join(dropped.hint("shuffle_hash"), same, "left")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    cut = let(
        lines_of(F.col("text")),
        lambda lines: F.struct(F.size(lines).cast("long").alias("n_lines"), _without(lines, gone).alias("kept")),
    )
    return met.select("doc_id", cut.alias("cut"), F.size(gone).cast("long").alias("n_dropped")).select(
        "doc_id", "cut.n_lines", "n_dropped", "cut.kept"
    )


def line_digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """:func:`without_common_lines` with the kept text's SHA-256 in place of the text."""
    return without_common_lines(docs, min_docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = """
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from split),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
common as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (common.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (common.key is null), '')) as kept_sha256
from keyed left join common on keyed.key = common.key
group by doc_id
"""
