"""Fill-in-middle: cut a text in three and write it as prefix, suffix, middle.

Texts are handled as the bytes of a whole batch. One scan finds where units begin; the
cuts are looked up in it. Each piece of a text moves by a constant number of bytes, so the
moves are written as differences at the pieces' beginnings; their running sum is every
byte's displacement, by which one scatter writes all outputs of the batch. The inverse
reads the pieces off the marks in the outputs and gathers the bytes back.

All arrays are made for a window of bytes at a time, so that a long text costs no more
than itself and its output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import whole_text

#: Bytes of the arrays handled at once, and of the texts taken together.
WINDOW = 1 << 20
GROUP = 1 << 22

FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)


class Marks(NamedTuple):
    """What stands before the prefix, the suffix and the middle.

    None may begin inside another or itself, which holds for ``<`` + letter + ``>``.
    """

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"


Flags = Callable[[int, int], np.ndarray]
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def _windows(n: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, WINDOW):
        yield lo, min(n, lo + WINDOW)


def count_before(flags: Flags, n: int, at: np.ndarray) -> np.ndarray:
    """How many of ``n`` bytes are flagged before each of the rising positions ``at``."""
    out = np.zeros(len(at), np.int64)
    total = 0
    for lo, hi in _windows(n):
        sums = np.concatenate([[0], np.cumsum(flags(lo, hi), dtype=np.int64)])
        i, j = np.searchsorted(at, [lo, hi])
        out[i:j] = total + sums[at[i:j] - lo]
        total += sums[-1]
    out[np.searchsorted(at, n) :] = total
    return out


def find_nth(flags: Flags, n: int, wanted: np.ndarray) -> np.ndarray:
    """Position of the flagged byte of each of the rising numbers; ``n`` beyond the last."""
    out = np.full(len(wanted), n, np.int64)
    total = 0
    for lo, hi in _windows(n):
        places = np.flatnonzero(flags(lo, hi))
        i, j = np.searchsorted(wanted, [total, total + len(places)])
        out[i:j] = lo + places[wanted[i:j] - total]
        total += len(places)
    return out


def unit_flags(data: np.ndarray, heads: np.ndarray) -> Flags:
    """Where units begin: a run of letters, or any other code point. ``heads``: texts' first bytes."""

    def flags(lo: int, hi: int) -> np.ndarray:
        part = data[lo:hi]
        letter = _LETTER[part]
        before = np.empty_like(letter)
        before[1:] = letter[:-1]
        before[0] = lo > 0 and _LETTER[data[lo - 1]]
        new = np.where(letter, ~before, (part & 0xC0) != 0x80)
        i, j = np.searchsorted(heads, [lo, hi])
        new[heads[i:j] - lo] = True
        return new

    return flags


def char_flags(data: np.ndarray) -> Flags:
    """Where code points begin."""
    return lambda lo, hi: (data[lo:hi] & 0xC0) != 0x80


def find_mark(data: np.ndarray, mark: bytes) -> np.ndarray:
    """All positions at which ``mark`` begins."""
    found = []
    for lo, hi in _windows(len(data) - len(mark) + 1):
        hit = data[lo:hi] == mark[0]
        for k, byte in enumerate(mark[1:], 1):
            hit &= data[lo + k : hi + k] == byte
        found.append(lo + np.flatnonzero(hit))
    return np.concatenate([np.zeros(0, np.int64), *found])


def _displacements(begins: np.ndarray, moves: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Per window the number of bytes that each byte moves by.

    Piece ``i`` begins at ``begins[i]`` (rising; empty pieces share a place) and moves by
    ``moves[i]``.
    """
    steps = np.diff(moves, prepend=0)
    carried = 0
    for lo, hi in _windows(n):
        i, j = np.searchsorted(begins, [lo, hi])
        differences = np.zeros(hi - lo, np.int64)
        np.add.at(differences, begins[i:j] - lo, steps[i:j])
        differences[0] += carried
        moved = np.cumsum(differences)
        carried = moved[-1]
        yield lo, hi, moved


def _put(out: np.ndarray, at: np.ndarray, mark: bytes) -> None:
    for k, byte in enumerate(mark):
        out[at + k] = byte


def transform(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, plain_share: int, spm_share: int, marks: Marks):
    """Outputs of the texts ``data[offsets[i]:offsets[i + 1]]``, and their figures.

    ``h`` has four numbers per text: two for the cuts, one for whether to cut at all, one
    for the form. Returns (output bytes, output offsets, units, form, prefix's and
    middle's code points).
    """
    n, begins, ends = len(data), offsets[:-1], offsets[1:]
    flags = unit_flags(data, begins[ends > begins])
    before = count_before(flags, n, offsets)
    units = np.diff(before)
    picked = np.sort(h[:, :2] % (units + 1)[:, None], axis=1)
    cuts = find_nth(flags, n, (before[:-1, None] + picked).ravel()).reshape(-1, 2)

    form = np.where(h[:, 3] % 100 < spm_share, SPM, PSM)
    form[(ends == begins) | (h[:, 2] % 100 >= 100 - plain_share)] = PLAIN
    for mark in marks:
        at = find_mark(data, mark)
        text = np.searchsorted(offsets, at, side="right") - 1
        form[text[at + len(mark) <= offsets[text + 1]]] = PLAIN
    cuts[form == PLAIN] = ends[form == PLAIN, None]  # all of it is prefix

    edges = np.column_stack([begins, cuts, ends])
    chars = np.diff(count_before(char_flags(data), n, edges.ravel()).reshape(-1, 4), axis=1)
    size = np.diff(edges, axis=1)
    p, s, m = (len(mark) * (form != PLAIN) for mark in marks)
    starts = np.concatenate([[0], np.cumsum(ends - begins + p + s + m)])
    first = starts[:-1]
    # spm: <S>suffix<P>prefix<M>middle; psm: <P>prefix<S>suffix<M>middle
    back = form == SPM
    prefix_at = first + p + np.where(back, s + size[:, 2], 0)
    suffix_at = first + s + np.where(back, 0, p + size[:, 0])
    middle_at = starts[1:] - size[:, 1]
    moves = np.column_stack([prefix_at, middle_at, suffix_at]) - edges[:, :3]

    out = np.empty(starts[-1], np.uint8)
    for lo, hi, moved in _displacements(edges[:, :3].ravel(), moves.ravel(), n):
        out[np.arange(lo, hi) + moved] = data[lo:hi]
    cut = form != PLAIN
    for at, mark in zip((prefix_at, suffix_at, middle_at), marks, strict=True):
        _put(out, at[cut] - len(mark), mark)
    return out, starts, units, form, chars[:, 0], chars[:, 1]


def inverse(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, marks: Marks):
    """The texts of outputs, from the outputs and their forms alone: (bytes, offsets).

    An output that is not plain holds each mark once, as its text held none.
    """
    n, begins, ends = len(data), offsets[:-1], offsets[1:]
    pieces = np.column_stack([begins, ends, ends, ends])  # begins of prefix, middle, suffix; end of the first piece
    cut = np.flatnonzero(form != PLAIN)
    at = []
    for mark in marks:
        places = find_mark(data, mark)
        text = np.searchsorted(offsets, places, side="right") - 1
        inside = (form[text] != PLAIN) & (places + len(mark) <= offsets[text + 1])
        if not np.array_equal(text[inside], cut):
            raise ValueError(f"an output that does not hold {mark!r} once")
        at.append(places[inside])
    prefix, suffix, middle = at
    p, s, m = map(len, marks)
    back = form[cut] == SPM
    size = np.column_stack([ends - begins, np.zeros((len(begins), 2), np.int64)])  # prefix, middle, suffix
    size[cut, 0] = np.where(back, middle, suffix) - (prefix + p)
    size[cut, 1] = ends[cut] - (middle + m)
    size[cut, 2] = np.where(back, prefix, middle) - (suffix + s)
    pieces[cut, 0], pieces[cut, 1], pieces[cut, 2] = prefix + p, middle + m, suffix + s

    starts = np.concatenate([[0], np.cumsum(size.sum(axis=1))])
    to = starts[:-1, None] + np.column_stack([np.zeros(len(size), np.int64), np.cumsum(size, axis=1)[:, :2]])
    moves = pieces[:, :3] - to
    out = np.empty(starts[-1], np.uint8)
    for lo, hi, moved in _displacements(to.ravel(), moves.ravel(), len(out)):
        out[lo:hi] = data[np.arange(lo, hi) + moved]
    return out, starts


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and offsets (from 0)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).cast(pa.binary()).cast(pa.string())


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``GROUP`` bytes of text, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = _bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + GROUP, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def _numbers(seed: str) -> list[Column]:
    """Four numbers from the id: the first groups of 8 digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: str = "1", plain_share: int = 10, spm_share: int = 20, marks: Marks = Marks()
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` per row of ``docs``.

    A text has ``n`` units, runs of A-Z and a-z or other single code points; its cuts and
    form depend on ``seed`` and doc_id alone. ``plain`` outputs are the text: those of
    empty texts, of texts that hold a mark, and of ``plain_share`` percent of all; their
    counts of code points are null. Of the others ``spm_share`` percent have the suffix
    first.

    A null text is an empty one, a null id counts as no digits, repeated rows get the
    same result, other columns are left out, and no documents give no rows.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, "text"):
            data, offsets = _bytes(batch.column("text"))
            h = np.column_stack([batch.column(f"h{k}").to_numpy() for k in range(1, 5)])
            out, starts, units, form, prefix, middle = transform(data, offsets, h, plain_share, spm_share, marks)
            plain = form == PLAIN
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(units),
                    pa.array([FORMS[k] for k in form], pa.string()),
                    pa.array(prefix, mask=plain),
                    pa.array(middle, mask=plain),
                    _texts(out, starts),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"), *_numbers(seed))
    return narrow.mapInArrow(work, schema)


def with_restored(outputs: DataFrame, marks: Marks = Marks()) -> DataFrame:
    """``outputs(form, output, ...)`` and ``restored``, the text rebuilt from these two columns."""
    schema = T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, "output"):
            data, offsets = _bytes(batch.column("output"))
            form = np.array([FORMS.index(name) for name in batch.column("form").to_pylist()])
            texts = _texts(*inverse(data, offsets, form, marks))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "restored"])

    return outputs.mapInArrow(work, schema)


def fim_digest(docs: DataFrame, seed: str = "1") -> DataFrame:
    """Outputs and texts rebuilt from them, both as SHA-256 of their UTF-8."""
    return with_restored(fill_in_middle(docs, seed)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


ORACLE = """
with hashed as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id::varchar) as h from documents),
cut as (
  select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
         ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
         ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
  from hashed),
placed as (
  select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                   or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from cut),
parts as (
  select doc_id, n, form, text, array_to_string(units[1:a], '') as p,
         array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:], '') as s
  from placed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
