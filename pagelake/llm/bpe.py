"""Byte-level BPE by backtracking from longest matches, in time linear in the text.

Bytes are read as Latin-1 characters, so a trie over strings holds the vocabulary. From
the longest token at a place the encoder moves on if the pair with the token before it
is compatible, else it tries the next shorter token, else it takes the last token back.
Two tokens are compatible if merging their joined bytes gives just these two; a sequence
of tokens is what the merges produce exactly when all its neighbours are compatible.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import whole_text

KEPT = 300_000  # memoised pieces in each half of a memo; results do not depend on it
KEPT_PAIRS = 1 << 20
LONG = 64  # longer words are not remembered, which bounds the bytes a memo holds


def ranks_of_tiktoken(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def ranks_of_tokenizer(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a byte-level BPE file of the tokenizers library.

    Added special tokens are left out: their strings are ordinary text.
    """
    with open(path, encoding="utf-8") as file:
        saved = json.load(file)
    special = {t["content"] for t in saved.get("added_tokens", [])}
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    vocabulary = saved["model"]["vocab"]
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}


_NONE = 1 << 40


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """A dictionary of bounded size: what was not asked for since half of it filled goes."""

    def __init__(self, kept: int = KEPT):
        super().__init__()
        self.kept = kept
        self.older: dict[str, bytes] = {}

    def recall(self, key: str) -> bytes | None:
        """An older value, made recent again."""
        value = self.older.get(key)
        return None if value is None else self.put(key, value)

    def put(self, key: str, value: bytes) -> bytes:
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordCoder:
    """Codes whole texts word by word, remembering words, by any exact coder of texts."""

    def __init__(self, encode_exact: Callable[[str], bytes], kept: int = KEPT):
        self.encode_exact = encode_exact
        self.words = Memo(kept)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers.

        No match of the pattern runs over a blank that stands between two characters
        other than white space, so the text is cut there and the parts are remembered.
        """
        first, *parts = text.split(" ")
        found = list(map(self.words.get, parts))
        if not first or first[-1].isspace():
            return self._with_odd_blanks([first, *parts])
        if None in found:
            for i, part in enumerate(parts):
                if found[i] is None:
                    if not part or part[0].isspace() or part[-1].isspace():
                        return self._with_odd_blanks([first, *parts])
                    found[i] = self._word(part)
        return self.encode_exact(first) + b"".join(found)

    def _word(self, part: str) -> bytes:
        if len(part) > LONG:
            return self.encode_exact(" " + part)
        known = self.words.get(part) or self.words.recall(part)
        return known or self.words.put(part, self.encode_exact(" " + part))

    def _with_odd_blanks(self, parts: list[str]) -> bytes:
        """The same where other white space adjoins a blank: such parts stay together."""
        out, held, start = [], [parts[0]], True

        def coded() -> bytes:
            return self.encode_exact(" ".join(held)) if start else self._word(held[0])

        for part in parts[1:]:
            last = held[-1]
            if last and part and not last[-1].isspace() and not part[0].isspace():
                out.append(coded())
                held, start = [part], False
            else:
                held = held if start else ["", *held]
                held.append(part)
                start = True
        out.append(coded())
        return b"".join(out)


class ByteBPE:
    """Encoder and decoder for a vocabulary whose ids are the merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pieces_of = regex.compile(pattern).findall
        self.widest = max(map(len, self.ranks), default=1)
        wide = max(self.bytes_of, default=0) + 1
        self.text = [""] * wide
        self.size = [0] * wide
        # By token: the two it is merged from (-1 for bytes), the longest token it begins with.
        self.left, self.right, self.shorter = ([-1] * wide for _ in range(3))
        self.made: dict[str, int] = {}  # any other token is only ever a whole piece
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            halves = self.merged(token, rank)
            if len(token) == 1 or len(halves) == 2:
                self.text[rank], self.size[rank], self.made[token] = token, len(token), rank
                self.trie.add_word(token, rank)
                if len(token) > 1:
                    self.left[rank], self.right[rank] = halves
        # The longest token each path of the trie begins with.
        self.begins: dict[str, int] = {}
        for token, rank in self.made.items():
            last = -1
            for k in range(1, len(token) + 1):
                self.shorter[rank] = last
                last = self.begins[token[:k]] = self.made.get(token[:k], last)
        self.pairs: dict[int, bool] = {}
        self.pieces = Memo()
        self.encode = WordCoder(self.encode_exact).encode

    def merged(self, piece: str, below: int = _NONE) -> list[int]:
        """The merges of ranks under ``below`` done one by one: lowest first, then leftmost."""
        parts = list(piece)
        rank = self.ranks.get
        while len(parts) > 1:
            found = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best >= below:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep two neighbouring tokens apart.

        The tokens' merges are undone from the seam, the latest first. If what then meets
        at the seam could merge before the merge just undone, the tokens would not have
        come to be; of equal ranks the merge further left comes first.
        """
        limit, text, rank = _NONE, self.text, self.ranks.get
        while True:
            joined = rank(text[left] + text[right])
            if joined is not None and joined < limit:
                return False
            if self.left[left] >= 0 and (left > right or self.left[right] < 0):
                limit, left = left, self.right[left]
            elif self.left[right] >= 0:
                limit, right = right + 1, self.left[right]
            else:
                return True

    def backtracked(self, piece: str) -> list[int]:
        """Ids of a Latin-1 piece."""
        whole = self.ranks.get(piece)
        if whole is not None or not piece:
            return [whole] if piece else []
        longest, begin, pairs = self.trie.longest_prefix, self.begins.__getitem__, self.pairs
        size, shorter, widest, end = self.size, self.shorter, self.widest, len(piece)
        dead = bytearray(end + 1)  # places from which no compatible rest exists
        ids: list[int] = []
        ahead = piece[:widest]
        at, token = 0, begin(ahead[: longest(ahead)])
        while True:
            while token >= 0:
                stop = at + size[token]
                if not dead[stop]:
                    if not ids:
                        break
                    pair = ids[-1] << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(ids[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = stop
                if at == end:
                    return ids
                ahead = piece[at : at + widest]
                token = begin(ahead[: longest(ahead)])
            else:
                dead[at] = 1
                token = ids.pop()
                at -= size[token]
                token = shorter[token]

    def encode_exact(self, text: str) -> bytes:
        """Ids of a text, each match of the pattern by itself, as 32-bit little-endian."""
        found = self.pieces_of(text)
        known = list(map(self.pieces.get, found))
        if None in known:
            for i, piece in enumerate(found):
                if known[i] is None:
                    known[i] = self.pieces.get(piece) or self.pieces.recall(piece) or self._piece(piece)
        return b"".join(known)

    def _piece(self, piece: str) -> bytes:
        ids = as_bytes(self.backtracked(piece.encode().decode("latin-1")))
        return ids if len(piece) > LONG else self.pieces.put(piece, ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The coder for a vocabulary file, once per Python worker."""
    ranks = ranks_of_tokenizer(path) if path.endswith(".json") else ranks_of_tiktoken(path)
    return ByteBPE(ranks, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``: the whole text's ids, little-endian 32-bit.

    Null texts count as empty and have no ids. The vocabulary file lies at ``path`` on
    every worker, as an installed package does.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(path, pattern)
        for batch in batches:
            batch["ids"] = [coder.encode(t) for t in batch.pop("_text")]
            yield batch

    fields = [*(docs.schema[k] for k in keep), T.StructField("ids", T.BinaryType())]
    return docs.select(*keep, whole_text().alias("_text")).mapInPandas(run, T.StructType(fields))


def roundtrip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``.

    The text is encoded, the ids are written in decimal, read as ids, and decoded. A null
    or empty text has no tokens and the digests of no bytes. Repeated rows are all
    coded; extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(path, pattern)
        decimal = [str(i) for i in range(max(coder.bytes_of, default=0) + 1)]
        for batch in batches:
            counts, written, back = [], [], []
            for text in batch["_text"]:
                ids = np.frombuffer(coder.encode(text), "<u4").tolist()
                counts.append(len(ids))
                line = " ".join(map(decimal.__getitem__, ids))
                written.append(hashlib.sha256(line.encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts,
                                "ids_sha256": written, "decoded_sha256": back})

    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select("doc_id", whole_text().alias("_text")).mapInPandas(run, T.StructType(fields))
