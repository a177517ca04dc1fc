"""Operators over documents against plain Python on the same rows."""

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelake.llm import bpe, packing, sharding, simhash, toxicity
from pagelake.llm.bpe import load, ranks_of_tiktoken, ranks_of_tokenizer, roundtrip
from pagelake.llm.common import numbered, table
from pagelake.llm.components import components

RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
SAVED = str(public_tokenizers.path("byte_bpe_50k.json"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def documents(llm, sf):
    return table(llm, sf, "documents")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks_of_tiktoken(RANKS), special_tokens={})


# --- row numbers and components ----------------------------------------------------


def test_numbered(llm):
    rows = llm.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(100)], "a int, b int")
    got = numbered(rows, ["a"], "t", total="b").collect()
    got.sort(key=lambda r: r["row_no"])
    assert [r["row_no"] for r in got] == list(range(100))
    assert [r["b_before"] for r in got] == [sum(x["b"] for x in got[:i]) for i in range(100)]
    order = [(r["a"] is not None, r["a"] or 0) for r in got]
    assert order == sorted(order)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)] + [(100, 90), (90, 95), (7, 300)]])
def test_components(llm, edges):
    got = {r["node"]: r["component"] for r in components(llm.createDataFrame(edges, "u long, v long"), "t").collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for u, v in edges:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    assert got == want


# --- toxicity ----------------------------------------------------------------------


def test_toxicity_held_out(llm):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(llm, sf, "documents"), table(llm, sf, "labels")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    words = "idiot clown loser worthless scum moron pathetic stupid trash disgusting".split()
    rude = {r["doc_id"] for r in docs.filter(F.lower("text").rlike(r"\b(" + "|".join(words) + r")\b")).collect()}
    held = {i: r for i, r in got.items() if r["held_out"]}
    caught = [r["predicted"] for i, r in held.items() if i in rude]
    clean = [r["predicted"] for i, r in held.items() if i not in rude]
    assert np.mean(caught) >= 0.8 and np.mean(clean) <= 0.01


def test_toxicity_odd_rows(llm, odd_documents):
    labels = llm.createDataFrame([(5, 0, 1), (3, 0, 0), (3, 1, 1), (None, 0, 1), (9, 1, None)],
                                 "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.toxicity(odd_documents, known).collect()
        assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(odd_documents.limit(0), labels).collect() == []


def test_ngrams_do_not_depend_on_the_window(monkeypatch):
    text = "Some  TEXT with\nwords and wörds " * 20
    whole = toxicity.buckets_of(text)
    monkeypatch.setattr(toxicity, "WINDOW", 17)
    assert (toxicity.buckets_of(text) == whole).all()


# --- byte-level BPE ----------------------------------------------------------------


def test_bpe_equals_merges(llm, documents, odd_documents, plain):
    for docs in (documents, odd_documents):
        got = roundtrip(docs, RANKS, PATTERN).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = plain.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids),
                         hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert roundtrip(documents.limit(0), RANKS, PATTERN).collect() == []


def test_bpe_pieces(plain):
    coder = load(RANKS, PATTERN)
    rng = np.random.default_rng(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "中", "1", "'s", "!", "😀", "\x00", "ing", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode_ordinary(text), repr(text)
    for text in ("ab" * 3000, "".join(rng.choice(list("etaoinsr"), 20_000)), "zq" * 10 + "é" * 999):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


def test_bpe_odd_blanks_take_linear_time(plain):
    """Gaps of several blanks everywhere; and no memo keeps long words."""
    coder = bpe.ByteBPE(ranks_of_tiktoken(RANKS), PATTERN)
    for text in ("a  b c   d\n e f  ", " a b", "a ", "", "  ", "a \n b  \t c d", "x y  z", "  a  " * 50, "a" + " " * 5000 + "b"):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode_ordinary(text)

    def seconds(text):
        started = time.perf_counter()
        coder.encode(text)
        return time.perf_counter() - started

    one, two = (min(seconds("a " + "b  " * n) for _ in range(3)) for n in (300_000, 600_000))
    assert two < 3 * one + 0.2
    coder.encode(" ".join("ab" * (40 + n) for n in range(200)))
    assert max(len(word) for memo in (coder.pieces, coder.encode.__self__.words) for word in memo) <= bpe.LONG


def test_bpe_small_vocabulary_with_unreachable_token():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259, b"cab": 260}
    from pagelake.llm.bpe import ByteBPE

    coder = ByteBPE(ranks, r"\S+|\s+")
    rng = np.random.default_rng(2)
    for _ in range(500):
        word = "".join(rng.choice(list("abcxyz"), rng.integers(1, 14)))
        if word in ("xyz",):
            assert coder.backtracked(word) == [259]
        else:
            assert coder.backtracked(word) == coder.merged(word) or ranks.get(word.encode()) is not None


def test_vocabulary_files_agree():
    assert ranks_of_tokenizer(SAVED) == ranks_of_tiktoken(RANKS)


# --- SimHash -----------------------------------------------------------------------


def brute_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius=3):
    parent = dict.fromkeys(prints)
    for p in parent:
        parent[p] = p

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {p: root(p) for p in keys}


def test_masks_cover():
    rng = np.random.default_rng(3)
    masks = simhash.masks(3)
    assert len(masks) == 15
    for _ in range(2000):
        differ = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & differ == 0 for m in masks)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_simhash(llm, documents, odd_documents, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    for docs in (documents, odd_documents):
        rows = docs.select("doc_id", "text").collect()
        prints = {}
        for r in rows:
            prints.setdefault(brute_fingerprint(r["text"]), []).append(r["doc_id"])
        root = brute_components(prints)
        least = {}
        for p, ids in prints.items():
            known = [i for i in ids if i is not None] + ([least[root[p]]] if least.get(root[p]) is not None else [])
            least[root[p]] = min(known) if known else None
        want = sorted(((i, f"{p:016x}", least[root[p]]) for p, ids in prints.items() for i in ids), key=str)
        got = sorted(map(tuple, simhash.near_duplicates(docs).drop("group").collect()), key=str)
        assert got == want


def test_simhash_dense_bucket(llm):
    """Fingerprints that all share most bits: one bucket, links only between near ones."""
    rng = np.random.default_rng(4)
    values = {int(x) for x in rng.integers(0, 1 << 14, 400)}
    reps = llm.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.near_links(reps, 3, "t")
    assert edges.filter("bit_count(u ^ v) > 3").count() == 0
    got = {r["node"]: r["component"] for r in components(edges, "t").collect()}
    want = brute_components(values)
    groups = lambda m: {frozenset(k for k in values if m.get(k, k) == v) for v in {m.get(k, k) for k in values}}
    assert groups(got) == groups(want)


# --- packing -----------------------------------------------------------------------


def check_pieces(rows, ids_of):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
    sizes = [sum(p["length"] for p in ps) for ps in by_sequence.values()]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding == 0
    if ids_of is not None:
        for (doc, tokens), pieces in by_doc.items():
            ids = np.array([*ids_of[doc], 0], "<u4")
            assert len(ids) == tokens
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
            assert at == tokens


def test_packing(llm, documents):
    saved = Tokenizer.from_file(SAVED)
    saved.encode_special_tokens = True
    rows = documents.select("doc_id", "text").collect()
    ids = {r["doc_id"]: saved.encode(r["text"] or "", add_special_tokens=False).ids for r in rows}
    check_pieces(packing.packed_digest(documents, SAVED, PATTERN).collect(), ids)


def test_packing_special_tokens(llm):
    texts = ["a<|endoftext|>b", "x \n <|endoftext|>  y", "<|endoftext|><|endoftext|>", "<|endoftext", "plain"]
    saved = Tokenizer.from_file(SAVED)
    ids = {n: saved.encode(t, add_special_tokens=False).ids for n, t in enumerate(texts)}
    assert ids[0] == [64, 50256, 65]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_tokens(packing.tokenized(docs, SAVED, PATTERN).collect(), ids)


def test_packing_long_runs_of_space(llm):
    texts = [" " * 1_200_000 + "x", "a" + "\n" * 1_200_000, "a" + " " * 1_200_000 + "<|endoftext|> b"]
    saved = Tokenizer.from_file(SAVED)
    ids = {n: saved.encode(t, add_special_tokens=False).ids for n, t in enumerate(texts)}
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_tokens(packing.tokenized(docs, SAVED, PATTERN).collect(), ids)


def check_tokens(rows, ids_of):
    assert len(rows) == len(ids_of)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*ids_of[r["doc_id"]], 0]
        assert r["tokens"] == len(ids_of[r["doc_id"]]) + 1


def test_packing_odd_rows(llm, odd_documents):
    got = packing.packed_digest(odd_documents, SAVED, PATTERN).collect()
    check_pieces(got, None)
    plain = tiktoken.Encoding("p", pat_str=PATTERN, mergeable_ranks=ranks_of_tokenizer(SAVED), special_tokens={})
    total = sum(len(plain.encode_ordinary(r["text"] or "")) + 1 for r in odd_documents.collect())
    assert sum(r["length"] for r in got) == total
    assert packing.packed_digest(odd_documents.limit(0), SAVED, PATTERN).collect() == []


def test_plan_places_everything():
    rng = np.random.default_rng(5)
    for histogram in (np.zeros(64, np.int64), rng.integers(0, 200, 64), np.eye(64, dtype=np.int64)[40] * 1001):
        histogram[0] = 3
        plan = packing.Plan(histogram, 64, 7)
        used = {}
        for length in range(1, 64):
            for rank in range(int(histogram[length])):
                at = 0
                for start, size, sequence, offset in plan.places(length, rank):
                    assert start == at
                    at += size
                    used.setdefault(sequence, []).append((offset, size))
                assert at == length
        for parts in used.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at == 64 or at & (at - 1) == 0
        assert sorted(used) == list(range(7, plan.sequences))


# --- sharding ----------------------------------------------------------------------


def test_sharding(llm, documents, odd_documents):
    for docs in (documents, odd_documents):
        got = sharding.sharded(docs, 24).collect()
        rows = docs.select("doc_id", "text").collect()
        raw = [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
        want = sorted(((i, len(t) + 8, zlib.crc32(t)) for i, t in raw), key=str)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["law"] == "rows" and r["grown_shard"] is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots.get(s, [])) for s in range(24)]
        assert max(counts) - min(counts) <= 1
        order = sorted(raw, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), zlib.crc32(x[1])))
        by_place = {(r["shard"], r["slot"]): (r["doc_id"], r["text_crc32"]) for r in got}
        for number, (doc, text) in enumerate(order):
            place = sharding.shard_and_slot(number, len(order), 24, "shuffle-1")
            assert by_place[place] == (doc, zlib.crc32(text))
            assert sharding.row_at(*place, len(order), 24, "shuffle-1") == number
    assert sharding.sharded(documents.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 997, 4096])
def test_permutation(rows):
    out = sharding.permuted(np.arange(rows), rows, "k")
    assert sorted(out.tolist()) == list(range(rows))
    assert (sharding.permuted(out, rows, "k", back=True) == np.arange(rows)).all()
