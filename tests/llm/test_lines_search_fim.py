"""Line dedup, ranked lexical search and fill-in-middle against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.llm import fim, lexical, queries
from pagelake.llm.linededup import line_digest, without_common_lines

BLANKS = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_linededup", "op12_lexical", "op13_fim"])
def test_sql(llm, sf, name):
    equal, note, rows = compare(llm, connect(sf), sf, queries.QUERIES[name], queries.SQL[name])
    assert equal, note
    assert rows


# --- line dedup -----------------------------------------------------------------------


def plain_lines(rows, least):
    keys = lambda text: [line.strip(BLANKS).translate(UPPER) for line in text.split("\n")]
    held = Counter(key for _, text in rows for key in set(keys(text or "")) if key)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line, key in zip(lines, keys(text or ""), strict=True) if held[key] < least or not key]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_lines(llm):
    rows = [(k, f"own {k}\n  Common\tline \x0b\nother {k % 3}\n\nÄ {k % 2}") for k in range(12)]
    rows += [(20, None), (21, ""), (22, "common\tline"), (22, "common\tline"), (None, "COMMON\tLINE\nx")]
    rows += [(23, "\n\n"), (24, "ä 0\nother 0\rother 0"), (25, "\n".join(f"l{k}" for k in range(40_000)) + "\nother 1")]
    rows += [(26, "common\tline\nown 1\ncommon\tline\n\ncommon\tline")]
    docs = llm.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, hash int")
    for least in (1, 2, 4, 10, 100):
        got = Counter(tuple(r) for r in without_common_lines(docs, least).collect())
        assert got == plain_lines(rows, least), least


def test_lines_of_hot_and_cold_keys(llm, monkeypatch):
    """Common lines that are broadcast and those that are joined lose their lines alike."""
    from pagelake.llm import linededup

    rows = [(k, f"all\nhalf {k % 2}\ntenth {k % 10}\nown {k}") for k in range(200)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    for hot in (2, 8, 1_000_000):
        monkeypatch.setattr(linededup, "HOT", hot)
        got = Counter(tuple(r) for r in without_common_lines(docs, 10).collect())
        assert got == plain_lines(rows, 10)


def test_lines_odd(llm, odd_documents):
    assert line_digest(odd_documents.limit(0)).collect() == []
    got = line_digest(odd_documents, 2)
    assert got.count() == odd_documents.count()
    empty = [r for r in got.collect() if r.doc_id in (8, 9)]
    assert {(r.n_lines, r.n_dropped, r.kept_sha256) for r in empty} == {(1, 0, sha(""))}


def test_lines_run_no_python(llm, sf):
    plan = queries.op11_linededup(llm, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- ranked lexical search ------------------------------------------------------------


def plain_ranks(docs, items, k):
    found = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    counts = [(doc_id, Counter(found((text or "").translate(UPPER)))) for doc_id, text in docs]
    counts = [(doc_id, c) for doc_id, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    out = []
    for item_id, text in set(items):
        wanted = Counter(found((text or "").translate(UPPER)))
        scored = []
        for doc_id, c in counts:
            m = 75 + (25 * sum(c.values()) * total) // length
            score = 0
            for term, n in wanted.items():
                if c[term]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                    score += n * w * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * m))
            if score:
                scored.append((-score, doc_id is None, doc_id))
        ranked = sorted(scored, key=lambda one: (one[0], one[1], one[2] or 0))[:k]
        out += [(item_id, n, doc_id, -score) for n, (score, _, doc_id) in enumerate(ranked, 1)]
    return Counter(out)


@pytest.mark.parametrize("limits", [(1 << 14, 1 << 20, 1 << 15, 1 << 16), (7, 1 << 20, 30, 1), (50, 300, 1 << 15, 90)])
def test_ranks(llm, monkeypatch, limits):
    """Ties across segments, repeated terms and rows, null and empty texts, long texts."""
    for name, value in zip(("DOCS", "POSTINGS", "BLOCK", "PAIRS"), limits, strict=True):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical, "CHUNK", 50)
    draw = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)] + ["Über", "ÜBER", "x1y", "naïve", "é"]
    odds = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(draw.choice(words, n, p=odds / odds.sum()))
    docs = [(int(k), text(draw.integers(0, 60))) for k in draw.permutation(120)]
    docs += [(1000 - k, "W3 the same-text  w5.") for k in range(40)]  # a group of copies
    docs += [(7, "w1 w1"), (7, "w1 w1"), (None, "w9 w9 w3"), (None, None), (2000, ""), (2001, " \n-"), (2002, "q " * 3000)]
    items = [(1, "w3 W3 w5 w50"), (2, text(30)), (3, text(300)), (4, "absent"), (5, None), (6, ""), (7, "q w1 é"), (7, "q w1 é")]
    df = llm.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, term string").repartition(3)
    asked = llm.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    for k in (1, 20):
        got = [tuple(r) for r in lexical.ranked(df, asked, k).select("item_id", "rank", "doc_id", "score").collect()]
        assert Counter(got) == plain_ranks(docs, items, k)


def test_ranks_of_nothing(llm):
    docs = llm.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = llm.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical.ranked(docs.limit(0), items).collect() == []
    assert lexical.ranked(docs, items.limit(0)).collect() == []
    assert lexical.ranked(docs, items).dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_intervals_are_cut_off(llm):
    """Bounds leave most documents unscored, and the best are found all the same."""
    draw = np.random.default_rng(5)
    found = [Counter({f"w{k}": 1 for k in draw.zipf(1.5, 40) if k < 5000}) for _ in range(4000)]
    df = Counter(term for c in found for term in c)
    wanted = Counter({"w1": 1, "w2": 2, "w40": 1, "w41": 1})
    total = sum(sum(c.values()) for c in found)
    weights = {t: math.floor(1000 * math.log((2 * 4000 + 2) / (2 * df[t] + 1))) for t in wanted}
    numbers = {t: n for n, t in enumerate(wanted)}
    lists = []
    for term, n in numbers.items():
        docs = np.array([d for d, c in enumerate(found) if c[term]])
        lists.append((n, docs, np.array([found[d][term] for d in docs])))
    lengths = np.array([sum(c.values()) for c in found])
    held = lexical.Postings(lists, lengths, {numbers[t]: w for t, w in weights.items()}, total, 4000)
    repeats = np.array(list(wanted.values()))
    best, scored = lexical.search(held, np.arange(4000), np.arange(4), repeats, lexical.NOTHING, 20)
    plain = np.zeros(4000, np.int64)
    for n, docs, counts in lists:
        m = 75 + 25 * lengths[docs] * 4000 // total
        plain[docs] += repeats[n] * weights[list(wanted)[n]] * (10**9 * counts // (1000 * counts + 12 * m))
    order = np.lexsort((np.arange(4000), -plain))[:20]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == plain[order].tolist()
    assert scored < 1000


# --- fill-in-middle -------------------------------------------------------------------


def plain_fim(doc_id, text, plain_share=10, spm_share=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain_share:
        return doc_id, len(units), "plain", None, None, text, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_share else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), out, text


PIECE = st.sampled_from(["a", "Zz", " ", "<", ">", "P", "<P", "S>", "<M>", "é", "中", "😀", "\x00", "\n", "12"])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(PIECE, max_size=12).map("".join), min_size=1, max_size=8), window=st.integers(1, 40))
def test_fim_arrays(texts, window):
    """Any batch in windows of any size, and back from outputs and forms alone."""
    kept, fim.WINDOW = fim.WINDOW, window
    try:
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        digests = [hashlib.sha256(f"1:{k}".encode()).hexdigest() for k in range(len(texts))]
        h = np.array([[int(d[8 * j : 8 * j + 8], 16) for j in range(4)] for d in digests])
        out, starts, units, form, prefix, middle = fim.transform(data, offsets, h, 10, 20, fim.Marks())
        for k, text in enumerate(texts):
            want = plain_fim(k, text)
            got = out[starts[k] : starts[k + 1]].tobytes().decode()
            assert (got, units[k], fim.FORMS[form[k]]) == (want[5], want[1], want[2])
            if form[k] != fim.PLAIN:
                assert (prefix[k], middle[k]) == want[3:5]
        assert fim.inverse(out, starts, form, fim.Marks())[0].tobytes() == data.tobytes()
    finally:
        fim.WINDOW = kept


def test_fim(llm, odd_documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    rows += [(k, f"text {k} <P> and <" * (k % 3)) for k in range(30, 60)] + [(70, "<S"), (71, ">"), (None, None)]
    docs = llm.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, n int")
    want = Counter(plain_fim(*r) for r in rows)
    got = fim.with_restored(fim.fill_in_middle(docs))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    digest = Counter(tuple(r) for r in fim.fim_digest(docs).collect())
    assert digest == Counter((*r[:5], sha(r[5]), sha(r[6])) for r in want.elements())
    assert fim.fim_digest(docs.limit(0)).collect() == []


def test_fim_rejects_outputs_of_other_marks(llm):
    bad = llm.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")
    with pytest.raises(Exception, match="does not hold"):
        fim.with_restored(bad).collect()


def test_restored_counts(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    back = fim.with_restored(fim.fill_in_middle(docs)).join(docs, "doc_id")
    assert back.filter(F.col("restored") != F.coalesce("text", F.lit(""))).count() == 0
    forms = defaultdict(int, {r.form: r["count"] for r in back.groupBy("form").count().collect()})
    assert forms["psm"] > forms["spm"] > 0 and forms["plain"] > 0
