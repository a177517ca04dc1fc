"""Vector searches and the archive against SQL and plain Python."""

import base64
import hashlib

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from pagelake.llm import covertree, queries, topk, warc
from pagelake.llm.common import table
from pagelake.session import work_path

ODD = [
    (0, [1.0, 0.0, 0.0], 1), (50, [2.0, 0.0, 0.0], 1), (100, [0.99, 0.01, 0.0], 1), (3, None, 1),
    (4, [None, 1.0, 0.0], 1), (5, [float("nan"), 1.0, 0.0], 1), (6, [0.0, 0.0, 0.0], 1), (7, [], 1),
    (8, [float("inf"), 0.0, 0.0], 1), (9, [0.0, 1.0, 0.0], 1), (10, [0.0, 1.0, 0.0], 1), (10, [0.0, 1.0, 0.0], 1),
    (None, [0.0, 1.0, 0.0], 1), (11, [1e-30, 0.0, 0.0], 1), (12, [0.0, 1.0], 1), (150, [-1.0, 0.5, 0.0], 1),
]


@pytest.fixture(scope="module")
def odd_vectors(llm):
    return llm.createDataFrame(ODD, "vec_id long, embedding array<float>, node int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(llm, sf, name):
    equal, note, rows = compare(llm, connect(sf), sf, queries.QUERIES[name], queries.SQL[name])
    assert equal and rows, note


def brute_links(rows, least=0.9):
    width = max((len(v) for _, v in rows if v), default=0)
    sound = [i for i, (_, v) in enumerate(rows)
             if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {}
    for i in sound:
        x = np.zeros(width)
        x[: len(rows[i][1])] = rows[i][1]
        unit[i] = x / np.linalg.norm(x)
    near = {i: {j for j in sound if j != i and unit[i] @ unit[j] >= least} for i in sound}
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(names) if names else None
        out.append((name, len(near.get(i, ())), root, name is not None and name == root))
    return out


def test_cover_tree_odd_rows(llm, odd_vectors):
    got = sorted(map(tuple, covertree.near_vectors(odd_vectors).collect()), key=str)
    assert got == sorted(brute_links([(r[0], r[1]) for r in odd_vectors.collect()]), key=str)
    assert covertree.near_vectors(odd_vectors.limit(0)).collect() == []


@pytest.mark.parametrize("block,leaves", [(4096, 1024), (40, 1024), (40, 1)])
def test_cover_tree_clusters(llm, monkeypatch, block, leaves):
    """Tight clusters (counted whole), loose ones and noise, over one and many trees."""
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "LEAVES", leaves)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    spread = [0.001, 0.02, 0.1, 0.2, 0.4, 0.8]
    rows = [(n * 7 % 1009, (centres[n % 6] + rng.normal(size=8) * spread[n % 6]).astype("float32").tolist()) for n in range(300)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(map(tuple, covertree.near_vectors(df).collect()))
    assert got == sorted(brute_links(rows))


def brute_top(rows, k=5):
    width = max((len(v) for _, v in rows if v), default=0)
    sound = []
    for name, v in rows:
        if name is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            sound.append((name, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] + [0] * (width - len(v))))
    out = []
    for q, v in sound:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), n) for n, w in sound if n != q)
            out += [(q, r + 1, n, -s) for r, (s, n) in enumerate(scored[:k])]
    return out


def test_top_k_odd_rows(llm, odd_vectors):
    got = sorted(map(tuple, topk.top_k(odd_vectors, F.col("vec_id") % 50 == 0).collect()))
    assert got == sorted(brute_top([(r[0], r[1]) for r in odd_vectors.collect()]))
    assert topk.top_k(odd_vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(odd_vectors.filter("vec_id = 50"), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("scale", [1.0, 2.0**18])
def test_top_k_prunes_without_loss(llm, monkeypatch, scale):
    """Short batches and several blocks of queries, so bounds prune; small and very large numbers; ties."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 1000)
    rng = np.random.default_rng(7)
    values = rng.normal(size=(400, 40)) * np.geomspace(1, 0.01, 40) * scale
    values[100:200] = values[:100]
    rows = [(n, v.astype("float32").tolist()) for n, v in enumerate(values)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>")
    before = llm.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, first=20).collect()))
    finally:
        llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(brute_top(rows))


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_bounds_save_work(scale):
    """On random directions, the worst case, bounds leave out a third of the products and no row."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(4000, 64))
    vectors = np.floor(vectors / np.linalg.norm(vectors, axis=1)[:, None] * 256 * scale).astype(np.int64)
    vectors[7] = vectors[2000]
    vectors[50] = 0
    ids = rng.permutation(4000).astype(np.int64)
    state = topk.Search(ids[:60], vectors[:60], 5)
    for start in range(0, 4000, 500):
        state.offer(ids[start : start + 500], vectors[start : start + 500])
    for n, row in enumerate(vectors[:60] @ vectors.T):
        best = sorted((-int(score), int(i)) for score, i in zip(row, ids) if i != ids[n])[:5]
        assert [(-s, i) for s, i in zip(state.scores[n].tolist(), state.found[n].tolist())] == best
    assert state.done < 0.67 * state.full


def test_top_k_bounds_save_work_on_given_vectors(llm):
    given = table(llm, "/root/testdata/sf0.1", "embeddings")
    rows = given.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v")).toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["v"])
    state = topk.Search(ids[ids % 50 == 0], vectors[ids % 50 == 0], 5)
    for start in range(0, len(ids), 500):
        state.offer(ids[start : start + 500], vectors[start : start + 500])
    assert state.done < 0.75 * state.full


# --- archive -----------------------------------------------------------------------

PAGES = [
    (4, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (9, None, None), (3, "http://b\r\nX: y", ""),
    (None, "http://c", "<p>é</p>"), (5, "http://d", "x" * 200_000), (6, "http://e", "a\r\n\r\nb\r\n\r\n"), (6, "http://e", "a\r\n\r\nb\r\n\r\n"),
]


def test_archive_odd_rows(llm):
    pages = llm.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record", F.lit(1))
    got = warc.archived(pages, work_path(llm, "t")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (len((t or "").encode()), digest(t)) for _, _, t in PAGES)
    told = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert told == sorted([
        (2, "response", None), (4, "revisit", 2), (None, "revisit", 2), (3, "response", None), (9, "revisit", 3),
        (5, "response", None), (6, "response", None), (6, "revisit", 6)], key=str)
    small = warc.archived(pages, work_path(llm, "t"), min_bytes=10)
    assert sorted((r["page_id"], r["refers_to"]) for r in small.filter("record_type = 'revisit'").collect()) == [(6, 6)]
    assert warc.archived(pages.limit(0), work_path(llm, "t")).collect() == []


def test_archive_records_are_whole(llm, sf):
    pages = table(llm, sf, "pages")
    path = work_path(llm, "t")
    pages = pages.union(pages.withColumn("page_id", F.col("page_id") + 1000))
    warc.write_archive(pages, path)
    assert llm.read.parquet(f"{path}/payloads").count() == pages.select("html").distinct().count()
    rows = warc.read_archive(llm, path).collect()
    assert len(rows) == pages.count()
    html = {r["page_id"]: r["html"].encode() for r in pages.collect()}
    for r in rows:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and block.endswith(b"\r\n\r\n")
        lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = block[:-4]
        assert len(block) == int(lines[b"Content-Length"])
        page = int(lines[b"WARC-Record-ID"].split(b":")[2])
        body = block.split(b"\r\n\r\n", 1)[1]
        assert body == (b"" if r["revisit"] else html[page])


def test_archive_tells_a_changed_payload(llm, sf):
    path = work_path(llm, "t")
    warc.write_archive(table(llm, sf, "pages"), path)
    changed = llm.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    broken = work_path(llm, "t")
    changed.write.parquet(f"{broken}/payloads")
    llm.read.parquet(f"{path}/heads").write.parquet(f"{broken}/heads")
    with pytest.raises(Exception, match="payload is not what its digest says"):
        warc.read_archive(llm, broken).collect()
