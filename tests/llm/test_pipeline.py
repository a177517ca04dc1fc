"""The pipeline's stages against brute force on what each was given."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pagelake.llm import pii, queries, simhash, toxicity
from pagelake.llm.common import table
from test_text_operators import brute_components, brute_fingerprint, check_pieces

SF = "/root/testdata/sf0.001"


def test_registered():
    names = {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES}
    assert names == {str(n) for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.SQL) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "packing"]


@pytest.fixture(scope="module")
def steps(llm, tmp_path_factory):
    docs, out = table(llm, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(llm, docs, SF).write.parquet(path)
        docs = llm.read.parquet(path)
        out.append(docs)
    return out


def test_stages(llm, steps):
    documents = {r["doc_id"]: r for r in table(llm, SF, "documents").collect()}
    toxic = {r["doc_id"] for r in toxicity.toxicity(table(llm, SF, "documents"), table(llm, SF, "labels")).collect() if r["predicted"]}
    first, second, third, last = steps
    assert first.columns == second.columns == third.columns == list(corpus_pipeline.COLUMNS)
    assert {r["doc_id"]: r for r in first.collect()} == {i: r for i, r in documents.items() if i not in toxic}

    prints = {}
    for i, r in documents.items():
        if i not in toxic:
            prints.setdefault(brute_fingerprint(r["text"]), []).append(i)
    least = {}
    for p, root in brute_components(prints).items():
        least[root] = min(least.get(root, np.inf), *prints[p])
    assert {r["doc_id"]: r for r in second.collect()} == {i: documents[i] for i in least.values()}

    hidden = {r["doc_id"]: r["text"] for r in pii.pii(second, corpus_pipeline.KEY).collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in third.collect()} == {i: (t, len(t)) for i, t in hidden.items()}

    saved = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    check_pieces(last.collect(), {i: saved.encode(t, add_special_tokens=False).ids for i, t in hidden.items()})


def test_odd_rows_pass_all_stages(llm, odd_documents, tmp_path):
    names = {"row": "lang", "node": "source"}
    docs = odd_documents.withColumnsRenamed(names)
    for given in (docs, docs.limit(0)):
        now = given
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{given is docs}{n}")
            stage(llm, now, SF).write.parquet(path)
            now = llm.read.parquet(path)
        ids = {r["doc_id"] for r in now.collect()}
        assert ids == (set() if given is not docs else {None, 3, 8, 11, 12, 13})


def test_one_id_for_different_texts(llm):
    """Each group keeps one document, also where groups share their smallest id."""
    stories = [" ".join(f"{name}{n}" for n in range(200)) for name in ("red", "green", "blue")]
    rows = [(1, stories[0]), (1, stories[1]), (2, stories[1]), (1, stories[0]), (2, stories[2]), (None, stories[2]), (None, "a word")]
    docs = llm.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'a' as source", "length(text) as n_chars")
    got = corpus_pipeline.drop_near_copies(llm, docs, SF).collect()
    want = [(1, stories[0]), (1, stories[1]), (2, stories[2]), (None, "a word")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_run(llm, steps):
    got = corpus_pipeline.run(llm, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1].collect()))


def test_simhash_parameters():
    assert simhash.near_duplicates.__defaults__[:2] == (3, 3)
