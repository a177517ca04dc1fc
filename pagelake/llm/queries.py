"""The operators' queries with production parameters, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pagelake.llm import covertree, fim, lexical, linededup, topk, warc
from pagelake.llm.bpe import roundtrip
from pagelake.llm.common import table
from pagelake.llm.htmltext import main_text
from pagelake.llm.packing import packed_digest
from pagelake.llm.pii import pii
from pagelake.llm.sharding import sharded
from pagelake.llm.simhash import near_duplicates
from pagelake.llm.toxicity import toxicity
from pagelake.session import work_path


def op1_toxicity(spark, sf):
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_warc(spark, sf):
    return warc.archived(table(spark, sf, "pages"), work_path(spark, "llm-warc"))


def op3_bpe(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return roundtrip(table(spark, sf, "documents"), str(path), public_tokenizers.PATTERN)


def op4_simhash(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


def op5_packing(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packed_digest(table(spark, sf, "documents"), str(path), public_tokenizers.PATTERN)


def op6_pii(spark, sf):
    return pii(table(spark, sf, "documents"))


def op7_covertree(spark, sf):
    return covertree.near_vectors(table(spark, sf, "embeddings"))


def op8_sharding(spark, sf):
    return sharded(table(spark, sf, "documents"))


def op9_htmltext(spark, sf):
    return main_text(table(spark, sf, "pages"))


def op10_topk(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_linededup(spark, sf):
    return linededup.line_digest(table(spark, sf, "documents"))


def op12_lexical(spark, sf):
    return lexical.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_fim(spark, sf):
    return fim.fim_digest(table(spark, sf, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_covertree": op7_covertree,
    "op8_sharding": op8_sharding,
    "op9_htmltext": op9_htmltext,
    "op10_topk": op10_topk,
    "op11_linededup": op11_linededup,
    "op12_lexical": op12_lexical,
    "op13_fim": op13_fim,
}

SQL = {
    "op2_warc": warc.ORACLE,
    "op7_covertree": covertree.ORACLE,
    "op10_topk": topk.ORACLE,
    "op11_linededup": linededup.ORACLE,
    "op12_lexical": lexical.ORACLE,
    "op13_fim": fim.ORACLE,
}
