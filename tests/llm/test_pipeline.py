from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import pii, queries, simhash
from tests.llm.test_decontam import brute as decontam_brute
from tests.llm.test_similar import groups


def test_stages_against_brute_force(spark, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "pii", "tokens"]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = stages["quality"](spark, docs, sf).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    good = [k for k, v in labels.items() if v == (1, 0)]
    assert kept.columns == columns and sum(k in ids for k in good) >= 0.95 * len(good) and sum(k in ids for k, v in labels.items() if v[0] == 0) <= 3

    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    roots = groups([t for _, t in rows])
    one = stages["near_dedup"](spark, kept, sf).cache()
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {rows[j][0] for j in roots}

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = decontam_brute([(r["doc_id"], r["text"]) for r in one.collect()], bench)
    clean = stages["decontaminate"](spark, one, sf).cache()
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {k for k, v in want.items() if not v[4]}

    hidden = stages["pii"](spark, clean, sf).cache()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert hidden.columns == columns
    for r in hidden.collect():
        assert r["text"] == pii.replace(before[r["doc_id"]])[0] and r["n_chars"] == len(r["text"])
        assert not set(re.findall(r"\S+@\S+\.com|\d{16}|\d+\.\d+\.\d+\.\d+", before[r["doc_id"]])) & set(r["text"].split())

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = stages["tokens"](spark, hidden, sf).collect()
    assert len(last) == hidden.count()
    for r in last:
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == t.encode(r["text"], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_run(spark, sf):
    assert 0 < corpus_pipeline.run(spark, sf).count() <= spark.read.parquet(f"{sf}/documents.parquet").count()


def test_stages_take_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text here " * 9, "en", "s", 1, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "x"), (1, "some text here " * 9, "en", "s", 1, "x")], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
        assert rows.columns[:6] == docs.columns
    assert rows.count() == 0


#: These read conversations: op11 gives their prefixes, op12 a row for each.
CONVERSATIONS = {"op11_trie", "op12_repair"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - CONVERSATIONS))
def test_queries_cover_every_document(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES[name](spark, sf)
    assert got.count() == docs.count() == got.select("doc_id").distinct().count()


def test_queries_cover_every_conversation(spark, sf):
    convs = {r["conv_id"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    repaired = [r["conv_id"] for r in queries.op12_repair(spark, sf).collect()]
    assert len(repaired) == len(convs) and set(repaired) == convs
    root = queries.op11_trie(spark, sf).where("depth = 0").collect()
    assert [(r["conv_id"], r["n_convs"], r["parent_conv_id"]) for r in root] == [(min(convs), len(convs), None)]


def test_fingerprint_of_no_words():
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
