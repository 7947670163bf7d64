from __future__ import annotations

import itertools
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import queries
from brindle.llm import toxicity as X

WORDS = ["idiot", "scum", "worthless", "the", "river", "runs", "north", "and", "stone", "holds", "water", "tall", "ídolo", "straße"]


def corpus(rng, n=400):
    """Documents of plain words; every fourth has insults. Returns (doc_id, text) and (doc_id, toxic)."""
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = list(rng.choice(WORDS[3:], 30)) + (list(rng.choice(WORDS[:3], 2)) if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus(np.random.default_rng(1))
    return X.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_language_model_counts(spark):
    texts = ["The  cat, the CAT", None, "", "a", "Straße 9 straße", "x" * 9]
    want: Counter = Counter()
    for t in texts:
        letters = "".join(c if c.isalpha() else " " for c in f" {t or ''} ".lower())
        letters = " ".join(letters.split(" ")).replace("  ", " ").replace("  ", " ").replace("  ", " ")
        k = [0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 13 for c in letters]
        want.update(zip(k, k[1:], k[2:], k[3:], strict=False)) if t else None
    got = {tuple((r["gram"] // X.CLASSES**i) % X.CLASSES for i in (3, 2, 1, 0)): r["n"] for r in X.grams(spark.createDataFrame([(t, 1) for t in texts], "text string, n int")).collect()}
    assert got == dict(want)
    bits = X.costs(np.random.default_rng(0).integers(0, 9, X.CLASSES**4))
    assert np.allclose((2.0 ** -bits.astype(float)).sum(-1), 1, atol=1e-4)


@pytest.mark.parametrize("piece", ["1d10t", "w0rthl355", "scuuum", "i d1 o t", "5tr@ße", "*!x", "aaaa", "b.l.1"])
def test_viterbi_against_all_readings(model, piece):
    stretches = X.lattice(piece)
    found = []
    for choice in itertools.product(*stretches):
        text, price, state = "".join(c[0] for c in choice), sum(c[1] for c in choice), (0, 0, 0)
        for x in [*text, None]:
            k = 0 if x is None else int(X._classes()[ord(x)])
            price, state = price + float(model.bits[(*state, k)]), (*state[1:], k)
        found.append((round(price, 4), text))
    best = X.readings(stretches, model.bits, 1)[0]
    assert min(p for p, t in found if t == best) <= min(found)[0] + 1e-3


def test_disguised_words(spark, model):
    hidden = ["1d10t", "i d i o t", "i.d.i.o.t", "IDIOT!", "idiooot", "$cum", "5cuuum", "w0rthle55", "worth1ess,", "s-c-u-m", "idi0t.", "sc*m"]
    plain = ["the river runs", "stone 2024 holds 3 water", "a b and c", "www.stone.org", "tall!!! north", "", "..."]
    rows = [(i, f"the river {h} runs", 1) for i, h in enumerate(hidden)] + [(100 + i, p, 0) for i, p in enumerate(plain)]
    got = {r["doc_id"]: r for r in X.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()}
    assert [h for i, h in enumerate(hidden) if got[i]["score"] < 0.7] == []
    assert [p for i, p in enumerate(plain) if got[100 + i]["score"] >= 0.3] == []
    assert ("1d10t", "idiot") in [tuple(x) for x in got[0]["restored"]] and got[3]["restored"] == []


def test_noisy_or_finds_the_cause():
    """One cause in all toxic texts, each beside words of its own; clean texts hold the common words."""
    documents = [np.array([0, 1, 2 + i % 5]) for i in range(50)]
    p, leak = X.fit(documents, np.array([50.0, 50, 10, 10, 10, 10, 10]), np.array([0.0, 400, 3, 3, 3, 3, 3]), 50, 400)
    assert p[0] > 0.9 and p[1:].max() < 0.05 and leak < 0.01


def test_odd_rows(spark, model):
    rows = [(1, None), (None, "idiot"), (2, ""), (3, "x1" * 70_000), (4, "the idiot"), (4, "the idiot"), (5, "퟿\U0001f600 1🙂3a" + "e" * 300_000)]
    docs = spark.createDataFrame([(*r, "z", 3) for r in rows], "doc_id long, text string, `a.b` string, RESTORED int")
    got = X.score(docs, model)
    assert got.columns == ["doc_id", "text", "a.b", "score", "restored"]
    scores = sorted((r["doc_id"] or 0, r["score"]) for r in got.collect())
    assert len(scores) == 7 and all(0 <= s <= 1 for _, s in scores) and scores[0][1] >= 0.7 and scores[-2][1] == scores[-3][1] >= 0.7
    assert X.score(docs.limit(0), model).count() == 0

    unlabelled = X.train(docs, spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int"))
    assert unlabelled.causes == {} and {r["score"] for r in X.score(docs, unlabelled).collect()} == {0.0}
    assert X.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).causes == {}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    got = queries.op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rate = {r["toxic"]: r["rate"] for r in got.groupBy("toxic").agg(F.avg("predicted").alias("rate")).collect()}
    assert rate[1] >= 0.8 and rate[0] <= 0.01


def test_query_scores_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op13_toxicity(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in got)
