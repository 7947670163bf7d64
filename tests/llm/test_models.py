from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import langid as L
from brindle.llm import quality as Q
from brindle.llm import words as W


def norm(t):
    out = [32, 32, 32]
    for b in t.lower().encode():
        b = b if 97 <= b <= 122 or b >= 128 else 32
        if b != 32 or (len(out) > 3 and out[-1] != 32):
            out.append(b)
    return out


def tree(texts):
    c = defaultdict(lambda: defaultdict(int))
    for t in texts:
        s = norm(t)
        for i in range(3, len(s)):
            for k in range(4):
                c[tuple(s[i - k : i])][s[i]] += 1
    return c


def bits(c, t):
    s, total = norm(t), 0.0
    for i in range(3, len(s)):
        for k in (3, 2, 1, 0):
            ctx = c.get(tuple(s[i - k : i]))
            if not ctx:
                continue
            n, d = sum(ctx.values()), len(ctx)
            if s[i] in ctx:
                total -= math.log2(ctx[s[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


EN = ["the quick brown fox jumps over the lazy dog", "and then there was the other thing", "this is what they wanted to have"]
DE = ["der schnelle braune fuchs springt über den faulen hund", "und dann war da noch die andere sache", "das ist was sie haben wollten"]


def test_code_lengths_equal_plain_ppm(spark):
    rows = spark.createDataFrame([(t, "en") for t in EN] + [(t, "de") for t in DE] + [(None, "en"), ("x", None)], "text string, lang string")
    model = L.train(rows)
    assert model.langs == ["de", "en"]
    texts = ["the dog", "der hund", "漢字 zzz", "ÜBER  --  99 the", "q", *EN]
    got = model.lengths(texts)
    for j, c in enumerate((tree(DE), tree(EN))):
        assert np.allclose(got[:, j], [bits(c, t) for t in texts], rtol=1e-5)


def test_long_texts_are_coded_in_blocks(monkeypatch, spark):
    rows = spark.createDataFrame([(t, "en") for t in EN] + [(t, "de") for t in DE], "text string, lang string")
    model, text = L.train(rows), " ".join((EN + DE) * 30) + " " * 90 + "end"
    want = model.lengths([text])
    monkeypatch.setattr(L, "BLOCK", 100)
    assert np.allclose(model.lengths([text]), want)
    again = L.train(rows.unionByName(rows.withColumn("text", F.repeat("text", 40))))
    monkeypatch.undo()
    whole = L.train(rows.unionByName(rows.withColumn("text", F.repeat("text", 40))))
    assert np.allclose(again.lengths(EN), whole.lengths(EN))


def test_pruning_keeps_the_bound_and_the_lower_orders(spark):
    rows = spark.createDataFrame([(t, "en") for t in EN * 5] + [(t, "de") for t in DE], "text string, lang string")
    model, whole = L.train(rows, grams_kept=30), L.train(rows)
    assert 20 <= len(model.trees[0].cost3) <= 90 and np.isfinite(model.lengths(EN + DE)).all()
    assert np.allclose(model.trees[0].cost1, whole.trees[0].cost1) and np.allclose(model.trees[0].escape2, whole.trees[0].escape2)


def test_fifty_languages(spark):
    """Each has its own letter pairs; with a bound far below its number of 4-grams all are still told apart."""
    rnd = random.Random(3)
    speech = {f"l{k:02d}": [rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") + rnd.choice("bdgklmnrst") for _ in range(40)] for k in range(50)}
    say = lambda one, n: " ".join(rnd.choice(speech[one]) + rnd.choice(speech[one]) for _ in range(n))
    rows = spark.createDataFrame([(say(one, 60), one) for one in speech for _ in range(6)], "text string, lang string")
    docs = [(k, one, say(one, 40)) for k, one in enumerate(speech)]
    for cells in (L.CELLS, 8 * 50 * 300):
        model = L.train(rows, cells=cells)
        assert len(model.langs) == 50 and len(model.trees) == 7
        got = model.lengths([t for _, _, t in docs])
        assert [model.langs[i] for i in got.argmin(1)] == [one for _, one, _ in docs]
    for one in ("l00", "l49"):
        c = tree([r["text"] for r in rows.where(F.col("lang") == one).collect()])
        whole = L.train(rows)
        assert np.allclose(whole.lengths(["the dog bagok", say(one, 9)])[0, whole.langs.index(one)], bits(c, "the dog bagok"), rtol=1e-5)


def test_predictions_and_odd_rows(spark):
    train = spark.createDataFrame([(t, "en") for t in EN] + [(t, "de") for t in DE], "text string, lang string")
    docs = spark.createDataFrame([(1, "the other dog"), (2, "die andere sache"), (3, None), (4, "12 !! 3"), (None, "they have"), (2, "die andere sache")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = L.predict(docs, L.train(train))
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got.collect()) == [("1", "en"), ("2", "de"), ("2", "de"), ("3", "und"), ("4", "und"), ("None", "en")]
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = L.predict(docs, L.train(train.limit(0)))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    assert L.predict(docs.limit(0), L.train(train)).count() == 0
    tie = L.train(spark.createDataFrame([("same", "b"), ("same", "a")], "text string, lang string"))
    assert L.predict(docs.limit(1), tie).first()["lang_pred"] == "a"


def test_held_out_accuracy(spark, sf):
    from brindle.llm import queries

    got = queries.op4_langid(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("lang IS NOT NULL")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()


def test_word_hashes():
    data = np.frombuffer(b"ab cd ab  x ab", np.uint8)
    starts, ends = W.runs(data != 32, np.array([0]))
    h = W.hashes(data, starts, ends)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    starts, ends = W.runs(np.ones(6, bool), np.array([0, 2, 6]))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 2), (2, 6)]


def graded(seed, n):
    """Good prose, prose with insults, and shouting."""
    rnd = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 120))]
        kind = rnd.choice([0, 1, 2, 2, 2])
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        if kind == 1:
            w.insert(rnd.randrange(len(w)), rnd.choice(["moron", "scum"]))
        out.append((i, " ".join(w), kind))
    return out


def test_ordinal_regression_orders_grades(spark):
    train, test = graded(1, 800), graded(2, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k > 0), int(k == 1)) for i, _, k in train], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    tails = model.tails(pa.array([t for _, t, _ in test]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    kind = np.array([k for _, _, k in test])
    assert (tails[kind == 2, 1] > Q.LEAST).mean() > 0.98 and (tails[kind == 0, 1] > Q.LEAST).mean() < 0.02 and (tails[kind == 1, 1] > Q.LEAST).mean() < 0.2
    means = [tails[kind == k].sum(1).mean() for k in (0, 1, 2)]
    assert means == sorted(means)
    assert np.allclose(Q.train(docs, labels).tails(pa.array([t for _, t, _ in test])), tails)


def test_gradient_is_the_loss_slope():
    """The fit is at a minimum: moving any threshold or a weight raises the penalised loss."""
    rows = graded(3, 200)
    cols, counts = Q.features(pa.array([t for _, t, _ in rows]))
    grades = np.array([k for _, _, k in rows])
    model = Q.fit(cols, counts, grades, rounds=300)
    owner = np.repeat(np.arange(len(counts)), counts)

    def loss(w, t):
        s = np.bincount(owner, w[cols], len(counts))
        up = np.concatenate([np.ones((len(s), 1)), 1 / (1 + np.exp(t[None, :] - s[:, None])), np.zeros((len(s), 1))], 1)
        p = up[np.arange(len(s)), grades] - up[np.arange(len(s)), grades + 1]
        return -np.log(p).sum() + Q.PENALTY / 2 * (w @ w)

    w, t = model.weights.astype(float), model.thresholds
    here = loss(w, t)
    for k in range(len(t)):
        for step in (-0.05, 0.05):
            moved = t.copy()
            moved[k] += step
            assert loss(w, moved) > here - 1e-3
    for c in np.flatnonzero(w)[:40]:
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[c] += step
            assert loss(moved, t) > here - 1e-3


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "good words"), (None, "x"), (3, "good words")], "doc_id long, text string").withColumn("tail", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (2, 1, None), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    assert Q.score(docs, model).count() == 5 and Q.score(docs.limit(0), model).count() == 0
    assert Q.select(docs, model).columns == docs.columns
    for none in (labels.limit(0), labels.where("doc_id = 1")):
        assert Q.train(docs, none) is None
    assert Q.select(docs, None).count() == 5 and Q.score(docs, None).where("tail IS NULL AND expected_grade IS NULL").count() == 5


@pytest.mark.parametrize("bound", [1, 3])
def test_sample_is_bounded_and_fixed(spark, bound):
    rows = graded(5, 60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k > 0), 0) for i, _, k in rows], "doc_id long, quality int, toxic int")
    a, b = (Q.train(docs.repartition(n), labels.repartition(n), sample=40, most=bound * 2000) for n in (1, 7))
    assert (a is None) == (b is None) and (a is None or np.allclose(a.weights, b.weights))


def test_toxic_texts_go(spark):
    """Toxic texts are good prose with one telling word, so they score like clean ones in the grades' common direction."""
    rnd = random.Random(8)
    prose, junk = [f"w{i}" for i in range(300)], [f"j{i}" for i in range(300)]

    def one(k):
        words = [rnd.choice(prose if k else junk) for _ in range(rnd.randrange(60, 200))]
        if k == 1:
            words[rnd.randrange(len(words))] = rnd.choice(["scum", "moron", "idiot"])
        return " ".join(words)

    rows = [(i, one(k), k) for i, k in enumerate(rnd.choices([0, 1, 2], [2, 1, 9], k=5000))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k > 0), int(k == 1)) for i, _, k in rows if i < 4000], "doc_id long, quality int, toxic int")
    held = [(i, k) for i, _, k in rows if i >= 4000]
    kept = {r["doc_id"] for r in Q.select(docs, Q.train(docs, labels)).collect()}
    share = lambda grade: sum(i in kept for i, k in held if k == grade) / sum(k == grade for _, k in held)
    assert share(1) <= 0.1 and share(0) <= 0.05 and share(2) >= 0.97


@pytest.mark.parametrize("column", ["a.b", "__tail", "tail", "TEXT", "clean"])
def test_columns_of_any_name(spark, column):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad junk | 9", i) for i in range(60)], ["doc_id", "text", column])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    kept = Q.select(docs, model)
    assert kept.columns == docs.columns and [r[2] for r in kept.orderBy("doc_id").collect()] == list(range(1, 60, 2))
    assert Q.score(docs, model).columns == ["doc_id", "expected_grade", "tail", "clean"]


def test_long_texts_have_the_features_of_the_whole(monkeypatch):
    from brindle.llm import words as W

    text = pa.array(["Some words, words words: and MORE | 12 of them! " * 40 + "x" * 700 + " end"])
    whole = Q.features(text)
    monkeypatch.setattr(W, "PART", 128)
    monkeypatch.setattr(Q, "BLOCK", 1000)
    monkeypatch.setattr(W.long_text, "__defaults__", (1 << 12,))
    parts = Q.features(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
