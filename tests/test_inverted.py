from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.operators import inverted, lexical, manifest

WORDS = ["the", "of", "cat", "sat", "down", "bird", "向量", "c++", *[f"w{i}" for i in range(60)]]


def text(rng):
    return " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.randint(0, 40)))


def brute(docs, queries, k, fallback=False):
    """(query, document, score, rank) by the formula, one query and document at a time."""
    bags = {d: Counter(t.lower() for t in re.findall(lexical.TOKEN, x or "")) for d, x in docs.items()}
    n, avg = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()} if fallback else {t: floor if r < 0 else r for t, r in raw.items()}
    out = set()
    for q, x in queries.items():
        wanted = Counter(t.lower() for t in re.findall(lexical.TOKEN, x or ""))
        scores = [(-round(sum(w * idf[t] * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / (max(avg, 1) if fallback else avg))) for t, w in wanted.items() if b[t]), 9), d) for d, b in bags.items()]
        out |= {(q, d, round(-s, 6), i + 1) for i, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])}
    return out


def rows(found):
    return {(r[0], r[1], round(r[2], 6), r[3]) for r in found.collect()}


def write(spark, docs, path, mode="append"):
    spark.createDataFrame(list(docs.items()), "id long, text string").coalesce(1).write.mode(mode).parquet(path)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return {i: text(rng) for i in range(300)} | {300: None, 301: "", 302: "cat " * 400}


def asked(spark, docs, step=7):
    queries = {d: x for d, x in docs.items() if d % step == 0}
    return queries, spark.createDataFrame(list(queries.items()), "q long, query_text string")


@pytest.mark.parametrize("fallback", [False, True])
def test_many_queries_against_brute_force(spark, corpus, tmp_path, fallback):
    write(spark, corpus, f"{tmp_path}/docs")
    index = inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index", key="id", buckets=4)
    queries, table = asked(spark, corpus)
    assert rows(index.topk_many(table, 5, query_key="q", fallback=fallback, block=20)) == brute(corpus, queries, 5, fallback)


def test_hopeless_terms_are_skipped_and_change_nothing():
    """Later blocks of documents without a query's rare terms are not multiplied, and the best stay the same."""
    rng = np.random.default_rng(0)
    terms = ["common", *[f"rare{i}" for i in range(40)]]
    term = np.concatenate([np.zeros(40, np.int64), np.arange(1, 41)])
    query = np.concatenate([np.arange(40), np.arange(40)])
    weight = np.where(term == 0, 0.01, 5.0)
    make = lambda names: pa.RecordBatch.from_pydict({"key": pa.array(range(len(names))), "dl": pa.array([len(x) for x in names], pa.int32()), "terms": pa.array(names), "tf": pa.array([[1] * len(x) for x in names], pa.list_(pa.int32()))})
    first = make([["common", f"rare{i % 40}"] for i in range(200)])
    then = make([["common"] if rng.random() < 0.9 else ["common", "rare3"] for _ in range(300)])
    scan = inverted._Scan(terms, term, query, weight, 40, 2.0, 3)
    kept = scan.add(then, scan.add(first, None))
    assert scan.skipped == 39 and kept.num_rows == 120
    assert all(round(s, 3) > 4 for s in kept["similarity"].to_pylist())


def test_an_index_is_opened_without_reading_documents(spark, corpus, tmp_path):
    write(spark, corpus, f"{tmp_path}/docs")
    read = lambda: spark.read.parquet(f"{tmp_path}/docs")
    first = inverted.Index(read(), f"file://{tmp_path}/index", key="id", buckets=4)
    again = inverted.Index(read(), f"file://{tmp_path}/index", key="id", buckets=4)
    assert first.built and not again.built and again.top == first.top
    opened = again.topk_many(asked(spark, corpus)[1], 3, query_key="q").inputFiles()
    assert opened and all(f"{tmp_path}/index/" in f for f in opened)
    part = inverted.Index(read().where("id < 50"), f"file://{tmp_path}/index", key="id", buckets=4)
    assert part.built and part.top != first.top and part.size()[0] == 50


def test_new_files_alone_are_read(spark, corpus, tmp_path):
    """Files that came, went or changed are noticed by their listing; the index then equals one built anew."""
    for lo in range(0, 303, 101):
        write(spark, {d: x for d, x in corpus.items() if lo <= d < lo + 101}, f"{tmp_path}/docs/part={lo}", "overwrite")
    read = lambda: spark.read.parquet(f"{tmp_path}/docs")
    index = inverted.Index(read(), f"file://{tmp_path}/index", key="id", buckets=4)
    changed = {d: ("cat bird " if d % 2 else "") + (x or "") for d, x in corpus.items() if 101 <= d < 202}
    write(spark, changed, f"{tmp_path}/docs/part=101", "overwrite")
    write(spark, {900: "the cat w3", 901: "w3 w4"}, f"{tmp_path}/docs/part=900", "overwrite")
    opened = []
    index._rows = lambda docs, *a, own=inverted.Index._rows: opened.append(docs) or own(index, docs, *a)
    index._refresh(read(), "id", "text", manifest.listed(read())[1])
    assert "_metadata" in opened[0]._jdf.queryExecution().toString() and opened[0].select("part").distinct().count() == 2
    again = inverted.Index(read(), f"file://{tmp_path}/index", key="id", buckets=4)
    now = corpus | changed | {900: "the cat w3", 901: "w3 w4"}
    assert not again.built and len(again.record["segments"]) == 2 and len(again.record["gone"]) == 1
    queries, table = asked(spark, now)
    assert rows(again.topk_many(table, 5, query_key="q")) == brute(now, queries, 5)


def test_changes_by_key_marks_and_merging(spark, corpus, tmp_path):
    rng, now = random.Random(9), dict(corpus)
    write(spark, corpus, f"{tmp_path}/docs")
    index = inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index", key="id", buckets=4)
    parts = []
    for _ in range(6):
        new = {rng.randrange(400): text(rng) for _ in range(9)}
        gone = {d for d in rng.sample(sorted(now), 5) if d not in new}
        index.change(spark.createDataFrame(list(new.items()), "id long, text string"), spark.createDataFrame([(d,) for d in [*gone, 12345]], "id long"))
        now = {d: x for d, x in (now | new).items() if d not in gone}
        parts.append(len(index.record["segments"]) + len(index.record["gone"]))
        assert index.size()[0] == len(now)
    assert max(parts) <= inverted.MOST_PARTS and 1 in parts
    queries, table = asked(spark, now)
    assert rows(index.topk_many(table, 5, query_key="q")) == brute(now, queries, 5)
    live = spark.createDataFrame(list(now.items()), "id long, text string")
    for terms in (["the", "cat", "w3"], ["c++"], ["none"]):
        want = {r["id"]: round(r["score"], 9) for r in lexical.bm25(live, terms, key="id").where("score <> 0").collect()}
        assert {r["id"]: round(r["score"], 9) for r in lexical.bm25(index, terms, key="id").where("score <> 0").collect()} == want
    index.change(removed=live.select("id"))
    assert index.size()[0] == 0 and index.topk_many(table, 5, query_key="q").count() == 0


def test_empty_corpus(spark):
    import tempfile

    none = spark.createDataFrame([], "id long, text string")
    index = inverted.Index(none, f"file://{tempfile.mkdtemp()}", key="id")
    queries = spark.createDataFrame([(1, "the cat"), (2, None)], "q long, query_text string")
    assert index.topk_many(queries, 3, query_key="q").count() == 0 and index.totals(["the"]) == (0, 0.0, [0])
    index.change(spark.createDataFrame([(5, "the cat"), (6, "a bird"), (7, "stone")], "id long, text string"))
    assert [r["id"] for r in index.topk_many(queries, 3, query_key="q").collect()] == [5]
    assert index.topk_many(queries.where(F.lit(False)), 3, query_key="q").count() == 0


def test_fused_search_of_many_queries_equals_that_of_one(spark, corpus, tmp_path):
    """As ``hybrid_topk`` for each query by itself; one has no known term, one only a term that every document has (the fallback's case)."""
    from brindle.operators import ann, hybrid
    from brindle.session import shared_folder

    rng = np.random.default_rng(2)
    docs = {d: f"all {x or ''}" for d, x in corpus.items()}
    write(spark, docs, f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    index = inverted.Index(read, f"file://{tmp_path}/index", key="id", buckets=4)
    vectors = {d: [float(x) for x in rng.normal(size=8)] for d in list(docs)[:200]}
    entries = spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>")
    queries = {1: (vectors[5], "cat w3 w3 the"), 2: (vectors[9], "nothing known"), 3: (vectors[70], "all"), 4: ([1.0] * 8, "向量 w50 w59")}
    table = spark.createDataFrame([(q, v, t) for q, (v, t) in queries.items()], "q long, query_embedding array<double>, query_text string")
    near = ann.VectorIndex.build(entries, shared_folder(spark, "ann"), key="id", cells=4)
    for side in (entries, near):
        found = hybrid.hybrid_topk_many(index, side, table, 6, query_key="q").collect()
        got = {q: [(r["id"], round(r["score"], 9)) for r in sorted(found, key=lambda r: r["rank"]) if r["q"] == q] for q in queries}
        for q, (v, t) in queries.items():
            if side is entries or q != 4:
                want = hybrid.hybrid_topk(read, entries, v, lexical.query_terms(t), 6, key="id").collect()
                assert got[q][:3] == [(r["id"], round(r["score"], 9)) for r in want][:3]
                assert side is near or got[q] == [(r["id"], round(r["score"], 9)) for r in want]


def test_many_queries_are_one_pass_from_a_bar(spark, corpus, tmp_path, monkeypatch):
    """600 queries pass over the documents once, begin at their k-th best of one bucket, and are read once; single precision changes no rank."""
    docs = corpus | {1000 + i: text(random.Random(i)) for i in range(300)} | {2000 + i: "w1 w2 " + "w59 " * i for i in range(40)}
    write(spark, docs, f"{tmp_path}/docs")
    monkeypatch.setattr(inverted, "SAMPLED", 1)
    index = inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index", key="id", buckets=4)
    queries, table = asked(spark, docs, 1)
    found = index.topk_many(table, 3, query_key="q")
    assert len(queries) > 600 and found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert rows(found) == brute(docs, queries, 3)


def test_ranks_by_double_precision():
    """Scores that single precision cannot tell apart are ranked by their ninth place."""
    rng = np.random.default_rng(3)
    tf = [[int(x) for x in rng.integers(1, 9, 6)] for _ in range(300)]
    term, query = np.tile(np.arange(6), 50), np.repeat(np.arange(50), 6)
    weight = 1e5 * (1 + rng.random(300) * 1e-9)
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(300)), "dl": pa.array([100_000 + i for i in range(300)], pa.int32()), "terms": pa.array([list("abcdef")] * 300), "tf": pa.array(tf, pa.list_(pa.int32()))})
    scan = inverted._Scan(list("abcdef"), term, query, weight, 50, 1e9, 4)
    kept = scan.end(scan.add(batch, None))
    share = 1.5 * (0.25 + 0.75 * (100_000 + np.arange(300)) / 1e9)
    part = np.array(tf) * 2.5 / (np.array(tf) + share[:, None])
    want = {(q, d) for q in range(50) for d in sorted(range(300), key=lambda d: (-round(float(part[d] @ weight[query == q]), 9), d))[:4]}
    assert len(scan.frequent) == 6 and set(zip(kept["__query"].to_pylist(), kept["key"].to_pylist(), strict=True)) == want


def test_postings_are_lists(spark, corpus, tmp_path):
    """A token has a row for many documents, not one for each; odd texts count as the expression over them counts."""
    odd = corpus | {400: "Straße İI Kelvin K AB_c+#.-x 向量Cat", 401: "\n\t ", 402: "a" * 5000, 403: "THE the The"}
    write(spark, odd, f"{tmp_path}/docs")
    index = inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index", key="id", buckets=4)
    stored = index._read(f"{index.record['segments'][0]['folder']}/postings", index._posting())
    tokens = lexical.tokens(F.coalesce("text", F.lit("")))
    want = spark.read.parquet(f"{tmp_path}/docs").select("id", F.size(tokens).alias("dl"), F.explode(tokens).alias("token")).groupBy("token", "id", "dl").agg(F.count("*").alias("tf"))
    assert {tuple(r) for r in index.postings(["the", "cat", "c++", "向量"]).select("token", "key", "dl", "tf").collect()} == {tuple(r) for r in want.where("token IN ('the', 'cat', 'c++', '向量')").collect()}
    assert {tuple(r) for r in index.documents("key", "dl", "terms", "tf").selectExpr("explode(arrays_zip(terms, tf)) AS x", "key", "dl").select("x.terms", "key", "dl", "x.tf").collect()} == {tuple(r) for r in want.collect()}
    assert stored.count() * 10 < want.count() * 4


def test_given_pairs_are_scored_by_the_pass_that_ranks(spark, corpus, tmp_path, monkeypatch):
    """In blocks, a bounded number of terms at a time; pairs without a common term have no row, nor those of documents or queries that are not there."""
    write(spark, corpus, f"{tmp_path}/docs")
    monkeypatch.setattr(inverted.vector, "CELLS", 64)
    index = inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index", key="id", buckets=4)
    queries, table = asked(spark, corpus)
    rng = random.Random(4)
    pairs = {(q, d) for q in [*queries, 1] for d in [302, 999, *rng.sample(sorted(corpus), 9)]}
    for fallback in (False, True):
        found = index.ranked_pairs(table, spark.createDataFrame(sorted(pairs), "q long, id long"), 5, query_key="q", fallback=fallback, block=20).collect()
        every = brute(corpus, queries, len(corpus), fallback)
        assert {(r["q"], r["id"], round(r["score"], 6), r["rank"]) for r in found if r["rank"]} == {x for x in every if x[3] <= 5}
        given = [(r["q"], r["id"], round(r["score"], 6)) for r in found if not r["rank"]]
        assert len(given) == len(set(given)) and set(given) == {x[:3] for x in every if x[:2] in pairs}


def test_fused_search_passes_over_the_documents_once(spark, corpus, tmp_path):
    """What comes back is read from stored best rows: neither documents nor vectors are read, broadcast or shuffled for it again."""
    from brindle.operators import hybrid

    write(spark, corpus, f"{tmp_path}/docs")
    index = inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index", key="id", buckets=4)
    spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "id long, embedding array<double>").write.parquet(f"{tmp_path}/vectors")
    table = spark.createDataFrame([(1, [1.0, 2.0], "cat w3"), (2, [3.0, 1.0], "the bird")], "q long, query_embedding array<double>, query_text string")
    found = hybrid.hybrid_topk_many(index, spark.read.parquet(f"{tmp_path}/vectors"), table, 6, query_key="q")
    assert found.count() == 12 and "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in found.inputFiles() if f"{tmp_path}/index/" in f or f"{tmp_path}/vectors" in f]


def test_blocks_of_queries_wait_for_no_broadcast(spark, corpus, tmp_path):
    """A broadcast in the plan of many passes gets no core until they are through, and fails after five minutes; queries are named by the tasks, whatever their keys' type."""
    from brindle.operators import vector

    write(spark, corpus, f"{tmp_path}/docs")
    index = inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index", key="id", buckets=4)
    queries, table = asked(spark, corpus)
    named = table.select(F.concat(F.lit("q"), F.col("q").cast("string")).alias("q"), "query_text")
    found = index.topk_many(named, 5, query_key="q", block=20)
    assert rows(found) == {(f"q{q}", *x) for q, *x in brute(corpus, queries, 5)}
    entries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, embedding array<double>")
    near = vector.topk_many(entries, entries.selectExpr("concat('q', id) AS q", "embedding AS query_embedding"), 1, key="id", query_key="q", block=3)
    assert {(r["q"], r["id"]) for r in near.collect()} == {(f"q{i}", i) for i in range(9)}
    for plan in (found, near):
        assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_many_queries_need_no_postings(spark, corpus, tmp_path):
    """An index without them ranks many queries; they are made once, when a few terms are asked for, also of what came later."""
    write(spark, corpus, f"{tmp_path}/docs")
    opened = lambda root, **how: inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/{root}", key="id", buckets=4, **how)
    whole, index = opened("whole"), opened("index", postings=False)
    kept = lambda: len(list((tmp_path / "index").glob("*/*/postings*")))
    assert not kept() and {tuple(r) for r in index.words().collect()} == {tuple(r) for r in whole.words().collect()}
    queries, table = asked(spark, corpus)
    assert rows(index.topk_many(table, 5, query_key="q")) == brute(corpus, queries, 5) and not kept()
    now = corpus | {901: "the cat w3"}
    index.change(spark.createDataFrame([(901, now[901])], "id long, text string"))
    live, terms = spark.createDataFrame(list(now.items()), "id long, text string"), ["the", "cat", "w3"]
    want = {(r["id"], round(r["score"], 9)) for r in lexical.bm25(live, terms, key="id").where("score <> 0").collect()}
    for one in (index, opened("index"), opened("index", postings=False)):
        assert {(r["id"], round(r["score"], 9)) for r in lexical.bm25(one, terms, key="id").where("score <> 0").collect()} == want and kept() == 2


def test_documents_are_not_looked_up_when_all_files_are_new(spark, corpus, tmp_path, monkeypatch):
    """An index whose files are all replaced begins anew; documents added by key stay, as before."""
    write(spark, corpus, f"{tmp_path}/docs")
    opened = lambda: inverted.Index(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index", key="id", buckets=4, postings=False)
    first, took = opened(), []
    monkeypatch.setattr(inverted.Index, "_remove", lambda self, keys, own=inverted.Index._remove: took.append(1) or own(self, keys))
    now = {d + 1000: f"{x or ''} bird" for d, x in corpus.items()}
    write(spark, now, f"{tmp_path}/docs", "overwrite")
    index = opened()
    assert index.top == first.top and index.built and not took and index.size()[0] == len(now) and len(index.record["segments"]) == 1
    queries, table = asked(spark, now)
    assert rows(index.topk_many(table, 5, query_key="q")) == brute(now, queries, 5)
    index.change(spark.createDataFrame([(901, "the cat w3")], "id long, text string"))
    write(spark, corpus, f"{tmp_path}/docs", "overwrite")
    assert opened().size()[0] == len(corpus) + 1 and len(took) == 2
