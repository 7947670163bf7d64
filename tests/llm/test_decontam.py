from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontam as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, bench, window=10):
    wins: dict = {}
    for i, t in bench:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add("null" if i is None else str(i))
    sizes, out = {len(x) for x in wins}, {}
    for k, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in wins:
                    hit.update(range(p, p + n))
                    items |= wins[x]
        out[k] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def case(seed):
    rnd = random.Random(seed)
    alphabet = ["a", "b"] if seed % 2 else [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choice(alphabet) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 3, 50, 400]))) for i in range(30)] + [(99, None)]
    bench = [(i, text(rnd.choice([0, 2, 7, 10, 60]))) for i in range(8)] + [(50, None), (None, text(12)), (3, text(11))]
    long = text(130)
    bench.append((77, long.upper()))
    docs += [(200, "q " + long[:200] + " zz " + long), (201, f"{text(20)}!!{bench[9][1]}--{text(5)}")]
    return docs, bench


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("shard", [64, 400, 2 << 20])
def test_scan_equals_brute_force(seed, shard, monkeypatch):
    docs, bench = case(seed)
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    block = D.Block([i for i, _ in bench], pa.array([t for _, t in bench], pa.string()), 10)
    hits = D.scan([block], pa.array([t for _, t in docs], pa.string()))
    want = brute(docs, bench)
    assert [(int(n), int(h), len(x)) for n, h, x in zip(hits.n_words, hits.n_hit(), hits.names, strict=True)] == [want[k][:3] for k, _ in docs]


def test_contamination_and_clean(spark):
    docs, bench = case(2)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("n_hit", F.lit(1))
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("extra", F.lit(0))
    want = brute(docs, bench)
    got = {r["doc_id"]: r for r in D.contamination(rows, items).collect()}
    assert {k: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for k, r in got.items()} == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got.values())
    assert got[200]["longest"] == 130
    kept = D.clean(rows, items)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in want.items() if not v[4]}


def test_blocks_and_passes_give_the_same(spark, monkeypatch):
    docs, bench = case(4)
    rows, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench * 50, "item_id long, text string")
    want = brute(docs, bench)
    monkeypatch.setattr(D, "BLOCK_BYTES", 150)
    monkeypatch.setattr(D, "PASS_BYTES", 400)
    found = list(D.passes(items))
    assert len(found) > 1 and max(map(len, found)) > 1
    assert sum(len(b.names) for p in found for b in p) == sum(t is not None for _, t in bench)  # repeats count once
    got = D.contamination(rows, items).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == want


@pytest.mark.parametrize("column", ["a.b", "__hit", "items", "TEXT", "n_words"])
def test_columns_of_any_name(spark, column):
    rows = spark.createDataFrame([(1, "p q r s", 5), (2, "x y", 6)], ["doc_id", "text", column])
    items = spark.createDataFrame([(7, "q r s", 0)], ["item_id", "text", column])
    kept = D.clean(rows, items)
    assert kept.columns == rows.columns and [tuple(r) for r in kept.collect()] == [(2, "x y", 6)]
    assert [r["n_hit"] for r in D.contamination(rows, items).orderBy("doc_id").collect()] == [3, 0]


@pytest.mark.parametrize("alphabet", [2, 300])
def test_suffix_array_orders_to_the_depth(alphabet):
    ids = np.random.default_rng(alphabet).integers(0, alphabet, 700)
    order, rank, depth = D.suffix_array(ids, 10)
    padded = np.concatenate([ids, np.zeros(depth, np.int64)])
    assert depth >= 10 and order[0] >= 0
    runs = [padded[i : i + depth].tolist() for i in order.tolist()]
    assert runs == sorted(runs) and all((rank[a] == rank[b]) == (x == y) for a, b, x, y in zip(order, order[1:], runs, runs[1:]))


def test_more_distinct_suffixes_than_a_third_of_64_bits_count():
    ids = np.random.default_rng(1).permutation(2_300_000) + 1
    order, rank, _ = D.suffix_array(ids, 10)
    assert np.array_equal(ids[order], np.sort(ids)) and np.array_equal(rank.astype(np.int64), ids)


def test_a_long_item_is_found_to_the_word():
    rng = np.random.default_rng(1)
    item, own = rng.integers(0, 300_000, 200_000), rng.integers(0, 300_000, 600_000)
    text = np.concatenate([own[:520_000], item[40_000:43_000], own[520_000:]])
    block = D.Block([1], pa.array([" ".join(map(str, item.tolist()))]), 10)
    hits = D.scan([block], pa.array([" ".join(map(str, text.tolist()))]))
    assert 3_000 <= int(hits.n_hit()[0]) < 3_020 and int(hits.longest[0]) >= 3_000


def test_longest_matches_tell_places(spark):
    rows = spark.createDataFrame([(4, "x y " + " ".join(f"t{i}" for i in range(40)) + " z"), (3, "u " + " ".join(f"t{i}" for i in range(5, 30)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(35)) + " other")], "item_id long, text string")
    assert [tuple(r) for r in D.longest_matches(rows, items).collect()] == [("1", 35, 0, 4, 2)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.contamination(docs, items.limit(0)).where("contaminated OR n_items > 0 OR n_words <> 2").count() == 0
    assert D.contamination(docs, items).where("n_hit = 2").count() == 2
    assert D.clean(docs, items.limit(0)).count() == 2


def test_a_very_long_text_is_cut_in_parts(monkeypatch):
    from brindle.llm import words as W

    monkeypatch.setattr(W, "PART", 50)
    t = pa.array(["one two three four five six seven eight nine ten eleven " * 5, None, "x" * 200 + " y"])
    monkeypatch.setattr(D, "SHARD_BYTES", 80)
    _, counts = D.word_hashes(t)
    assert counts.tolist() == [55, 0, 2]
    one, two = (W.long_text(np.frombuffer(("p " * k + "y" * 260 + " q").encode(), np.uint8), D._WORD, 50) for k in (1, 30))
    assert [h for _, x in one for h in x][-2:] == [h for _, x in two for h in x][-2:]  # a long word's hash does not depend on its place
