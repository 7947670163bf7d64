from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import simhash
from brindle.llm.components import components, local_components
from brindle.llm.shared import Scratch


def brute(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint():
    rnd = random.Random(1)
    texts = ["", " \t\n", "One", "one two three", "a b c d", "A b C\u000bd É f", *(" ".join(rnd.choice("the of and ÉÀ xyz") for _ in range(n)) for n in (5, 50, 900))]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute(t)
        assert simhash.fingerprint(t.encode(), block=16) == brute(t)


def pairs_of(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_prefix_length_follows_the_size():
    assert [simhash.prefix_bits_for(n) for n in (0, 10**6, 125_000_000, 50_000_000_000)] == [16, 16, 16, 25]


@pytest.mark.parametrize(("hot", "bits"), [(simhash.HOT_VARIANTS, None), (0, None), (1200, None), (simhash.HOT_VARIANTS, 20), (1000, 20), (simhash.HOT_VARIANTS, 6)])
def test_links_equal_all_pairs(spark, hot, bits):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    flips = lambda k: np.bitwise_xor.reduce([np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64) for _ in range(k)])
    fps = np.unique(np.concatenate([base, base ^ flips(1), base ^ flips(3), base ^ flips(4), base[:40] ^ np.uint64(0b11111), [np.uint64(0), np.uint64(2**64 - 1)]]))
    signed = fps.view(np.int64).tolist()
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(rows, Scratch(spark, "t"), hot=hot, prefix_bits=bits).collect()
    at = {x: i for i, x in enumerate(signed)}
    root = local_components(len(fps), np.array([at[e["u"]] for e in edges]), np.array([at[e["v"]] for e in edges]))
    assert root.tolist() == pairs_of(fps)


def test_a_large_near_group_stays_linear(spark):
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << i) for i in range(60)] + [base ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)]
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(rows, Scratch(spark, "t"))
    assert edges.count() < 137 * len(fps)
    assert components(edges, Scratch(spark, "t")).select("root").distinct().count() == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    star = spark.range(1, 3000).selectExpr("0L AS u", "id AS v")
    assert components(star, Scratch(spark, "t")).where("root <> 0").count() == 0
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


ROWS = [(5, "alpha beta gamma delta one"), (5, "totally different words are here now"), (7, "totally different words are here now"), (None, "zz yy xx ww"), (None, "zz yy xx ww"), (9, None), (10, ""), (11, "q r s t u v"), (11, "q r s t u v"), (None, "q r s t u v")]


def test_rules_for_odd_rows(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(rows)
    assert got.count() == len(ROWS)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(5, 5), (7, 5), (None, None), (9, 9), (10, 9), (11, 11), (None, 11)}
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, "alpha beta gamma delta one"), (5, "totally different words are here now"), (None, "zz yy xx ww"), (9, None), (11, "q r s t u v")], key=str)
    assert simhash.keep_one(rows.limit(0)).count() == 0


def test_near_copies_are_found_and_others_left(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    docs = {i: [rnd.choice(words) for _ in range(400)] for i in range(60)}
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    for i in range(20):
        w = docs[i].copy()
        w[200] = "changed"
        rows.append((1000 + i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = np.array([brute(t) for _, t in rows], np.uint64)
    want = pairs_of(fps)
    assert [got[k] for k, _ in rows] == [rows[j][0] for j in want]
    assert sum(got[1000 + i] == i for i in range(20)) >= 12 and sum(got[i] == i for i in range(60)) == 60
