from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from brindle.llm import queries, trie
from brindle.llm.shared import Scratch
from tests.oracle import check

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(found[c])] for c in found}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
    return {c: (convs.get(c - c % 100) or [])[: h[c]] + convs[c][h[c] :] for c in convs}


def brute(convs):
    """Every node of the sequences, its subtree by a walk over all prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if tuple(convs[c]) == p) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def plain(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


def digest_rows(found):
    nodes = found.nodes.join(trie.ends_digest(found.members), ["key1", "key2", "depth"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return plain((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256 or empty) for r in nodes.collect())


def test_query_against_sql_and_brute_force(spark, sf):
    assert check(spark, sf, queries.op11_trie, queries.ORACLE["op11_trie"]) > 40
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(tuple(r) for r in queries.op11_trie(spark, sf).collect()) == brute(rebuilt(sequences(rows)))


@pytest.mark.parametrize("block", [3, 512])
def test_one_conversation_holds_a_third_of_all_rows(spark, block):
    rng = random.Random(block)
    turn = lambda: rng.choice([("user", "é"), ("user", "b"), ("assistant", "c" * 9), ("", ""), (None, "d"), ("s", None)])
    long = [turn() for _ in range(400)]
    convs = {0: long, 1: long[:350] + [turn() for _ in range(9)], 2: long, 3: long[:20]} | {c: [turn() for _ in range(rng.randint(1, 5))] for c in range(10, 120)}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    found = trie.build(Scratch(spark, "t"), trie.digests(spark.createDataFrame(rows, SCHEMA)), ["turn", "label"], 40, block=block)
    assert digest_rows(found) == brute(sequences(rows))
    for r in found.nodes.collect():  # intervals nest: a node's subtree holds its children and ends where its last member's nodes end
        assert r.subtree_end - r.node + 1 >= 1 + r.n_children and (r.parent is None) == (r.depth == 0)


def test_odd_rows(spark):
    rows = [(1, None, "user", "x"), (1, 0, None, None), (1, 0, None, None), (None, 1, "user", "lost"), (2, 3, "user", "x"), (3, 1, "user", "y" * 100_000)]
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows], SCHEMA + ", `a.b` string, depth long")
    found = digest_rows(trie.prefix_trie(docs))
    assert found == brute(sequences(rows)) and len(found) == 5
    assert trie.prefix_trie(docs.limit(0)).nodes.count() == 0


def test_lost_heads(spark, tmp_path):
    """A donor that is absent gives no turns; a conversation may be left without any."""
    rows = [(c, t, "user", f"{t} of {c // 3}") for c in (105, 106, 107, 200, 201, 202, 203, 204, 299) for t in range(c % 4 + 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert plain(tuple(r) for r in queries.op11_trie(spark, str(tmp_path)).collect()) == brute(rebuilt(sequences(rows)))
