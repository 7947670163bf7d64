from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import queries, repair
from tests.oracle import check

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_cheapest(initials, gone, cut):
    """Every sequence of edits with up to three inserts in a row, by plain enumeration: the least (cost, audit)."""
    gaps = ["".join(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    for edits in itertools.product(*[["D"] if g else ["K", "u", "a", "D"] for g in gone]):
        for fill in itertools.product(gaps, repeat=len(edits) + 1):
            out, audit, cost = fill[0], "I" * len(fill[0]), 2 * len(fill[0])
            for e, i, c, f in zip(edits, initials, cut, fill[1:], strict=True):
                out += ("xsua"[i] if e == "K" else "" if e == "D" else e) + f
                audit += (e if e in "KD" else "R") + "I" * len(f)
                cost += {"K": c, "D": 3}.get(e, 2 + c) + 2 * len(f)
            if GRAMMAR.fullmatch(out):
                best = min(best or (cost, audit), (cost, audit))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans(), st.booleans()), max_size=3))
def test_cheapest_against_enumeration(turns):
    initials, gone, cut = [t[0] for t in turns], [t[1] for t in turns], [t[2] and not t[1] for t in turns]
    assert repair.cheapest(initials, gone, cut) == brute_cheapest(initials, gone, cut)


def plain(initials, gone, cut):
    """The least (cost, audit) of each grammar state turn by turn, audits as strings."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    fill = lambda s: {q: min(x for x in ((c + 2 * k, a + "I" * k) for r, (c, a) in s.items() for k in range(3) if [r, step[r], step[step[r]]][k] == q)) for q in range(4) if any([r, step[r], step[step[r]]][k] == q for r in s for k in range(3))}
    states = {0: (0, "")}
    for i, g, c in zip(initials, gone, cut, strict=True):
        after: dict = {}
        for q, (cost, audit) in fill(states).items():
            options = [(q, cost + 3, audit + "D")]
            if not g:
                options.append((step[q], cost + 2 + c, audit + "R"))
                if (q, i) in {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}:
                    options.append((i, cost + c, audit + "K"))
            for r, *key in options:
                after[r] = min(after.get(r, tuple(key)), tuple(key))
        states = after
    return min(v for q, v in fill(states).items() if q in (0, 3))


def test_long_conversations():
    rng = random.Random(5)
    for n in (40, 400, 3000):
        turns = [(rng.choice([0, 1, 2, 3, 2, 3, 2, 3]), rng.random() < 0.1, rng.random() < 0.1) for _ in range(n)]
        arrays = [t[0] for t in turns], [t[1] for t in turns], [t[2] and not t[1] for t in turns]
        assert repair.cheapest(*arrays) == plain(*arrays)


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        f, role, text = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20, word(role), word(text)
        convs[conv] += []
        row = ((turn is not None, turn or 0), "user" if f == 4 else role, "" if f == 1 else re.sub(r"[.!?]", "", text) if f == 2 else text)
        convs[conv] += [row] * {0: 0, 3: 2}.get(f, 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0], r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        known = [t[0][1] for t in turns if t[0][0]]
        faults, seen = [], set()
        for _, role, text in turns:
            core = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = ["xsua".find(t[1][:1] or "x") if t[1][:1] in "xsua" else 0 for t in turns]
        initials = [max(i, 0) for i in initials]
        letters = "".join("xsua"[i] for i in initials)
        cost, audit = plain(initials, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        left, out, state = iter(turns), [], ""
        for e in audit:
            row = next(left) if e != "I" else (None, "", "")
            if e != "D":
                now = row[1][:1] if e == "K" else "a" if state == "u" else "u"
                out.append((row[1] if e == "K" else {"u": "user", "a": "assistant"}[now]) + ":" + row[2])
                state = now
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(letters[i : i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1))
        yield (conv, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_sql_and_brute_force(spark, sf):
    assert check(spark, sf, queries.op12_repair, queries.ORACLE["op12_repair"]) > 5
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in queries.op12_repair(spark, sf).select(COLUMNS).collect()) == sorted(brute(rows))


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \t\n", "é?", None, "x" * 60_000 + "!", "Why?\n\n", "　"]
    rows = [(c if c else None, rng.choice([None, 0, 1, 2, 3, 5, 8, -2]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(777, i, "user" if i % 2 else "assistant", f"{i // 3}.") for i in range(700)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", audit long, `a.b` string")
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.op12_repair(spark, str(tmp_path)).select(COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert repair.examine(docs.limit(0)).count() == 0

    reports = repair.examine(docs)
    turns = defaultdict(list)
    for r in repair.repaired(docs, reports).collect():
        turns[r.conv_id].append((r.place, r.edit, r.role[:1]))
    audits = {r.conv_id: r.audit for r in reports.collect()}
    assert len(audits) == 61
    for conv, audit in audits.items():
        found = sorted(turns[conv])
        assert [e for _, e, _ in found] == [e for e in audit if e != "D"] and [p for p, *_ in found] == list(range(len(found)))
        assert GRAMMAR.fullmatch("".join(i for *_, i in found))
