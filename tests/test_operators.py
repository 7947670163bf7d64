from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.functions import paths
from brindle.functions import text as X
from brindle.operators import evaluate, hybrid, inverted, lexical, manifest, relational, traces, vector, windows


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("10k-20k", (10.0, 20.0)), (" 30K ~ 15k ", (15.0, 30.0)), ("8.5k至9k", (8.5, 9.0)), ("面议", None), ("10-20k", None), ("10k-20k/月", None)],
)
def test_salary(spark, text, want):
    got = one(spark, X.salary(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("上海市浦东", "上海"), ("广东省深圳市、上海市", "广东省"), ("内蒙古呼和浩特", "内蒙古自治区"), ("北京、全国", "全国"), ("", "未知"), ("深圳市南山", "深圳市")],
)
def test_province(spark, text, want):
    assert one(spark, X.province(F.col("t")), t=text) == want


def test_text_functions(spark):
    assert one(spark, X.job_function(F.lit("marketing"), F.col("t")), t="跨境TikTok专员") == "电商运营"
    assert one(spark, X.job_function(F.lit("agent_dev"), F.col("t")), t="电商") == "Agent/AI 开发"
    assert one(spark, X.year_tags(F.col("t")), t="2024, 12024 and 1999 then 2024") == [1999, 2024]
    assert one(spark, X.title(F.col("t")), t="  a \n b " + "c" * 40) == ("a b " + "c" * 40)[:30] + "..."
    assert one(spark, X.normalise(F.col("t")), t="a  b ，c !") == "a b，c!"
    assert one(spark, X.keywords(F.col("t")), t="a, b，，c/d|e") == ["a", "b", "c", "d", "e"]
    assert one(spark, X.safe_url(F.col("t")), t="HTTPS://Ex.com:443/a?b#c") == "https://ex.com/a?b"
    assert one(spark, X.safe_url(F.col("t")), t="https://u@ex.com/a") is None and one(spark, X.safe_url(F.col("t")), t="http://ex.com") is None
    assert one(spark, X.is_write_tool(F.col("t"), F.lit("")), t="createIssue") and not one(spark, X.is_write_tool(F.col("t"), F.lit("reads")), t="list_releases")
    assert one(spark, X.is_sensitive(F.col("t")), t="my api_key=abcd1234") and not one(spark, X.is_sensitive(F.col("t")), t="what is a token")
    assert one(spark, X.masked_values(F.col("t")), t='{"a": 1, "api_key": "xyz"}') == '{"a": 1, "api_key": [REDACTED]}'
    assert one(spark, X.parsed_reply(F.col("t")), t='```json\n{"answer": "yes"}\n```') == "yes" and one(spark, X.parsed_reply(F.col("t")), t="plain") == "plain"
    assert one(spark, X.json_list(F.col("t")), t='["a", 1, "b"]') == ["a", "b"] and one(spark, X.json_list(F.col("t")), t="oops") == []
    assert one(spark, X.citations(F.col("t")), t="[web_1] x [note_2] [web_1] [x_1]") == ["web_1", "note_2"]
    assert one(spark, X.token_estimate(F.col("t")), t="你好abcd") == 3
    assert one(spark, X.clean_lines(F.col("t")), t="a  \r\n\n\n\nb") == "a\n\nb"
    assert one(spark, X.utc_instant(F.col("t")), t="2024-01-01T00:00:00") is None and one(spark, X.utc_instant(F.col("t")), t="2024-01-01T00:00:00+02:00") is not None
    assert one(spark, X.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2)))) == {"a": 1, "b": 2}


def test_paths(spark):
    assert paths.safe_path("a/con.md") == "a/_con.md" and paths.safe_path("x?. ") == "x_"
    rows = spark.createDataFrame([("A.md", "A.md"), ("a.md", "a.md"), ("b.md", "b.md")], "path string, source_path string")
    got = {r["source_path"]: r["target"] for r in paths.distinct_paths(rows).collect()}
    assert got["b.md"] == "b.md" and got["A.md"].startswith("A--") and got["a.md"].startswith("a--") and got["A.md"].lower() != got["a.md"].lower()


def test_tokens_keep_cjk_runs():
    assert lexical.query_terms("向量检索 C++ v2.0 é") == ["向量检索", "c++", "v2.0"]


def test_bm25_against_plain_python(spark):
    from math import log

    texts = ["the cat sat", "the dog sat down", "the the bird", "", "cat cat cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    terms = ["the", "cat", "cat", "zebra"]
    got = {r["id"]: r["score"] for r in lexical.bm25(docs, terms, key="id").collect()}
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    raw = {w: log(n - d + 0.5) - log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in raw.items()}
    for i, t in enumerate(toks):
        want = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in terms if t.count(w))
        assert abs(got[i] - want) < 1e-9


def test_bm25_index(spark, tmp_path):
    """The index scores as the texts do, is used again for the same content only, and reads the buckets of its query's terms."""
    words = ["the", "cat", "sat", "down", "bird", "向量", "c++"]
    texts = [" ".join(words[(i * j) % 7] for j in range(i % 9)) for i in range(60)] + [None, "", "the " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    index = inverted.Index(docs, f"file://{tmp_path}", key="id", buckets=8)
    assert index.built and not inverted.Index(docs.repartition(3), f"file://{tmp_path}", key="id", buckets=8).built
    for terms in (["the", "cat", "cat", "zebra"], ["c++"], ["zebra"], ["the"]):
        for fallback in (False, True):
            want = {r["id"]: r["score"] for r in lexical.bm25(docs, terms, key="id", fallback=fallback).where("score <> 0").collect()}
            got = {r["id"]: r["score"] for r in lexical.bm25(index, terms, key="id", fallback=fallback).where("score <> 0").collect()}
            assert got == want
        want, got = (lexical.bm25_or_fallback(x, terms, key="id").where("score <> 0").collect() for x in (docs, index))
        assert sorted(map(tuple, want)) == sorted(map(tuple, got))
    part = inverted.Index(docs.where("id % 2 = 0"), f"file://{tmp_path}", key="id", buckets=8)
    assert part.built and part.totals(["the"])[0] == 32 and not inverted.Index(docs, f"file://{tmp_path}", key="id", buckets=8).built
    plan = index.counts(["cat"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,cat)]" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    none = inverted.Index(docs.limit(0), f"file://{tmp_path}", key="id", buckets=8)
    assert none.totals(["the"]) == (0, 0.0, [0]) and lexical.bm25(none, ["the"], key="id").count() == 0


def test_fusion_and_ties(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.4), ("c", -0.2)], "id string, similarity double")
    b = spark.createDataFrame([("b", 4.0), ("d", 2.0), ("c", 0.0), ("e", 4.0)], "id string, score double")
    got = [(r["id"], round(r["score"], 3)) for r in hybrid.fuse(v, b, 4, key="id").collect()]
    assert got == [("a", 0.9), ("b", 0.7), ("e", 0.5), ("d", 0.25)]


def test_vector_edges(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "id int, embedding array<float>")
    got = {r["id"]: round(r["similarity"], 6) for r in vector.topk(e, [1.0, 0.0], 10, key="id").collect()}
    assert got == {1: 1.0, 4: 0.707107, 2: 0.0, 3: 0.0}
    assert vector.topk(e, [1.0, 0.0], 0, key="id").count() == 0
    assert tuple(vector.check_embeddings(e, 2).first()) == (4, 1, 0)


def test_rerank_falls_back_when_scores_are_missing(spark):
    hits = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2), (3, 0.7, 3)], "id int, similarity double, place int")
    good = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.5)], "id int, rerank_score double")
    assert [r["id"] for r in hybrid.rerank(hits, good, key="id").orderBy("new_place").collect()] == [2, 3, 1]
    part = hybrid.rerank(hits, good.limit(1), key="id").orderBy("new_place").collect()
    assert [r["id"] for r in part] == [1, 2, 3] and part[0]["fallback_reason"] == "incomplete_scores"
    assert one(spark, hybrid.parse_rerank(F.col("t"), 2), t='{"output":{"results":[{"index":1,"relevance_score":0.5},{"index":0,"relevance_score":0.2}]}}') == [0.2, 0.5]
    assert one(spark, hybrid.parse_rerank(F.col("t"), 2), t='{"results":[{"index":1,"relevance_score":0.5}]}') is None


def test_metrics_golden(spark):
    """Three cases: a second-rank hit, a miss, a negative below the threshold."""
    cases = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "case_id string, positive boolean")
    hits = spark.createDataFrame([("a", 0.9, False), ("a", 0.8, True), ("b", 0.7, False), ("c", 0.2, False)], "case_id string, similarity double, matched boolean")
    m = evaluate.metrics(evaluate.case_results(cases, hits, thresholds=[0.45])).first()
    assert (m["recall"], m["mrr"], m["negative_accuracy"], round(m["accuracy"], 4)) == (0.5, 0.25, 1.0, 0.6667)
    empty = evaluate.metrics(evaluate.case_results(cases.limit(0), hits.limit(0))).first()
    assert (empty["recall"], empty["accuracy"]) == (0.0, 0.0)


def test_merged_summary_rebuilds_counts(spark):
    parts = spark.createDataFrame([(4, 2, 0.5, 0.4, 1.0), (6, 0, 0.6667, 0.5, 0.0)], "positives int, negatives int, recall double, mrr double, negative_accuracy double")
    m = evaluate.merged_summary(parts).first()
    assert m["recall"] == 0.6 and abs(m["mrr"] - 0.46) < 1e-9 and abs(m["accuracy"] - 8 / 12) < 1e-9


def test_hit_matches(spark):
    ok = evaluate.hit_matches(F.col("s"), F.col("t"), F.col("c"), F.array(F.lit("a.md")), F.array(F.lit("RAG")))
    assert one(spark, ok, s="a.md", t="About rag", c="") and not one(spark, ok, s="b.md", t="rag", c="")


def test_nth_conventions(spark):
    rows = spark.range(1, 11).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    n = F.col("n")
    assert evaluate.nth(rows, "v", evaluate.p95_floor(n), "g").first()["value"] == 9.0
    assert evaluate.nth(rows, "v", evaluate.p95_ceil(n), "g").first()["value"] == 10.0
    assert evaluate.nth(rows, "v", evaluate.p_round(n, 0.5), "g").first()["value"] == 5.0


def test_histogram_counts_shared_edges_twice(spark):
    rows = spark.createDataFrame([(256,), (10,)], "n int")
    got = {r["low"]: r["n"] for r in evaluate.histogram(rows, "n", [(0, 256), (256, 512)]).collect()}
    assert got == {0: 2, 256: 1}


def test_manifest(spark):
    a = spark.createDataFrame([("x", "1", 3), ("y", "2", 2), ("z", "3", 1)], "path string, h string, n int")
    b = spark.createDataFrame([("x", "1", 3), ("y", "9", 1), ("w", "4", 1)], "path string, h string, n int")
    assert {r["path"]: r["change"] for r in manifest.difference(a, b, "path", "h").collect()} == {"x": "unchanged", "y": "changed", "z": "removed", "w": "added"}
    assert {r[0] for r in manifest.obsolete_ids(a, b, "path", "n").collect()} == {"y#1", "z#0"}
    assert manifest.fingerprint(a, "path", "h").first() == manifest.fingerprint(a.orderBy(F.desc("path")), "path", "h").first()
    assert manifest.fingerprint(a, "path", "h").first() != manifest.fingerprint(b, "path", "h").first()
    bad = spark.createDataFrame([("/a", "0" * 64, 1), ("a/../b", "0" * 64, 1), ("ok", "0" * 64, -1), ("c", "A" * 64, 1), ("d", "0" * 64, 1), ("d", "0" * 64, 1)], "path string, content_sha256 string, chunk_count int")
    assert sorted(r["problem"] for r in manifest.problems(bad).collect()) == ["count", "duplicate", "hash", "path", "path"]
    kids = spark.createDataFrame([("p", "p:jd_text", "jd_text"), ("p", "p:job_info", "job_info"), ("q", "q:jd_text", "jd_text")], "parent_id string, child_id string, child_type string")
    assert [r[0] for r in manifest.child_problems(kids).collect()] == ["q"]
    assert one(spark, manifest.subject_of(F.col("t"), {"物理": "physics"}), t="docs/物理/a.md") == "physics"
    assert one(spark, manifest.subject_of(F.col("t"), {"物理": "physics"}), t="docs/a.md") == "general"


def test_lifecycle(spark):
    rows = spark.createDataFrame([(1, "UPLOADED"), (2, "READY")], "id int, status string")
    tries = spark.createDataFrame([(1, "UPLOADED", "PARSING", 1), (1, "UPLOADED", "DELETING", 2), (2, "READY", "PARSING", 3), (9, "READY", "DELETING", 4)], "id int, expected string, target string, attempt int")
    assert {r["attempt"]: r["won"] for r in relational.claim(rows, tries).collect()} == {1: True, 2: False, 3: False, 4: False}
    history = spark.createDataFrame([(1, 1, "UPLOADED"), (1, 2, "PARSING"), (1, 3, "READY")], "id int, seq int, status string")
    assert [(r["before"], r["status"]) for r in relational.transition_problems(history, "id", "status", ["seq"]).collect()] == [("PARSING", "READY")]
    with pytest.raises(ValueError):
        relational.check_range(5, 1)
    assert one(spark, relational.file_problem(F.col("n"), F.lit("application/pdf"), F.col("c").cast("binary"), 100), n="a.pdf", c="%PDF-1.7") is None
    assert one(spark, relational.file_problem(F.col("n"), F.lit("application/pdf"), F.col("c").cast("binary"), 100), n="a.pdf", c="hello") == "bad_magic"


def test_trace_states(spark):
    e = spark.createDataFrame([("a", 1, "start", None), ("a", 2, "finish", "OK"), ("a", 3, "finish", "ERROR"), ("b", 1, "finish", "OK"), ("c", 5, "start", None), ("d", 1, "start", None), ("d", 2, "finish", "odd")], "trace_id string, seq int, kind string, status string")
    assert {r["trace_id"]: r["status"] for r in traces.trace_states(e).collect()} == {"a": "OK", "c": "RUNNING", "d": "ERROR"}


def test_windows(spark):
    turns = spark.createDataFrame([(1, i) for i in range(1, 21)] + [(2, i) for i in range(1, 5)], "s int, id int")
    assert [r["id"] for r in windows.recent_turns(turns, "s", "id").where("s = 1").orderBy("place").collect()] == list(range(15, 21))
    assert [tuple(r) for r in windows.summary_due(turns, "s", "id").collect()] == [(1, 14, 14)]
    calls = spark.createDataFrame([(1, i, i in (2, 3, 4)) for i in range(1, 7)], "t int, n int, bad boolean")
    assert [r["n"] for r in windows.cut_off(calls, "t", "n", F.col("bad")).orderBy("n").collect()] == [1, 2, 3]
    blocks = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 200), (1, 3, "c")], "g int, o int, t string")
    got = [(len(r["used"]), r["truncated"]) for r in windows.budgeted(blocks, "g", "o", "t", 150).orderBy("o").collect()]
    assert got == [(50, False), (98, True)]


def test_masking(spark):
    from brindle.functions import masking

    assert masking.preview_of('{"a": {"my_token": 1, "b": [{"password": "x"}]}}', 200) == '{"a": {"my_token": "[REDACTED]", "b": [{"password": "[REDACTED]"}]}}'
    assert masking.preview_of("token=abc, x=1", 200) == "token=[REDACTED], x=1" and masking.preview_of(None, 5) is None
    assert one(spark, masking.captured(F.col("t"), False), t="x") is None and one(spark, masking.captured(F.col("t"), True, 2), t="xyz") == "xy"


def test_attachment_flow(spark):
    from brindle.operators import attachments as A

    now, late = F.expr("TIMESTAMP '2026-01-01 00:00:00'"), F.expr("TIMESTAMP '2026-01-03 00:00:00'")
    empty = spark.createDataFrame([], "id string, user_id string, session_id long, scope string, status string, created_at timestamp, updated_at timestamp, expires_at timestamp, page_count int, error_code string")
    users = spark.createDataFrame([(1, "u")], "id long, user_id string")
    asked = spark.createDataFrame([(f"d{i}", "u", 1) for i in range(7)] + [("x", "v", 1), ("y", "u", 9)], "id string, user_id string, session_id long")
    docs, refused = A.create(empty, asked, users, now)
    assert {tuple(r) for r in refused.collect()} == {("d5", "quota"), ("d6", "quota"), ("x", "not_owner"), ("y", "session_missing")}
    docs = A.move(docs, docs.where("id <> 'd4'"), "PARSING", now)
    results = spark.createDataFrame([("d0", 3, None), ("d1", 2, None), ("d2", None, "broken"), ("d4", 1, None)], "id string, page_count int, error string")
    docs = A.parsed(docs, results, now)
    state = lambda x: {r["id"]: r["status"] for r in x.collect()}
    assert state(docs) == {"d0": "INDEXING", "d1": "INDEXING", "d2": "FAILED", "d3": "PARSING", "d4": "UPLOADED"}
    chunks = spark.createDataFrame([("d0", "text"), ("d3", "early")], "document_id string, text string")
    docs, vectors = A.publish(docs, chunks.limit(0), chunks, now)
    assert state(docs)["d0"] == "READY" and state(docs)["d1"] == "FAILED" and [r["document_id"] for r in vectors.collect()] == ["d0"]
    assert state(A.downgrade(docs, vectors.limit(0), now))["d0"] == "FAILED" and state(A.downgrade(docs, vectors, now))["d0"] == "READY"
    assert A.publish(A.move(docs, docs, "INDEXING", now, ["PARSING"]), vectors, chunks, late)[1].count() == 1
    left, vectors = A.reclaim(docs, vectors, late)
    assert left.count() == 0 and vectors.count() == 0


def test_sessions(spark):
    from brindle.operators import sessions as S

    now, later = F.expr("TIMESTAMP '2026-01-01'"), F.expr("TIMESTAMP '2026-01-02'")
    rows = S.new_session(spark.createDataFrame([(1, "u", "p", "s", " "), (2, "u", "p", None, " T ")], "order int, user_id string, persona_id string, subject string, title string"), now, 5)
    assert [(r["id"], r["title"]) for r in rows.orderBy("id").collect()] == [(5, "新会话"), (6, "T")]
    assert S.retitle(rows, spark.createDataFrame([(5, "a  b" + "x" * 40)], "id long, title string")).where("id = 5").first()["title"] == "a b" + "x" * 27 + "..."
    turns = spark.createDataFrame([(1, 5, "u", "m", "{}"), (2, 6, "other", "m", "{}")], "id long, session_id long, user_id string, message string, reply_json string")
    conv, after = S.save_turns(turns.limit(0).withColumn("created_at", now), rows, turns, later)
    assert conv.count() == 1 and [r["id"] for r in after.where(F.col("updated_at") == later).collect()] == [5]
    journal = S.add_entries(spark.createDataFrame([], "id int, entry_date date, content string, created_at timestamp, updated_at timestamp"), spark.createDataFrame([(1, None, "a"), (2, None, "b")], "id int, entry_date date, content string"), now, F.to_date(F.lit("2026-01-05")))
    changed = S.change_entries(journal, spark.createDataFrame([(1, "c"), (2, None)], "id int, content string"), later)
    assert {(r["id"], r["content"]) for r in changed.where(F.col("updated_at") == later).collect()} == {(1, "c")}
    left, told = S.delete_entries(journal, spark.createDataFrame([(1,), (9,)], "id int"))
    assert left.count() == 1 and {tuple(r) for r in told.collect()} == {(1, True), (9, False)}
    assert S.job_rows(spark.createDataFrame([(1, [" a ", "", "b"])], "id int, skills array<string>"), ["skills"]).first()["skills_json"] == '["a","b"]'


def test_shards(spark, tmp_path):
    from brindle.operators import shards as S

    record = {"chunks": 3, "collection": "c", "embedding_model": "m", "dimension": 2}
    assert S.identity_problem(record, 3, "c", "m", [0.0, 1.0]) is None and S.identity_problem(record, 3, "c", "m", [0.0]) == "dimension" and S.identity_problem(None, 0, "c", "m", []) == "no_manifest"
    assert S.route("a", ["a", "b"]) == ["a"] and S.route("z", ["a", "b"]) == ["a", "b"] and S.index_for(None, True, False) == "vector"
    good, bad = S.manifests(spark.createDataFrame([("a", '{"schema_version": 1, "fingerprint": "f", "chunks": 2}'), ("b", "{"), ("c", '{"schema_version": 2}')], "path string, text string"))
    assert [r["path"] for r in good.collect()] == ["a"] and {tuple(r) for r in bad.collect()} == {("b", "not_json"), ("c", "schema_version")}
    for name, text in (("new", "2"), ("live", "1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.md").write_text(text)
    with pytest.raises(ValueError):
        S.install(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/live", 5)
    S.install(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/live", 1)
    assert (tmp_path / "live" / "f.md").read_text() == "2" and not (tmp_path / "live.old").exists()


def test_nth_is_exact_on_many_rows(spark):
    import random

    rnd = random.Random(7)
    rows = [(g, float(rnd.choice([rnd.randrange(50), rnd.random() * 1000]))) for g in ("a", "b", None) for _ in range(4000)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    n = F.col("n")
    for share in (0.0, 0.001, 0.37, 0.5, 0.95, 1.0):
        got = {r["g"]: (r["value"], r["n"]) for r in evaluate.nth(df, "v", evaluate.p_round(n, share), "g").collect()}
        for g in ("a", "b", None):
            own = sorted(v for k, v in rows if k == g and v is not None)
            assert got[g] == (own[round((len(own) - 1) * share)], 4000)
    own = sorted(v for _, v in rows if v is not None)
    assert evaluate.nth(df, "v", evaluate.p95_ceil(n)).first()["value"] == own[int(12000 * 0.95) - 1]
    assert evaluate.nth(df.limit(0), "v", evaluate.p95_ceil(n), "g").count() == 0


def test_topk_many_equals_single_queries(spark):
    import random

    rnd = random.Random(9)
    rows = [(f"k{i:03d}", [rnd.choice([0.0, 1.0, 0.5]) for _ in range(3)]) for i in range(300)] + [("short", [1.0]), ("none", None), ("zero", [0.0, 0.0, 0.0])]
    entries = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    asked = [(q, [rnd.random() for _ in range(3)]) for q in range(7)] + [(7, [0.0, 0.0, 0.0]), (8, [1.0])]
    queries = spark.createDataFrame(asked, "q int, query_embedding array<float>")
    for block in (4096, 2):
        got = vector.topk_many(entries, queries, 6, key="id", query_key="q", block=block)
        by = {}
        for r in got.orderBy("q", "rank").collect():
            by.setdefault(r["q"], []).append((r["id"], round(r["similarity"], 6)))
        for q, v in asked:
            want = vector.topk(entries.where("embedding IS NOT NULL").withColumn("s", F.round(vector.cosine_to(F.col("embedding"), [float(x) for x in v]), 9)), [float(x) for x in v], 1000, key="id")
            want = sorted(((r["id"], r["s"]) for r in want.collect()), key=lambda x: (-x[1], x[0]))[:6]
            assert by[q] == [(i, round(s, 6)) for i, s in want]


def test_gather_survives_a_failing_shard(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id bigint, embedding array<float>")
    part = lambda x: lambda: vector.topk(e.where(F.col("id") == x), [1.0, 0.0], 2, key="id").select("id", "similarity")

    def broken():
        return e.select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"), F.lit(1.0).alias("similarity"))

    hits, failed = vector.gather(spark, {"a": part(1), "b": part(2), "c": broken, "d": part(3)}, 2, key="id", schema="id bigint, similarity double")
    assert [r["id"] for r in hits.collect()] == [1, 3] and list(failed) == ["c"]
    hits, failed = vector.gather(spark, {"c": broken}, 2, key="id", schema="id bigint, similarity double")
    assert hits.count() == 0 and list(failed) == ["c"]


def test_frozen_shards_prune(spark, tmp_path):
    from brindle.operators import shards

    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "subject string, id int")
    assert shards.freeze(rows, f"file://{tmp_path}", "subject") == {"x": 2, "y": 1}
    some = shards.frozen(spark, f"file://{tmp_path}", shards.route("x", ["x", "y"]))
    assert sorted(r["id"] for r in some.collect()) == [1, 2] and "PartitionFilters: [isnotnull(subject" in some._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        shards.freeze(rows.unionByName(spark.createDataFrame([(None, 4)], "subject string, id int")), f"file://{tmp_path}", "subject")
    assert shards.frozen(spark, f"file://{tmp_path}", ["y"]).count() == 1


def test_rounds_may_overshoot(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", 2, True), ("a", 2, True), ("a", 3, False), ("b", 5, True), ("b", 9, None)], "t string, r int, bad boolean")
    got = [tuple(r) for r in windows.cut_off_rounds(rows, "t", "r", F.col("bad")).select("t", "r", "failures").orderBy("t", "r").collect()]
    assert got == [("a", 1, 1), ("a", 1, 1), ("a", 2, 3), ("a", 2, 3), ("b", 5, 1), ("b", 9, 1)]


def test_framed_evidence(spark):
    """Against a plain loop: the cut leaves no white space before the mark, one character of room gives the mark alone, an exact fit is not cut."""
    import random

    rng = random.Random(5)
    groups = {g: ["".join(rng.choice("ab  ") for _ in range(rng.randrange(0, 30))) for _ in range(6)] for g in range(40)}
    blocks = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)] + [(99, 0, None)], "g int, o int, t string")
    got = {(r["g"], r["o"]): r["used"] for r in windows.framed(blocks, "g", "o", "t", F.lit(7), 70, header=5).collect()}
    want = {(99, 0): ""}
    for g, ts in groups.items():
        left = 65
        for i, t in enumerate(ts):
            room = left - 7
            if room <= 0:
                break
            want[g, i] = t if len(t) <= room else t[: room - 1].rstrip() + "…"
            if len(t) > room:
                break
            left = room - len(t)
    assert got == want


def test_hard_cut_is_of_the_whole(spark):
    rows = spark.createDataFrame([(1, 1, "old" * 9), (1, 2, "new"), (2, 1, ""), (2, 2, None), (3, 1, "x ")], "u int, at int, t string")
    head = lambda n: F.concat(F.lit("n="), n.cast("string"), F.lit("\n\n"))
    got = {r["u"]: r["context"] for r in windows.hard_cut(rows, "u", "t", head, 12, newest="at", key="at").collect()}
    assert got == {1: "n=2\n\nnew\n\nol", 2: None, 3: "n=1\n\nx "}


def test_tables_are_dealt_by_their_size(spark, monkeypatch, tmp_path):
    """What one task sorts does not grow with the table, however well its keys pack; publishing and removing need few joins."""
    from pyspark.sql import functions as F

    from brindle.operators import attachments, spread

    monkeypatch.setattr(spread, "PART", 1 << 10)
    for n in (20_000, 80_000):
        spark.range(n).select("id", F.lit("INDEXING").alias("status"), F.lit(None).cast("timestamp").alias("expires_at"), F.current_timestamp().alias("updated_at")).write.parquet(f"{tmp_path}/{n}")
    parts = [spread.dealt(spark.read.parquet(f"{tmp_path}/{n}"), "id").rdd.getNumPartitions() for n in (20_000, 80_000)]
    assert 20 < parts[0] < parts[1] and spread.dealt(spark.range(3), "id").count() == 3
    docs = spark.read.parquet(f"{tmp_path}/20000")
    vectors = docs.where("id % 2 = 0").select(F.col("id").alias("document_id"))
    left, kept = attachments.remove(docs, vectors, docs.where("id % 4 = 0"), F.current_timestamp())
    assert left.count() == 15_000 and kept.count() == 5_000
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    after, found = attachments.publish(docs, vectors, docs.where("id % 3 = 0").select(F.col("id").alias("document_id")), F.current_timestamp())
    assert {r["status"]: r["count"] for r in after.groupBy("status").count().collect()} == {"READY": 6667, "FAILED": 13333}
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 and found.count() == 6667 + 6666
