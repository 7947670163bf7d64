from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import manifest, pipelines
from brindle.operators.store import Store, canonical_lines
from brindle.sources import files, jobs, tables
from brindle.streaming import traces as streams


def embed(rows, text):
    """A stand-in for an embedding provider: three numbers from the text."""
    return rows.withColumn("embedding", F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"), (F.crc32(F.col(text).cast("binary")) % 7).cast("float")))


def test_buckets_not_touched_stay(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t", key="id", buckets=8)
    s.rebuild(spark.range(100).selectExpr("id", "'a' AS v"))
    before = s._commit()["parts"]
    s.upsert(spark.createDataFrame([(3, "b"), (1000, "c")], "id long, v string"), "id")
    after = s._commit()["parts"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2 and s.count() == 101
    s.delete(spark.createDataFrame([(3,)], "id long"), "id")
    assert s.count() == 100 and s.read().where("id = 3").count() == 0 and s.problems("id").count() == 0
    assert s.sync(spark.createDataFrame([(5, "z")], "id long, v string"), "id", remove=spark.createDataFrame([(7,)], "id long"), expect=99) == 99
    s.delete(spark.range(2000), "id")
    assert s.count() == 0 and s.read().columns == ["id", "v"]


@pytest.mark.parametrize("key", [None, "id"])
def test_store(spark, tmp_path, key):
    s = Store(spark, f"file://{tmp_path}/t", key)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert not s.exists() and s.rebuild(rows).count() == 2
    s.upsert(spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), "id")
    assert {tuple(r) for r in s.read().collect()} == {(1, "a"), (2, "B"), (3, "c")}
    s.delete(spark.createDataFrame([(1,)], "id int"), "id")
    s.replace_groups(spark.createDataFrame([(3, "d")], "id int, v string"), "id")
    assert {tuple(r) for r in s.read().collect()} == {(2, "B"), (3, "d")}
    with pytest.raises(ValueError):
        s.sync(rows, "id", expect=99)
    assert s.count() == 2 and s.sync(rows, "id", replace=True, expect=2) == 2
    assert canonical_lines(spark.createDataFrame([("é", None)], "b string, a string")).first()[0] == '{"a":null,"b":"é"}'


def write(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


def test_note_index_refresh(spark, tmp_path):
    root = tmp_path / "notes"
    write(root, "docs/a.md", "# A\none two")
    write(root, "docs/b.md", "# B\nthree " + "word. " * 300)
    write(root, "docs/empty.md", "# Only a title")
    store, commit, settings = Store(spark, f"file://{tmp_path}/index"), f"file://{tmp_path}/commit.json", {"model": "m"}
    go = lambda: pipelines.build_notes(files.markdown(spark, f"file://{root}"), store, embed, commit, settings, dimension=3)
    assert go() == "full" and go() == "unchanged"
    n = store.count()
    write(root, "docs/b.md", "# B\nshort")
    assert go() == "incremental" and store.count() < n
    (root / "docs/a.md").unlink()
    assert go() == "incremental" and {r[0] for r in store.read().select("source").distinct().collect()} == {"docs/b.md"}
    settings["model"] = "other"
    assert go() == "full" and go() == "unchanged"
    assert json.loads((tmp_path / "commit.json").read_text())["chunks"] == 1
    manifest.invalidate(spark, commit)
    assert manifest.read_commit(spark, commit) is None and go() == "full"


HEAD = "文件,相关度,相关度分值,职位,招聘主体,薪资,学历,招聘人数,专业,地区,更新时间,所属行业,公司性质,公司规模,技术关键词,同模板条数,JD指纹,详情页"


def test_jobs(spark, tmp_path):
    root = tmp_path / "jobs"
    row = lambda file, fp, pay="10k-20k", title="Agent 工程师": f"{file},高,90,{title},某公司,{pay},本科,3,计算机,广东省深圳市,2026-01-01,软件,民营,100人,\"Python,LLM/RAG\",2,{fp},http://x"
    lines = [HEAD, row("a.md", "f1"), row("b.md", "f2", "面议"), row("c.md", "f3"), row("", "f4"), row("d.md", "f5"), row("e.md", "f1"), row("g.md", "f6", title="")]
    root.mkdir()
    (root / "list.csv").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    body = "## 职位原文\n\n做事\n```\ncode\n```\n\n## 福利标签\n\n双休\n"
    for name in ("a.md", "b.md", "e.md", "g.md"):
        write(root / "jobs", name, body)
    write(root / "jobs", "c.md", "## 其他\n\nx")
    (root / "jobs" / "d.md").write_bytes(b"\xff\xfe\x00")
    listing = jobs.listing(spark, f"file://{root}/list.csv", "marketing")
    built = jobs.build(listing, files.scan(spark, f"file://{root}/jobs", ".md")).cache()
    assert {(r["file"], r["reject"]) for r in jobs.rejects(built).collect()} == {("b.md", "unsupported_salary"), ("c.md", "missing_section"), ("", "missing_filename"), ("d.md", "not_utf8"), ("e.md", "duplicate_jd_id"), ("g.md", "missing_field")}
    (p,) = jobs.parents(built).collect()
    assert (p["jd_id"], p["province"], p["keywords"], p["duplicate_count"], p["relevance_score"]) == ("marketing:f1", "广东省", ["Python", "LLM", "RAG"], 2, 90)
    assert p["jd_text"] == "# Agent 工程师\n\n## 职位原文\n\n做事\ncode" and p["job_info"].endswith("## 福利标签\n\n双休") and "| 薪资 | 10k-20k |" in p["job_info"]
    with pytest.raises(ValueError):
        jobs.parents(built, strict=True)
    kids = jobs.children(jobs.parents(built))
    assert manifest.child_problems(kids).count() == 0
    store = Store(spark, f"file://{tmp_path}/kids")
    assert pipelines.refresh_children(kids, store, embed) == {"added": 2} and pipelines.refresh_children(kids, store, embed) == {"unchanged": 2}
    assert pipelines.ready(store.read(), kids)
    found = pipelines.search_jobs(store.read(), jobs.parents(built), [5.0, 1.0, 1.0], ["python"], threshold=0.1, salary_floor=5, education="本科").collect()
    assert [r["jd_id"] for r in found] == ["marketing:f1"]
    assert pipelines.search_jobs(store.read(), jobs.parents(built), [5.0, 1.0, 1.0], ["python"], threshold=0.1, salary_ceiling=5).count() == 0


def test_eval_cases(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('﻿{"query": "a", "expected_sources": ["x", " "]}\n\n{"id": "k", "question": "b", "group": "jd"}\n', encoding="utf-8")
    got = files.eval_cases(spark, f"file://{p}").orderBy("line").collect()
    assert [(r["id"], r["query"], r["group"], r["expected_sources"]) for r in got] == [("case_001", "a", "default", ["x"]), ("k", "b", "jd", [])]
    cases = files.eval_cases(spark, f"file://{p}")
    assert [r["id"] for r in files.select_cases(cases, ["k", "case_001"]).collect()] == ["k", "case_001"]
    with pytest.raises(ValueError):
        files.select_cases(cases, ["nope"])
    p.write_text('{"id": "z"}\n')
    with pytest.raises(Exception, match="no query"):
        files.eval_cases(spark, f"file://{p}").collect()


def test_scans(spark, tmp_path):
    write(tmp_path / "h", "a.html", "<p>x</p>")
    write(tmp_path / "h", "b.html", "<p>x</p>")
    with pytest.raises(ValueError, match="duplicate"):
        files.html(spark, f"file://{tmp_path}/h")
    with pytest.raises(ValueError, match="no"):
        files.markdown(spark, f"file://{tmp_path}/h")
    assert [r["path"] for r in files.listing(spark, f"file://{tmp_path}/h", [".HTML"]).collect()] == ["a.html", "b.html"]
    raw = spark.createDataFrame([(1, " T ", "https://A.com/x#f", "s", None), (2, "U", "https://a.com/x", "t", None), (3, "V", "http://a.com", "t", None)], "place int, title string, url string, content string, published_at string")
    assert [(r["title"], r["url"], r["domain"]) for r in files.web_results(raw).collect()] == [("T", "https://a.com/x", "a.com")]
    pdf = spark.createDataFrame([("x.pdf", bytearray(b"%PDF-1.4 broken"))], "path string, content binary")
    assert files.pdf_pages(pdf).first()["error"] is not None


def test_scan_of_many_small_files(spark, tmp_path):
    """Tasks follow the bytes and not the number of files, whose list stays out of the driver; all rounds of a deep tree are read."""
    root = tmp_path / "a b%20c"
    names = [f"{i % 3}/{i % 90}/x/{i}.md" for i in range(900)] + ["top é.md", "0/#1?.md", "0/empty.md"]
    for i, n in enumerate(names):
        write(root, n, "" if "empty" in n else f"text {i}")
    for n in ("0/.hidden.md", "_skipped/a.md", "0/other.txt", "0/A.MD"):
        write(root, n, "x")
    rows = files.scan(spark, f"file://{root}", ".md")
    assert rows.columns == ["path", "content", "sha256", "size", "modificationTime"]
    assert rows.rdd.getNumPartitions() <= 4 and len(rows.inputFiles()) < 100
    got = {r["path"]: (bytes(r["content"]), r["size"], round(r["modificationTime"].timestamp() * 1000)) for r in rows.collect()}
    assert got == {n: ((root / n).read_bytes(), (root / n).stat().st_size, (root / n).stat().st_mtime_ns // 1_000_000) for n in names}
    assert [r["path"] for r in files.scan(spark, str(root), ".md", only=["0/#1?.md"]).collect()] == ["0/#1?.md"]
    assert files.scan(spark, f"file://{root}", ".md", content=False).columns == ["path", "size", "modificationTime"]
    assert files.listing(spark, f"file://{root}", [".md"]).count() == len(names) + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan(spark, f"file://{root}/none", ".md")


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.append(spark.createDataFrame([("t1", 1)], "trace_id string, rounds int"), "agent_traces", path)
    tables.append(spark.createDataFrame([("t2", "OK", "extra")], "trace_id string, status string, other string"), "agent_traces", path)
    assert {(r["trace_id"], r["status"], r["rounds"]) for r in tables.read(spark, path, "agent_traces").collect()} == {("t1", None, 1), ("t2", "OK", None)}
    docs = spark.createDataFrame([("a", "ATTACHMENT", "READY", None, 1, None, None, 1), ("b", "INTERNAL", "FAILED", None, None, None, None, 1), ("c", "INTERNAL", "READY", None, None, None, None, -1)], "id string, scope string, status string, user_id string, session_id long, expires_at timestamp, error_code string, size_bytes long").withColumn("page_count", F.lit(1))
    assert {tuple(r) for r in tables.document_problems(docs).collect()} == {("a", "scope_shape"), ("b", "error_code"), ("c", "size")}


def test_trace_stream(spark, tmp_path):
    schema = "trace_id string, seq int, kind string, status string"
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, "start", None), ("b", 1, "start", None), ("c", 1, "finish", "OK")], schema).coalesce(1).write.parquet(f"file://{src}")
    store = Store(spark, f"file://{tmp_path}/states")
    run = lambda: streams.trace_state_stream(spark.readStream.schema(schema).parquet(f"file://{src}"), store, f"file://{tmp_path}/log").awaitTermination()
    run()
    spark.createDataFrame([("a", 2, "finish", "weird"), ("a", 3, "finish", "OK"), ("c", 0, "start", None)], schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
    run()
    assert {r["trace_id"]: r["status"] for r in store.read().collect()} == {"a": "ERROR", "b": "RUNNING", "c": "OK"}
    run()
    assert store.count() == 3


@pytest.mark.parametrize("name", ["note_search", "job_search"])
def test_searches_join_texts_once(spark, sf, name):
    """The texts are joined with their vectors once and read from there: no later plan reads the documents."""
    from brindle.plans.catalogue import QUERIES

    opened = QUERIES[name](spark, sf).inputFiles()
    assert opened and all("/entries-" in f for f in opened)
