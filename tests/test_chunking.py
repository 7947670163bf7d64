from __future__ import annotations

import random
import re

import pytest

from brindle.operators import chunk_html as H
from brindle.operators import chunk_markdown as M
from brindle.operators import chunk_pages as P


def test_heading_paths_nest_by_stack():
    text = "# A\none\n### C\ntwo\n### D\nthree\n## B\nfour\n# Only a title\n"
    assert [(c.title_path, c.content.split("\n")[-1]) for c in M.chunks(text)] == [("A", "one"), ("A > C", "two"), ("A > C > D", "three"), ("A > B", "four")]


def test_fences_hide_headings_and_are_repeated():
    body = "\n".join(f"line {i}" for i in range(60))
    found = M.chunks(f"# T\n```py\n# no heading\n{body}\n```\n", 120, 10)
    assert len(found) > 3 and {c.title_path for c in found} == {"T"}
    assert all(c.content.startswith("# T\n```py\n") and c.content.endswith("\n```") for c in found)


def test_table_header_is_repeated():
    rows = "\n".join(f"| {i} | value {i} |" for i in range(40))
    found = M.chunks(f"# T\n| a | b |\n|---|---|\n{rows}", 150, 10)
    assert len(found) > 2 and all("| a | b |\n|---|---|\n" in c.content for c in found)


def test_list_keeps_its_intro():
    items = "\n".join(f"- item number {i}" for i in range(30))
    found = M.chunks(f"# T\nBefore it.\nThese are the items:\n{items}", 130, 10)
    assert sum("These are the items:" in c.content for c in found) >= 3
    assert found[0].content == "# T\nBefore it." or "Before it." in found[0].content


@pytest.mark.parametrize("seed", range(6))
def test_pieces_keep_the_budget_and_the_text(seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta.", "gamma,", "delta!", "第一。", "两个", "\n", "\n\n", "- x", "3.14", "```", "| a | b |", "# H"]
    text = " ".join(rnd.choice(words) for _ in range(600))
    size = rnd.choice([40, 120, 512])
    found = M.chunks(text, size, size // 10)
    assert [c.index for c in found] == list(range(len(found)))
    assert all(len(c.content) <= size for c in found)
    joined = "".join(c.content for c in found)
    assert all(w in joined for w in ("alpha", "beta.", "第一。") if w in text)


def test_windows_prefer_sentence_ends_and_overlap():
    text = "One sentence here. " * 40
    found = M.windows(text, 100, 20)
    assert all(p.endswith(".") and p.startswith("One") for p in found)
    assert M.windows("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    assert not any(p.startswith("14") for p in M.windows("pi is 3.14 and more words follow " * 20, 60, 0))


def brute_windows(text, size, overlap):
    """Every window's end by trying all places from the last, one kind of boundary after another."""
    stops = {i: i for i in range(len(text))}

    def sentence(i):
        if text[i] not in "。…！？；!?;.":
            return None
        e = i + 1
        while e < len(text) and text[e] in "」』”’\"')）]】》":
            e += 1
        if text[i] in "!?;." and ((text[i] == "." and i and text[i - 1].isdigit()) or (e < len(text) and not text[e].isspace())):
            return None
        return e

    out, at = [], 0
    while len(text) - at > size:
        low, high = at + max(size // 2, overlap + 1), at + size
        gaps = [e for e in range(low, high + 1) if re.search(r"\n[ \t]*\n$", text[at:e])]
        ends = [e for i in stops if low - 1 <= i < high and (e := sentence(i)) and e <= high]
        lines = [i + 1 for i in range(low - 1, high) if text[i] == "\n"]
        soft = [i + 1 for i in range(low - 1, high) if text[i] in ",，、 \t"]
        cut = next((max(x) for x in (gaps, ends, lines, soft) if x), high)
        out.append(text[at:cut].strip())
        begin = cut - overlap
        least = max(at + 1, begin - 2 * overlap)
        near = [i + 1 for i in range(least - 1, begin) if text[i] == "\n"] + [e for i in range(least - 1, begin) if (e := sentence(i)) and e <= begin]
        if overlap and near:
            begin = max(near)
            while begin < cut and text[begin].isspace():
                begin += 1
            begin = begin if begin < cut else cut - overlap
        at = begin
    return [p for p in [*out, text[at:].strip()] if p]


@pytest.mark.parametrize("seed", range(30))
def test_windows_equal_brute_force(seed):
    rnd = random.Random(seed)
    bits = ["word", "Wort,", "end. ", "fin!\"", "第一。", "（好！）", "3.14", "\n", "\n\n", " ", "、", "x" * 30, "?) ", "v2. "]
    text = "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.choice([20, 200])))
    text = re.sub(r"\n(?:[ \t]*\n)+", "\n\n", text)
    for size, overlap in ((20, 0), (40, 8), (64, 30), (100, 99)):
        if len(text) > size:
            assert M.windows(text, size, overlap) == brute_windows(text, size, overlap)


class ByPairs:
    """Counts a pair of letters as a token, and a header of any length as its words, so that counts do not add up."""

    def count(self, text):
        return len(re.findall(r"..?", text)) + text.count("z")

    def offsets(self, text):
        return [m.span() for m in re.finditer(r"..?", text)]


@pytest.mark.parametrize("seed", range(8))
def test_token_windows_equal_one_by_one(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice("abz ") for _ in range(300))
    for tok in (ByPairs(), H.WordTokenizer()):
        cutter = H.Splitter("h", tok, 24, 8, 20, 3)
        tokens = [t for t in tok.offsets(text) if t[1] > t[0]]
        room, want, at = 20 - tok.count("h\n\n"), [], 0
        while not want or want[-1][1] != len(text):
            fitting = [(a, z, e) for e in range(at + 1, min(at + room, len(tokens)) + 1) for a, z in [(tokens[at][0] if at else 0, tokens[e - 1][1] if e < len(tokens) else len(text))] if cutter.fits(text[a:z])]
            want.append(fitting[-1])
            at = fitting[-1][2] - 3
        assert [p.text for p in cutter.windows(text)] == [text[a:z] for a, z, _ in want]


def test_windows_validate():
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            M.check_window(size, overlap)


def test_empty_texts_have_no_chunks(spark):
    assert M.chunks("") == [] and M.chunks("\n \n") == []
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "# T\nbody")], "source string, text string")
    assert [r["chunk_id"] for r in M.chunk_table(rows, "source", "text").collect()] == ["c#0"]


PAGE = """<html><head><title>Lesson 1</title><style>x</style></head><body>
<section class="content-slide"><h2>Chapter</h2><h3>Q1 What is it?</h3><p>An  answer , short.</p><ul><li>one</li><li>two</li></ul></section>
<section class="content-slide"><p>More of it.</p><div class="controls">no</div></section>
<section class="content-slide"></section>
<section class="content-slide"><h3>Trends of 2023 and 2025</h3><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x|y</td></tr></table><pre><code class="language-py">a = 1
b = 2</code></pre><img alt="a picture"></section></body></html>"""


def test_units_of_slides():
    found = H.units(PAGE, "x\\p.html")
    assert [u["chunk_type"] for u in found] == ["lesson_overview", "section_overview", "qa", "trend"]
    qa, trend = found[2], found[3]
    assert qa["source"] == "x/p.html" and qa["question"] == "Q1 What is it?" and (qa["slide_start"], qa["slide_end"]) == (1, 2)
    assert H.content_of(qa) == "An answer, short.\n\n- one\n- two\n\nMore of it."
    assert trend["time_tags"] == [2023, 2025] and trend["blocks"][0].text == "| a | b |\n| --- | --- |\n| 1 | x\\|y |"
    assert trend["blocks"][1].text == "```py\na = 1\nb = 2\n```" and trend["blocks"][2].text == "a picture"
    assert H.header_of(trend) == "课程：Agent 求职面试全攻略\n讲次：Lesson 1\n章节：Chapter\n专题：Trends of 2023 and 2025"


def test_course_map():
    html = '<div class="hero"><h1>Map</h1></div><div class="course-card"><span class="lesson-no">1</span><span class="lesson-title">T</span><p class="lesson-desc">D</p><ul class="lesson-points"><li>p</li></ul></div>'
    (unit,) = H.units(html, "m.html")
    assert unit["chunk_type"] == "course_overview" and unit["course"] == "Map" and H.content_of(unit) == "1 · T\n简介：D\n知识点：\n- p"
    with pytest.raises(ValueError):
        H.units("  ", "m.html")


def test_records_keep_the_budget():
    long = " ".join(f"Sentence number {i} has some words in it, and a clause." for i in range(80))
    page = PAGE.replace("More of it.", long)
    tok = H.WordTokenizer()
    found = H.records(H.units(page, "p.html"), tok, threshold=120, target_min=40, target_max=80, overlap=10)
    assert all(r["embedding_token_count"] <= 120 for r in found)
    parts = [r for r in found if r["chunk_type"] == "qa"]
    assert len(parts) > 3 and [r["part_index"] for r in parts] == list(range(len(parts))) and {r["part_count"] for r in parts} == {len(parts)}
    text = "".join(re.sub(r"\s", "", r["content"]) for r in parts)
    assert re.sub(r"\s", "", long) in text
    one = "x" * 3 + "".join(f"w{i}_" for i in range(10))
    windows = H.Splitter("h", tok, 12, 4, 8, 2).windows(" ".join(["tok"] * 30))
    assert all(p.method == "token_window" for p in windows) and [p.overlap for p in windows][0] == 0 and one


def test_record_table_is_valid(spark):
    rows = spark.createDataFrame([("p.html", PAGE), ("q.html", PAGE)], "url string, html string")
    found = H.record_table(rows, "url", "html")
    assert found.count() == 8 and H.record_problems(found).count() == 0


def test_page_chunks_never_cross_pages(spark):
    assert P.page_chunks(["a" * 10, "b" * 10, "", "c" * 50], 30, 5) == ["a" * 10 + "\n\n" + "b" * 10, *M.windows("c" * 50, 30, 5)]
    block = lambda i, t: (i, "text", [0.0, 0.0, 1.0, 1.0], t)
    doc = (1, "d", "f.pdf", 2, 4, [(1, 1.0, 1.0, [block(0, "ab")]), (2, 1.0, 1.0, [block(0, "cd")])])
    bad = (1, "e", "f.pdf", 2, 9, [(1, 1.0, 1.0, [block(0, "ab")]), (3, 1.0, 1.0, [block(0, "cd")])])
    docs = spark.createDataFrame([doc, bad], P.DOCUMENT)
    assert [tuple(r) for r in P.problems(docs).collect()] == [("e", "page_number")]
    assert [(r["chunk_index"], r["page_start"], r["text"]) for r in P.chunk_table(docs.where("document_id = 'd'")).orderBy("chunk_index").collect()] == [(0, 1, "ab"), (1, 2, "cd")]


def test_the_registered_query_chunks_whole_texts(spark, tmp_path):
    from brindle.plans.chunking import chunk_markdown_docs

    words = [f"w{i:03d}" for i in range(420)]
    texts = [" ".join(words), "\n".join(" ".join(words[k : k + 20]) for k in range(0, 420, 20)), "\n".join(words[:21]), words[0], "x\n\n \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {str(i): "" for i in range(len(texts))}
    for r in chunk_markdown_docs(spark, str(tmp_path)).collect():
        got[r["source"]] += r["content"].replace("\n", "") + " "
    for i, t in enumerate(texts):
        assert [w for w in t.split() if w not in got[str(i)]] == []


def test_pages_become_python_objects_in_parts():
    import pyarrow as pa

    from brindle.operators import chunk_pages

    texts = [["x" * 300, None], [], None, ["y" * 5000], ["z" * 10] * 3, ["ä" * 400], []]
    batch = pa.record_batch({"document_id": [str(i) for i in range(7)], "page": pa.array([1] * 7, pa.int32()), "texts": pa.array(texts, pa.list_(pa.string()))})
    parts = list(chunk_pages._parts(batch, 1000))
    assert pa.Table.from_batches(parts).combine_chunks().to_pydict() == batch.to_pydict() and len(parts) == 4
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for x in p["texts"].to_pylist() for t in x or []) <= 1000 for p in parts)
    again = batch.slice(3)  # a slice's offsets do not begin at 0
    assert pa.Table.from_batches(list(chunk_pages._parts(again, 100))).to_pydict() == again.to_pydict()


def test_a_window_looks_at_the_places_near_it(monkeypatch):
    """The time of a window does not grow with the text: places outside its range are not read."""
    from brindle.operators import chunk_markdown

    reads, found = [0], chunk_markdown.boundaries

    class Counting(list):
        def __getitem__(self, at):
            reads[0] += 1
            return super().__getitem__(at)

    monkeypatch.setattr(chunk_markdown, "boundaries", lambda text: Counting(found(text)))
    spans = list(chunk_markdown.window_spans("ab cd, ef gh. " * 5000, 512, 50))
    assert len(spans) > 100 and reads[0] < 300 * len(spans)
