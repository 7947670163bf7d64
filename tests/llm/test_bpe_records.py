from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import bpe, records
from brindle.llm.shared import Scratch

TEXTS = ["", None, "Hello, world! it's 2024.", "don't  stop\n\n\t now ", "über straße ñandú 漢字かな 🎉 é", "\x1c\x1f\x85\xa0 odd   blanks　here", "<|endoftext|> is text", "a" * 5000, " " * 300, "word " * 4000]


@pytest.fixture(scope="module")
def plain():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_equals_the_library_and_decodes(plain):
    for t in TEXTS:
        got = bpe.encode(t)
        assert got.tolist() == plain.encode_ordinary(t or "")
        assert b"".join(bpe.decode(got)) == (t or "").encode()


def test_safe_pieces_keep_the_ids(plain):
    rnd = random.Random(3)
    for _ in range(60):
        t = "".join(rnd.choice(["a", "B", "9", " ", "  ", "\n", "'s", "'", "é", "漢", "!", "\t", "　"]) for _ in range(rnd.randrange(1, 120)))
        assert "".join(bpe.safe_pieces(t, 7)) == t
        assert bpe.encode(t, long=7).tolist() == plain.encode_ordinary(t)
    assert list(bpe.safe_pieces("x" * 50, 7)) == ["x" * 50]


def by_match(text):
    """Ids of each match of the split pattern apart, by the pattern's own engine in Python."""
    import regex

    enc = bpe.encoding()
    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc._encode_single_piece(m)]


@pytest.mark.parametrize("n, blank", [(99_999, " "), (100_000, "\n"), (100_000, "\u3000"), (100_001, "\t "), (100_001, " "), (3_000_000, " "), (3_000_000, "\n")])
def test_long_runs_of_blanks(n, blank):
    run = (blank * n)[:n]
    for text in (run, f"{run}x y", f"word{run}", f"one 2{run}3, four{run} five"):
        ids = bpe.encode(text)
        assert b"".join(bpe.decode(ids)) == text.encode()
        if n < 200_000 or text == run + "x y":
            assert ids.tolist() == by_match(text)


def test_a_long_run_beside_good_rows(spark):
    texts = ["good", "x" + " " * 3_000_000 + "y", "\n" * 2_000_000, None]
    got = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r, t in zip(sorted(got, key=lambda r: r["doc_id"]), texts, strict=True))


def test_decode_in_blocks_may_split_characters():
    ids = bpe.encode("漢字" * 50)
    assert b"".join(bpe.decode(ids, block=1)) == ("漢字" * 50).encode()


def test_encode_documents(spark, plain):
    rows = spark.createDataFrame([*enumerate(TEXTS), (2, TEXTS[2]), (None, "no id")], "doc_id int, text string").withColumn("N_TOKENS", F.lit("clash")).withColumn("kept", F.lit(1))
    out = bpe.encode_documents(rows, ids=True)
    assert out.columns == ["doc_id", "text", "kept", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    got = out.collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        ids = np.array(plain.encode_ordinary(r["text"] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], bytes(r["token_ids"])) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), ids.tobytes())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_documents(rows.limit(0)).count() == 0


def test_frames_detect_damage():
    block = records.frame(b"payload")
    assert bytes(records.payload_of(block)) == b"payload" and bytes(records.payload_of(records.frame(b""))) == b""
    for i in range(len(block)):
        broken = bytearray(block)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            records.payload_of(bytes(broken))
    with pytest.raises(ValueError):
        records.payload_of(block[:-1])
    assert records.masked(0) == 0xA282EAD8


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_equal_the_library():
    t, own = library(), records.Tokens()
    rnd = random.Random(4)
    texts = [x or "" for x in TEXTS] + ["".join(rnd.choice(["a", "Bc", "9", " ", "  ", "\n", "'s", "'", "é", "!", "\t", "\r\n", "²", "½", "µ"]) for _ in range(80)) for _ in range(200)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, own.kind).tobytes() for x in texts]
    assert own.encode_many(texts) == want
    records.REMEMBERED, kept = 5, records.REMEMBERED
    try:
        assert own.encode_many(texts[::-1]) == want[::-1]
    finally:
        records.REMEMBERED = kept
    assert np.frombuffer(own.encode_many(["a<|endoftext|>b"])[0], own.kind).tolist() == [64, 50256, 65]


def test_round_trip(spark):
    t = library()
    keyed = [(k, x) for k, x in zip([7, 3, 9, 1, 12, 5, 5, 20, 21, 22], TEXTS, strict=True)] + [(None, "first")]
    rows = spark.createDataFrame(keyed, "doc_id long, text string").withColumn("start", F.lit("clash"))
    index, folder = records.store_records(rows, Scratch(spark, "t"), parts=4)
    got = records.read_records(index, folder, ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got][0] is None and [r["doc_id"] for r in got[1:]] == sorted(k for k, _ in keyed[:-1])
    at = 0
    text_of = {k: x for k, x in keyed if k != 5}
    for r in got:
        ids = np.frombuffer(bytes(r["token_ids"]), "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        if r["doc_id"] != 5:
            assert ids.tolist() == [*t.encode(text_of[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        at += len(ids)
    some = records.read_records(index.where("doc_id IN (9, 20)"), folder)
    assert {r["doc_id"] for r in some.collect()} == {9, 20}


@pytest.mark.parametrize("column", ["a.b", "n_tokens", "TEXT", "ids_sha256"])
def test_columns_of_any_name(spark, column):
    rows = spark.createDataFrame([(1, "p q", 5)], ["doc_id", "text", column])
    got = bpe.encode_documents(rows)
    assert got.columns == [c for c in rows.columns if c not in ("n_tokens", "ids_sha256")] + ["n_tokens", "ids_sha256", "decoded_sha256"] and got.first()["n_tokens"] == 2
    assert [r["n_tokens"] for r in records.read_documents(spark, rows).collect()] == [3]


def test_very_long_texts_in_one_table(spark):
    rows = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_documents(rows, ids=True).collect()}
    assert got[1]["n_tokens"] == 400_001 and all(np.frombuffer(bytes(got[k]["token_ids"]), "<u4").tolist() == library().encode(t, add_special_tokens=False).ids for k, t in rows.collect())


def test_empty_table_and_one_key(spark):
    rows = spark.createDataFrame([(1, "a")] * 5, "doc_id long, text string")
    assert records.read_documents(spark, rows.limit(0)).count() == 0
    assert sorted(r["start"] for r in records.read_documents(spark, rows).collect()) == [0, 2, 4, 6, 8]


def test_ranges_deal_out_a_hot_key_and_nulls(spark):
    from brindle.llm.shared import Ranges

    rows = spark.range(900).selectExpr("CASE WHEN id < 300 THEN NULL WHEN id < 600 THEN 7L ELSE id END AS k", "xxhash64(id) AS h")
    ranges = Ranges(rows, "k", 12)
    got = rows.select("k", "h", ranges.part(F.col("k"), F.col("h")).alias("p")).collect()
    sizes = np.bincount([r["p"] for r in got], minlength=ranges.count)
    assert len(sizes) == ranges.count and sizes.max() <= 160
    order = sorted(got, key=lambda r: (r["k"] is not None, r["k"] or 0, r["h"]))
    assert [r["p"] for r in order] == sorted(r["p"] for r in got)


def test_many_ranges(spark):
    from brindle.llm.shared import Ranges

    rows = spark.range(4000).selectExpr("id * 3 AS k", "xxhash64(id) AS h")
    few, many = Ranges(rows, "k", 5), Ranges(rows, "k", 1500)
    assert len(many.cuts) > 1000 and len(set(many.cuts)) > 512
    got = rows.select("k", few.part(F.col("k"), F.col("h")).alias("a"), many.part(F.col("k"), F.col("h")).alias("b")).orderBy("k").collect()
    for r in got:
        assert r["a"] == sum(c < r["k"] for c in few.cuts) and r["b"] == sum(c < r["k"] for c in many.cuts)


def test_each_range_gets_a_task_of_its_own(spark):
    from brindle.llm.shared import Ranges

    rows = spark.range(3000).selectExpr("id AS k", "xxhash64(id) AS h")
    ranges = Ranges(rows, "k", 24)
    dealt = ranges.deal(rows.withColumn("p", ranges.part(F.col("k"), F.col("h"))), "p")
    seen = dealt.select("p", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(seen) == ranges.count == len({r["task"] for r in seen})
