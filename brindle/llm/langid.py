"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order three is frozen from the counts of all orders over all training documents. A byte costs
-log2 of c / (T + D) in its longest context that has seen it, plus -log2 of D / (T + D) for every longer context that is known but has not
(escape method C: T occurrences of the context, D distinct bytes after it), down to a uniform order -1. A text's exact code length is the sum over
all its bytes; the language with the least wins, ties by name. The score is the posterior of that language under equal priors.

Texts are coded in lower case, with every run of ASCII characters that are no letters as one blank, after three blanks of context. A
text that is null or has no letter is ``und`` with score 0, and so is every text where no training row exists. Training skips rows with a null text or
language; languages are whatever values the column holds. Repeated rows count as often as they occur. An empty table gives an
empty result; extra columns are ignored.

Counts cover all training rows and are summed in each task before the shuffle. Every context's occurrences and followers are counted before anything is
left out; then only the tree leaves the executors, and orders 0 and 1 of it whole. Of orders 2 and 3 each language keeps its most frequent cells, at most GRAMS, and at
most CELLS / (TOGETHER * languages), so that the model's tables have a fixed bound: up to 20 languages keep 400,000 cells an order each, 200 languages 40,000. A byte
whose cell was left out costs its context's escape and the next order's code, as an unseen one does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.shared import Scratch, own_columns, pieces

GRAMS, CELLS = 400_000, 64_000_000
#: Languages that share one lookup table; more languages have more tables.
TOGETHER = 8
#: Bytes of text worked on at a time.
BLOCK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\x00-`{-\x7f]+")
_PAD, _BLANK = 255, 32
_MAP = np.arange(256, dtype=np.uint8)
_MAP[[*range(0, 97), *range(123, 128)]] = _BLANK
_EMPTY = np.uint64(2**64 - 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams (the byte in the low bits, its three predecessors above) at all bytes of the normalised texts, and each text's number of bytes."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    pad = bytes([_PAD]) * 3
    data = _MAP[np.frombuffer(pad + pad.join(raw) if raw else b"", np.uint8)]
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    blank = data == _BLANK
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (data[:-1] == _PAD)))
    ends = np.cumsum([3 + len(r) for r in raw])
    data = data[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    real = data != _PAD
    s = np.where(real, data, _BLANK).astype(np.uint32)
    key = s.copy()
    for back, shift in ((1, 8), (2, 16), (3, 24)):
        key[back:] |= s[:-back] << np.uint32(shift)
    return key[real], np.diff(kept) - 3


def grams(text: str) -> Iterator[np.ndarray]:
    """The 4-grams of one text of any length, in blocks; each block is coded after the last normalised characters before it."""
    tail = ""
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        yield coded([tail + block])[0][len(coded([tail])[0]) if tail else 0 :]
        tail = _OTHER.sub(" ", (tail + block).lower())[-8:]


class Table:
    """Open addressing from 64-bit keys to row numbers, many keys at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.reach, todo = 0, np.arange(len(keys))
        keys = keys.astype(np.uint64)
        while len(todo):
            slot = (self._home(keys[todo]) + self.reach) & (len(self.keys) - 1)
            free = self.keys[slot] == _EMPTY
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            win = free & first
            self.keys[slot[win]], self.rows[slot[win]] = keys[todo[win]], todo[win]
            todo = todo[~win]
            self.reach += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        keys = keys.astype(np.uint64)
        home = self._home(keys)
        seen = self.keys[home]
        out = np.where(seen == keys, self.rows[home], -1)
        todo = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        for step in range(1, self.reach):
            if not len(todo):
                break
            slot = (home[todo] + step) & (len(self.keys) - 1)
            seen = self.keys[slot]
            hit = seen == keys[todo]
            out[todo[hit]] = self.rows[slot[hit]]
            todo = todo[~hit & (seen != _EMPTY)]
        return out


class Counts:
    """One language. four: 4-grams and their counts. three: 3-grams, their counts as such, and their occurrences and distinct followers as contexts.
    two: counts of byte pairs, and occurrences and distinct followers of them as contexts, 65,536 of each."""

    def __init__(self, four: tuple, three: tuple, two: tuple):
        self.four, self.three, self.two = four, three, two


class Tree:
    """Frozen code lengths in bits of some languages."""

    def __init__(self, counts: list[Counts]):
        n = len(counts)
        g4 = np.unique(np.concatenate([c.four[0] for c in counts])).astype(np.uint64)
        g3 = np.unique(np.concatenate([g4 & np.uint64(0xFFFFFF), g4 >> np.uint64(8), *[c.three[0].astype(np.uint64) for c in counts]]))
        self.full, self.three = Table(g4), Table(g3)
        self.cost3 = np.zeros((len(g4), n), np.float32)
        self.cost2, self.escape3 = np.zeros((len(g3), n), np.float32), np.zeros((len(g3), n), np.float32)
        self.cost1, self.escape2 = np.zeros((1 << 16, n), np.float32), np.zeros((1 << 16, n), np.float32)
        pair = np.arange(1 << 16)
        for j, c in enumerate(counts):
            placed = lambda keys, of, values: np.bincount(np.searchsorted(keys, of.astype(np.uint64)), values, len(keys))
            c4, (c3, t3, d3), (c2, t2, d2) = placed(g4, *c.four), (placed(g3, c.three[0], x) for x in c.three[1:]), c.two
            c1 = np.bincount(pair & 255, c2, 256)
            cost0 = self._level(c1, np.zeros(256, np.int64), np.array([c1.sum()]), np.array([np.count_nonzero(c1)]), np.full(256, 8.0))[0]
            cost1, _ = self._level(c2, pair >> 8, np.bincount(pair >> 8, c2, 256), np.bincount(pair >> 8, c2 > 0, 256), cost0[pair & 255])
            cost2, self.escape2[:, j] = self._level(c3, (g3 >> np.uint64(8)).astype(np.int64), t2, d2, cost1[(g3 & np.uint64(0xFFFF)).astype(np.int64)])
            cost3, self.escape3[:, j] = self._level(c4, np.searchsorted(g3, g4 >> np.uint64(8)), t3, d3, cost2[np.searchsorted(g3, g4 & np.uint64(0xFFFFFF))])
            self.cost1[:, j], self.cost2[:, j], self.cost3[:, j] = cost1, cost2, cost3

    @staticmethod
    def _level(count: np.ndarray, context: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each (context, byte), and each context's escape (0 if it is unknown), from the next lower order's."""
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            seen = -np.log2(count / (total + kinds)[context])
        return np.where((count > 0) & (total[context] > 0), seen, escape[context] + lower), escape  # a cell whose context was left out counts as unseen

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each 4-gram's byte under each language."""
        row = self.full.find(keys)
        out = self.cost3[row] if len(self.cost3) else np.zeros((len(keys), self.cost1.shape[1]), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            k = keys[new].astype(np.int64)
            r3, pair = self.three.find((k & 0xFFFFFF).astype(np.uint64)), k & 0xFFFF
            cost = np.where((r3 >= 0)[:, None], self.cost2[r3], self.escape2[(k >> 8) & 0xFFFF] + self.cost1[pair])
            context = self.three.find((k >> 8).astype(np.uint64))
            out[new] = cost + np.where((context >= 0)[:, None], self.escape3[context], 0)
        return out


class Model:
    """Trees of all languages, TOGETHER in each."""

    def __init__(self, counts: dict[str, Counts]):
        self.langs = sorted(counts)
        self.trees = [Tree([counts[lang] for lang in self.langs[i : i + TOGETHER]]) for i in range(0, len(self.langs), TOGETHER)]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        found = [tree.bits(keys) for tree in self.trees]
        return found[0] if len(found) == 1 else np.concatenate(found, 1)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Exact code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        if sum(map(len, texts)) > 2 * BLOCK:
            for i, t in enumerate(texts):
                for keys in grams(t):
                    out[i] += self.bits(keys).sum(0, dtype=np.float64)
            return out
        keys, counts = coded(texts)
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(self.bits(keys), (np.cumsum(counts) - counts)[some], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", grams_kept: int = GRAMS, cells: int = CELLS) -> Model:
    """Count all rows, then freeze. The driver receives the kept 4-grams only."""
    rows = own_columns(docs, text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

        def sent(one: str) -> pa.RecordBatch:
            keys, n = merged(sums.pop(one))
            return pa.RecordBatch.from_arrays([pa.array([one] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        def add(one: str, keys: np.ndarray) -> None:
            parts = sums.setdefault(one, [])
            parts.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in parts) > 500_000:
                parts[:] = [merged(parts)]

        for batch in batches:
            for part in pieces(batch, text, BLOCK):
                by: dict[str, list[str]] = {}
                for t, one in zip(part.column(text).to_pylist(), part.column(lang).to_pylist(), strict=True):
                    by.setdefault(one, []).append(t)
                for one, texts in by.items():
                    if len(texts) == 1 and len(texts[0]) > BLOCK:
                        for keys in grams(texts[0]):
                            add(one, keys)
                    else:
                        add(one, coded(texts)[0])
                    if len(sums[one]) == 1 and len(sums[one][0][0]) > 500_000:
                        yield sent(one)
        for one in list(sums):
            yield sent(one)

    scratch = Scratch(docs.sparkSession, "langid")

    def lower(table: DataFrame, mask: int) -> DataFrame:
        """Counts of one order less: of the byte and its nearer context, and what each context has."""
        as_cell = F.struct(F.col("g").bitwiseAND(mask).alias("g"), F.col("c"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("d"))
        as_context = F.struct(F.shiftright("g", 8).alias("g"), F.lit(0).cast("long").alias("c"), F.col("c").alias("t"), F.lit(1).cast("long").alias("d"))
        return table.select("lang", F.explode(F.array(as_cell, as_context)).alias("x")).groupBy("lang", "x.g").agg(*[F.sum(f"x.{c}").alias(c) for c in ("c", "t", "d")])

    four = scratch.put(rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", F.col("gram").alias("g")).agg(F.sum("n").alias("c")))
    three = scratch.put(lower(four, 0xFFFFFF))
    two = _by_language(lower(three.where("c > 0"), 0xFFFF), ["g", "c", "t", "d"])  # 65,536 rows a language at most
    bound = min(grams_kept, cells // (TOGETHER * max(1, len(two))))
    cells4, cells3 = _most_frequent(four, F.col("c"), bound, ["g", "c"]), _most_frequent(three, F.col("c") + F.col("t"), bound, ["g", "c", "t", "d"])
    scratch.clear()

    def dense(found: list[np.ndarray]) -> tuple:
        return tuple(np.bincount(found[0], x, 1 << 16) for x in found[1:])

    none = [np.zeros(0, np.int64)] * 4
    return Model({one: Counts(tuple(cells4.get(one, none[:2])), tuple(cells3.get(one, none)), dense(found)) for one, found in two.items()})


def _by_language(table: DataFrame, columns: list[str]) -> dict[str, list[np.ndarray]]:
    got = table.select("lang", *columns).toArrow().combine_chunks()
    names = got.column("lang").to_numpy()
    return {one: [got.column(c).to_numpy()[names == one] for c in columns] for one in sorted(set(names))}


def _most_frequent(table: DataFrame, weight: F.Column, bound: int, columns: list[str]) -> dict[str, list[np.ndarray]]:
    """About ``bound`` cells of each language, the heaviest. Weights are told apart by half octaves (100 steps a language at most); of the step that exceeds
    the bound a share is kept, drawn by the cell's hash."""
    step = F.floor(F.log2(weight) * 2)
    steps: dict[str, list] = {}
    for r in table.groupBy("lang", step.alias("step")).count().collect():
        steps.setdefault(r["lang"], []).append((r["step"], r["count"]))
    least = []
    for one, found in steps.items():
        room, floor, share = bound, -1, 1.0
        for s, n in sorted(found, reverse=True):
            if n > room:
                floor, share = s, room / n
                break
            room -= n
        least.append((one, floor, share))
    if not least:
        return {}
    floors = F.broadcast(table.sparkSession.createDataFrame(least, "lang string, least bigint, share double"))
    drawn = F.xxhash64("g").cast("double") / 2.0**64 + 0.5 < F.col("share")
    return _by_language(table.join(floors, "lang").where((step > F.col("least")) | (step == F.col("least")) & drawn), columns)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, bits (the code length under lang_pred). One pass, no shuffle. Very long texts are coded in blocks."""
    rows = own_columns(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by CELLS
    schema = T.StructType([rows.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, text, BLOCK):
                texts = [t or "" for t in part.column(text).to_pylist()]
                known = np.array([bool(model.langs) and has_letter(t) for t in texts])
                best, score, bits = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
                if known.any():
                    length = model.lengths([t for t, k in zip(texts, known, strict=True) if k])
                    who = length.argmin(1)
                    least = length[np.arange(len(who)), who]
                    best[known], bits[known] = who, least
                    score[known] = 1 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(1)
                names = ["und" if b < 0 else model.langs[b] for b in best]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(names, pa.string()), pa.array(score), pa.array(bits)], [f.name for f in schema])

    return rows.mapInArrow(run, schema)
