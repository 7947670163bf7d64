"""Toxicity by noisy-channel restoration of disguised words and a noisy-or over word stems.

1. A character language model (order 4, 40 classes of letters) is counted over the whole corpus. Its table has a fixed size (40^4 costs,
   10 MB), whatever the corpus holds; the counts come from every document.
2. Words with digits or signs between letters (leetspeak), a letter three times or more in a row (repetition) and single letters set apart
   (spacing) are lattices of what they may stand for. Viterbi decoding under the model gives their likeliest readings; READINGS of them are scored.
3. Stems (the first 3 to 7 letters) and whole words of the restored text are the causes of a noisy-or: a document is toxic if any of its causes acts.
   Expectation maximisation on labelled documents finds causes; clean documents clear every stem they hold. Length neither dilutes nor adds up. A stem that
   was found to be a cause scores its share of toxic documents at least, since insults that mostly come together hide each other's strength.

Fitting reads SAMPLE labelled documents of either label at most, those with the least hash of their id, equal texts once, and looks at the
STEMS stems that most toxic ones of them share; several labels of an id count as toxic if one says so, null labels as none. Doubled letters count as
one in stems. Null and empty texts have the score of a text without causes; without toxic labels every score is 0. Texts of any length are
read whole, word by word; runs of letters and signs longer than BLOCK characters are decoded in blocks. Repeated rows
give repeated results; extra input columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.shared import Scratch, own_columns, pieces, range_count, with_fields, without

CLASSES, SAMPLE, STEMS, READINGS, BLOCK = 40, 8_000, 400_000, 3, 48
#: Probability that counts of a shorter context lend to a longer one, as so many sightings; sightings without toxicity that every stem starts with.
LENT, DOUBT = 3.0, 1.5
#: A stem acts with at least this probability to count as a cause; its share of toxic documents is taken after so many more without.
ACTS, RESERVE = 0.05, 3.0
#: What a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou"}
_SIGNS = "".join(re.escape(x) for x in LEET if not x.isdigit())
_PIECE = re.compile(rf"(?:[^\W_]|[{_SIGNS}])+")
_HIDDEN = re.compile(rf"[\d{_SIGNS}]|(.)\1\1")
_SPACED = re.compile(rf"(?<!\w)(?:[^\W_]|[{_SIGNS}])(?:[ ._\-]{{1,3}}(?:[^\W_]|[{_SIGNS}])){{2,}}(?!\w)")
_WORD = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"(.)\1+")
_LETTER = re.compile(r"[^\W\d_]")
_THRICE = re.compile(r"(.)\1\1")
_AROUND = ".,;:?\"'()[]"
_NOTHING: tuple[list[str], list[tuple[str, str]]] = ([], [])


@cache
def _classes() -> np.ndarray:
    """The class of each code point: 0 no letter, 1 to 26 a to z, others by their number."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % (CLASSES - 27)
    return table


def symbols(text: str) -> np.ndarray:
    """Classes of the lower-cased text's characters, with one 0 between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found = _classes()[np.where(codes < 1 << 16, codes, 0)]
    return found[(found > 0) | np.concatenate([[True], found[:-1] > 0])] if len(found) else found


def grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often each window of four classes occurs in all texts; windows do not reach across texts or blocks of a million characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**4, np.int64)
        for batch in batches:
            for b in pieces(batch, "text", 2 << 20):
                for t in b.column("text").to_pylist():
                    for lo in range(0, len(t or ""), 1 << 20):
                        s = symbols(f" {t[lo : lo + (1 << 20)]} ").astype(np.int32)
                        if len(s) > 3:
                            held, n = np.unique(((s[:-3] * CLASSES + s[1:-2]) * CLASSES + s[2:-1]) * CLASSES + s[3:], return_counts=True)
                            total[held] += n
        held = np.flatnonzero(total)
        for lo in range(0, len(held), 1 << 16):
            part = held[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["gram", "n"])

    return own_columns(docs, text).toDF("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def costs(counts: np.ndarray) -> np.ndarray:
    """Bits that each class costs behind three others; shorter contexts lend to longer ones."""
    n = counts.reshape((CLASSES,) * 4).astype(np.float64)
    p = np.full(CLASSES, 1 / CLASSES)
    for longer in range(4):
        seen = n.sum(axis=tuple(range(3 - longer)))
        p = (seen + LENT * p) / (seen.sum(-1, keepdims=True) + LENT)
    return -np.log2(p).astype(np.float32)


@dataclass
class Model:
    """Bits of the language model; of each cause the probability that it acts and its share of toxic documents; the probability of toxicity without any."""

    bits: np.ndarray
    causes: dict[str, tuple[float, float]] = field(default_factory=dict)
    leak: float = 0.0

    def score(self, stems: Iterable[str]) -> float:
        silent, share = 1 - self.leak, 0.0
        for s in sorted(stems):
            p, own = self.causes[s]
            silent, share = silent * (1 - p), max(share, own)
        return max(1 - silent, share)


def lattice(piece: str) -> list[list[tuple[str, float]]]:
    """What each stretch of a disguised word may stand for, and the bits that this reading costs by itself."""
    found = []
    for m in re.finditer(r"(.)\1*", piece):
        sign, n = m[1], len(m[0])
        if sign in " ._-":
            found.append([("", 1.0), (" ", 2.0)])
            continue
        letters = [(x, 1.0) for x in LEET.get(sign, "")] + ([(sign, 0.0)] if sign not in LEET else [])
        if n < 3:
            found += [letters] * n
        else:
            found.append([(x * k, bits + k) for x, bits in letters for k in (1, 2)])
    return found


def readings(stretches: list[list[tuple[str, float]]], bits: np.ndarray, most: int = READINGS) -> list[str]:
    """The ``most`` likeliest readings of a lattice, the likeliest first: Viterbi decoding over the last three classes."""
    table = _classes()
    beams: dict[tuple[int, int, int], list[tuple[float, str]]] = {(0, 0, 0): [(0.0, "")]}
    for options in stretches:
        after: dict[tuple[int, int, int], list[tuple[float, str]]] = {}
        for state, paths in beams.items():
            for letters, paid in options:
                end, price = state, paid
                for x in letters:
                    k = int(table[ord(x)]) if ord(x) < 1 << 16 else 0
                    price += float(bits[(*end, k)])
                    end = (end[1], end[2], k)
                after.setdefault(end, []).extend((c + price, t + letters) for c, t in paths)
        beams = {s: sorted(p)[:most] for s, p in after.items()}
    ends = sorted((c + float(bits[(*s, 0)]), t) for s, paths in beams.items() for c, t in paths)
    return list(dict.fromkeys(t for _, t in ends))[:most]


class Reader:
    """The readings of a text's tokens; keeps those of tokens met before (up to a number, then anew). ``wanted``: the stems to look for, or all."""

    def __init__(self, bits: np.ndarray, wanted: dict | None = None, keep: int = 150_000):
        self.bits, self.wanted, self.keep, self.known = bits, wanted, keep, {}
        self.heads = None if wanted is None else {s[:3] for s in wanted}

    def plain(self, token: str) -> bool:
        """Whether a token is an undisguised word that begins like no wanted stem, as most are."""
        word = token.strip(_AROUND)
        if self.heads is None or not word.isalpha() or _THRICE.search(word):
            return False
        head = word[:3]
        if len(head) < 3 or head[0] == head[1] or head[1] == head[2]:
            head = (_DOUBLE.sub(r"\1", word) + "$")[:3]
        return head not in self.heads

    def stems(self, token: str) -> tuple[list[str], list[tuple[str, str]]]:
        """The stems of a token (of those wanted), and what was restored in it."""
        hit = self.known.get(token)
        if hit is None:
            if self.plain(token):
                hit = _NOTHING
            else:
                words, changed = self.token(token)
                found = {s for w in words for s in stems(w)}
                hit = [s for s in found if self.wanted is None or s in self.wanted], changed
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[token] = hit
        return hit

    def restored(self, piece: str) -> list[str]:
        parts = [readings(lattice(piece[lo : lo + BLOCK]), self.bits) for lo in range(0, len(piece), BLOCK)]
        return parts[0] if len(parts) == 1 else ["".join(p[0] for p in parts)]

    def token(self, token: str) -> tuple[list[str], list[tuple[str, str]]]:
        """The words of a token as restored, and what was restored."""
        words, changed = [], []
        for m in _PIECE.finditer(token):
            piece = m[0].rstrip("!|+*(").lstrip("+*(")
            if _HIDDEN.search(piece) and _LETTER.search(piece):
                found = self.restored(piece)
                changed.append((piece, found[0]))
                words += [w for x in found for w in _WORD.findall(x)]
            else:
                words += _WORD.findall(piece)
        return words, changed

    def spaced(self, text: str) -> Iterator[tuple[str, list[str]]]:
        for m in _SPACED.finditer(text):
            yield m[0], self.restored(m[0])


def stems(word: str) -> list[str]:
    """The first 3 to 7 letters of a word, doubled letters as one, and the whole of it (with an end mark)."""
    word = _DOUBLE.sub(r"\1", word)
    return [word[:n] for n in range(3, min(7, len(word)) + 1)] + [word + "$"]


def found_stems(text: str, reader: Reader) -> tuple[set[str], list[tuple[str, str]]]:
    """The stems of a text that the reader wants, and what was restored."""
    text = text.lower()
    found, changed = set(), []
    for token in set(text.split()):
        hit = reader.stems(token)
        if hit is not _NOTHING:
            found.update(hit[0])
            changed += hit[1]
    for span, read in reader.spaced(text):
        changed.append((span, read[0]))
        found.update(s for x in read for w in _WORD.findall(x) for s in stems(w) if reader.wanted is None or s in reader.wanted)
    return found, changed


def fit(documents: Iterable[np.ndarray], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: float, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Noisy-or by expectation maximisation. documents: the causes in each toxic text; toxic, clean: in how many of either a cause occurs.

    Clean texts need no rows: they hold no acting cause, so each counts as one failure of its causes."""
    documents = list(documents)
    which = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    causes = np.concatenate([*documents, np.zeros(0, np.int64)]).astype(np.int64)
    p, leak = np.minimum(0.9, toxic / (toxic + clean + DOUBT)), 0.01
    for _ in range(rounds):
        silent = np.bincount(which, np.log1p(-np.minimum(p[causes], 1 - 1e-9)), len(documents)) + np.log1p(-leak)
        acts = np.maximum(1 - np.exp(silent), 1e-9)
        p = np.bincount(causes, p[causes] / acts[which], len(p)) / (toxic + clean + DOUBT)
        leak = min(0.5, float((leak / acts).sum()) / (n_toxic + n_clean + DOUBT))
    return p, leak


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = STEMS) -> Model:
    """A model from labelled documents (labels: key, toxic 0/1) and the language of the whole corpus (``docs`` unless given)."""
    spark = docs.sparkSession
    counted = grams(docs if corpus is None else corpus, text).toArrow()  # 40^4 rows at most
    counts = np.zeros(CLASSES**4, np.int64)
    counts[counted["gram"].to_numpy()] = counted["n"].to_numpy()
    model = Model(costs(counts))

    marks = own_columns(labels, key, "toxic").toDF("id", "toxic").where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = own_columns(docs, key, text).toDF("id", "text").where("text IS NOT NULL")
    marks = marks.join(rows.select("id").distinct(), "id", "left_semi")
    share = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not share.get(1):
        return model
    taken = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    scratch = Scratch(spark, "toxicity")
    texts = rows.join(F.broadcast(taken[0].unionByName(taken[1])), "id")  # 2 * sample ids at most
    texts = texts.groupBy(F.md5("text").alias("same"), "toxic").agg(F.min_by("text", "id").alias("text"))
    texts = scratch.put(texts.select("text", "toxic").repartition(range_count(rows, 1)))
    bits = spark.sparkContext.broadcast(model.bits)

    def count(rows: DataFrame, wanted: dict | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, found = Reader(bits.value, wanted), Counter()
            for b in batches:
                for t in b.column("text").to_pylist():
                    found.update(found_stems(t, reader)[0])
                    if len(found) > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["stem", "n"])
                        found = Counter()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["stem", "n"])

        return rows.mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    toxic = {r["stem"]: r["n"] for r in count(texts.where("toxic = 1"), None).where("n > 2").orderBy(F.desc("n"), "stem").limit(most).collect()}
    clean = {r["stem"]: r["n"] for r in count(texts.where("toxic = 0"), toxic).collect()}
    weight = (share.get(0, 0) / max(n_clean, 1)) / (share[1] / n_toxic)  # a clean text of the sample stands for so many
    likely = sorted(s for s, n in toxic.items() if n / n_toxic > 3 * clean.get(s, 0) / max(n_clean, 1))
    index = {s: i for i, s in enumerate(likely)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(bits.value, index)
        for b in batches:
            found = [sorted(index[s] for s in found_stems(t, reader)[0]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["stems"])

    documents = [np.array(r["stems"], np.int64) for r in texts.where("toxic = 1").mapInArrow(held, "stems array<int>").collect()]  # the sample's toxic texts
    bad, good = np.array([toxic[s] for s in likely], float), weight * np.array([clean.get(s, 0) for s in likely], float)
    p, model.leak = fit(documents, bad, good, n_toxic, weight * n_clean)
    share = np.where(p > ACTS, bad / (bad + good + RESERVE), 0)
    model.causes = {s: (float(a), float(b)) for s, a, b in zip(likely, p, share, strict=True) if a > 0.01}
    scratch.clear()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (probability of toxicity) and restored (what disguised stretches were read as) to each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, names = without(docs, "score", "restored")
    column = f"c{names.index(text)}"
    kind = T.ArrayType(T.StructType([T.StructField("found", T.StringType()), T.StructField("reading", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model.bits, model.causes)
        for batch in batches:
            for b in pieces(batch, column, 8 << 20):
                scores, changes = [], []
                for t in b.column(column).to_pylist():
                    found, changed = found_stems(t or "", reader)
                    scores.append(model.score(found))
                    changes.append([{"found": a, "reading": r} for a, r in sorted(set(changed))])
                struct = pa.list_(pa.struct([("found", pa.string()), ("reading", pa.string())]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(changes, struct)], [*b.schema.names, "score", "restored"])

    schema = with_fields(rows.schema, T.StructField("score", T.DoubleType()), T.StructField("restored", kind))
    return rows.mapInArrow(run, schema).toDF(*names, "score", "restored")
