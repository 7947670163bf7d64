"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds t_1 < t_2 < ... turn a text's score s into
P(grade >= k) = 1 / (1 + exp(t_k - s)). Selection uses a tail probability, ranking the expected grade.

One direction cannot tell both poor from good and toxic from clean, so a second fit of the same kind, on the good rows (grades 1 and 2) alone, gives
P(grade 2 | grade >= 1); selection of grade 2 asks for both. Without good rows of both kinds there is no second fit and no such cut.

Grades: 0 for quality 0, 1 for quality 1 of a toxic text, 2 for quality 1 otherwise; rows without quality or text are not used.
Features: which words occur (ASCII in lower case), hashed, and levels of a few shares (capitals, symbols, digits, bars, repeated words,
distinct words, length), hashed too. A null or empty text has the length feature alone. A very long text is read in blocks cut between words.

Fitting uses a bounded sample of labelled rows: the SAMPLE rows with the least hash of their id, as far as they hold FEATURES features in
all. Scoring covers every row, in one pass without a shuffle. If no labels, or one grade only, are given, there is no model: expected grade,
tail and clean are null and ``select`` keeps every row. Repeated labels count as often as they occur; repeated documents are scored alike. Extra columns
pass through ``select``; ``score`` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import words as W
from brindle.llm.shared import flat, own_columns, pieces, positional

SAMPLE, FEATURES, BITS = 12_000, 8_000_000, 18
#: L2 penalty of the weights. A feature must occur in RARE sampled texts to have one, or fewer (one in 600 of them, 5 at least) in a small sample.
PENALTY, RARE = 0.3, 20
#: A text is kept if it has the best grade with this probability: low, for a clean text lost costs more than a doubtful one kept.
LEAST = 0.2
#: And if it is clean, given that it is good, with this probability: just below the share of clean texts among good ones, so that a text that says nothing stays.
CLEAN = 0.8
BLOCK = W.PART
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_KIND = np.zeros(256, np.int64)  # 0 other, 1 capital, 2 symbol, 3 digit, 4 bar, 5 small or non-ASCII
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_LOW40 = np.uint64((1 << 40) - 1)
_KIND[65:91], _KIND[48:58], _KIND[124], _KIND[97:123], _KIND[128:] = 1, 3, 4, 5, 5


def _level(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share in 12 levels, finer near nothing."""
    return np.minimum(11, np.sqrt(part / np.maximum(whole, 1)) * 12).astype(np.int64)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text one after another, and how many each has."""
    data, offsets = flat(texts)
    n = len(texts)
    size = np.diff(offsets)
    if n == 1 and len(data) > BLOCK:
        kinds, count, again, key = _long_text(data)
    else:
        owner = np.repeat(np.arange(n), size)
        kinds = np.bincount(owner * 6 + _KIND[data], minlength=6 * n).reshape(n, 6)
        low = W.LOWER[data]
        starts, ends = W.runs(_WORD[low], offsets)
        hashed = W.hashes(low, starts, ends)
        doc = W.owners(offsets, starts)
        count = np.bincount(doc, minlength=n)
        again = np.bincount(doc[1:][(hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
        key = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (hashed & _LOW40))
    mask = np.uint64((1 << bits) - 1)
    distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
    letters = kinds[:, 1] + kinds[:, 5]
    shares = [_level(kinds[:, 1], letters), _level(kinds[:, 2], size), _level(kinds[:, 3], size), _level(kinds[:, 4], size), _level(again, count), _level(distinct, count), np.log2(count + 1).astype(np.int64)]
    more = np.stack([(k + 1) * 64 + v for k, v in enumerate(shares)], 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        more = (more * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    rows = np.concatenate([key >> np.uint64(40), np.repeat(np.arange(n, dtype=np.uint64), more.shape[1])])
    cols = np.concatenate([key & mask, more.ravel() & mask])
    both = np.unique((rows << np.uint64(bits)) | cols)
    return (both & mask).astype(np.int64), np.bincount((both >> np.uint64(bits)).astype(np.int64), minlength=n)


def _long_text(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one long text, block by block: bytes by kind, words, words like the one before, and the distinct words' hashes."""
    kinds, count, again, last, key = np.zeros((1, 6), np.int64), 0, 0, None, np.zeros(0, np.uint64)
    for block, hashed in W.long_text(data, _WORD):
        kinds[0] += np.bincount(_KIND[block], minlength=6)
        if len(hashed):
            again += int(np.count_nonzero(hashed[1:] == hashed[:-1])) + (last == hashed[0])
            count, last, key = count + len(hashed), hashed[-1], np.union1d(key, hashed & _LOW40)
    return kinds, np.array([count]), np.array([again]), key


class Model:
    #: The fit on good rows, which gives P(grade 2 | grade >= 1).
    clean: Model | None = None

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int = BITS):
        self.weights, self.thresholds, self.bits = weights.astype(np.float32), thresholds, bits

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each text."""
        return self.tails_of(*features(texts, self.bits))

    def tails_of(self, cols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        score = np.bincount(np.repeat(np.arange(len(counts)), counts), self.weights[cols], len(counts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(cols: np.ndarray, counts: np.ndarray, grades: np.ndarray, bits: int = BITS, penalty: float = PENALTY, rounds: int = 60) -> Model | None:
    """Maximum penalised likelihood by limited-memory BFGS. Thresholds stay ordered: each step above the first is an exponential."""
    kinds = np.unique(grades)
    if len(kinds) < 2:
        return None
    top = int(grades.max())
    # Features of fewer than RARE sampled texts keep weight 0; what is left is held by rows and by columns.
    owner = np.repeat(np.arange(len(counts)), counts)
    common = np.bincount(cols, minlength=1 << bits)[cols] >= max(5, min(RARE, len(counts) // 600))
    owner, cols = owner[common], cols[common]
    used, at = np.unique(cols, return_inverse=True)
    n, dims = len(grades), len(used)
    row_of = owner[np.argsort(at, kind="stable")]
    column_starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=dims))[:-1]]).astype(np.int64)
    full_rows, row_starts = np.unique(owner, return_index=True)

    def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p[:dims], np.cumsum(np.concatenate([p[dims : dims + 1], np.exp(p[dims + 1 :])]))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = unpack(p)
        s = np.zeros(n)
        if dims:
            s[full_rows] = np.add.reduceat(w[at], row_starts)
        up = np.concatenate([np.ones((n, 1)), _sigmoid(s[:, None] - t[None, :]), np.zeros((n, 1))], 1)  # P(grade >= k)
        rows = np.arange(n)
        a, b = up[rows, grades], up[rows, grades + 1]
        prob = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        ds = (da - db) / prob
        dt = np.zeros(top + 2)
        np.add.at(dt, grades, -da / prob)
        np.add.at(dt, grades + 1, db / prob)
        dt = dt[1 : top + 1]
        later = np.cumsum(dt[::-1])[::-1]
        step = np.concatenate([[1.0], np.exp(p[dims + 1 :])])
        grad = np.concatenate([(-np.add.reduceat(ds[row_of], column_starts) if dims else np.zeros(0)) + penalty * w, -later * step])
        return -np.log(prob).sum() + penalty / 2 * (w @ w), grad

    p = np.zeros(dims + top)
    value, grad = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q = grad.copy()
        alphas = []
        for ds, dg in reversed(past):
            alphas.append(ds @ q / (dg @ ds))
            q -= alphas[-1] * dg
        if past:
            ds, dg = past[-1]
            q *= (ds @ dg) / (dg @ dg)
        for (ds, dg), alpha in zip(past, reversed(alphas), strict=True):
            q += (alpha - dg @ q / (dg @ ds)) * ds
        step = 1.0 if past else 1 / max(1.0, np.linalg.norm(grad))
        slope = -(grad @ q)
        for _ in range(30):
            new = p - step * q
            fresh, g = loss(new)
            if fresh <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        ds, dg = new - p, g - grad
        if ds @ dg > 1e-10:
            past = [*past[-9:], (ds, dg)]
        done = value - fresh < 1e-6 * abs(value)
        p, value, grad = new, fresh, g
        if done:
            break
    w, t = unpack(p)
    weights = np.zeros(1 << bits)
    weights[used] = w
    return Model(weights, t, bits)


def grade() -> F.Column:
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) > 0), 1).when(F.col("quality") > 0, 2)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = FEATURES, bits: int = BITS) -> Model | None:
    """Fit on the bounded sample. The driver receives its features, never texts."""
    chosen = labels.select(F.col(f"`{key}`").alias("k"), grade().alias("grade")).where("k IS NOT NULL AND grade IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "grade").limit(sample)  # at most ``sample`` small rows: a proven bound for the broadcast
    rows = own_columns(docs, key, text).where(F.col(text).isNotNull())
    rows = rows.join(F.broadcast(chosen), F.col(f"`{key}`") == F.col("k")).select("k", "grade", F.col(f"`{text}`").alias("t"))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", BLOCK):
                cols, counts = features(part.column("t"), bits)
                ends = np.cumsum(counts)
                blobs = [cols[e - c : e].astype("<u4").tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("grade"), pa.array(blobs, pa.binary())], ["k", "grade", "cols"])

    found = rows.mapInArrow(run, f"k {kind}, grade int, cols binary").orderBy(F.xxhash64("k"), "k", "grade", "cols")
    cols, counts, grades, total = [], [], [], 0
    for r in found.toLocalIterator(prefetchPartitions=False):
        one = np.frombuffer(r["cols"], "<u4").astype(np.int32)
        total += len(one)
        if total > most and cols:
            break
        cols.append(one)
        counts.append(len(one))
        grades.append(r["grade"])
    if not cols:
        return None
    model = fit(np.concatenate(cols), np.array(counts), np.array(grades), bits)
    good = [i for i, g in enumerate(grades) if g]
    if model and good:
        model.clean = fit(np.concatenate([cols[i] for i in good]), np.array([counts[i] for i in good]), np.array([grades[i] - 1 for i in good]), bits)
    return model


def _scored(rows: DataFrame, model: Model | None, column: str, at_least: int) -> DataFrame:
    """``rows`` with expected_grade, tail and clean."""
    names = ["expected_grade", "tail", "clean"]
    schema = T.StructType([*rows.schema, *[T.StructField(n, T.DoubleType()) for n in names]])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 2 * 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, column, BLOCK):
                if model is None:
                    more = [pa.nulls(part.num_rows, pa.float64())] * 3
                else:
                    found = features(part.column(column), model.bits)
                    tails = model.tails_of(*found)
                    clean = pa.array(model.clean.tails_of(*found)[:, 0]) if model.clean and at_least > 1 else pa.nulls(part.num_rows, pa.float64())
                    more = [pa.array(tails.sum(1)), pa.array(tails[:, min(at_least, tails.shape[1]) - 1]), clean]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", at_least: int = 2) -> DataFrame:
    """key, expected_grade, tail (the probability of ``at_least`` or better) and clean (P(grade 2 | grade >= 1)) of every row."""
    return _scored(own_columns(docs, key, text).toDF("c0", "c1"), model, "c1", at_least).drop("c1").withColumnRenamed("c0", key)


def kept(tail: str = "tail", clean: str = "clean", least: float = LEAST, least_clean: float = CLEAN) -> F.Column:
    """Whether a scored row is kept; a probability that no model gives rejects nothing."""
    return (F.coalesce(tail, F.lit(1.0)) >= least) & (F.coalesce(clean, F.lit(1.0)) >= least_clean)


def select(docs: DataFrame, model: Model | None, text: str = "text", at_least: int = 2, least: float = LEAST, least_clean: float = CLEAN) -> DataFrame:
    """The rows whose tail probability is ``least`` or more and that are clean with ``least_clean`` or more, all columns unchanged."""
    found = _scored(positional(docs), model, f"c{docs.columns.index(text)}", at_least).where(kept("tail", "clean", least, least_clean))
    return found.drop("expected_grade", "tail", "clean").toDF(*docs.columns)
