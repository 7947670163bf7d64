"""Retrieval, routing and generation evaluation; percentiles and histograms in the several conventions that reports use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import ratio

THRESHOLDS = [0.25, 0.35, 0.45, 0.55, 0.65, 0.75]


def hit_matches(source: Column, title: Column, content: Column, sources: Column, words: Column) -> Column:
    """The hit's source is expected and all expected words occur in its title or content, in any case."""
    hay = F.lower(F.concat_ws("\n", title, content))
    return F.array_contains(sources, source) & F.forall(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.contains(hay, F.lower(w)))


def case_results(cases: DataFrame, hits: DataFrame, *, case: str = "case_id", group: str | None = None, positive: str = "positive", matched: str = "matched", score: str = "similarity", ties: Sequence[str] = (), thresholds: Sequence[float] = (0.0,)) -> DataFrame:
    """One row a case and threshold: rank of the first matching hit among those that pass (null: none), and the number that pass.

    cases: case, positive; hits: case, matched, similarity. The hits' order is fixed once; each threshold only cuts its tail."""
    order = Window.partitionBy(case).orderBy(F.desc(score), *ties)
    ranked = hits.withColumn("__rank", F.row_number().over(order))
    wide = ranked.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.col(score) >= F.col("threshold"))
    found = wide.groupBy(case, "threshold").agg(F.min(F.when(F.col(matched), F.col("__rank"))).alias("rank"), F.count("*").alias("passed"))
    every = cases.select(case, positive, *([group] if group else [])).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return every.join(found, [case, "threshold"], "left").withColumn("passed", F.coalesce("passed", F.lit(0)))


def metrics(results: DataFrame, *by: str, positive: str = "positive") -> DataFrame:
    """Recall, MRR, negative and overall accuracy; unrounded, 0 where there is nothing to divide by."""
    good, bad = F.col(positive), ~F.col(positive)
    hit, quiet = F.count_if(good & F.col("rank").isNotNull()), F.count_if(bad & (F.col("passed") == 0))
    n_pos, n_neg = F.count_if(good), F.count_if(bad)
    out = results.groupBy(*by).agg(hit.alias("hits"), n_pos.alias("positives"), n_neg.alias("negatives"), quiet.alias("quiet"), F.coalesce(F.sum(F.when(good, 1.0 / F.col("rank"))), F.lit(0.0)).alias("__rr"))
    return out.select(
        *by, "positives", "negatives", "hits", ratio(F.col("hits"), F.col("positives")).alias("recall"), ratio(F.col("__rr"), F.col("positives")).alias("mrr"),
        ratio(F.col("quiet"), F.col("negatives")).alias("negative_accuracy"), ratio(F.col("hits") + F.col("quiet"), F.col("positives") + F.col("negatives")).alias("accuracy"),
    )


def merged_summary(parts: DataFrame) -> DataFrame:
    """One summary of several that only keep rates: counts are rebuilt as round(rate * n), MRR is weighted by positives. Compatible with such reports,
    and as inexact as they are; with the results at hand use ``metrics`` on their union."""
    back = parts.agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"), F.sum(F.bround(F.col("recall") * F.col("positives"))).alias("hits"), F.sum(F.bround(F.col("negative_accuracy") * F.col("negatives"))).alias("quiet"), F.sum(F.col("mrr") * F.col("positives")).alias("rr"))
    p, n = F.col("positives"), F.col("negatives")
    return back.select("positives", "negatives", ratio(F.col("hits"), p).alias("recall"), ratio(F.col("rr"), p).alias("mrr"), ratio(F.col("quiet"), n).alias("negative_accuracy"), ratio(F.col("hits") + F.col("quiet"), p + n).alias("accuracy"))


def routing(cases: DataFrame, expected: str, chosen: str) -> DataFrame:
    """``correct``: the chosen set equals the expected one, so no expectation asks for no choice."""
    return cases.withColumn("correct", F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(chosen)))


def confusion(cases: DataFrame, expected: str, chosen: str) -> DataFrame:
    """First expected against first chosen in order, ``none`` for no entry."""
    a = F.when(F.size(expected) > 0, F.col(expected)[0]).otherwise("none")
    b = F.when(F.size(chosen) > 0, F.array_sort(chosen)[0]).otherwise("none")
    return cases.groupBy(a.alias("expected"), b.alias("chosen")).agg(F.count("*").alias("n"))


GRID = 1000


def order_statistics(rows: DataFrame, value: str, places: Mapping[str, Column], *by: str) -> DataFrame:
    """For each group its count ``n`` and the values at some places of its ascending order (from 1, functions of ``n``); exact at any size.

    One pass makes a quantile sketch that brackets each place to about half a percent of the rows; a second counts what lies below each bracket, and
    the distinct values inside one, which alone are put in order. However many places are asked for, the rows are read twice and never gathered."""
    v, names = F.col(value), list(places)
    some = rows.where(v.isNotNull()).select(*by, value)
    stats = some.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("q"))
    bounds = []
    for k, name in enumerate(names):
        i = F.floor(places[name] / F.col("n") * GRID).cast("int")
        bounds += [places[name].cast("long").alias(f"__place{k}"), F.when(i > 2, F.get("q", i - 2)).alias(f"__low{k}"), F.when(i < GRID - 3, F.get("q", i + 3)).alias(f"__high{k}")]
    stats = stats.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("n").alias("__n"), *bounds)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = some.join(stats, same) if by else some.crossJoin(F.broadcast(stats))  # without groups: one row
    below = [F.coalesce(v < F.col(f"__low{k}"), F.lit(False)) for k in range(len(names))]
    inside = [~below[k] & F.coalesce(v <= F.col(f"__high{k}"), F.lit(True)) for k in range(len(names))]
    keys = [*[f"__{c}" for c in by], "__n", *[f"__place{k}" for k in range(len(names))]]
    some_inside = reduce(lambda a, b: a | b, inside)
    counts = joined.groupBy(*keys, F.when(some_inside, v).alias("v")).agg(*[F.count_if(c).alias(f"below{k}") for k, c in enumerate(below)], *[F.count_if(c).alias(f"in{k}") for k, c in enumerate(inside)])
    group = Window.partitionBy(*[f"__{c}" for c in by] or [F.lit(0)])
    upto = [F.sum(f"below{k}").over(group) + F.sum(f"in{k}").over(group.orderBy(F.col("v").asc_nulls_first())) for k in range(len(names))]
    counts = counts.select("*", *[u.alias(f"upto{k}") for k, u in enumerate(upto)])
    hit = [(F.col(f"in{k}") > 0) & (F.col(f"upto{k}") >= F.col(f"__place{k}")) & (F.col(f"upto{k}") - F.col(f"in{k}") < F.col(f"__place{k}")) for k in range(len(names))]
    found = counts.groupBy(*[f"__{c}" for c in by], "__n").agg(*[F.max(F.when(h, F.col("v"))).alias(n) for n, h in zip(names, hit, strict=True)])
    return found.select(*[F.col(f"__{c}").alias(c) for c in by], F.col("__n").alias("n"), *names)


def nth(rows: DataFrame, value: str, place: Column, *by: str) -> DataFrame:
    """``order_statistics`` of one place: the groups, value, n."""
    return order_statistics(rows, value, {"value": place}, *by).select(*by, "value", "n")


def p95_floor(n: Column) -> Column:
    """sorted[max(0, int(n * 0.95) - 1)]"""
    return F.greatest(F.lit(1), F.floor(n * 0.95))


def p95_ceil(n: Column) -> Column:
    """sorted[ceil(n * 0.95) - 1]"""
    return F.greatest(F.lit(1), F.ceil(n * 0.95))


def p_round(n: Column, share: float) -> Column:
    """sorted[round((n - 1) * share)], halves to even"""
    return F.bround((n - 1) * F.lit(share)).cast("long") + 1


def tool_metrics(calls: DataFrame, *by: str, latency: str = "latency_ms", ok: str = "ok") -> DataFrame:
    """Calls, failures and two percentiles of each tool."""
    counts = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(~F.col(ok)).alias("failures"))
    found = order_statistics(calls, latency, {"p50": p_round(F.col("n"), 0.5), "p95": p_round(F.col("n"), 0.95)}, *by)
    return counts.join(found.select(*by, F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95")), list(by), "left")


def interpolated(rows: DataFrame, value: str, shares: Sequence[float], *by: str, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Percentiles p<share> between the two neighbouring values, in proportion to the distance; ``more``: further order statistics of the same passes."""
    at = lambda s: (F.col("n") - 1) * F.lit(s)
    names = {s: f"p{round(s * 100)}" for s in shares}
    places = {f"{name}{end}": f(at(s)).cast("long") + 1 for s, name in names.items() for end, f in (("_low", F.floor), ("_high", F.ceil))}
    found = order_statistics(rows, value, {**places, **(more or {})}, *by)
    between = lambda s, n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (at(s) - F.floor(at(s)))
    return found.select(*by, *[between(s, n).cast("double").alias(n) for s, n in names.items()], *(more or {}))


def histogram(rows: DataFrame, value: str, edges: Sequence[tuple[int, int | None]]) -> DataFrame:
    """Counts in buckets whose both ends belong to them, so a value on a shared edge counts in both."""
    v = F.col(value)
    inside = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), ((v >= a) & (F.lit(True) if b is None else v <= b)).alias("in")) for i, (a, b) in enumerate(edges)]), lambda x: x["in"])
    counts = rows.select(F.explode(F.transform(inside, lambda x: x["i"])).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return counts.withColumn("low", F.get(F.array(*[F.lit(a) for a, _ in edges]), F.col("bucket")))


def exceeding(rows: DataFrame, value: str, limits: Sequence[int]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(value) > x).alias(f"over_{x}") for x in limits])


def skill_fit(skills: DataFrame, by: str, importance: str, level: str, name: str) -> DataFrame:
    """Fit of each profile: weighted share of the best possible level, band, up to three strengths and gaps by name. One shuffle by profile."""
    imp, lvl = F.greatest(F.lit(1), F.least(F.lit(5), F.col(importance))), F.greatest(F.lit(0), F.least(F.lit(5), F.col(level)))
    rows = skills.select(by, F.col(name).alias("name"), imp.alias("imp"), lvl.alias("lvl"))
    strong = F.struct((-F.col("lvl")).alias("a"), (-F.col("imp")).alias("b"), F.col("name").alias("c"))
    gap = F.struct((-(F.lit(5) - F.col("lvl")) * F.col("imp")).alias("a"), (-F.col("imp")).alias("b"), F.col("name").alias("c"))
    three = []
    for column, item, kept in (("s", strong, F.col("lvl") >= 4), ("g", gap, (F.col("imp") >= 4) & (F.col("lvl") <= 2))):
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(kept), item))
        rows = rows.withColumn(column, F.when(kept & (place <= 3), item))
        three.append(F.array_sort(F.collect_list(column)).alias(column))  # nulls are left out: three at most
    best = rows.groupBy(by).agg(F.sum(F.col("imp") * F.col("lvl")).alias("got"), F.sum(F.col("imp") * 5).alias("possible"), *three)
    score = F.bround(F.when(F.col("possible") == 0, 0.0).otherwise(F.col("got") * 100.0 / F.col("possible"))).cast("int")
    band = F.when(score >= 85, "strong").when(score >= 70, "good").when(score >= 40, "partial").otherwise("weak")
    return best.select(by, score.alias("score"), band.alias("band"), F.array_join(F.transform("s", lambda x: x["c"].cast("string")), ",").alias("strengths"), F.array_join(F.transform("g", lambda x: x["c"].cast("string")), ",").alias("gaps"))


def manual_scores(records: DataFrame, mode: str, fields: Sequence[str]) -> DataFrame:
    """Per mode: records, those with every field scored, their mean total, and each field's mean over the records that have it."""
    full = F.lit(True)
    total = F.lit(0)
    for f in fields:
        full, total = full & F.col(f).isNotNull(), total + F.coalesce(F.col(f), F.lit(0))
    return records.groupBy(mode).agg(F.count("*").alias("records"), F.count_if(full).alias("scored"), F.avg(F.when(full, total)).alias("mean_total"), *[F.avg(f).alias(f"mean_{f}") for f in fields])


def winner(summary: DataFrame, mode: str) -> DataFrame:
    """The mode with the best mean total, ``tie``, or null with fewer than two modes scored."""
    one = summary.where("mean_total IS NOT NULL").agg(F.count("*").alias("n"), F.max("mean_total").alias("best"), F.collect_list(F.struct("mean_total", mode)).alias("all"))
    top = F.filter("all", lambda x: x["mean_total"] == F.col("best"))
    return one.select(F.when(F.col("n") < 2, F.lit(None).cast("string")).when(F.size(top) > 1, "tie").otherwise(top[0][mode]).alias("winner"))


def seed_coverage(cases: DataFrame, context: str, sources: str) -> DataFrame:
    """Share of cases whose context mentions an expected source, and the context's mean and greatest length."""
    ok = F.exists(F.col(sources), lambda s: F.contains(F.col(context), s))
    return cases.agg(F.count("*").alias("cases"), F.count_if(ok).alias("covered"), F.avg(F.length(context)).alias("mean_chars"), F.max(F.length(context)).alias("max_chars"))
