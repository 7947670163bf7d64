from __future__ import annotations

import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.operators import evaluate


@pytest.mark.parametrize("n", [1, 2, 7, 4000])
def test_percentiles_between_neighbours(spark, n):
    rng = random.Random(n)
    values = {g: [rng.choice([rng.gauss(0, 9), 1.5, float(rng.randint(0, 5))]) for _ in range(n + g)] for g in range(3)}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [(0, None), (9, None)], "g int, v double")
    got = {r["g"]: r for r in evaluate.interpolated(rows, "v", [0.0, 0.5, 0.9, 1.0], "g", more={"third": F.least(F.col("n"), F.lit(3))}).collect()}
    assert set(got) == {0, 1, 2}
    for g, vs in values.items():
        assert got[g]["p50"] == pytest.approx(statistics.median(vs)) and (got[g]["p0"], got[g]["p100"]) == (min(vs), max(vs))
        assert got[g]["p90"] == pytest.approx(duckdb.execute("SELECT quantile_cont(x, 0.9) FROM (SELECT unnest(?) AS x)", [vs]).fetchone()[0])
        assert got[g]["third"] == sorted(vs)[min(len(vs), 3) - 1]


def test_no_group_is_gathered(spark):
    """No aggregate that keeps all values of a group: the plan has sketches and counts alone."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = evaluate.interpolated(rows, "v", [0.5, 0.95], "g")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_" not in plan
    one = evaluate.order_statistics(rows, "v", {"first": F.lit(1), "last": F.col("n")}).collect()
    assert [tuple(r) for r in one] == [(1000, 0.0, 999.0)]
    assert evaluate.interpolated(rows.limit(0), "v", [0.5], "g").count() == 0


def test_rounding_as_python_does(spark):
    from brindle.functions import text as X

    rng = random.Random(2)
    values = [rng.uniform(-9, 9) for _ in range(3000)] + [rng.randint(-10**7, 10**7) / 10**rng.randint(0, 9) for _ in range(3000)] + [rng.randint(-(2**20), 2**20) / 2**rng.randint(0, 12) for _ in range(3000)]
    values += [0.0, -0.0, 2.675, 1.005, 0.5, 1.5, 2.5, -0.5, 0.03125, 0.00005, 1e300, -1e22, 123456789.12345, None, float("inf")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for places in (0, 2, 4, 6):
        got = {r["i"]: r["x"] for r in rows.select("i", X.rounded(F.col("v"), places).alias("x")).collect()}
        assert [(v, got[i], round(v, places)) for i, v in enumerate(values) if v is not None and got[i] != round(v, places)] == []
        assert got[values.index(None)] is None
