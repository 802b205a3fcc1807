"""Exact quantiles by rank narrowing against numpy, and how many scans they take."""

import math

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.operators import quantiles
from segstats.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0, 0.1, 0.9]


def numpy_quantiles(values, probs):
    """numpy's linear interpolation, whose neighbours may be infinite."""
    s = sorted(values)
    out = []
    for p in probs:
        pos = p * (len(s) - 1)
        a, b = s[math.floor(pos)], s[math.ceil(pos)]
        out.append(a if a == b or pos == int(pos) else (math.ceil(pos) - pos) * a + (pos - math.floor(pos)) * b)
    return out


@pytest.fixture
def scans(monkeypatch):
    """Counts the jobs' collects: one for each scan."""
    seen = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(1) or collect(self))
    return seen


SETS = {
    "continuous": lambda r: r.lognormal(3, 1.5, 3000),
    "ties": lambda r: np.concatenate([np.full(1400, 7.25), r.normal(0, 1, 300), [1e-300, -1e300]]),
    "one": lambda r: np.array([4.0]),
    "two": lambda r: np.array([4.0, 9.0]),
    "infinite": lambda r: np.concatenate([r.normal(0, 1, 900), [math.inf]]),
    "both_infinite": lambda r: np.concatenate([r.normal(0, 1, 900), [math.inf, -math.inf, -math.inf]]),
    "extreme": lambda r: np.concatenate([r.normal(0, 1, 900), [1.7e308, -1.7e308]]),
    "geometric": lambda r: 2.0 ** np.arange(-500, 500),
}


@pytest.mark.parametrize("rows_at_once", [3, 50, quantiles.ROWS_AT_ONCE])
def test_matches_numpy_in_few_scans(spark, scans, rows_at_once):
    rng = np.random.default_rng(11)
    sets = {k: make(rng) for k, make in SETS.items()}
    data = [(k, float(x)) for k, xs in sets.items() for x in xs] + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = exact_quantiles(df, "g", "v", PROBS, rows_at_once=rows_at_once)
    assert len(scans) <= 4
    assert set(got) == set(sets)
    for g, values in sets.items():
        assert got[g] == pytest.approx(numpy_quantiles(values, PROBS), rel=1e-12), g


def test_matches_spark_percentile(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), (F.hash("id") / 7.0).alias("v"))
    probs = [0.25, 0.5, 0.75]
    got = exact_quantiles(df, "g", "v", probs, rows_at_once=10)
    q = F.percentile("v", F.array(*map(F.lit, probs)))
    assert got == {r["g"]: list(r["q"]) for r in df.groupBy("g").agg(q.alias("q")).collect()}


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """Even brackets that hold none of the wanted ranks end in the right values."""
    df = spark.createDataFrame([("x", float(k)) for k in range(2000)], "g string, v double")
    first = [{"_g": "x", "n": 2000, "lo": 0.0, "hi": 1999.0, "near": [1500.0, 1501.0] * 4}]
    assert exact_quantiles(df, "g", "v", [0.5], first=first, rows_at_once=5) == {"x": [999.5]}


def test_only_nulls(spark):
    df = spark.createDataFrame([("x", None)], "g string, v double")
    assert exact_quantiles(df, "g", "v", [0.5]) == {}


def test_many_brackets_are_narrowed_until_all_together_are_few(spark, monkeypatch):
    collected = []
    take = quantiles._values_at_ranks

    def counted(cells, targets):
        collected.append(cells.count())
        return take(cells, targets)

    monkeypatch.setattr(quantiles, "_values_at_ranks", counted)
    data = spark.range(0, 60_000, 1, 4).selectExpr("cast(id % 60 as string) AS g", "cast(id * 7919 % 60000 as double) AS v")
    want = quantiles.exact_quantiles(data, "g", "v", (0.25, 0.5, 0.75))
    got = quantiles.exact_quantiles(data, "g", "v", (0.25, 0.5, 0.75), rows_at_once=45)
    assert got == want and len(got) == 60
    assert collected[1] < collected[0] <= 60 * 3 * 45
