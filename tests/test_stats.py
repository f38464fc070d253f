"""Distribution statistics against numpy and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staygrid.operators import aggregate, stats
from tests.conftest import rows


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    return [("hot" if rng.random() < 0.8 else "cold", round(rng.gauss(5, 40), 1)) for _ in range(900)]


def test_quantiles(spark, sample):
    df = spark.createDataFrame(sample, "g string, v double")
    out = stats.quantiles(df, ["g"], "v", {"a": 0.03, "b": 0.5, "c": 0.99}).collect()
    for r in out:
        values = [v for g, v in sample if g == r.g]
        assert np.allclose([r.a, r.b, r.c], np.quantile(values, [0.03, 0.5, 0.99]))
    whole = stats.quantiles(df, [], "v", {"m": 0.5}).first()
    assert math.isclose(whole.m, np.median([v for _, v in sample]))


def test_count_based_aggregates(spark, sample):
    df = spark.createDataFrame(sample, "g string, v double")
    outs = {k: k for k in ("median", "min", "max", "sum", "mean", "count")}
    for r in aggregate.by_counts(df, ["g"], "v", outs).collect():
        values = np.array([v for g, v in sample if g == r.g])
        got = [r.median, r.min, r.max, r.sum, r.mean, r["count"]]
        assert np.allclose(got, [np.median(values), values.min(), values.max(), values.sum(), values.mean(), len(values)])


def test_rank_sum(spark, sample):
    df = spark.createDataFrame(sample, "g string, v double")
    r = stats.rank_sum_test(df, [], "v", F.col("g") == "hot").first()
    a, b = [v for g, v in sample if g == "hot"], [v for g, v in sample if g == "cold"]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert math.isclose(r.u, u)
    ties = sum(c ** 3 - c for c in np.unique(a + b, return_counts=True)[1])
    n = len(a) + len(b)
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / sd
    assert math.isclose(r.z, z) and math.isclose(r.p_value, math.erfc(z / math.sqrt(2)), rel_tol=1e-6)


def test_chi_square(spark):
    df = spark.createDataFrame([(10, 20, 30, 15), (5, 5, 5, 5)], "a int, b int, c int, d int")
    stat = stats.chi_square_2x2(*[F.col(c) for c in "abcd"])
    got = [r[0] for r in df.select(stat).collect()]
    assert math.isclose(got[0], 75 * (abs(10 * 15 - 20 * 30) - 37.5) ** 2 / (30 * 45 * 40 * 35)) and got[1] == 0
    p = df.select(stat.alias("s")).select(stats.chi_square_p("s")).first()[0]
    assert math.isclose(p, math.erfc(math.sqrt(got[0] / 2)), rel_tol=1e-6)


def test_density(spark):
    values = [1.0, 2.0, 2.5, 4.0, 9.0]
    out = stats.kde(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", points=11).orderBy("point").collect()
    h = np.std(values, ddof=1) * len(values) ** -0.2
    x = np.linspace(1 - 0.8, 9 + 0.8, 11)
    d = [np.mean(np.exp(-0.5 * ((p - np.array(values)) / h) ** 2)) / (h * math.sqrt(2 * math.pi)) for p in x]
    assert np.allclose([r.x for r in out], x) and np.allclose([r.density for r in out], d)


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (1, 3.0), (1, 2.0), (2, None)], "g int, v double")
    assert rows(stats.mode(df, ["g"], "v", "m")) == [(1, 2.0)]


def test_wide_grid_keeps_empty_intervals(spark):
    df = spark.createDataFrame([(1, 10, 1.0, None), (1, 20, 4.0, None), (1, 4000, None, None), (2, 0, None, 7.0)], "id long, t long, a double, b double")
    assert rows(aggregate.wide_grid(df, ["id"], "t", ["a", "b"], 3600), "id", "t") == [(1, 0, 2.5, None), (1, 3600, None, None), (2, 0, None, 7.0)]
