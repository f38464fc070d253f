"""Sliced windows against brute force, with one series holding most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from staygrid.operators import kidney, organ, slices
from staygrid.operators.slices import SLICE, Acc, crowded, framed, grid_framed, of_crowded, row_framed, scan, time_slice, value_slice
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    data = []
    for id, n in ((1, 700), (2, 40), (3, 1), (4, 60)):
        times = sorted(rng.sample(range(-50_000, 400_000), n))
        data += [(id, t, None if rng.random() < 0.3 else float(rng.randint(0, 50))) for t in times]
    return data


def brute(data, pick):
    out = []
    for id in sorted({r[0] for r in data}):
        own = [r for r in data if r[0] == id]
        out += [(id, r[1], pick(own, i)) for i, r in enumerate(own)]
    return out


def known(rs):
    return [r[2] for r in rs if r[2] is not None]


KINDS = {
    "sum": lambda rs: sum(known(rs)) if known(rs) else None, "count": lambda rs: len(known(rs)),
    "min": lambda rs: min(known(rs), default=None), "max": lambda rs: max(known(rs), default=None),
    "last": lambda rs: known(rs)[-1] if known(rs) else None, "first": lambda rs: known(rs)[0] if known(rs) else None,
}


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("cut", [7, 50, None])
def test_scan(spark, skewed, reverse, exclusive, cut):
    df = spark.createDataFrame(skewed, "id long, t long, v double")
    out = scan(df, ["id"], "t", [Acc(k, k, F.col("v")) for k in KINDS], time_slice("t", 7_000), reverse, exclusive, cut)
    assert out.columns == ["id", "t", "v", *KINDS]
    got = out.orderBy("id", "t").collect()
    for kind, f in KINDS.items():
        def pick(own, i):
            if reverse:
                return f(list(reversed(own[i + exclusive:])))
            return f(own[: i + 1 - exclusive])
        assert [(r.id, r.t, r[kind]) for r in got] == brute(skewed, pick), kind


def test_framed(spark, skewed):
    df = spark.createDataFrame(skewed, "id long, t long, v double")
    out = framed(df, ["id"], "t", 5_000, 900, {"hi": lambda w: F.max("v").over(w), "n": lambda w: F.count("v").over(w)}, width=6_100)
    window = lambda own, i: [r for r in own if own[i][1] - 5_000 <= r[1] <= own[i][1] + 900]
    assert rows(out.select("id", "t", "hi"), "id", "t") == brute(skewed, lambda o, i: KINDS["max"](window(o, i)))
    assert rows(out.select("id", "t", "n"), "id", "t") == brute(skewed, lambda o, i: len(known(window(o, i))))


def test_row_framed(spark, skewed):
    df = spark.createDataFrame(skewed, "id long, t long, v double")
    out = row_framed(df, ["id"], "t", 4, 2, {"lo": lambda w: F.min("v").over(w)}, width=16)
    expected = brute(skewed, lambda o, i: KINDS["min"](o[max(0, i - 4): i + 3]))
    assert rows(out.select("id", "t", "lo"), "id", "t") == expected


@pytest.mark.parametrize("back", [1, 3, 24])
def test_grid_framed(spark, back):
    rng = random.Random(back)
    data = [
        (id, (start + k) * 3600, None if rng.random() < 0.4 else float(rng.randint(0, 9)))
        for id, start, n in ((1, -30, 300), (2, 5, 1), (3, 0, back), (4, 17, 90)) for k in range(n)
    ]
    df = spark.createDataFrame(data, "id long, t long, v double")
    accs = [Acc("lo", "min", F.col("v")), Acc("hi", "max", F.col("v")), Acc("s", "sum", F.col("v")), Acc("n", "count", F.lit(1))]
    out = grid_framed(df, ["id"], "t", 3600, back, accs)
    frame = lambda o, i: o[max(0, i - back): i + 1]
    for name, kind in (("lo", "min"), ("hi", "max"), ("s", "sum")):
        assert rows(out.select("id", "t", name), "id", "t") == brute(data, lambda o, i: KINDS[kind](frame(o, i))), name
    assert rows(out.select("id", "t", "n"), "id", "t") == brute(data, lambda o, i: len(frame(o, i)))


def slice_sizes(spark, n, cut):
    """Rows of each slice when one stay has a third of ``n`` rows inside two days, a third of its rows in one minute."""
    rng = random.Random(n)
    crowd = [(1, 9_000 + rng.randrange(60) if k % 3 == 0 else rng.randrange(2 * 86_400)) for k in range(n // 3)]
    data = crowd + [(2 + k % 200, rng.randrange(-86_400, 30 * 86_400)) for k in range(n - n // 3)]
    df = spark.createDataFrame(data, "id long, t long").repartition(4)
    found = scan(df, ["id"], "t", [Acc("n", "count", F.lit(1))], rows=cut)
    cuts = slices.cuts(df, ["id"], ["t"], [Acc("n", "count", F.lit(1))], F.col("t"), rows=cut)
    assert [r.id for r in cuts.collect()] == [1]
    sizes = [r["count"] for r in slices.with_slices(df, ["id"], "t", cuts).groupBy("id", SLICE).count().collect()]
    place = found.where("id = 1").select("t", "n").orderBy("n").collect()
    assert [r.n for r in place] == list(range(1, n // 3 + 1)) and [r.t for r in place] == sorted(t for i, t in data if i == 1)
    return sizes


def test_slices_stay_small_when_rows_grow(spark):
    """Ten times the rows: no slice has more than the limit and what one second adds."""
    for n in (3_000, 30_000):
        assert max(slice_sizes(spark, n, 200)) <= 200 + n // 9 / 60 * 2


def test_crowded_groups(spark, monkeypatch):
    df = spark.range(1_000).select((F.col("id") % 100).alias("a"), F.lit(None).cast("int").alias("b"))
    assert crowded(df, ["a", "b"], 5).count() == 100 and crowded(df, ["a", "b"], 10).count() == 0
    many = crowded(df, ["b"], 5)
    assert of_crowded(df, many, ["b"]).count() == 1_000 and of_crowded(df, many, ["b"], others=True).count() == 0
    monkeypatch.setattr(slices, "PARTS", 8)
    assert many.first()._limit == 5 and crowded(df, ["b"], 5).first()._limit == 125


def test_windows_are_keyed_by_slice(spark, skewed):
    df = spark.createDataFrame(skewed, "id long, t long, v double")
    plan = scan(df, ["id"], "t", [Acc("s", "sum", F.col("v"))])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    over_rows = [w for w in windows if "sum(v#" in w]
    assert over_rows and all("_slice" in w.split("windowspecdefinition(")[1].split("ASC")[0] for w in over_rows)


def test_value_slice_is_monotone(spark):
    values = sorted([-1e300, -5.5, -1.0, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.01, 2.0, 999.0, 1e9, 1e300])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.orderBy("v").select(value_slice("v")).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("back, width", [(1, 8), (3, 16), (24, 100), (24, 4_096)])
def test_fill_framed(spark, back, width):
    """The aggregates of the completed grid, over gaps longer and shorter than the frame and over borders of slices."""
    rng = random.Random(back + width)
    data = []
    for id, start, n, share in ((1, -30, 400, 0.05), (2, 5, 1, 1), (3, 0, 60, 1), (4, 17, 300, 0.9), (None, -7, 300, 0.3), (6, 3, 9_000, 0.001)):
        at = sorted({0, n - 1, *(k for k in range(n) if rng.random() < share)})
        data += [(id, (start + k) * 3600 + 60, None if rng.random() < 0.2 else float(rng.randint(0, 9))) for k in at]
    df = spark.createDataFrame(data, "id long, t long, v double")
    accs = [Acc("lo", "min", F.col("v")), Acc("hi", "max", F.col("v")), Acc("s", "sum", F.col("v")), Acc("n", "count", F.lit(1))]
    for end in (lambda lo, hi: hi, lambda lo, hi: hi - lo):
        want = {}
        for id in {r[0] for r in data}:
            own = {t: v for i, t, v in data if i == id}
            lo, hi = min(own), max(own)
            for t in range(lo, end(lo, hi) + 1, 3600):
                frame = [own.get(x) for x in range(max(lo, t - back * 3600), t + 1, 3600)]
                there = [v for v in frame if v is not None]
                want[id, t] = (min(there), max(there), sum(there), len(frame)) if there else (None, None, None, len(frame))
        out = slices.fill_framed(df, ["id"], "t", 3600, back, accs, end(F.min("t"), F.max("t")), width).collect()
        assert len(out) == len(want) and {(r.id, r.t): (r.lo, r.hi, r.s, r.n) for r in out} == want


def test_grids_are_made_after_the_windows(spark):
    """The hours of urine and scores are the last step: none of them is shuffled or sorted."""
    df = spark.createDataFrame([(1, 0, 1.0), (1, 720 * 3600, 2.0)], "id long, t long, sofa_resp double")
    for out in (organ.sofa_score(df, ["id"], "t"), kidney.urine24(df, ["id"], "t", "sofa_resp")):
        lines = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate " in x or "Window [" in x]
        assert "Generate " in lines[0] and "Window [" in lines[1] and out.count() == 721


def test_scan_of_the_whole_table(spark):
    """Without ids all rows are one series: its borders are a scalar, whether it is cut or not, and also without rows."""
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "t long, v double")
    accs = [Acc("n", "count", F.col("v")), Acc("s", "sum", F.col("v"))]
    want = [(i, float(i % 7), i, float(sum(j % 7 for j in range(i))) if i else None) for i in range(200)]
    for most in (10, 1_000):
        found = slices.scan(df, [], "t", accs, rows=most, exclusive=True)
        assert rows(found, "t") == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    cut = slices.cuts(df, [], ["t"], accs, F.col("t"), rows=10)
    assert slices.with_slices(df, [], "t", cut).select(SLICE).distinct().count() == 20
    assert slices.scan(df.where("t < 0"), [], "t", accs).count() == 0
