"""Medians of crowded groups, window aggregates and rises inside windows, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from staygrid.functions.units import unit_graph, unit_key
from staygrid.operators import intervals, sepsis
from staygrid.operators.aggregate import by_counts
from staygrid.schema import HOUR

OUTS = {"mid": "median", "lo": "min", "hi": "max", "total": "sum", "avg": "mean", "n": "count"}


@pytest.fixture(scope="module")
def measured():
    """One stay with nearly all rows: one group of many distinct values, one of few, one without any; a stay without an id."""
    rng = random.Random(2)
    data = [(1, "many", rng.uniform(100, 104), rng.randint(1, 3), f"u{rng.randint(1, 5)}") for _ in range(2_001)]
    data += [(1, "few", float(rng.choice([-5, 0, 7])), rng.randint(1, 3), "x") for _ in range(300)]
    data += [(1, "none", None, 1, "y"), (2, "many", 3.5, 2, None), (2, "many", -1.0, 1, "z"), (2, "none", None, 1, None)]
    data += [(None, "many", float(k), 1, "n") for k in range(40)] + [(3, None, None, 1, None), (3, None, 4.0, 1, "q")]
    return data


def plain(data, weighted):
    groups = {}
    for id, item, v, w, u in data:
        groups.setdefault((id, item), []).append((v, w if weighted else 1, u))
    out = []
    for key, own in groups.items():
        values = [v for v, w, _ in own if v is not None for _ in range(w)]
        unit = min((u for _, _, u in own if u is not None), default=None)
        some = bool(values)
        out.append((*key, statistics.median(values) if some else None, min(values) if some else None, max(values) if some else None,
                    sum(values) if some else None, sum(values) / len(values) if some else None, len(values), unit))
    return out


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[:2] == w[:2] and g[-1] == w[-1] and (g[-2] or 0) == w[-2]
        for a, b in zip(g[2:-2], w[2:-2]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (g, w)


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("limit", [None, 30, 1_000])
def test_medians(spark, measured, weighted, limit):
    df = spark.createDataFrame(measured, "id long, item string, v double, w int, u string")
    out = by_counts(df, ["id", F.col("item").alias("what")], "v", OUTS, True, F.col("w") if weighted else None, ["u"], rows=limit)
    assert out.columns == ["id", "what", *OUTS, "u"]
    near([tuple(r) for r in out.collect()], plain(measured, weighted))
    known = by_counts(df, ["id", "item"], "v", {"mid": "median"}, rows=limit)
    assert known.count() == 5 and known.dtypes[-1] == ("mid", "double")


def test_crowded_groups_are_opened_in_the_middle_only(spark, measured):
    """No window goes over the values of a whole group."""
    df = spark.createDataFrame(measured, "id long, item string, v double, w int, u string")
    plan = by_counts(df, ["id", "item"], "v", {"mid": "median"}, rows=30)._jdf.queryExecution().optimizedPlan().toString()
    over_values = [line for line in plan.splitlines() if "Window [" in line and "[v#" in line]
    assert over_values and all("_slice" in line for line in over_values)


@pytest.mark.parametrize("left, right", [(True, True), (False, False), (True, False)])
@pytest.mark.parametrize("limit", [None, 25])
def test_hop(spark, left, right, limit):
    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(-3_000, 20_000), None if rng.random() < 0.2 else float(rng.randint(-9, 9))) for _ in range(400)]
    data += [(1, 50, 1.0), (1, 50, 2.0), (1, 50, None)]
    spans = []
    for _ in range(150):
        s = rng.randrange(-4_000, 21_000)
        spans.append((rng.choice([1, 2, 4]), s, s + rng.choice([0, 1, 5, 60, 700, 5_000, 30_000, -3])))
    spans += [(1, 50, 50), (1, 50, 50), (1, 49, 51), (1, None, 7), (2, 7, None)]
    df, windows = spark.createDataFrame(data, "id long, t long, v double"), spark.createDataFrame(spans, "id long, s long, e long")
    aggs = {"total": ("sum", "v"), "n": ("count", "v"), "avg": ("mean", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "sd": ("std", "v")}
    want = []
    for id, s, e in spans:
        if s is None or e is None:
            continue
        own = [v for i, t, v in data if i == id and (t >= s if left else t > s) and (t <= e if right else t < e)]
        if own:
            vs = [v for v in own if v is not None]
            want.append((id, s, e, sum(vs) if vs else None, len(vs), sum(vs) / len(vs) if vs else None, min(vs, default=None), max(vs, default=None),
                         statistics.stdev(vs) if len(vs) > 1 else None))
    got = [tuple(r) for r in intervals.hop(df, windows, ["id"], "t", "s", "e", aggs, left, right, rows=limit).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[:3] == w[:3] and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(g[3:], w[3:])), (g, w)


@pytest.mark.parametrize("block", [2, 3])
def test_extremes_over_blocks_of_blocks(spark, monkeypatch, block):
    """Spans that lie in one block, in two, in larger blocks, and over all of them."""
    monkeypatch.setattr(intervals, "BLOCK", block)
    rng = random.Random(block)
    values = [None if rng.random() < 0.1 else float(rng.randint(0, 99)) for _ in range(41)]
    df = spark.createDataFrame([(7, t, v) for t, v in enumerate(values)], "id long, t long, v double")
    windows = spark.createDataFrame([(7, a, b) for a in range(41) for b in range(a, 41)], "id long, s long, e long")
    got = intervals.hop(df, windows, ["id"], "t", "s", "e", {"lo": ("min", "v"), "hi": ("max", "v")}).collect()
    assert len(got) == 41 * 42 // 2
    for r in got:
        own = [v for v in values[r.s : r.e + 1] if v is not None]
        assert (r.lo, r.hi) == (min(own, default=None), max(own, default=None)), r


def test_hop_pairs_no_rows_with_windows(spark):
    """The only join is that of windows with blocks of rows, and sums need none."""
    df, windows = spark.createDataFrame([(1, 0, 1.0)], "id long, t long, v double"), spark.createDataFrame([(1, 0, 5)], "id long, s long, e long")

    def joins(aggs):
        out = intervals.hop(df, windows, ["id"], "t", "s", "e", aggs)
        assert out.collect()
        ran = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return [line for line in ran.splitlines() if "Join" in line]

    assert joins({"total": ("sum", "v"), "sd": ("std", "v")}) == []
    assert all("_node" in line for line in joins({"lo": ("min", "v")}))


@pytest.mark.parametrize("delta", ["cummin", "min", "start"])
def test_rise_inside_any_window(spark, delta):
    rng = random.Random(9)
    scores = [(i, h * HOUR, float(rng.choice([0, 0, 1, 1, 2, 3, 4]))) for i in range(30) for h in sorted(rng.sample(range(400), 60))]
    marks = [(i, h * HOUR) for i in range(30) for h in rng.sample(range(400), 3)]
    want = []
    for i in range(30):
        own = [(t, s) for k, t, s in scores if k == i]
        hits = []
        for si in sorted({t for k, t in marks if k == i}):
            inside = [(t, s) for t, s in own if si - 48 * HOUR <= t <= si + 24 * HOUR]
            for n, (t, s) in enumerate(inside):
                seen = [x for _, x in inside[: n + 1]]
                base = min(seen) if delta == "cummin" else min(seen[-24:]) if delta == "min" else inside[0][1]
                if s - base >= 2:
                    hits.append((t, si, s - base))
        if hits:
            t, _, rise = min(hits)
            want.append((i, t, True, rise))
    got = sepsis.sep3_sofa2(spark.createDataFrame(scores, "id long, t long, sofa2 double"), spark.createDataFrame(marks, "id long, t long"),
                            ["id"], "t", si_window="any", delta=delta, keep_components=True).collect()
    assert sorted(tuple(r) for r in got) == want and len(want) > 5


def test_unit_graph():
    temp = unit_graph(["C", "°C"], "temp")
    assert temp[unit_key("Deg F")] == pytest.approx((1 / 1.8, -32 / 1.8)) and temp[unit_key("°c")] == (1, 0) and temp["k"] == (1, -273.15)
    assert unit_graph(["mg/dL"], "glu")[unit_key("mmol/L")] == pytest.approx((18.016, 0))
    assert unit_graph(["mg/dL"], "ca")[unit_key("mmol/l")] == pytest.approx((4.0, 0))
    assert unit_key("mmol/l") not in unit_graph(["mg/dL"], "crp")  # a molar step needs its substance
    assert unit_graph(["g"], "x")["ng"] == pytest.approx((1e-9, 0))  # two steps
    assert unit_graph(["umol/L"], "crea")[unit_key("mg/dl")] == pytest.approx((88.4, 0)) and unit_key("µg") == unit_key("μg") == "ug"
