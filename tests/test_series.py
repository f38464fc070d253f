"""Documented examples, invariants and edges of the time-series operators."""

from pyspark.sql import functions as F

from staygrid.operators import asof, grid, intervals, ids as idx, kidney, rates, rolling, select, sepsis
from staygrid.functions import units
from staygrid.schema import HOUR, Table, filter_significant, nan_to_null, significant
from tests.conftest import rows, series


def column(df, name="v"):
    return [r[name] for r in df.orderBy("id", "t").collect()]


def test_deltas(spark):
    s = series(spark, [2.0, 1.0, 4.0, 3.0, 5.0])
    assert column(rolling.delta_cummin(s, ["id"], "t", "v"), "delta") == [0, 0, 3, 2, 4]
    assert column(rolling.delta_start(s, ["id"], "t", "v"), "delta") == [0, -1, 2, 1, 3]
    s = series(spark, [2.0, 3.0, 1.0, 4.0, 2.0, 5.0])
    assert column(rolling.delta_min(s, ["id"], "t", "v", 3), "delta") == [0, 1, 0, 3, 1, 3]


def test_sessions_and_padded_differences(spark):
    s = series(spark, [1.0] * 5, [h * HOUR for h in (0, 1, 10, 11, 12)])
    assert column(rolling.sessions(s, ["id"], "t"), "grp") == [0, 0, 1, 1, 1]
    s = series(spark, [1.0] * 3, [0, 2 * HOUR, 20 * HOUR])
    assert column(rolling.padded_capped_diff(s, ["id"], "t", 4 * HOUR, 12 * HOUR), "diff") == [4 * HOUR, 2 * HOUR, 12 * HOUR]


def test_intervals(spark):
    s = series(spark, [1.0] * 3, [0, 2 * HOUR, 10 * HOUR])
    ends = column(rolling.create_intervals(s, ["id"], "t"), "end")
    assert ends == [2 * HOUR, 8 * HOUR, 11 * HOUR]


def test_fill_gaps_is_idempotent(spark):
    s = series(spark, [10.0, 20.0, 30.0], [0, 2 * HOUR, 3 * HOUR])
    once = grid.fill_gaps(s, ["id"], "t", HOUR)
    assert rows(once, "t") == [(1, 0, 10.0), (1, HOUR, None), (1, 2 * HOUR, 20.0), (1, 3 * HOUR, 30.0)]
    assert rows(grid.fill_gaps(once, ["id"], "t", HOUR), "t") == rows(once, "t")
    filled = grid.fill_gaps(s, ["id"], "t", HOUR, method="interpolate")
    assert column(filled) == [10.0, 15.0, 20.0, 30.0]


def test_merge_ranges_is_disjoint_and_idempotent(spark):
    w = spark.createDataFrame([(1, 0, 3 * HOUR), (1, 2 * HOUR, 4 * HOUR), (1, 5 * HOUR, 7 * HOUR), (2, 0, 1)], "id long, s long, e long")
    joined = intervals.merge_ranges(w, ["id"], "s", "e", HOUR)
    assert rows(joined) == [(1, 0, 7 * HOUR), (2, 0, 1)]
    apart = intervals.merge_ranges(w, ["id"], "s", "e")
    assert rows(apart) == [(1, 0, 4 * HOUR), (1, 5 * HOUR, 7 * HOUR), (2, 0, 1)]
    assert rows(intervals.merge_ranges(apart, ["id"], "s", "e")) == rows(apart)


def test_expand(spark):
    w = spark.createDataFrame([(1, 30, 7_300), (2, 100, 50)], "id long, s long, e long")
    assert rows(grid.expand(w, "s", "e", HOUR)) == [(1, 30), (1, 3_630), (1, 7_230)]
    assert rows(grid.expand(w, "s", "e", HOUR, floored=True)) == [(1, 0), (1, HOUR), (1, 2 * HOUR)]


def test_locf_does_not_cross_long_gaps(spark):
    s = series(spark, [1.0, None, None, None], [0, HOUR, 2 * HOUR, 20 * HOUR])
    assert column(rolling.locf(s, ["id"], "t", ["v"], 3 * HOUR)) == [1.0, 1.0, 1.0, None]
    assert column(rolling.locf(s, ["id"], "t", ["v"])) == [1.0] * 4
    assert column(rolling.locf_window(s, ["id"], "t", ["v"], HOUR)) == [1.0, 1.0, None, None]


def test_nearest_prefers_the_earlier_of_equals(spark):
    left = series(spark, [1.0], [100])
    right = spark.createDataFrame([(1, 90, "before"), (1, 110, "after"), (1, 300, "far")], "id long, t long, x string")
    for tolerance in (None, 50):
        assert column(asof.asof(left, right, ["id"], "t", ["x"], "nearest", tolerance), "x") == ["before"]
    assert column(asof.asof(left, right, ["id"], "t", ["x"], "forward"), "x") == ["after"]
    assert column(asof.asof(left, right, ["id"], "t", ["x"], "backward", 5), "x") == [None]


def test_id_upgrade_multiplies_rows(spark):
    rows_in = spark.createDataFrame([(1, 80), (1, 85), (2, 90)], "hadm long, hr int")
    mapping = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (1, 10)], "hadm long, stay long")
    assert idx.upgrade_id(rows_in, mapping, "hadm", "stay").count() == 5
    assert rows(idx.downgrade_id(rows_in.withColumnRenamed("hadm", "stay"), spark.createDataFrame([(1, 7), (2, 7)], "stay long, hadm long"), "stay", "hadm")) == [(7, 85.0)]


def test_vasopressor_rates(spark):
    df = spark.createDataFrame([(300.0, "ug/min", 75.0), (18.0, "mg/h", 60.0), (1.0, "ml/h", 60.0)], "r double, u string, w double")
    assert [r[0] for r in df.select(units.vaso_rate("r", "u", "w")).collect()] == [4.0, 5.0, None]
    assert units.can_convert("mg%", "µmol/l") and not units.can_convert("kg", "mmhg")


def test_repeated_windows_give_repeated_rows(spark):
    data = series(spark, [1.0, 2.0, 4.0], [0, 100_000, 300_000])
    w = spark.createDataFrame([(1, 0, 300_000), (1, 0, 300_000), (1, 400_000, 500_000)], "id long, s long, e long")
    out = intervals.hop(data, w, ["id"], "t", "s", "e", {"total": ("sum", "v"), "sd": ("std", "v")})
    assert [(r.total, round(r.sd, 6)) for r in out.collect()] == [(7.0, 1.527525)] * 2


def test_expanded_intervals_weigh_by_time(spark):
    s = series(spark, [1.0, 9.0], [0, 50 * 60])
    out = grid.expand_intervals(s, ["id"], "t", "v")
    # 50 points of the first value against 10 of the second inside the first hour
    assert rows(out.where("t = 0")) == [(1, 0, 1.0)]


def test_amount_to_rate_keeps_single_rows(spark):
    df = spark.createDataFrame([(1, 0, 5.0, "mg", 1), (1, 0, 1.0, "mg", 2), (1, HOUR, 3.0, "mg", 2)], "id long, t long, v double, u string, g int")
    out = rates.amount_to_rate(df, ["id"], "t", ["g"], "v", "u", "mg/h")
    assert rows(out.select("g", "t", "v")) == [(1, 0, None), (2, HOUR, 2.0)]


def test_infection_windows_are_half_open(spark):
    abx = spark.createDataFrame([(1, 0), (2, 0), (3, 72 * HOUR)], "id long, t long")
    samp = spark.createDataFrame([(1, 24 * HOUR), (2, 24 * HOUR - 1), (3, 0)], "id long, t long")
    assert rows(sepsis.si_and(abx, samp, ["id"], "t").select("id", "t")) == [(2, 0)]


def test_creatinine_excludes_the_current_time(spark):
    crea = series(spark, [1.0, 1.3, 200.0, 3.1], [0, 48 * HOUR, 50 * HOUR, 60 * HOUR]).withColumnRenamed("v", "crea")
    out = kidney.creatinine_stages(crea, ["id"], "t")
    assert [(r.creat_low_past_48hr, r.aki_stage_creat) for r in out.orderBy("t").collect()] == [(None, 0), (1.0, 1), (1.3, 3)]


def test_table_kinds(spark):
    t = Table(series(spark, [1.0]), ("id",), "t", value="v")
    assert (t.kind, t.as_id().kind, t.as_win("d").kind) == ("ts", "id", "win")
    renamed = t.rename({"id": "stay", "v": "hr"})
    assert renamed.meta_vars == ["stay", "t"] and renamed.value == "hr" and renamed.data_vars == ["hr"]
    p = spark.createDataFrame([(0.01,), (0.2,)], "p_value double")
    assert filter_significant(p).count() == 1 and [r.significant for r in significant(p).collect()] == [True, False]
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None


def test_differences_count_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert rows(select.differences(a, a.distinct())) == [(1, 1)]
    assert select.all_equal(a, a.orderBy(F.desc("x"))).first()[0]
