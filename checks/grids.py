"""Time grids, window expansion, interval merging, durations."""

from pyspark.sql import functions as F

from checks.common import IDS, TIME, ev, hv, nv, query, r6, wins
from staygrid.functions import times
from staygrid.operators import grid, intervals
from staygrid.schema import HOUR, Table


@query("SELECT seq, (t // 900) * 900 AS t, floor((t - 1000000) / 3600)::BIGINT * 3600 AS u FROM ev", "ev")
def floored_times(spark, sf):
    rows = ev(spark, sf).select("seq", "t", (F.col("t") - 1_000_000).alias("u"))
    return grid.floor_times(grid.floor_times(rows, ["t"], 900), ["u"], 3_600)


@query("""SELECT id, (t // 21600) * 21600 AS t, median(value) AS value, arg_min(item, seq) AS item, median(seq) AS seq,
    arg_min(end_t, seq) AS end_t FROM (SELECT *, CAST((t // 21600) * 21600 AS VARCHAR) AS end_t FROM ev) GROUP BY 1, 2""", "ev")
def coarser_interval(spark, sf):
    rows = ev(spark, sf).withColumn("end_t", (F.floor(F.col("t") / 21600) * 21600).cast("string"))
    out = grid.change_interval(rows, IDS, TIME, 21_600, order=["seq"])
    return out.select("id", "t", "value", "item", F.col("seq").cast("double").alias("seq"), "end_t")


@query("SELECT id, t, value FROM grid LEFT JOIN hv USING (id, t)", "ev hv grid")
def gap_free_grid(spark, sf):
    return grid.fill_gaps(hv(spark, sf), IDS, TIME, HOUR)


@query("""SELECT id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS value
    FROM grid LEFT JOIN hv USING (id, t)""", "ev hv grid")
def gap_free_grid_carried(spark, sf):
    return grid.fill_gaps(hv(spark, sf), IDS, TIME, HOUR, method="ffill")


@query("""WITH l AS (SELECT id, unnest(generate_series(86400, 86400 * (2 + id % 9), 3600)) AS t FROM (SELECT DISTINCT id FROM hv))
    SELECT id, t, coalesce(value, 0) AS value FROM l LEFT JOIN hv USING (id, t)""", "ev hv")
def grid_in_given_limits(spark, sf):
    limits = hv(spark, sf).select("id").distinct().withColumns({"start": F.lit(86_400), "end": 86_400 * (2 + F.col("id") % 9)})
    return grid.fill_gaps(hv(spark, sf), IDS, TIME, HOUR, limits, method="zero")


@query("""SELECT id, coalesce(((s // 3600) * 3600), lo) AS "start", coalesce((e // 3600) * 3600, hi) AS "end" FROM (SELECT id, min(t) AS lo, max(t) AS hi FROM hv GROUP BY id)
    LEFT JOIN (SELECT id, min(s) AS s, max(e) AS e FROM wins WHERE id % 3 = 0 GROUP BY id) USING (id)""", "ev hv wins")
def grid_limits_of_stays(spark, sf):
    stays = wins(spark, sf).where("id % 3 = 0").select("id", F.col("s").alias("start"), F.col("e").alias("end"))
    return grid.grid_limits(hv(spark, sf), IDS, TIME, stays)


@query("SELECT id, seq, unnest(generate_series(s, e, 1800)) AS s FROM wins", "ev wins")
def expanded_windows(spark, sf):
    return grid.expand(wins(spark, sf).drop("value"), "s", "e", 1_800)


@query("SELECT id, seq, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s FROM wins", "ev wins")
def expanded_floored_windows(spark, sf):
    return grid.expand(wins(spark, sf).drop("value"), "s", "e", HOUR, floored=True)


@query("""SELECT DISTINCT id, unnest(generate_series((s // 3600) * 3600, (s // 3600) * 3600 +
    3600 * (greatest(1, CAST(ceil((e - (s // 3600) * 3600) / 3600.0) AS BIGINT)) - 1), 3600)) AS s, value FROM wins WHERE e > s""", "ev wins")
def window_rows_on_grid(spark, sf):
    rows = wins(spark, sf).withColumn("dur", F.col("e") - F.col("s"))
    return grid.expand_windows(rows, IDS, "s", "dur", "value")


_MINUTES = """WITH n AS (SELECT id, t, value, greatest(coalesce(lead(t) OVER (PARTITION BY id ORDER BY t, seq) - t, 3600) - 60, 0) AS d
        FROM ev WHERE item = 'click'),
    p AS (SELECT id, unnest(generate_series(t, t + d, 60)) AS t, value FROM n)
    SELECT id, (t // 3600) * 3600 AS t, round(median(value), 6) AS value FROM p GROUP BY 1, 2"""


@query(_MINUTES, "ev")
def charted_rates_by_minute(spark, sf):
    rows = ev(spark, sf).where("item = 'click'")
    return r6(grid.expand_intervals(rows, IDS, ["t", "seq"], "value"), "value")


@query("""WITH o AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wins),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e) AS k FROM o)
    SELECT id, min(s) AS s, max(e) AS e FROM i GROUP BY id, k""", "ev wins")
def merged_ranges(spark, sf):
    return intervals.merge_ranges(wins(spark, sf), IDS, "s", "e", HOUR)


@query("SELECT id, count(*) >= 2 AND (max(t) - min(t)) // 3600 + 1 <> count(*) AS has_gaps FROM hv GROUP BY id", "ev hv")
def series_with_gaps(spark, sf):
    return grid.has_gaps(hv(spark, sf), IDS, TIME, HOUR)


@query("SELECT bool_or(g) AS has_gaps FROM (SELECT id, count(*) >= 2 AND (max(t) - min(t)) // 3600 + 1 <> count(*) AS g FROM hv GROUP BY id)", "ev hv")
def any_series_with_gaps(spark, sf):
    return grid.any_gaps(hv(spark, sf), IDS, TIME, HOUR)


@query("""WITH d AS (SELECT id, (t // 604800) * 604800 AS t FROM ev GROUP BY 1, 2)
    SELECT id, (max(t) - min(t)) // 604800 + 1 = count(*) AS is_regular FROM d GROUP BY id""", "ev")
def regular_series(spark, sf):
    rows = ev(spark, sf).select("id", (F.floor(F.col("t") / 604800) * 604800).alias("t")).distinct()
    return grid.is_regular(rows, IDS, TIME, 604_800)


@query("SELECT bool_and(x % 7200 = 0) AS obeys_interval FROM (SELECT t - min(t) OVER (PARTITION BY id) AS x FROM hv)", "ev hv")
def steps_obey_interval(spark, sf):
    return grid.obeys_interval(hv(spark, sf), IDS, TIME, 7_200)


@query("SELECT min(d) AS interval FROM (SELECT t - lag(t) OVER (PARTITION BY id ORDER BY t) AS d FROM hv) WHERE d > 0", "ev hv")
def smallest_step(spark, sf):
    return grid.detect_interval(hv(spark, sf), IDS, TIME)


@query("""SELECT greatest(CAST(round_even(median(d) / 3600, 0) AS BIGINT) * 3600, 3600) AS interval
    FROM (SELECT t - lag(t) OVER (PARTITION BY id ORDER BY t) AS d FROM hv) WHERE d IS NOT NULL""", "ev hv")
def median_step(spark, sf):
    return grid.infer_interval(hv(spark, sf), IDS, TIME)


@query("SELECT id, seq, e - s AS dur FROM wins", "ev wins")
def window_durations(spark, sf):
    return grid.duration(wins(spark, sf), "s", "e").select("id", "seq", "dur")


@query("SELECT id, CAST(floor(value / 30) AS BIGINT) AS g, min(s) AS s, max(e) // 3600 - min(s) // 3600 AS dur FROM wins GROUP BY 1, 2", "ev wins")
def grouped_durations(spark, sf):
    rows = wins(spark, sf).withColumn("g", F.floor(F.col("value") / 30))
    return grid.group_duration(rows, IDS, "s", "e", ["g"])


@query("""WITH g AS (SELECT id, t, CASE WHEN t - lag(t) OVER (PARTITION BY id ORDER BY t, seq) > 43200 THEN 1 ELSE 0 END AS gap, seq FROM ev),
    r AS (SELECT id, t, sum(gap) OVER (PARTITION BY id ORDER BY t, seq) AS run FROM g)
    SELECT id, min(t) AS t, round((max(t) - min(t)) / 3600.0, 6) AS dur FROM r GROUP BY id, run""", "ev")
def session_durations(spark, sf):
    return r6(grid.session_duration(ev(spark, sf).select("id", "t", "seq"), IDS, ["t", "seq"], 43_200), "dur")


@query("SELECT id, t, value, CAST(21600 AS INTEGER) AS dur FROM hv", "ev hv")
def series_as_windows(spark, sf):
    rows = grid.to_window(hv(spark, sf), 21_600)
    return Table(rows, ("id",), "t", value="value").as_win("dur").df


@query("SELECT id, t, (t + 7200) / 60.0 AS minutes, (t + 7200) / 86400.0 AS days FROM hv", "ev hv")
def duration_units(spark, sf):
    s = F.col("t") + 7_200
    return hv(spark, sf).select("id", "t", times.change_unit(s, "secs", "mins").alias("minutes"), times.change_unit(s, "secs", "days").alias("days"))


@query("SELECT id, CAST(value AS BIGINT) AS t, true AS on_vent FROM (SELECT id, floor(value) AS value FROM nv WHERE value IS NOT NULL)", "ev hv nv")
def flagged_times(spark, sf):
    rows = nv(spark, sf).withColumn("value", F.floor("value"))
    return grid.flag_rows(rows, IDS, "value", "t", "on_vent")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 HOUR ELSE date_trunc('day', o_orderdate) + INTERVAL 12 HOUR END AS at FROM orders""")
def date_or_time(spark, sf):
    from checks.common import table

    o = table(spark, sf, "orders")
    exact = F.when(F.col("o_orderkey") % 3 == 0, F.timestamp_add("HOUR", F.lit(5), "o_orderdate"))
    return o.select("o_orderkey", times.combine_date_time(exact, F.col("o_orderdate")).alias("at"))


@query("""WITH r AS (SELECT id, (s // 3600) * 3600 AS lo, (e // 3600) * 3600 AS hi, value FROM wins),
    x AS (SELECT id, lo, CASE WHEN hi = lo THEN lo + 3600 ELSE hi END AS hi, value FROM r)
    SELECT id, unnest(generate_series(lo, hi, 3600)) AS s, round(value / ((hi - lo) / 3600.0), 6) AS value, 'units/hr' AS unit FROM x""", "ev wins")
def distributed_amounts(spark, sf):
    return r6(grid.distribute_amount(wins(spark, sf), IDS, "s", "e", "value"), "value")


@query("""SELECT DISTINCT id, unnest(generate_series((s // 3600) * 3600, ((s + greatest(e - s, 7200)) // 3600) * 3600, 3600)) AS s, true AS vaso_ind FROM wins""", "ev wins")
def infusion_hours(spark, sf):
    rows = wins(spark, sf).select("id", "s", (F.col("e") - F.col("s")).alias("d1"), F.lit(7_200).cast("long").alias("d2"))
    return grid.any_infusion(rows, IDS, "s", ["d1", "d2"])


@query("""SELECT DISTINCT id, unnest(generate_series((s // 3600) * 3600, ((e - s) // 3600) * 3600, 3600)) AS s, true AS vaso_ind FROM wins
    WHERE (e - s) >= (s // 3600) * 3600""", "ev wins")
def infusion_hours_compat(spark, sf):
    rows = wins(spark, sf).select("id", "s", (F.col("e") - F.col("s")).alias("d1"))
    return grid.any_infusion(rows, IDS, "s", ["d1"], compat=True)


@query("""SELECT id, t, bool_or(f) AS vaso_ind FROM (SELECT id, t, coalesce(value > 0, false) AS f FROM nv
    UNION ALL SELECT id, t, value - 60 > 0 FROM hv) GROUP BY 1, 2""", "ev hv nv")
def any_positive_rate(spark, sf):
    shifted = hv(spark, sf).withColumn("value", F.col("value") - 60)
    return grid.any_rate([(nv(spark, sf), "value"), (shifted, "value")], IDS, TIME)


@query("""SELECT seq, to_timestamp(0)::TIMESTAMP IS NOT NULL AS known, round(date_diff('microsecond', TIMESTAMP '2024-01-02', ts) / 3600000000.0, 6) AS hours
    FROM (SELECT event_id AS seq, ts FROM events)""")
def hours_since_admission(spark, sf):
    from checks.common import table

    e = table(spark, sf, "events")
    hours = times.hours_since(F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'"), "ts")
    return r6(e.select(F.col("event_id").alias("seq"), F.col("ts").isNotNull().alias("known"), hours.alias("hours")), "hours")
