"""Rolling windows, carrying, differences, sessions, urine and kidney windows."""

from pyspark.sql import functions as F

from checks.common import IDS, TIME, ev, hv, nv, query, r6
from staygrid.functions import scores
from staygrid.operators import circulation, kidney, rolling
from staygrid.schema import HOUR

_W = "(PARTITION BY id ORDER BY t RANGE BETWEEN {b} PRECEDING AND {a} FOLLOWING)"


def _sql_window(before, after):
    return _W.format(b=before, a=after)


@query(f"""SELECT id, t, value, max(value) OVER w AS hi, min(value) OVER w AS lo, round(avg(value) OVER w, 6) AS mean,
    round(sum(value) OVER w, 6) AS total, count(value) OVER w AS n, round(stddev_samp(value) OVER w, 6) AS sd
    FROM hv WINDOW w AS {_sql_window(86400, 0)}""", "ev hv")
def slide_look_back(spark, sf):
    out = rolling.slide(hv(spark, sf), IDS, TIME, 24 * HOUR, 0, {
        "hi": ("max", "value"), "lo": ("min", "value"), "mean": ("mean", "value"), "total": ("sum", "value"),
        "n": ("count", "value"), "sd": ("std", "value")})
    return r6(out, "mean", "total", "sd")


@query(f"""SELECT id, t, first_value(value) OVER w AS a, last_value(value) OVER w AS b FROM hv WINDOW w AS {_sql_window(43200, 21600)}""", "ev hv")
def slide_both_sides(spark, sf):
    return rolling.slide(hv(spark, sf), IDS, TIME, 12 * HOUR, 6 * HOUR, {"a": ("first", "value"), "b": ("last", "value")}).select("id", "t", "a", "b")


@query(f"""SELECT id, t, hi FROM (SELECT id, t, max(value) OVER w AS hi, min(t) OVER (PARTITION BY id) AS t0 FROM hv WINDOW w AS {_sql_window(86400, 0)})
    WHERE t - t0 >= 86400""", "ev hv")
def slide_full_window(spark, sf):
    return rolling.slide(hv(spark, sf), IDS, TIME, 24 * HOUR, 0, {"hi": ("max", "value")}, full_window=True).select("id", "t", "hi")


@query("""SELECT id, p AS t, round(avg(value), 6) AS value, count(*) AS n FROM ev, (SELECT unnest([172800, 864000, 1296000, 1814400]) AS p)
    WHERE t BETWEEN p - 86400 AND p + 43200 GROUP BY 1, 2""", "ev")
def slide_at_points(spark, sf):
    out = rolling.slide_at(ev(spark, sf), IDS, TIME, [172800, 864000, 1296000, 1814400], 86400, 43200,
                           {"value": ("mean", "value"), "n": ("count", "seq")})
    return r6(out, "value")


@query("""WITH x AS (SELECT id, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY id),
    w AS (SELECT id, t0 + k * 172800 AS s FROM x, (SELECT unnest(range(0, 100)) AS k) WHERE t0 + k * 172800 + 432000 <= t1)
    SELECT w.id, s AS window_start, s + 432000 AS window_end, count(*) AS n_obs, round(avg(value), 6) AS value_mean,
    round(stddev_samp(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max
    FROM w JOIN ev ON ev.id = w.id AND t >= s AND t < s + 432000 GROUP BY 1, 2, 3""", "ev")
def fixed_step_windows(spark, sf):
    return r6(rolling.slide_windows(ev(spark, sf), IDS, TIME, "value", 432_000, 172_800), "value_mean", "value_std")


@query("SELECT id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS value FROM nv", "ev hv nv")
def carry_forward(spark, sf):
    return rolling.locf(nv(spark, sf), IDS, TIME, ["value"])


@query("SELECT id, t, first_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM nv", "ev hv nv")
def carry_backward(spark, sf):
    return rolling.locb(nv(spark, sf), IDS, TIME, ["value"])


_RUNS = """WITH g AS (SELECT id, t, value, CASE WHEN t - lag(t) OVER (PARTITION BY id ORDER BY t) > 43200 THEN 1 ELSE 0 END AS gap FROM nv),
    r AS (SELECT id, t, value, sum(gap) OVER (PARTITION BY id ORDER BY t) AS run FROM g)"""


@query(_RUNS + " SELECT id, t, last_value(value IGNORE NULLS) OVER (PARTITION BY id, run ORDER BY t ROWS UNBOUNDED PRECEDING) AS value FROM r", "ev hv nv")
def carry_forward_within_gap(spark, sf):
    return rolling.locf(nv(spark, sf), IDS, TIME, ["value"], max_gap=12 * HOUR)


@query(_RUNS + " SELECT id, t, first_value(value IGNORE NULLS) OVER (PARTITION BY id, run ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM r", "ev hv nv")
def carry_backward_within_gap(spark, sf):
    return rolling.locb(nv(spark, sf), IDS, TIME, ["value"], max_gap=12 * HOUR)


@query(f"SELECT id, t, last_value(value IGNORE NULLS) OVER {_sql_window(86400, 0)} AS value FROM nv", "ev hv nv")
def carry_within_a_day(spark, sf):
    return rolling.locf_window(nv(spark, sf), IDS, TIME, ["value"])


_NUMBERED = """WITH n AS (SELECT id, t, value, row_number() OVER (PARTITION BY id ORDER BY t) AS r FROM nv),
    f AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN r END) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS pr,
        min(CASE WHEN value IS NOT NULL THEN r END) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr FROM n),
    v AS (SELECT f.*, p.value AS pv, q.value AS qv FROM f LEFT JOIN n p ON p.id = f.id AND p.r = pr LEFT JOIN n q ON q.id = f.id AND q.r = nr)"""


@query(_NUMBERED + " SELECT id, t, CASE WHEN r - pr <= 1 THEN pv END AS value FROM v", "ev hv nv")
def fill_forward_limited(spark, sf):
    return rolling.fill_na(nv(spark, sf), IDS, TIME, ["value"], "ffill", limit=1)


@query(_NUMBERED + " SELECT id, t, round(coalesce(value, pv + (qv - pv) * (r - pr) / (nr - pr), pv), 6) AS value FROM v", "ev hv nv")
def fill_linear(spark, sf):
    return r6(rolling.fill_na(nv(spark, sf), IDS, TIME, ["value"], "interpolate"), "value")


@query("SELECT id, t, round(coalesce(value, avg(value) OVER (PARTITION BY id)), 6) AS value FROM nv", "ev hv nv")
def fill_with_mean(spark, sf):
    return r6(rolling.fill_na(nv(spark, sf), IDS, TIME, ["value"], "mean"), "value")


@query("SELECT id, t, round(coalesce(value, median(value) OVER (PARTITION BY id)), 6) AS value FROM nv", "ev hv nv")
def fill_with_median(spark, sf):
    return r6(rolling.fill_na(nv(spark, sf), IDS, TIME, ["value"], "median"), "value")


@query("""WITH x AS (SELECT id, t, floor(value / 20) AS value FROM nv),
    m AS (SELECT id, arg_min(value, (-n, value)) AS m FROM (SELECT id, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY id)
    SELECT id, t, coalesce(value, m) AS value FROM x LEFT JOIN m USING (id)""", "ev hv nv")
def fill_with_mode(spark, sf):
    rows = nv(spark, sf).withColumn("value", F.floor(F.col("value") / 20).cast("double"))
    return rolling.fill_na(rows, IDS, TIME, ["value"], "mode")


@query("SELECT id, t, coalesce(value, -1.0) AS value FROM nv", "ev hv nv")
def fill_with_constant(spark, sf):
    return rolling.fill_na(nv(spark, sf), IDS, TIME, ["value"], "const", value=-1.0)


@query("SELECT id, t, round(value - min(value) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS delta FROM nv", "ev hv nv")
def rise_over_running_minimum(spark, sf):
    return r6(rolling.delta_cummin(nv(spark, sf), IDS, TIME, "value"), "delta").drop("value")


@query("SELECT id, t, round(value - f, 6) AS delta FROM nv LEFT JOIN (SELECT id, arg_min(value, t) AS f FROM nv WHERE value IS NOT NULL GROUP BY id) USING (id)", "ev hv nv")
def change_from_start(spark, sf):
    return r6(rolling.delta_start(nv(spark, sf), IDS, TIME, "value"), "delta").drop("value")


@query("SELECT id, t, round(value - min(value) OVER (PARTITION BY id ORDER BY t ROWS 23 PRECEDING), 6) AS delta FROM nv", "ev hv nv")
def rise_over_last_rows(spark, sf):
    return r6(rolling.delta_min(nv(spark, sf), IDS, TIME, "value"), "delta").drop("value")


@query("SELECT id, t, round(value - min(value) OVER (PARTITION BY id), 6) AS delta FROM nv", "ev hv nv")
def rise_over_group_minimum(spark, sf):
    return r6(rolling.delta_group_min(nv(spark, sf), IDS, "value"), "delta").drop("value")


@query("SELECT id, t, coalesce(greatest(value - lag(value) OVER (PARTITION BY id ORDER BY t), 0), value) AS value FROM (SELECT id, t, round(value) AS value FROM hv)", "ev hv")
def cumulative_to_increments(spark, sf):
    rows = hv(spark, sf).withColumn("value", F.round("value"))
    return rolling.increments(rows, IDS, TIME, "value")


@query("SELECT id, t, least(coalesce(t - lag(t) OVER (PARTITION BY id ORDER BY t), 14400), 43200) AS diff FROM hv", "ev hv")
def padded_capped_differences(spark, sf):
    return rolling.padded_capped_diff(hv(spark, sf), IDS, TIME, 4 * HOUR, 12 * HOUR).select("id", "t", "diff")


@query("""SELECT id, t, seq, sum(gap) OVER (PARTITION BY id ORDER BY t, seq)::BIGINT AS grp FROM (
    SELECT id, t, seq, CASE WHEN t - lag(t) OVER (PARTITION BY id ORDER BY t, seq) > 21600 THEN 1 ELSE 0 END AS gap FROM ev)""", "ev")
def sessions_by_gap(spark, sf):
    return rolling.sessions(ev(spark, sf).select("id", "t", "seq"), IDS, ["t", "seq"])


@query("""SELECT id, t, t + least(coalesce(lead(t) OVER (PARTITION BY id ORDER BY t) - t, 3600), 21600) AS "end" FROM hv""", "ev hv")
def intervals_to_next_row(spark, sf):
    return rolling.create_intervals(hv(spark, sf), IDS, TIME).select("id", "t", "end")


@query("""SELECT id, t, t + greatest(coalesce(lead(t) OVER (PARTITION BY id ORDER BY t) - t, 3600) - 3600, 0) AS "end" FROM hv""", "ev hv")
def intervals_shortened(spark, sf):
    return rolling.create_intervals(hv(spark, sf), IDS, TIME, max_len=None, shorten=HOUR).select("id", "t", "end")


@query("""SELECT id, t, CASE WHEN d > 43200 THEN 14400 ELSE d END AS dur FROM (
    SELECT id, t, coalesce(lead(t) OVER (PARTITION BY id ORDER BY t) - t, 14400) AS d FROM hv)""", "ev hv")
def durations_to_next_record(spark, sf):
    return rolling.record_durations(hv(spark, sf), IDS, TIME).select("id", "t", "dur")


@query("""SELECT id, bool_and(ok) AS is_sorted FROM (SELECT id, coalesce(lag(x) OVER (PARTITION BY id ORDER BY seq) <= x, true) AS ok
    FROM (SELECT id, seq, t // (1 + id % 2 * 1000000) AS x FROM ev)) GROUP BY id""", "ev")
def time_order_per_id(spark, sf):
    rows = ev(spark, sf).withColumn("x", F.floor(F.col("t") / (1 + F.col("id") % 2 * 1_000_000)))
    return rolling.is_sorted(rows, IDS, "seq", "x")


@query("""SELECT id, 'large_time_gap' AS issue, count(*) AS n_occurrences, max(g) AS max_gap FROM (
    SELECT id, t - lag(t) OVER (PARTITION BY id ORDER BY t) AS g FROM hv) WHERE g > 86400 GROUP BY id""", "ev hv")
def long_time_gaps(spark, sf):
    return rolling.time_consistency(hv(spark, sf), IDS, TIME, 86_400)


# --- urine and kidney --------------------------------------------------------------

_U24 = """SELECT id, t, CASE WHEN n >= 12 THEN round(s * 24 / n, 6) END AS urine24 FROM (
    SELECT id, t, sum(coalesce(value, 0)) OVER w AS s, count(*) OVER w AS n FROM grid LEFT JOIN nv USING (id, t)
    WINDOW w AS (PARTITION BY id ORDER BY t ROWS 23 PRECEDING))"""


@query(_U24, "ev hv nv grid")
def urine_per_day(spark, sf):
    return r6(kidney.urine24(nv(spark, sf), IDS, TIME, "value"), "urine24")


@query("""WITH x AS (SELECT id, min(t) AS lo, max(t) - min(t) AS hi FROM hv GROUP BY id),
    g AS (SELECT id, unnest(generate_series(lo, hi, 3600)) AS t FROM x WHERE lo <= hi)
    """ + _U24.replace("FROM grid", "FROM g"), "ev hv nv")
def urine_per_day_compat(spark, sf):
    return r6(kidney.urine24(nv(spark, sf), IDS, TIME, "value", compat=True), "urine24")


_WEIGHT = "SELECT id, 40 + id % 60 AS weight FROM (SELECT DISTINCT id FROM ev) WHERE id % 4 <> 0"


def _weight(spark, sf):
    return ev(spark, sf).select("id").distinct().where("id % 4 <> 0").withColumn("weight", F.col("id") % 60 + 40)


@query(f"""SELECT id, t, CASE WHEN n >= 3 THEN round(s / (weight * 6), 6) END AS uo_6h FROM (
    SELECT id, t, weight, sum(value) OVER w AS s, count(value) OVER w AS n FROM nv JOIN ({_WEIGHT}) USING (id)
    WINDOW w AS (PARTITION BY id ORDER BY t ROWS 5 PRECEDING))""", "ev hv nv")
def urine_rate_by_rows(spark, sf):
    return r6(kidney.urine_rate(nv(spark, sf), _weight(spark, sf), IDS, TIME, 6, "value"), "uo_6h")


@query(f"SELECT id, t, round(value / weight, 6) AS urine_mlkgph FROM nv LEFT JOIN ({_WEIGHT}) USING (id)", "ev hv nv")
def urine_per_kilogram(spark, sf):
    return r6(kidney.urine_per_kg_hour(nv(spark, sf), _weight(spark, sf), IDS, TIME, "value"), "urine_mlkgph")


_CREA = """c AS (SELECT id, t, value / 15 AS crea FROM hv WHERE value > 0 AND value / 15 <= 150),
    l AS (SELECT id, t, crea, min(crea) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN 172800 PRECEDING AND 1 PRECEDING) AS l48,
        min(crea) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS l7 FROM c),
    sc AS (SELECT *, CASE WHEN coalesce(crea >= l7 * 3.0, false) OR (crea >= 4.0 AND (coalesce(l48 <= 3.7, false) OR coalesce(crea >= l7 * 1.5, false))) THEN 3
        WHEN crea >= l7 * 2.0 THEN 2 WHEN crea >= l7 * 1.5 OR crea >= l48 + 0.3 THEN 1 ELSE 0 END AS st FROM l)"""


def _crea(spark, sf):
    return hv(spark, sf).select("id", "t", (F.col("value") / 15).alias("crea"))


@query(f"""WITH {_CREA} SELECT id, t, crea, l48 AS creat_low_past_48hr, l7 AS creat_low_past_7day, st AS aki_stage_creat FROM sc""", "ev hv")
def creatinine_staging(spark, sf):
    return kidney.creatinine_stages(_crea(spark, sf), IDS, TIME)


_URINE = f"""u AS (SELECT id, t, coalesce(weight, 70) AS kg, sum(value) OVER w6 AS s6, min(t) OVER w6 AS f6, sum(value) OVER w12 AS s12, min(t) OVER w12 AS f12,
        sum(value) OVER w24 AS s24, min(t) OVER w24 AS f24 FROM nv LEFT JOIN ({_WEIGHT}) USING (id)
        WINDOW w6 AS (PARTITION BY id ORDER BY t RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW),
        w12 AS (PARTITION BY id ORDER BY t RANGE BETWEEN 43199 PRECEDING AND CURRENT ROW),
        w24 AS (PARTITION BY id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)),
    ur AS (SELECT id, t, coalesce(s6, 0) / (kg * greatest((t - f6) / 3600.0, 1.0)) AS r6, coalesce(s12, 0) / (kg * greatest((t - f12) / 3600.0, 1.0)) AS r12,
        coalesce(s24, 0) / (kg * greatest((t - f24) / 3600.0, 1.0)) AS r24 FROM u),
    us AS (SELECT *, CASE WHEN r24 < 0.3 OR r12 = 0 THEN 3 WHEN r12 < 0.5 THEN 2 WHEN r6 < 0.5 THEN 1 ELSE 0 END AS st FROM ur)"""


@query(f"WITH {_URINE} SELECT id, t, round(r6, 6) AS uo_rt_6hr, round(r12, 6) AS uo_rt_12hr, round(r24, 6) AS uo_rt_24hr, st AS aki_stage_uo FROM us", "ev hv nv")
def urine_staging(spark, sf):
    return r6(kidney.urine_stages(nv(spark, sf), _weight(spark, sf), IDS, TIME, "value"), "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr")


_AKI = f"""{_CREA}, {_URINE},
    j AS (SELECT id, t, sc.st AS a, us.st AS b, coalesce(x.rrt, false) AS rrt FROM sc FULL JOIN us USING (id, t)
        LEFT JOIN (SELECT id, t, true AS rrt FROM hv WHERE value > 150) x USING (id, t)),
    k AS (SELECT id, t, CASE WHEN rrt THEN 3 ELSE coalesce(a, 0) END AS a, coalesce(b, 0) AS b, CASE WHEN rrt THEN 3 ELSE 0 END AS r FROM j),
    aki AS (SELECT id, t, a AS aki_stage_creat, b AS aki_stage_uo, r AS aki_stage_rrt, greatest(a, b) AS aki_stage, greatest(a, b) > 0 AS aki FROM k)"""


def _aki(spark, sf):
    rrt = hv(spark, sf).where("value > 150").select("id", "t", F.lit(True).alias("rrt"))
    urine = nv(spark, sf).withColumnRenamed("value", "urine")
    return kidney.aki_stages(_crea(spark, sf), IDS, TIME, urine, _weight(spark, sf), rrt)


@query(f"WITH {_AKI} SELECT * FROM aki", "ev hv nv")
def kidney_injury_stages(spark, sf):
    return _aki(spark, sf).select("id", "t", "aki_stage_creat", "aki_stage_uo", "aki_stage_rrt", "aki_stage", "aki")


@query(f"WITH {_AKI} SELECT id, min(t) AS first_aki_time, max(aki_stage) AS max_aki_stage FROM aki WHERE aki GROUP BY id", "ev hv nv")
def kidney_injury_incidence(spark, sf):
    return kidney.aki_incidence(_aki(spark, sf), IDS, TIME)


@query(f"""WITH {_AKI}, p AS (SELECT id, bool_or(aki) AS aki, max(aki_stage) AS stage, count(*) AS n FROM aki GROUP BY id)
    SELECT 'n_patients' AS metric, NULL::INT AS stage, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'n_measurements', NULL, sum(n)::DOUBLE FROM p
    UNION ALL SELECT 'aki_patients', NULL, count(*) FILTER (aki)::DOUBLE FROM p UNION ALL SELECT 'aki_rate', NULL, round(avg(aki::INT), 6) FROM p
    UNION ALL SELECT 'measurements', aki_stage, count(*)::DOUBLE FROM aki GROUP BY 2 UNION ALL SELECT 'patients', stage, count(*)::DOUBLE FROM p GROUP BY 2""", "ev hv nv")
def kidney_injury_summary(spark, sf):
    return r6(kidney.aki_summary(_aki(spark, sf), IDS), "value")


# --- circulation -------------------------------------------------------------------

_CIRC = """x AS (SELECT id, t, value / 12 AS lact, 30 + value AS map, CASE WHEN t // 3600 % 5 = 0 THEN value / 500 END AS norepi_rate,
        CASE WHEN t // 3600 % 7 = 0 THEN value / 400 END AS epi_rate, CASE WHEN t // 3600 % 11 = 0 THEN 1.0 ELSE 0.0 END AS vaso_rate FROM hv),
    f AS (SELECT *, coalesce(lact >= 2.0, false) AS le, coalesce(map <= 65, false) AS ml,
        coalesce(norepi_rate > 0 AND norepi_rate < 0.1, false) OR coalesce(epi_rate > 0 AND epi_rate < 0.1, false) AS l2,
        coalesce(norepi_rate >= 0.1, false) OR coalesce(epi_rate >= 0.1, false) OR vaso_rate > 0 AS l3 FROM x),
    w AS (SELECT *, avg((ml OR l2 OR l3)::INT) OVER v AS fm, avg(le::INT) OVER v AS fl, bool_or(l2) OVER v AS a2, bool_or(l3) OVER v AS a3,
        count(*) OVER (PARTITION BY id) AS n FROM f WINDOW v AS (PARTITION BY id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    c AS (SELECT id, t, CASE WHEN n < 9 THEN CASE WHEN NOT le THEN 0 WHEN l3 THEN 3 WHEN l2 THEN 2 WHEN ml THEN 1 ELSE 0 END
        WHEN fm >= 2.0::DOUBLE / 3 AND fl >= 2.0::DOUBLE / 3 THEN CASE WHEN a3 THEN 3 WHEN a2 THEN 2 ELSE 1 END ELSE 0 END AS circ_event FROM w)"""


def _circ_input(spark, sf):
    hour, v = F.floor(F.col("t") / HOUR), F.col("value")
    return hv(spark, sf).select(
        "id", "t", (v / 12).alias("lact"), (v + 30).alias("map"), F.when(hour % 5 == 0, v / 500).alias("norepi_rate"),
        F.when(hour % 7 == 0, v / 400).alias("epi_rate"), F.when(hour % 11 == 0, 1.0).otherwise(0.0).alias("vaso_rate"))


@query(f"WITH {_CIRC} SELECT id, t, circ_event, circ_event > 0 AS circ_failure FROM c", "ev hv")
def circulatory_failure_windows(spark, sf):
    return circulation.circ_failure(_circ_input(spark, sf), IDS, TIME).select("id", "t", "circ_event", "circ_failure")


@query(f"WITH {_CIRC} SELECT id, min(t) AS first_circ_failure_time, arg_min(circ_event, t) AS first_event_level FROM c WHERE circ_event >= 2 GROUP BY id", "ev hv")
def circulatory_failure_incidence(spark, sf):
    return circulation.circ_incidence(circulation.circ_failure(_circ_input(spark, sf), IDS, TIME), IDS, TIME, 2)


@query(f"""WITH {_CIRC} SELECT count(*) AS total_observations, count(DISTINCT id) AS total_patients,
    count(DISTINCT id) FILTER (circ_event > 0) AS patients_with_circ_failure,
    {", ".join(f"count(*) FILTER (circ_event = {e}) AS event_{e}_count, round(100.0 * count(*) FILTER (circ_event = {e}) / count(*), 6) AS event_{e}_pct" for e in range(4))},
    round(count(*) FILTER (circ_event > 0) / count(*), 6) AS circ_failure_rate FROM c""", "ev hv")
def circulatory_failure_summary(spark, sf):
    out = circulation.circ_summary(circulation.circ_failure(_circ_input(spark, sf), IDS, TIME), IDS)
    return r6(out, *[f"event_{e}_pct" for e in range(4)], "circ_failure_rate")


@query(f"WITH {_CIRC} SELECT id, t, CASE WHEN NOT le THEN 0 WHEN l3 THEN 3 WHEN l2 THEN 2 WHEN ml THEN 1 ELSE 0 END AS circ_event FROM f", "ev hv")
def circulatory_event_points(spark, sf):
    out = _circ_input(spark, sf).withColumn("circ_event", scores.circ_failure_event("lact", "map", "norepi_rate", "epi_rate", "vaso_rate"))
    return out.select("id", "t", "circ_event")


