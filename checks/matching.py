"""As-of matching, window aggregation, infection and sepsis."""

from pyspark.sql import functions as F

from checks.common import IDS, TIME, ev, hv, item_a, item_b, query, r6, rounded, wins
from staygrid.operators import asof, intervals, sepsis
from staygrid.schema import HOUR

_AB = "ev item_a item_b"


@query("SELECT id, t, a, b FROM item_a ASOF LEFT JOIN item_b USING (id, t)", _AB)
def last_before(spark, sf):
    return asof.asof(item_a(spark, sf), item_b(spark, sf), IDS, TIME, ["b"])


@query("""SELECT id, t, a, CASE WHEN bt - t <= 36000 THEN b END AS b, CASE WHEN bt - t <= 36000 THEN bt END AS at FROM (
    SELECT x.id, x.t, a, arg_min(b, y.t) AS b, min(y.t) AS bt FROM item_a x LEFT JOIN item_b y ON x.id = y.id AND y.t >= x.t GROUP BY 1, 2, 3)""", _AB)
def next_within_tolerance(spark, sf):
    return asof.asof(item_a(spark, sf), item_b(spark, sf), IDS, TIME, ["b"], "forward", 36_000, "at")


_NEAR = """SELECT x.id, x.t, {cols}, arg_min(b, (abs(y.t - x.t), y.t)) AS b FROM item_a x LEFT JOIN item_b y
    ON x.id = y.id AND abs(y.t - x.t) <= {tol} GROUP BY 1, 2, 3"""


@query(_NEAR.format(cols="a", tol=7200), _AB)
def nearest_within_tolerance(spark, sf):
    return asof.asof(item_a(spark, sf), item_b(spark, sf), IDS, TIME, ["b"], "nearest", 7_200)


@query(_NEAR.format(cols="a", tol=100000000), _AB)
def nearest_of_all(spark, sf):
    return asof.asof(item_a(spark, sf), item_b(spark, sf), IDS, TIME, ["b"], "nearest")


def _ratio(spark, sf, mode):
    b = item_b(spark, sf)
    return r6(asof.oxygen_ratio(item_a(spark, sf), b, IDS, TIME, "a", "b", mode), "pafi")


@query("SELECT id, t, round(100 * a / coalesce(b, 21), 6) AS pafi FROM item_a LEFT JOIN item_b USING (id, t) WHERE coalesce(b, 21) > 0", _AB)
def oxygen_ratio_same_time(spark, sf):
    return _ratio(spark, sf, "match_vals")


@query(f"SELECT id, t, round(100 * a / coalesce(b, 21), 6) AS pafi FROM ({_NEAR.format(cols='a', tol=7200)}) WHERE coalesce(b, 21) > 0", _AB)
def oxygen_ratio_nearest(spark, sf):
    return _ratio(spark, sf, "extreme_vals")


@query("SELECT id, t, round(100 * a / coalesce(b, 21), 6) AS pafi FROM (SELECT id, t, a, b FROM item_a ASOF LEFT JOIN item_b USING (id, t)) WHERE coalesce(b, 21) > 0", _AB)
def oxygen_ratio_last(spark, sf):
    return _ratio(spark, sf, "fill_gaps")


@query("""WITH f AS (SELECT x.id, x.t, a, arg_max(b, y.t) AS b FROM item_a x LEFT JOIN item_b y ON x.id = y.id AND y.t BETWEEN x.t - 7200 AND x.t GROUP BY 1, 2, 3),
    g AS (SELECT y.id, y.t, arg_max(a, x.t) AS a, b FROM item_b y LEFT JOIN item_a x ON x.id = y.id AND x.t BETWEEN y.t - 7200 AND y.t
        WHERE y.id IN (SELECT id FROM item_a) GROUP BY y.id, y.t, b)
    SELECT DISTINCT id, t, a, coalesce(b, 21) AS b FROM (SELECT id, t, a, b FROM f UNION ALL SELECT id, t, a, b FROM g)""", _AB)
def inspired_oxygen_matched(spark, sf):
    return asof.match_fio2(item_a(spark, sf), item_b(spark, sf), IDS, TIME, "a", "b")


_BOTH = "m AS (SELECT id, t, a, b FROM item_a FULL JOIN item_b USING (id, t))"


@query(f"""WITH {_BOTH} SELECT id, t, min(a) OVER w AS a, coalesce(max(b) OVER w, 21) AS b FROM m
    WINDOW w AS (PARTITION BY id ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)""", _AB)
def inspired_oxygen_extremes(spark, sf):
    return asof.match_fio2(item_a(spark, sf), item_b(spark, sf), IDS, TIME, "a", "b", "extreme_vals")


@query(f"""WITH {_BOTH}, g AS (SELECT id, unnest(generate_series(lo, hi, 3600)) AS t FROM (SELECT id, min(t) AS lo, max(t) AS hi FROM m GROUP BY id))
    SELECT id, t, min(a) OVER w AS a, coalesce(max(b) OVER w, 21) AS b FROM g LEFT JOIN m USING (id, t)
    WINDOW w AS (PARTITION BY id ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)""", _AB)
def inspired_oxygen_on_grid(spark, sf):
    return asof.match_fio2(item_a(spark, sf), item_b(spark, sf), IDS, TIME, "a", "b", "fill_gaps")


@query(f"SELECT id, t, round(a - b, 6) AS driving_pres FROM ({_NEAR.format(cols='a', tol=3600)}) WHERE a - b > 0", _AB)
def driving_pressure(spark, sf):
    return r6(asof.driving_pressure(item_a(spark, sf), item_b(spark, sf), IDS, TIME, "a", "b"), "driving_pres")


_VENT = """SELECT id, t, coalesce(e - t, 21600) AS dur FROM (
    SELECT x.id, x.t, min(y.t) AS e FROM item_a x LEFT JOIN item_b y ON x.id = y.id AND y.t BETWEEN x.t AND x.t + 21600 GROUP BY 1, 2)"""


@query(f"SELECT * FROM ({_VENT}) WHERE dur >= 1800", _AB)
def ventilation_windows(spark, sf):
    return asof.ventilation_windows(item_a(spark, sf), item_b(spark, sf), IDS, TIME)


@query(f"SELECT * FROM ({_VENT.replace('21600) AS dur', 't + 21600) AS dur')}) WHERE dur >= 1800", _AB)
def ventilation_windows_compat(spark, sf):
    return asof.ventilation_windows(item_a(spark, sf), item_b(spark, sf), IDS, TIME, compat=True)


_HOP = """SELECT w.id, s, e, round(avg(h.value), 6) AS mean, round(sum(h.value), 6) AS total, min(h.value) AS lo, max(h.value) AS hi, count(h.value) AS n,
    round(stddev_samp(h.value), 5) AS sd FROM wx w JOIN hv h ON w.id = h.id AND {on} GROUP BY 1, 2, 3"""
_WX = "WITH wx AS (SELECT id, s, s + CAST(floor(value * 20000) AS BIGINT) AS e FROM wins) "


def _hop(spark, sf, left, right):
    windows = wins(spark, sf).select("id", "s", (F.col("s") + F.floor(F.col("value") * 20000)).alias("e"))
    out = intervals.hop(hv(spark, sf), windows, IDS, TIME, "s", "e", {
        "mean": ("mean", "value"), "total": ("sum", "value"), "lo": ("min", "value"), "hi": ("max", "value"),
        "n": ("count", "value"), "sd": ("std", "value")}, left, right)
    return r6(out, "mean", "total").withColumn("sd", rounded("sd", 5))


@query(_WX + _HOP.format(on="h.t BETWEEN s AND e"), "ev hv wins")
def window_aggregates_closed(spark, sf):
    return _hop(spark, sf, True, True)


@query(_WX + _HOP.format(on="h.t > s AND h.t < e"), "ev hv wins")
def window_aggregates_open(spark, sf):
    return _hop(spark, sf, False, False)


_LASTING = """d AS (SELECT id, (s // 3600) * 3600 AS s, (s // 3600) * 3600 + (e - s) AS e FROM wins WHERE e > s),
    o AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e) AS k FROM o),
    m AS (SELECT id, min(s) AS s, max(e) AS e FROM i GROUP BY id, k HAVING max(e) - min(s) >= 3600)"""


@query(f"""WITH {_LASTING} SELECT r.id, r.t, max(r.value) AS rate60 FROM (SELECT id, (t // 3600) * 3600 AS t, value FROM ev) r
    JOIN m ON m.id = r.id AND r.t BETWEEN s AND e GROUP BY 1, 2""", "ev wins")
def sustained_infusion_rate(spark, sf):
    durations = wins(spark, sf).select("id", F.col("s").alias("t"), (F.col("e") - F.col("s")).alias("dur"))
    return intervals.sustained_rate(ev(spark, sf).select("id", "t", "value"), durations, IDS, TIME, "value", "dur", "rate60")


# --- infection and sepsis ------------------------------------------------------------

_INF = """abx AS (SELECT DISTINCT id, (t // 3600) * 3600 AS t FROM ev WHERE item = 'click' AND value > 20),
    samp AS (SELECT DISTINCT id, (t // 3600) * 3600 AS t, value > 60 AS pos FROM ev WHERE item = 'view' AND value > 30)"""


def _abx(spark, sf):
    return ev(spark, sf).where("item = 'click' AND value > 20").select("id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t")).distinct()


def _samp(spark, sf):
    rows = ev(spark, sf).where("item = 'view' AND value > 30")
    return rows.select("id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t"), (F.col("value") > 60).alias("samp")).distinct()


_AND = """si AS (SELECT id, t FROM abx a WHERE EXISTS (SELECT 1 FROM samp s WHERE s.id = a.id AND s.t >= a.t AND s.t < a.t + 86400)
    UNION SELECT id, t FROM samp s WHERE EXISTS (SELECT 1 FROM abx a WHERE a.id = s.id AND a.t >= s.t AND a.t < s.t + 259200))"""


@query(f"WITH {_INF}, {_AND} SELECT id, t, true AS susp_inf FROM si", "ev")
def infection_by_both(spark, sf):
    return sepsis.susp_inf(_abx(spark, sf), _samp(spark, sf), IDS, TIME)


@query(f"""WITH {_INF}, p AS (SELECT a.id, a.t, 0 AS r, a.t AS abx_time, min(s.t) AS samp_time FROM abx a JOIN samp s ON s.id = a.id AND s.t >= a.t AND s.t < a.t + 86400 GROUP BY 1, 2, 3, 4
    UNION ALL SELECT s.id, s.t, 1, min(a.t), s.t FROM samp s JOIN abx a ON a.id = s.id AND a.t >= s.t AND a.t < s.t + 259200 GROUP BY s.id, s.t)
    SELECT id, t, arg_min(abx_time, r) AS abx_time, arg_min(samp_time, r) AS samp_time, true AS susp_inf FROM p GROUP BY 1, 2""", "ev")
def infection_with_components(spark, sf):
    return sepsis.susp_inf(_abx(spark, sf), _samp(spark, sf), IDS, TIME, keep_components=True)


@query(f"""WITH {_INF} SELECT id, t, max(a) AS abx_time, max(s) AS samp_time, true AS susp_inf FROM (
    SELECT id, t, t AS a, NULL AS s FROM abx UNION ALL SELECT id, t, NULL, t FROM samp) GROUP BY 1, 2""", "ev")
def infection_by_either(spark, sf):
    return sepsis.susp_inf(_abx(spark, sf), _samp(spark, sf), IDS, TIME, "or", keep_components=True)


@query(f"""WITH {_INF}, c AS (SELECT id, t, count(*) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN CURRENT ROW AND 172800 FOLLOWING) AS n FROM abx)
    SELECT id, t, true AS susp_inf FROM c WHERE n >= 2 AND id IN (SELECT id FROM ev WHERE item = 'error' AND value > 100)""", "ev")
def infection_by_diagnosis(spark, sf):
    diagnosed = ev(spark, sf).where("item = 'error' AND value > 100")
    return sepsis.susp_inf(_abx(spark, sf), None, IDS, TIME, "auto", 48 * HOUR, 2, diagnosed=diagnosed)


@query(f"WITH {_INF} SELECT DISTINCT id, t, true AS susp_inf FROM samp WHERE pos", "ev")
def infection_by_positive_culture(spark, sf):
    return sepsis.susp_inf(_abx(spark, sf), _samp(spark, sf), IDS, TIME, "samp", positive_cultures=True)


_SOFA = "so AS (SELECT id, t, CAST(floor(value / 15) AS INTEGER) AS sofa FROM hv), ds AS (SELECT id, t, sofa, sofa - min(sofa) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS d FROM so)"


def _sofa(spark, sf, name="sofa"):
    return hv(spark, sf).select("id", "t", F.floor(F.col("value") / 15).cast("int").alias(name))


def _sep3_sql(pick):
    return f"""WITH {_INF}, {_AND}, {_SOFA}, e AS ({pick}) SELECT ds.id, min(ds.t) AS t, true AS sep3, arg_min(d, ds.t) AS delta_sofa FROM ds JOIN e ON e.id = ds.id
        AND ds.t BETWEEN e.t - 172800 AND e.t + 86400 WHERE d >= 2 GROUP BY 1"""


def _sep3(spark, sf, which):
    si = sepsis.susp_inf(_abx(spark, sf), _samp(spark, sf), IDS, TIME)
    return sepsis.sep3(_sofa(spark, sf), si, IDS, TIME, si_window=which, keep_components=True)


@query(_sep3_sql("SELECT id, min(t) AS t FROM si GROUP BY id"), "ev hv")
def sepsis_first_infection(spark, sf):
    return _sep3(spark, sf, "first")


@query(_sep3_sql("SELECT id, max(t) AS t FROM si GROUP BY id"), "ev hv")
def sepsis_last_infection(spark, sf):
    return _sep3(spark, sf, "last")


@query(_sep3_sql("SELECT id, t FROM si"), "ev hv")
def sepsis_any_infection(spark, sf):
    return _sep3(spark, sf, "any")


_SEP2 = f"""WITH {_INF}, {_AND}, {_SOFA}, j AS (SELECT so.id, so.t, sofa, si.t AS si, min(sofa) OVER (PARTITION BY so.id, si.t ORDER BY so.t ROWS UNBOUNDED PRECEDING) AS low
    FROM so JOIN si ON si.id = so.id AND so.t BETWEEN si.t - 172800 AND si.t + 86400)
    SELECT id, min(t) AS t, true AS sep3_sofa2 FROM j WHERE sofa - low >= 2 GROUP BY id"""


@query(_SEP2, "ev hv")
def sepsis_sofa2_any(spark, sf):
    si = sepsis.susp_inf(_abx(spark, sf), _samp(spark, sf), IDS, TIME)
    return sepsis.sep3_sofa2(_sofa(spark, sf, "sofa2"), si, IDS, TIME, si_window="any")


@query(_SEP2.replace("j AS", "si1 AS (SELECT id, min(t) AS t FROM si GROUP BY id), j AS").replace("JOIN si ON", "JOIN si1 si ON"), "ev hv")
def sepsis_sofa2_first(spark, sf):
    si = sepsis.susp_inf(_abx(spark, sf), _samp(spark, sf), IDS, TIME)
    return sepsis.sep3_sofa2(_sofa(spark, sf, "sofa2"), si, IDS, TIME)


@query(f"""WITH {_INF}, {_AND}, {_SOFA}, e AS (SELECT id, min(t) AS t FROM si GROUP BY id),
    o AS (SELECT ds.id, ds.t, d FROM ds JOIN e ON e.id = ds.id AND ds.t BETWEEN e.t - 172800 AND e.t + 86400),
    a AS (SELECT id, min(t) AS x FROM o WHERE d >= 2 GROUP BY id), b AS (SELECT id, min(t) AS y FROM o WHERE d >= 4 GROUP BY id)
    SELECT id, x AS onset_time_sofa1, y AS onset_time_sofa2, round((y - x) / 3600.0, 6) AS time_diff_hours, coalesce(abs(y - x) <= 3600, false) AS agreement,
    CASE WHEN x IS NULL THEN 'SOFA-2' WHEN y IS NULL THEN 'SOFA-1' WHEN y < x THEN 'SOFA-2 earlier' WHEN y > x THEN 'SOFA-1 earlier' ELSE 'same' END AS earlier_onset
    FROM a FULL JOIN b USING (id)""", "ev hv")
def sepsis_onsets_compared(spark, sf):
    si = sepsis.susp_inf(_abx(spark, sf), _samp(spark, sf), IDS, TIME)
    first = sepsis.onset(_sofa(spark, sf), si, IDS, TIME)
    second = sepsis.onset(_sofa(spark, sf), si, IDS, TIME, system="SOFA-2", threshold=4)
    return r6(sepsis.compare_onsets(first, second, IDS), "time_diff_hours")
