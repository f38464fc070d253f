"""Named source rules."""

from pyspark.sql import functions as F

from checks.common import ev, hv, nv, query, r6, rounded, table, wins
from staygrid.operators.rules import Roles, apply_rule
from staygrid.schema import HOUR

R = Roles(("id",), "t")
W = Roles(("id",), "s", stop="e")


def _text(spark, sf):
    return ev(spark, sf).selectExpr("id", "t", "seq", "item", "CASE WHEN seq % 5 = 0 THEN '> 89' ELSE cast(cast(floor(value) AS int) AS string) END AS value")


@query("SELECT seq, CASE WHEN seq % 5 = 0 THEN 90.0 ELSE floor(value) END AS value FROM ev", "ev")
def rule_oldest_age(spark, sf):
    return apply_rule(_text(spark, sf), R, "eicu_age").select("seq", "value")


@query("SELECT seq, least(floor(value) * 100 / 365.25, 90.0) AS value FROM ev", "ev")
def rule_age_from_days(spark, sf):
    rows = ev(spark, sf).withColumn("value", F.floor("value") * 100)
    return apply_rule(rows, R, "mimic_age").select("seq", "value")


@query("""SELECT c_custkey, CASE WHEN p4 IN ('Genitourinary', 'Transplant') THEN 'other' WHEN p2 = 'Operative' THEN 'surg' ELSE 'med' END AS value FROM (
    SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Operative' ELSE 'Non-operative' END AS p2, CASE WHEN c_nationkey % 5 = 0 THEN 'Transplant' ELSE c_mktsegment END AS p4
    FROM customer WHERE c_acctbal > 1000)""")
def rule_admission_path(spark, sf):
    path = F.concat_ws(
        "|", F.lit("admission diagnosis"), F.when(F.col("c_acctbal") > 1000, "All Diagnosis").otherwise("Other"),
        F.when(F.col("c_nationkey") % 2 == 0, "Operative").otherwise("Non-operative"), F.lit("Diagnosis"),
        F.when(F.col("c_nationkey") % 5 == 0, "Transplant").otherwise(F.col("c_mktsegment")), F.lit("rest"))
    rows = table(spark, sf, "customer").select("c_custkey", path.alias("value"))
    return apply_rule(rows, R, "eicu_adx")


@query("""SELECT seq, value >= 40 AS above, round(value * 0.5, 6) AS half, floor(value)::BIGINT AS down, ceil(value)::BIGINT AS up, round_even(value, 0) AS near,
    CASE WHEN item = 'click' THEN round(value / 7, 6) ELSE value END AS unit_value, CASE WHEN item = 'click' THEN 'g/dL' ELSE item END AS unit FROM ev""", "ev")
def rules_on_values(spark, sf):
    rows = ev(spark, sf).withColumn("unit", F.col("item"))
    steps = {
        "above": ("comp_na", {"op": ">=", "value": 40}), "half": ("binary_op", {"op": "*", "value": 0.5}), "down": ("floor", {}), "up": ("ceiling", {}),
        "near": ("round", {}), "unit_value": ("convert_unit", {"op": "/", "by": 7, "new_unit": "g/dL", "pattern": "^CLI"}),
    }
    out = rows.select("seq", "id", "t", "item", "value", "unit")
    for name, (rule, params) in steps.items():
        out = apply_rule(out.withColumn("_v", F.col("value")), Roles(("id",), "t", value="_v"), rule, **params).withColumnRenamed("_v", name)
    return r6(out, "half").withColumn("unit_value", F.when(F.col("item") == "click", rounded("unit_value")).otherwise(F.col("unit_value"))).drop("id", "t", "item", "value")


@query("""SELECT seq, CASE item WHEN 'click' THEN 'one' WHEN 'error' THEN 'two' END AS value, true AS present, 'mg/item' AS unit, CASE WHEN seq % 2 = 0 THEN -value ELSE value END AS signed,
    CASE WHEN seq % 3 = 0 THEN -1 ELSE 2 END AS rass FROM ev""", "ev")
def rules_on_labels(spark, sf):
    rows = ev(spark, sf).select(
        "seq", "id", "t", F.col("value").alias("signed"), F.col("item").alias("value"), F.lit("mg").alias("unit"), F.lit("item").alias("rate_unit"),
        F.when(F.col("seq") % 2 == 0, "-").otherwise("+").alias("aux"), F.when(F.col("seq") % 3 == 0, "-1 awake").otherwise("2 restless").alias("rass"),
        F.lit(False).alias("present"))
    out = apply_rule(rows, R, "apply_map", mapping={"click": "one", "error": "two"})
    out = apply_rule(out, Roles(("id",), "t", value="present"), "set_val")
    out = apply_rule(out, R, "aumc_rate")
    out = apply_rule(out, Roles(("id",), "t", value="signed"), "aumc_bxs")
    out = apply_rule(out, Roles(("id",), "t", value="rass"), "aumc_rass")
    return out.select("seq", "value", "present", "unit", "signed", "rass")


@query("""SELECT seq, coalesce(CASE WHEN seq % 4 <> 0 THEN t + 250000 END - t < 259200, false) AS died, (t // 3600) * 3600 AS hour FROM ev""", "ev")
def rules_on_death(spark, sf):
    rows = ev(spark, sf).select("seq", "id", F.when(F.col("seq") % 4 != 0, F.col("t") + 250_000).alias("t"), F.col("t").alias("value"), F.col("t").alias("hour"))
    died = apply_rule(rows, R, "aumc_death").select("seq", F.col("value").alias("died"))
    moved = apply_rule(rows.drop("t"), Roles(("id",), "t", value="hour"), "sic_death").select("seq", F.col("t").alias("hour"))
    return died.join(moved, "seq")


@query("SELECT id, max(t) AS t, true AS value FROM ev WHERE id % 3 = 0 GROUP BY id", "ev")
def rule_death_at_last_row(spark, sf):
    rows = ev(spark, sf).withColumn("aux", F.when(F.col("id") % 3 == 0, "Dead").otherwise("alive"))
    return apply_rule(rows, R, "hirid_death")


@query("""SELECT seq, CASE WHEN seq % 2 = 0 THEN t + 5 ELSE t + 43200 END AS t, value > 30 AS value, t + 43200 AS presc FROM ev""", "ev")
def rules_on_sampling(spark, sf):
    rows = ev(spark, sf).select(
        "seq", "id", "t", F.col("t").alias("presc"), F.when(F.col("value") > 30, F.lit("org")).alias("value"), F.when(F.col("seq") % 2 == 0, F.col("t") + 5).alias("aux"))
    out = apply_rule(rows, R, "mimic_sampling")
    return apply_rule(out.withColumn("flag", F.lit(False)), Roles(("id",), "presc", value="flag"), "mimic_abx_presc").select("seq", "t", "value", "presc")


@query("SELECT id, t, round(median(value), 6) AS value, 'mL' AS unit FROM (SELECT id, (t // 21600) * 21600 AS t, value FROM ev) GROUP BY 1, 2", "ev")
def rule_aggregate(spark, sf):
    rows = ev(spark, sf).withColumn("t", F.floor(F.col("t") / 21600) * 21600)
    return r6(apply_rule(rows, R, "aggregate_fun", how="median", unit="mL"), "value")


@query("SELECT seq, round(floor(value) * 2 + 10, 6) AS value FROM ev", "ev")
def rule_sequence(spark, sf):
    steps = [{"rule": "floor"}, {"rule": "binary_op", "op": "*", "value": 2}, {"rule": "binary_op", "op": "+", "value": 10}]
    return apply_rule(ev(spark, sf), R, "combine_callbacks", rules=steps).select("seq", rounded("value").alias("value"))


@query("SELECT id, g, min(s) AS s, max(e) // 3600 - min(s) // 3600 AS value FROM (SELECT *, seq % 3 AS g FROM wins) GROUP BY 1, 2", "ev wins")
def rule_infusion_durations(spark, sf):
    rows = wins(spark, sf).withColumn("g", F.col("seq") % 3)
    return apply_rule(rows, Roles(("id",), "s", stop="e", group=("g",)), "mimic_dur_inmv")


@query("SELECT id, g, min(t) AS t, max(t) // 3600 - min(t) // 3600 AS value FROM (SELECT *, seq % 3 AS g FROM ev) GROUP BY 1, 2", "ev")
def rule_charted_durations(spark, sf):
    rows = ev(spark, sf).withColumn("g", F.col("seq") % 3)
    return apply_rule(rows, Roles(("id",), "t", group=("g",)), "hirid_duration")


@query("""WITH n AS (SELECT id, s, value, e FROM wins) SELECT id, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s, value FROM n""", "ev wins")
def rule_running_rate(spark, sf):
    return apply_rule(wins(spark, sf), W, "mimic_rate_mv")


@query("""WITH n AS (SELECT id, t, value, greatest(coalesce(lead(t) OVER (PARTITION BY id, g ORDER BY t) - t, 3600) - 3600, 0) AS d
        FROM (SELECT id, (t // 3600) * 3600 AS t, seq % 2 AS g, max(value) AS value FROM ev GROUP BY 1, 2, 3)),
    p AS (SELECT id, unnest(generate_series(t, t + d, 3600)) AS t, value FROM n) SELECT id, t, round(median(value), 6) AS value FROM p GROUP BY 1, 2""", "ev")
def rule_charted_rate(spark, sf):
    rows = ev(spark, sf).groupBy("id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t"), (F.col("seq") % 2).alias("g")).agg(F.max("value").alias("value"))
    return r6(apply_rule(rows, Roles(("id",), "t", group=("g",)), "mimic_rate_cv"), "value")


@query("SELECT id, CAST(floor(value) AS BIGINT) AS t, true AS value FROM nv WHERE value IS NOT NULL", "ev hv nv")
def rule_vent_flag(spark, sf):
    rows = nv(spark, sf).withColumn("value", F.floor("value"))
    return apply_rule(rows, R, "vent_flag").select("id", "t", "value")


@query("""WITH g AS (SELECT id, t, CASE WHEN t - lag(t) OVER (PARTITION BY id ORDER BY t) > 86400 THEN 1 ELSE 0 END AS gap FROM hv),
    r AS (SELECT id, t, sum(gap) OVER (PARTITION BY id ORDER BY t) AS run FROM g) SELECT id, min(t) AS t, (max(t) - min(t)) / 3600.0 AS value FROM r GROUP BY id, run""", "ev hv")
def rule_sessions(spark, sf):
    return apply_rule(hv(spark, sf), R, "eicu_duration", gap=86_400)


@query("""SELECT id, t, CASE WHEN d > 43200 THEN 14400 ELSE d END AS dur FROM (SELECT id, t, coalesce(lead(t) OVER (PARTITION BY id ORDER BY t) - t, 14400) AS d FROM hv)""", "ev hv")
def rule_ventilation_records(spark, sf):
    return apply_rule(hv(spark, sf), R, "hirid_vent").select("id", "t", "dur")


@query("SELECT id, t, round(coalesce(greatest(value - lag(value) OVER (PARTITION BY id ORDER BY t), 0), value), 6) AS value, 'mL' AS unit FROM hv", "ev hv")
def rule_cumulative_urine(spark, sf):
    return r6(apply_rule(hv(spark, sf), R, "hirid_urine"), "value")


@query("""WITH g AS (SELECT id, seq % 4 AS g, min(s) // 3600 AS a, max(e) // 3600 AS b FROM wins GROUP BY 1, 2) SELECT id, min(a) AS s, max(b - a) AS value FROM g GROUP BY 1""", "ev wins")
def rule_longest_infusion(spark, sf):
    rows = wins(spark, sf).withColumn("g", F.col("seq") % 4)
    return apply_rule(rows, Roles(("id",), "s", stop="e", group=("g",)), "sic_dur")


@query("SELECT id, t, CASE WHEN value <> 0 THEN round(w * 100 / value, 6) END AS value FROM (SELECT id, t, value, t // 3600 AS w FROM hv)", "ev hv")
def rule_cell_ratio(spark, sf):
    rows = hv(spark, sf).select("id", "t", F.col("value").alias("aux"), F.floor(F.col("t") / HOUR).alias("value"))
    return r6(apply_rule(rows, R, "blood_cell_ratio").drop("aux"), "value")


@query("SELECT id, t, value, CAST(360 AS INTEGER) AS dur FROM hv", "ev hv")
def rule_constant_window(spark, sf):
    return apply_rule(hv(spark, sf), R, "ts_to_win_tbl", length=360)
