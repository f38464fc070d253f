"""Named source rules that group, spread or scale rows, each run by its name."""

from pyspark.sql import functions as F

from checks import units_checks as u
from checks.common import ev, hv, query, r6, rounded, wins
from staygrid.operators.rules import Roles, apply_rule
from staygrid.schema import HOUR

R = Roles(("id",), "t")
ROW = Roles(("id",), ["t", "seq"])  # ties of a time by row number
W = Roles(("id",), "s", stop="e")


@query("SELECT seq, value FROM ev", "ev")
def rule_identity(spark, sf):
    return apply_rule(ev(spark, sf), R, "identity_callback").select("seq", "value")


@query("SELECT seq, CASE WHEN seq % 4 <> 0 THEN floor(value)::DOUBLE END AS value FROM ev", "ev")
def rule_percent(spark, sf):
    rows = ev(spark, sf).selectExpr("seq", "CASE WHEN seq % 4 <> 0 THEN concat(cast(floor(value) AS string), '%') END AS value")
    return apply_rule(rows, R, "percent_as_numeric")


@query("SELECT seq, regexp_replace(item, '[aeiou]', '_', 'g') AS value FROM ev", "ev")
def rule_substitution(spark, sf):
    rows = ev(spark, sf).select("seq", F.col("item").alias("value"))
    return apply_rule(rows, R, "sub_trans", pattern="[aeiou]", replacement="_")


@query("SELECT seq, round(value * CASE item WHEN 'click' THEN 0.5 WHEN 'view' THEN 5 ELSE 1 END, 6) AS value FROM ev", "ev")
def rule_concentration(spark, sf):
    return r6(apply_rule(ev(spark, sf), R, "dex_to_10", factors={"click": 0.5, "view": 5}).select("seq", "value"), "value")


@query("""SELECT id, g, t, dur, unit, round(a / (dur / 3600.0), 6) AS value FROM (SELECT id, seq % 3 AS g, min(t) AS t,
    CASE WHEN max(t) = min(t) THEN 600 ELSE max(t) - min(t) END + 60 AS dur, 'mg/hr' AS unit, sum(value) AS a FROM ev GROUP BY 1, 2)""", "ev")
def rule_group_amount(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "seq % 3 AS g", "t", "value", "'mg' AS unit")
    return r6(apply_rule(rows, Roles(("id",), "t", group=("g",)), "grp_mount_to_rate", min_dur=600, extra_dur=60), "value")


@query(u.AMOUNT_CHANGES, "ev")
def rule_amount_changes(spark, sf):
    return r6(apply_rule(u.amounts(spark, sf), Roles(("id",), ["t", "seq"], group=("g",)), "grp_amount_to_rate", unit="mL/h"), "value").drop("seq")


@query("SELECT id, g, min(t) AS t, max(t) // 3600 - min(t) // 3600 AS value FROM (SELECT *, seq % 3 AS g FROM ev) GROUP BY 1, 2", "ev")
def rule_charted_group_durations(spark, sf):
    rows = ev(spark, sf).withColumn("g", F.col("seq") % 3)
    return apply_rule(rows, Roles(("id",), "t", group=("g",)), "mimic_dur_incv")


@query("SELECT id, g, min(s) AS s, max(e) // 3600 - min(s) // 3600 AS value FROM (SELECT *, seq % 5 AS g FROM wins) GROUP BY 1, 2", "ev wins")
def rule_order_durations(spark, sf):
    rows = wins(spark, sf).withColumn("g", F.col("seq") % 5)
    return apply_rule(rows, Roles(("id",), "s", stop="e", group=("g",)), "aumc_dur")


@query(u._spread(u._KG), "ev")
def rule_drug_text_per_kg(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "t", "seq", "value", f"{u._DRUG} AS item", "50 + id % 40 AS weight")
    return r6(apply_rule(rows, ROW, "eicu_rate_kg", ml_to_mcg=32), "value")


@query(u._spread("CASE seq % 6 WHEN 1 THEN value / 60 * 1000 * 0.5 WHEN 2 THEN value / 60 * 32 * 0.5 WHEN 3 THEN value WHEN 5 THEN value END"), "ev")
def rule_drug_text_units(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "t", "seq", "value", f"{u._DRUG} AS item")
    return r6(apply_rule(rows, ROW, "eicu_rate_units", ml_to_mcg=32, mcg_to_units=0.5), "value")


@query(f"WITH {u._DOSE_SQL} SELECT id, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s, round(v, 4) AS value, 'mcg/kg/min' AS unit FROM k", "ev wins")
def rule_order_rate_per_kg(spark, sf):
    out = apply_rule(u._doses(spark, sf), W, "aumc_rate_kg", weight_relative="rel")
    return out.withColumn("value", rounded("value", 4))


@query("""SELECT id, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s,
    round(value * CASE seq % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1 ELSE 1000000 END * 0.01 / CASE seq % 4 WHEN 0 THEN 60 WHEN 1 THEN 1440 WHEN 2 THEN 1 ELSE 60 END, 4) AS value, 'units/min' AS unit
    FROM wins WHERE e > s""", "ev wins")
def rule_order_rate_in_units(spark, sf):
    out = apply_rule(u._doses(spark, sf), W, "aumc_rate_units", mcg_to_units=0.01)
    return out.withColumn("value", rounded("value", 4))


@query(f"""WITH {u._INFUSED}, n AS (SELECT id, t, grp, v, greatest(coalesce(lead(t) OVER (PARTITION BY id, grp ORDER BY t) - t, 3600) - 60, 0) AS d FROM q),
    p AS (SELECT id, unnest(generate_series(t, t + d, 60)) AS t, v FROM n) SELECT id, (t // 3600) * 3600 AS t, round(median(v), 6) AS value FROM p GROUP BY 1, 2""", "ev")
def rule_given_doses_per_kg(spark, sf):
    rows = ev(spark, sf).selectExpr(
        "id", "t", "value", "seq % 3 AS grp", "50 + id % 40 AS weight", "CASE item WHEN 'click' THEN 'mg' WHEN 'view' THEN 'µg' ELSE 'ml' END AS unit")
    return r6(apply_rule(rows, Roles(("id",), "t", group=("grp",)), "hirid_rate_kg"), "value")


@query("""WITH u AS (SELECT id, t, CASE WHEN seq % 4 = 0 THEN value * 1000 ELSE value END AS value, CASE seq % 4 WHEN 0 THEN 'mg' WHEN 1 THEN 'mg' WHEN 2 THEN 'IE' END AS unit FROM ev)
    SELECT id, (t // 3600) * 3600 AS t, unit || '/min' AS unit, round(sum(value) / 60, 6) AS value FROM u GROUP BY 1, 2, 3""", "ev")
def rule_given_doses(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "t", "value", "CASE seq % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'mg' WHEN 2 THEN 'IE' END AS unit")
    return r6(apply_rule(rows, R, "hirid_rate", to_unit="mg"), "value")


@query("SELECT id, t, CASE WHEN id % 10 <> 0 THEN round(value / (id % 10), 6) END AS value FROM hv", "ev hv")
def rule_rate_over_weight(spark, sf):
    return r6(apply_rule(hv(spark, sf).withColumn("weight", F.col("id") % 10), R, "mimic_kg_rate").drop("weight"), "value")


@query("""WITH h AS (SELECT id, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s, CASE WHEN id % 5 > 0 THEN value * 1000000 / (id % 5) ELSE value END AS v
    FROM wins WHERE e > s) SELECT id, s, round(median(v), 4) AS value FROM h GROUP BY 1, 2""", "ev wins")
def rule_amount_per_kg(spark, sf):
    out = apply_rule(wins(spark, sf).withColumn("weight", F.col("id") % 5), W, "sic_rate_kg")
    return out.withColumn("value", rounded("value", 4))


@query("""WITH r AS (SELECT id, (s // 3600) * 3600 AS lo, (e // 3600) * 3600 AS hi, value FROM wins),
    x AS (SELECT id, lo, CASE WHEN hi = lo THEN lo + 3600 ELSE hi END AS hi, value FROM r)
    SELECT id, unnest(generate_series(lo, hi, 3600)) AS s, round(value / ((hi - lo) / 3600.0), 6) AS value, 'units/hr' AS unit FROM x""", "ev wins")
def rule_distributed_amount(spark, sf):
    return r6(apply_rule(wins(spark, sf), W, "distribute_amount"), "value")


@query("""SELECT seq, CASE WHEN seq % 2 = 0 THEN round(value, 6) WHEN e > s THEN round(value * 3 / ((e - s) / 3600.0), 6) END AS value,
    CASE WHEN seq % 2 = 0 THEN 'mL/h' ELSE 'mg/hour' END AS unit FROM wins""", "ev wins")
def rule_rate_or_amount(spark, sf):
    rows = wins(spark, sf).selectExpr(
        "seq", "CASE WHEN seq % 2 = 0 THEN value END AS value", "'mL/h' AS unit", "e - s AS dur", "value * 3 AS amount", "'mg' AS amount_unit")
    return r6(apply_rule(rows, R, "mimv_rate"), "value").select("seq", "value", "unit")


_BOLUS = """SELECT seq, round(v * CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END / m * 5 * 60, 4) AS value, 'ml/hr' AS unit, round(m * 60, 6) AS dur FROM (
    SELECT seq, floor(value)::DOUBLE AS v, CASE WHEN e > s THEN (e - s) / 60.0 ELSE 1.0 END AS m FROM wins)"""


def _bolus(spark, sf, **limit):
    rows = wins(spark, sf).selectExpr("seq", "concat(cast(floor(value) as string), CASE WHEN seq % 3 = 0 THEN '  g' ELSE ' ml' END) AS value", "e - s AS dur")
    out = apply_rule(rows, R, "eicu_dex_med", **limit)
    return out.select("seq", rounded("value", 4).alias("value"), "unit", rounded("dur").alias("dur"))


@query(f"{_BOLUS} WHERE m <= 720", "ev wins")
def rule_dextrose_bolus(spark, sf):
    return _bolus(spark, sf)


@query(_BOLUS, "ev wins")
def rule_dextrose_bolus_of_any_length(spark, sf):
    return _bolus(spark, sf, max_minutes=None)


@query("SELECT seq, floor(value)::DOUBLE AS value, CAST(3600 AS INTEGER) AS dur, 'ml/hr' AS unit FROM ev", "ev")
def rule_dextrose_infusion(spark, sf):
    rows = ev(spark, sf).selectExpr("seq", "cast(floor(value) AS string) AS value")
    return apply_rule(rows, R, "eicu_dex_inf")


@query("""SELECT id, t, t + least(coalesce(lead(t) OVER (PARTITION BY id ORDER BY t) - t, 7200), 14400) AS stop FROM hv""", "ev hv")
def rule_intervals(spark, sf):
    return apply_rule(hv(spark, sf), R, "create_intervals", overhang=2 * HOUR, max_len=4 * HOUR).select("id", "t", "stop")
