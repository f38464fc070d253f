"""Units, dose rates and scalar helpers."""

from pyspark.sql import functions as F

from checks.common import IDS, TIME, ev, hv, query, r6, rounded, table, wins
from staygrid.functions import scalars, times, units
from staygrid.operators import rates

_UNIT = "CASE seq % 5 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'umol/L' WHEN 2 THEN 'µmol/l' WHEN 3 THEN 'mg%' ELSE 'other' END"


@query(f"""SELECT seq, CASE u WHEN 'other' THEN value WHEN 'mg/dL' THEN value WHEN 'mg%' THEN value ELSE round(value / 88.4, 6) END AS value,
    CASE u WHEN 'other' THEN 'other' ELSE 'mg/dl' END AS unit FROM (SELECT seq, value, {_UNIT} AS u FROM ev)""", "ev")
def mixed_units_to_one(spark, sf):
    rows = ev(spark, sf).selectExpr("seq", "value", f"{_UNIT} AS unit")
    return r6(units.convert_units(rows, "value", "unit", "mg/dl"), "value")


@query("""SELECT seq, round(value / 9.0, 6) AS lact, round(value * 18.016, 6) AS glu, round(value * 1.8 + 32, 6) AS f, round((value - 32) / 1.8, 6) AS c,
    round(value * 88.4, 6) AS crea, round(value / 0.133322, 6) AS mmhg, round(value * 17.1, 6) AS bili, round(value * 2.54, 6) AS cm, round(value / 2.8, 6) AS bun FROM ev""", "ev")
def named_conversions(spark, sf):
    made = {
        "lact": units.lactate_mg_to_mmol("value"), "glu": units.glucose_mmol_to_mg("value"), "f": units.celsius_to_fahrenheit("value"),
        "c": units.fahrenheit_to_celsius("value"), "crea": units.creatinine_mg_to_umol("value"), "mmhg": units.kpa_to_mmhg("value"),
        "bili": units.convert("value", "mg/dL", "umol/L", "bilirubin"), "cm": units.convert("value", "in", "cm"),
        "bun": units.convert("value", "mg/dl", "mmol/l", "BUN"),
    }
    return ev(spark, sf).select("seq", *[rounded(c, 6).alias(n) for n, c in made.items()])


_RATE_UNIT = "CASE seq % 6 WHEN 0 THEN 'mcg/kg/min' WHEN 1 THEN 'ug/min' WHEN 2 THEN 'mg/hr' WHEN 3 THEN 'mg/kg/h' WHEN 4 THEN ' MCG / min' ELSE 'ml/h' END"


@query("""SELECT seq, round(CASE seq % 6 WHEN 0 THEN value WHEN 1 THEN value / w WHEN 2 THEN value * 1000 / (60 * w) WHEN 3 THEN value * 1000 / 60
    WHEN 4 THEN value / w END, 6) AS rate FROM (SELECT seq, value, 50 + seq % 40 AS w FROM ev)""", "ev")
def vasopressor_rates(spark, sf):
    rows = ev(spark, sf).selectExpr("seq", "value", f"{_RATE_UNIT} AS unit", "50 + seq % 40 AS w")
    return rows.select("seq", rounded(units.vaso_rate("value", "unit", "w"), 6).alias("rate"))


@query("""SELECT seq, round(CASE WHEN seq % 2 = 0 THEN (value - 32) * 5 / 9 ELSE value END, 6) AS value, CASE WHEN seq % 2 = 0 THEN 'C' ELSE 'K' END AS unit FROM ev""", "ev")
def convert_where_unit_matches(spark, sf):
    rows = ev(spark, sf).selectExpr("seq", "value", "CASE WHEN seq % 2 = 0 THEN 'Deg F' ELSE 'K' END AS unit")
    return r6(units.convert_where(rows, "value", "unit", lambda v: (v - 32) * 5 / 9, "C", "deg ?f$"), "value")


@query("SELECT seq, CASE WHEN x <= 1 THEN round(x * 100, 6) ELSE x END AS fio2 FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN floor(value) / 500 ELSE value END AS x FROM ev)", "ev")
def inspired_oxygen_percent(spark, sf):
    rows = ev(spark, sf).selectExpr("seq", "CASE WHEN seq % 3 = 0 THEN floor(value) / 500 ELSE value END AS x")
    x = units.fio2_percent("x")
    return rows.select("seq", F.when(F.col("x") <= 1, rounded(x, 6)).otherwise(x).alias("fio2"))


_DRUG = "CASE seq % 6 WHEN 0 THEN 'Norepi (mcg/kg/min)' WHEN 1 THEN 'Norepi (mg/hr)' WHEN 2 THEN 'Norepi (ml/hr)' WHEN 3 THEN 'Norepi (units/min)' WHEN 4 THEN 'Norepi (nanograms/kg/min)' ELSE 'Norepi' END"
_KG = """CASE seq % 6 WHEN 0 THEN value WHEN 1 THEN value / 60 * 1000 / w WHEN 2 THEN value / 60 * 32 / w WHEN 4 THEN value / 1000 END"""


def _spread(expr, cte="ev"):
    return f"""WITH r AS (SELECT id, t, seq, {expr} AS v FROM (SELECT *, 50 + id % 40 AS w FROM ev)),
    n AS (SELECT id, t, v, greatest(coalesce(lead(t) OVER (PARTITION BY id ORDER BY t, seq) - t, 3600) - 60, 0) AS d FROM r WHERE v IS NOT NULL),
    p AS (SELECT id, unnest(generate_series(t, t + d, 60)) AS t, v FROM n)
    SELECT id, (t // 3600) * 3600 AS t, round(median(v), 6) AS value FROM p GROUP BY 1, 2"""


@query(_spread(_KG), "ev")
def drug_text_rates_per_kg(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "t", "seq", "value", f"{_DRUG} AS drug", "50 + id % 40 AS w")
    return r6(rates.rate_per_kg(rows, IDS, ["t", "seq"], "value", "drug", "w", 32), "value")


@query(_spread("CASE seq % 6 WHEN 1 THEN value / 60 * 1000 * 0.5 WHEN 2 THEN value / 60 * 32 * 0.5 WHEN 3 THEN value WHEN 5 THEN value END"), "ev")
def drug_text_rates_in_units(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "t", "seq", "value", f"{_DRUG} AS drug")
    return r6(rates.rate_in_units(rows, IDS, ["t", "seq"], "value", "drug", 32, 0.5), "value")


_DOSE_COLUMNS = [
    "id", "s", "e", "seq", "value", "CASE seq % 3 WHEN 0 THEN 'mg' WHEN 1 THEN 'µg' ELSE 'g' END AS unit",
    "CASE seq % 4 WHEN 0 THEN 'uur' WHEN 1 THEN 'dag' WHEN 2 THEN 'min' END AS rate_unit", "40 + id % 50 AS weight", "seq % 7 = 0 AS rel",
]
_DOSE_SQL = """d AS (%s), k AS (SELECT id, s, e, value * CASE unit WHEN 'mg' THEN 1000 WHEN 'g' THEN 1000000 ELSE 1 END / CASE rate_unit WHEN 'uur' THEN 60 WHEN 'dag' THEN 1440 ELSE 1 END
    / CASE WHEN rel THEN 1 ELSE weight END AS v FROM d WHERE rate_unit IS NOT NULL AND e > s)""" % f"SELECT {', '.join(_DOSE_COLUMNS)} FROM wins"


def _doses(spark, sf):
    return wins(spark, sf).selectExpr(*_DOSE_COLUMNS)


@query(f"""WITH {_DOSE_SQL} SELECT id, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s, round(v, 4) AS value, 'mcg/kg/min' AS unit FROM k""", "ev wins")
def doses_per_kg(spark, sf):
    out = rates.dose_per_kg(_doses(spark, sf), IDS, "s", "e", "value", "unit", "rate_unit", "weight", "rel")
    return out.withColumn("value", rounded("value", 4))


@query("""SELECT id, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s,
    round(value * CASE seq % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1 ELSE 1000000 END * 0.01 / CASE seq % 4 WHEN 0 THEN 60 WHEN 1 THEN 1440 WHEN 2 THEN 1 ELSE 60 END, 4) AS value, 'units/min' AS unit
    FROM wins WHERE e > s""", "ev wins")
def doses_in_units(spark, sf):
    out = rates.dose_in_units(_doses(spark, sf), IDS, "s", "e", "value", "unit", "rate_unit", 0.01)
    return out.withColumn("value", rounded("value", 4))


_INFUSED = """i AS (SELECT id, (t // 3600) * 3600 AS t, seq % 3 AS grp, CASE item WHEN 'click' THEN value * 1000 WHEN 'view' THEN value END AS v, 50 + id % 40 AS w FROM ev),
    q AS (SELECT id, t, grp, sum(v) / 60.0 / max(w) AS v FROM i WHERE v IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"WITH {_INFUSED} SELECT id, t, grp, round(v, 6) AS value FROM q", "ev")
def infusion_doses_per_kg(spark, sf):
    rows = ev(spark, sf).selectExpr(
        "id", "t", "value", "seq % 3 AS grp", "50 + id % 40 AS w", "CASE item WHEN 'click' THEN 'mg' WHEN 'view' THEN 'µg' ELSE 'ml' END AS unit")
    return r6(rates.infusion_rate_per_kg(rows, IDS, TIME, "value", "unit", ["grp"], "w", spread=False), "value")


@query(f"""WITH {_INFUSED}, n AS (SELECT id, t, grp, v, greatest(coalesce(lead(t) OVER (PARTITION BY id, grp ORDER BY t) - t, 3600) - 60, 0) AS d FROM q),
    p AS (SELECT id, unnest(generate_series(t, t + d, 60)) AS t, v FROM n) SELECT id, (t // 3600) * 3600 AS t, round(median(v), 6) AS value FROM p GROUP BY 1, 2""", "ev")
def infusion_doses_spread(spark, sf):
    rows = ev(spark, sf).selectExpr(
        "id", "t", "value", "seq % 3 AS grp", "50 + id % 40 AS w", "CASE item WHEN 'click' THEN 'mg' WHEN 'view' THEN 'µg' ELSE 'ml' END AS unit")
    return r6(rates.infusion_rate_per_kg(rows, IDS, TIME, "value", "unit", ["grp"], "w"), "value")


@query("""WITH u AS (SELECT id, t, CASE WHEN seq % 4 = 0 THEN value * 1000 ELSE value END AS value, CASE seq % 4 WHEN 0 THEN 'mg' WHEN 1 THEN 'mg' WHEN 2 THEN 'IE' END AS unit FROM ev)
    SELECT id, (t // 3600) * 3600 AS t, unit || '/min' AS unit, round(sum(value) / 60, 6) AS value FROM u GROUP BY 1, 2, 3""", "ev")
def infusion_doses_plain(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "t", "value", "CASE seq % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'mg' WHEN 2 THEN 'IE' END AS unit")
    return r6(rates.infusion_rate(rows, IDS, TIME, "value", "unit", [], "mg"), "value")


@query("SELECT id, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s, value FROM wins", "ev wins")
def running_rates(spark, sf):
    return rates.expand_rate(wins(spark, sf), IDS, "s", "e", "value")


@query("""SELECT seq, CASE WHEN seq % 2 = 0 THEN round(value, 6) WHEN e > s THEN round(value * 3 / ((e - s) / 3600.0), 6) END AS rate,
    CASE WHEN seq % 2 = 0 THEN 'mL/h' ELSE 'mg/hour' END AS unit FROM wins""", "ev wins")
def rate_from_amount(spark, sf):
    rows = wins(spark, sf).selectExpr(
        "seq", "CASE WHEN seq % 2 = 0 THEN value END AS rate", "'mL/h' AS unit", "e - s AS dur", "value * 3 AS amount", "'mg' AS auom")
    return r6(rates.rate_or_amount(rows, "rate", "unit", "dur", "amount", "auom"), "rate").select("seq", "rate", "unit")


# Times are floored to six hours and groups small, so that equal times and groups of one row occur: both have no rate.
AMOUNT_CHANGES = """SELECT id, g, t, 'mL/h' AS unit, CASE WHEN n > 1 AND t > pt THEN round((value - pv) / ((t - pt) / 3600.0), 6) END AS value FROM (
    SELECT id, g, t, value, lag(value) OVER w AS pv, lag(t) OVER w AS pt, count(*) OVER (PARTITION BY id, g) AS n, row_number() OVER w AS r
    FROM (SELECT id, seq % 31 AS g, (t // 21600) * 21600 AS t, seq, value FROM ev) WINDOW w AS (PARTITION BY id, g ORDER BY t, seq)) WHERE r > 1 OR n = 1"""


def amounts(spark, sf):
    return ev(spark, sf).selectExpr("id", "seq % 31 AS g", "t - pmod(t, 21600) AS t", "seq", "value", "'mL' AS unit")


@query(AMOUNT_CHANGES, "ev")
def amount_changes_to_rates(spark, sf):
    return r6(rates.amount_to_rate(amounts(spark, sf), IDS, ["t", "seq"], ["g"], "value", "unit", "mL/h"), "value").drop("seq")


@query("""SELECT id, g, t, dur, unit, round(a / (dur / 3600.0), 6) AS value FROM (SELECT id, seq % 3 AS g, min(t) AS t,
    CASE WHEN max(t) = min(t) THEN 600 ELSE max(t) - min(t) END + 60 AS dur, 'mg/hr' AS unit, sum(value) AS a FROM ev GROUP BY 1, 2)""", "ev")
def group_amounts_to_rates(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "seq % 3 AS g", "t", "value", "'mg' AS unit")
    return r6(rates.group_amount_to_rate(rows, IDS, TIME, ["g"], "value", 600, 60, "unit"), "value")


@query("SELECT seq, round(value * CASE item WHEN 'click' THEN 0.5 WHEN 'view' THEN 5 ELSE 1 END, 6) AS value FROM ev", "ev")
def concentration_factors(spark, sf):
    return ev(spark, sf).select("seq", rounded(rates.dextrose_factor("item", "value", {"click": 0.5, "view": 5}), 6).alias("value"))


@query("""SELECT seq, round(v * CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END / m * 5 * 60, 4) AS dose, 'ml/hr' AS unit, round(m * 60, 6) AS dur FROM (
    SELECT seq, floor(value)::DOUBLE AS v, CASE WHEN e > s THEN (e - s) / 60.0 ELSE 1.0 END AS m FROM wins) WHERE m <= 720""", "ev wins")
def dextrose_boluses(spark, sf):
    rows = wins(spark, sf).selectExpr("seq", "concat(cast(floor(value) as string), CASE WHEN seq % 3 = 0 THEN '  g' ELSE ' ml' END) AS dose", "e - s AS dur")
    out = rates.dextrose_bolus(rows, "dose", "dur")
    return out.select("seq", rounded("dose", 4).alias("dose"), "unit", rounded("dur").alias("dur"))


@query("SELECT id, t, CASE WHEN id % 10 <> 0 THEN round(value / (id % 10), 6) END AS value FROM hv", "ev hv")
def rates_over_weight(spark, sf):
    rows = hv(spark, sf).withColumn("weight", F.col("id") % 10)
    return r6(rates.rate_over_weight(rows, "value", "weight"), "value").drop("weight")


@query("""WITH h AS (SELECT id, unnest(generate_series((s // 3600) * 3600, (e // 3600) * 3600, 3600)) AS s, CASE WHEN id % 5 > 0 THEN value * 1000 / (id % 5) ELSE value END AS v
    FROM wins WHERE e > s) SELECT id, s, round(median(v), 6) AS value FROM h GROUP BY 1, 2""", "ev wins")
def amounts_per_kg(spark, sf):
    rows = wins(spark, sf).withColumn("w", F.col("id") % 5)
    return r6(rates.amount_per_kg(rows, IDS, "s", "e", "value", "w", 1000), "value")


@query("""WITH g AS (SELECT id, seq % 4 AS g, min(s) // 3600 AS a, max(e) // 3600 AS b FROM wins GROUP BY 1, 2)
    SELECT id, min(a) AS s, max(b - a) AS dur FROM g GROUP BY 1""", "ev wins")
def longest_infusions(spark, sf):
    rows = wins(spark, sf).withColumn("g", F.col("seq") % 4)
    return rates.longest_infusion(rows, IDS, "s", "e", ["g"])


# --- scalar helpers ----------------------------------------------------------------

@query("""SELECT seq, round_even(value / 5, 0) * 5 AS nearest, coalesce(v = 3, false) AS is3, coalesce(v <> 3, false) AS not3, coalesce(v = 3, true) AS maybe3,
    coalesce(v > 5, false) AS above, coalesce(v < 8, false) AS truthy, coalesce(NOT v < 8, false) AS falsy, coalesce(v, -1) AS known
    FROM (SELECT seq, value, CASE WHEN seq % 4 <> 0 THEN floor(value) % 10 END AS v FROM ev)""", "ev")
def null_safe_tests(spark, sf):
    rows = ev(spark, sf).selectExpr("seq", "value", "CASE WHEN seq % 4 <> 0 THEN floor(value) % 10 END AS v")
    below = F.col("v") < 8
    return rows.select(
        "seq", scalars.round_to("value", 5).alias("nearest"), scalars.is_val("v", 3).alias("is3"), scalars.not_val("v", 3).alias("not3"),
        scalars.val_or_na("v", 3).alias("maybe3"), scalars.comp_na("v", ">", 5).alias("above"), scalars.is_true(below).alias("truthy"),
        scalars.is_false(below).alias("falsy"), scalars.coalesce(F.col("v").cast("double"), F.lit(-1.0)).alias("known"))


@query("""SELECT seq, CASE WHEN seq % 3 <> 0 THEN p END AS number, p AS percent, CASE item WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' END AS mapped,
    regexp_replace(item, '[aeiou]', '_', 'g') AS replaced, 'u' || seq % 3 AS unit, round(value * 2 + 1, 6) AS op, round(pow(value, 2), 4) AS power
    FROM (SELECT *, floor(value)::DOUBLE AS p FROM ev)""", "ev")
def text_and_arithmetic(spark, sf):
    rows = ev(spark, sf).selectExpr("*", "cast(cast(floor(value) as int) as string) AS p")
    text = F.when(F.col("seq") % 3 != 0, F.col("p")).otherwise("n/a")
    return rows.select(
        "seq", scalars.to_number(text).alias("number"), scalars.percent_as_number(F.concat("p", F.lit("%"))).alias("percent"),
        scalars.apply_map("item", {"click": "C", "view": "V"}).alias("mapped"), scalars.sub_trans("item", "[aeiou]", "_").alias("replaced"),
        scalars.extract_unit(F.concat(F.lit("x (u"), (F.col("seq") % 3).cast("string"), F.lit(")"))).alias("unit"),
        rounded(scalars.binary_op(scalars.binary_op("value", "*", 2), "+", 1), 6).alias("op"), rounded(scalars.binary_op("value", "^", 2), 4).alias("power"))


@query("""SELECT seq, t / 60000.0 AS mins, (t * 60)::BIGINT AS secs, CASE WHEN t % 86400 = 0 THEN 'day' WHEN t % 3600 = 0 THEN 'hour' WHEN t % 60 = 0 THEN 'min' ELSE 'sec' END AS unit,
    t + 90061 AS later FROM ev""", "ev")
def time_helpers(spark, sf):
    step = times.days(1) + times.hours(1) + times.mins(1) + times.secs(1)
    return ev(spark, sf).select(
        "seq", times.ms_as_mins("t").alias("mins"), times.min_as_secs("t").alias("secs"), scalars.unit_of_seconds("t").alias("unit"),
        (F.col("t") + step).alias("later"))


@query("SELECT p_partkey, p_size * 2 + 1 AS p_size FROM part WHERE p_size > 10")
def composed_transforms(spark, sf):
    steps = scalars.combine(lambda d: d.where("p_size > 10"), lambda d: d.withColumn("p_size", F.col("p_size") * 2), lambda d: d.withColumn("p_size", F.col("p_size") + 1))
    return steps(table(spark, sf, "part").select("p_partkey", "p_size"))


