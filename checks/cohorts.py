"""Cohort filters, comparison, tests and data quality."""

import math

from pyspark.sql import functions as F

from checks.common import IDS, TIME, demo, ev, hv, item_a, item_b, nv, query, r6, table
from staygrid.operators import cohort, quality, stats
from staygrid.schema import Table

CRITERIA = cohort.Criteria(age_min=25, age_max=70, los_min=50, los_max=400, gender="m", survived=True, has_sepsis=False)
_SEPSIS = "SELECT DISTINCT o_orderkey AS patient_id FROM orders WHERE regexp_matches('A4' || (o_custkey % 4), '^(A40|A41)') OR o_orderkey % 50 = 0"
_KEPT = "age >= 25 AND age <= 70 AND los_hours >= 50 AND los_hours <= 400 AND gender = 'M' AND survived"


def _sepsis(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("patient_id"), F.concat(F.lit("A4"), (F.col("o_custkey") % 4).cast("string")).alias("code"),
        F.when(F.col("o_orderkey") % 50 == 0, "Septic shock").otherwise("other").alias("text"))
    return cohort.sepsis_ids(o, "patient_id", "code", "text")


@query(_SEPSIS)
def sepsis_patients(spark, sf):
    return _sepsis(spark, sf)


@query(f"SELECT patient_id, age, los_hours FROM demo WHERE {_KEPT} AND patient_id NOT IN ({_SEPSIS})", "demo")
def filtered_cohort(spark, sf):
    return cohort.filter_cohort(demo(spark, sf), CRITERIA, _sepsis(spark, sf)).select("patient_id", "age", "los_hours")


@query("""SELECT 'all' AS criterion, count(*) AS n_left, 0::INT AS step FROM demo UNION ALL SELECT 'age_min', count(*) FILTER (age >= 25), 1 FROM demo
    UNION ALL SELECT 'age_max', count(*) FILTER (age BETWEEN 25 AND 70), 2 FROM demo UNION ALL SELECT 'los_min', count(*) FILTER (age BETWEEN 25 AND 70 AND los_hours >= 50), 3 FROM demo
    UNION ALL SELECT 'los_max', count(*) FILTER (age BETWEEN 25 AND 70 AND los_hours BETWEEN 50 AND 400), 4 FROM demo
    UNION ALL SELECT 'gender', count(*) FILTER (age BETWEEN 25 AND 70 AND los_hours BETWEEN 50 AND 400 AND gender = 'M'), 5 FROM demo
    UNION ALL SELECT 'survived', count(*) FILTER (age BETWEEN 25 AND 70 AND los_hours BETWEEN 50 AND 400 AND gender = 'M' AND survived), 6 FROM demo""", "demo")
def cohort_attrition(spark, sf):
    return cohort.attrition(demo(spark, sf), CRITERIA)


@query("""SELECT count(*) AS n, round(avg(age), 6) AS age_mean, round(stddev_samp(age), 6) AS age_sd, round(avg(los_hours), 6) AS los_mean,
    round(avg((gender = 'M')::INT), 6) AS male_share, round(avg(survived::INT), 6) AS survival, round(avg(first_icu_stay::INT), 6) AS first_stay_share,
    round(quantile_cont(age, 0.25), 6) AS age_q1, round(median(age), 6) AS age_median, round(quantile_cont(age, 0.75), 6) AS age_q3, round(median(los_hours), 6) AS los_median FROM demo""", "demo")
def cohort_statistics(spark, sf):
    out = cohort.cohort_stats(demo(spark, sf))
    return r6(out, *[c for c in out.columns if c != "n"])


@query("""SELECT grp, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM demo), 6) AS pct, round(avg(age), 6) AS age_mean, round(stddev_samp(age), 6) AS age_sd,
    round(avg((gender = 'M')::INT) * 100, 6) AS male_pct, round(avg(survived::INT) * 100, 6) AS survival_pct, round(median(los_hours), 6) AS los_median FROM demo GROUP BY grp""", "demo")
def cohort_groups(spark, sf):
    out = cohort.cohort_comparison(demo(spark, sf), "grp")
    return r6(out, *[c for c in out.columns if c not in ("grp", "n")])


@query("""SELECT grp, count(*) AS n, round(median(los_hours), 6) AS los_median FROM (SELECT los_hours, CASE WHEN patient_id % 7 = 0 THEN 'seven' WHEN patient_id % 5 = 0 THEN 'five' ELSE 'Other' END AS grp
    FROM demo) GROUP BY grp""", "demo")
def cohort_custom_groups(spark, sf):
    groups = demo(spark, sf).where("patient_id % 7 = 0 OR patient_id % 5 = 0").select(
        "patient_id", F.when(F.col("patient_id") % 7 == 0, "seven").otherwise("five").alias("grp"))
    out = cohort.cohort_comparison(demo(spark, sf).drop("grp"), "grp", groups)
    return r6(out.select("grp", "n", "los_median"), "los_median")


def _erfc(x):
    """The published Chebyshev fit of the complementary error function, as SQL."""
    t, poly = f"(1.0 / (1.0 + 0.5 * ({x})))", "0.17087277::DOUBLE"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + ({c}))"
    return f"({t} * exp(-pow({x}, 2) + {poly}))"


def _p_of_z(z):
    return f"CASE WHEN {z} < 0 THEN 1.0 ELSE least({_erfc(f'(abs({z}) / sqrt(2.0))')}, 1.0) END"


def _rank(x):
    return f"""(SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM (
        SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM (
            SELECT count(*) FILTER (g = 'F')::DOUBLE AS n1, count(*) FILTER (g = 'O')::DOUBLE AS n2, sum(r) FILTER (g = 'F') AS r1, sum(k * k - 1) AS ties FROM (
                SELECT grp AS g, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {x})::DOUBLE AS k FROM demo WHERE grp IN ('F', 'O')))))"""


def _numeric(feature, x):
    side = lambda i, g: ", ".join(
        f"{f} AS {n}_{i}" for n, f in (
            ("n", f"count({x}) FILTER (grp = '{g}')"), ("mean", f"round(avg({x}) FILTER (grp = '{g}'), 6)"), ("sd", f"round(stddev_samp({x}) FILTER (grp = '{g}'), 6)"),
            ("median", f"round(median({x}) FILTER (grp = '{g}'), 6)"), ("q25", f"round(quantile_cont({x}, 0.25) FILTER (grp = '{g}'), 6)"), ("q75", f"round(quantile_cont({x}, 0.75) FILTER (grp = '{g}'), 6)")))
    return f"""SELECT '{feature}' AS feature, {side(1, 'F')}, {side(2, 'O')}, NULL::DOUBLE AS pct_1, NULL::DOUBLE AS pct_2,
        (SELECT round(u, 6) FROM {_rank(x)}) AS statistic, (SELECT round({_p_of_z('z')} + 1e-9, 6) FROM {_rank(x)}) AS p_value FROM demo"""


def _share(feature, yes, no):
    n = lambda c, g: f"count(*) FILTER ({c} AND grp = '{g}')::DOUBLE"
    p = f"least({_erfc('sqrt(statistic / 2.0)')}, 1.0)"
    return f"""SELECT * REPLACE (round(statistic, 6) AS statistic), round({p} + 1e-9, 6) AS p_value FROM (SELECT '{feature}' AS feature, a::BIGINT AS n_1, NULL AS mean_1, NULL AS sd_1, NULL AS median_1, NULL AS q25_1, NULL AS q75_1, c::BIGINT AS n_2, NULL AS mean_2, NULL AS sd_2,
        NULL AS median_2, NULL AS q25_2, NULL AS q75_2, CASE WHEN n1 > 0 THEN round(a * 100 / n1, 6) END AS pct_1, CASE WHEN n2 > 0 THEN round(c * 100 / n2, 6) END AS pct_2,
        CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) <> 0 THEN (a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END AS statistic
        FROM (SELECT {n(yes, 'F')} AS a, {n(no, 'F')} AS b, {n(yes, 'O')} AS c, {n(no, 'O')} AS d, count(*) FILTER (grp = 'F') AS n1, count(*) FILTER (grp = 'O') AS n2 FROM demo))"""


@query(" UNION ALL BY NAME ".join([
    _numeric("age", "age"), _numeric("los_days", "(los_hours / 24)"), _share("male", "gender = 'M'", "gender = 'F'"), _share("deceased", "NOT survived", "survived"),
]), "demo")
def table_one(spark, sf):
    out = cohort.summary_table(demo(spark, sf), "grp", "F", "O")
    return r6(out, *[c for c in out.columns if c not in ("feature", "n_1", "n_2")])


_TIES = "(SELECT sum(c * c * c - c) FROM (SELECT count(*)::DOUBLE AS c FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_quantity))"


@query(f"""WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    s AS (SELECT count(*) FILTER (g = 'A')::DOUBLE AS n1, count(*) FILTER (g = 'R')::DOUBLE AS n2, sum(r) FILTER (g = 'A') AS r1 FROM r),
    u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - {_TIES} / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM s)
    SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS u, round(z, 6) AS z, round({_p_of_z('z')} + 1e-9, 6) AS p_value
    FROM (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z FROM u)""")
def rank_sum_with_ties(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_returnflag IN ('A', 'R')")
    return r6(stats.rank_sum_test(rows, [], "l_quantity", F.col("l_returnflag") == "A"), "u", "z", "p_value")


_KDE = f"""WITH s AS (SELECT item, count(*)::DOUBLE AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) - (max(value) - min(value)) * 0.1 AS lo,
        ((max(value) - min(value)) * 1.2) / 49 AS step FROM ev GROUP BY item),
    g AS (SELECT item, n, h, unnest(range(0, 50))::INT AS point, lo, step FROM s)
    SELECT item, point, round(max(lo + point * step), 6) AS x, round(sum(exp(-0.5 * pow((lo + point * step - value) / h, 2))) / (max(n) * max(h) * {math.sqrt(2 * math.pi)!r}::DOUBLE), 6) AS density
    FROM g JOIN ev USING (item) GROUP BY 1, 2"""


@query(_KDE, "ev")
def density_curves(spark, sf):
    return r6(stats.kde(ev(spark, sf), ["item"], "value", points=50), "x", "density")


@query("""SELECT item, bin, count(*) AS n, bin * 10.0::DOUBLE AS bin_start FROM (SELECT item, least(floor(value / 10), 19)::BIGINT AS bin FROM ev WHERE value BETWEEN 0 AND 200)
    GROUP BY 1, 2""", "ev")
def feature_histogram(spark, sf):
    return cohort.feature_distribution(ev(spark, sf), ["item"], "value", 0, 200, 20)


@query("""SELECT 'a' AS source, item, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q25,
    round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM ev WHERE id % 2 = 0 GROUP BY 2
    UNION ALL SELECT 'b', item, count(*), round(avg(value), 6), round(stddev_samp(value), 6), round(quantile_cont(value, 0.25), 6), round(median(value), 6), round(quantile_cont(value, 0.75), 6)
    FROM ev WHERE id % 2 = 1 GROUP BY 2""", "ev")
def features_by_source(spark, sf):
    e = ev(spark, sf)
    out = cohort.feature_summary({"a": e.where("id % 2 = 0"), "b": e.where("id % 2 = 1")}, "item", "value")
    return r6(out, "mean", "sd", "q25", "median", "q75")


@query("""SELECT CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS "group", day, round(avg(value), 6) AS centre, round(stddev_samp(value), 6) AS std, count(value) AS count,
    round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci FROM (SELECT id, t // 86400 AS day, value FROM ev) WHERE day <= 20 GROUP BY 1, 2""", "ev")
def group_time_series(spark, sf):
    return _group_series(spark, sf, "mean")


@query("""SELECT CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS "group", day, round(median(value), 6) AS centre, round(stddev_samp(value), 6) AS std, count(value) AS count,
    round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci FROM (SELECT id, t // 86400 AS day, value FROM ev) WHERE day <= 20 GROUP BY 1, 2""", "ev")
def group_time_medians(spark, sf):
    return _group_series(spark, sf, "median")


def _group_series(spark, sf, how):
    e = ev(spark, sf).withColumn("day", F.floor(F.col("t") / 86400))
    groups = e.select("id", F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("group")).distinct()
    return r6(cohort.compare_series(cohort.with_group(e, groups, "id"), "group", "day", "value", how, max_time=20), "centre", "std", "ci")


_BANDS = ", ".join(
    f"count(*) FILTER (los > {a} AND los <= {b})::BIGINT AS \"{n}\"" for a, b, n in zip(cohort.LOS_EDGES, cohort.LOS_EDGES[1:], cohort.LOS_LABELS))


@query(f"""SELECT CASE WHEN age <= 30 THEN '18-30' WHEN age <= 40 THEN '30-40' WHEN age <= 50 THEN '40-50' WHEN age <= 60 THEN '50-60' WHEN age <= 70 THEN '60-70' ELSE '70+' END AS age_group, {_BANDS}
    FROM (SELECT age, los_hours / 24 AS los FROM demo) WHERE age > 0 AND age <= 100 AND los > 0 AND los <= 1000 GROUP BY 1""", "demo")
def age_by_stay_matrix(spark, sf):
    return cohort.complexity_matrix(demo(spark, sf).withColumn("los_days", F.col("los_hours") / 24))


@query("""SELECT count(*) AS total_patients, round(avg(age), 6) AS avg_age, round(avg((gender = 'M')::INT) * 100, 6) AS male_pct, round(avg(los_hours) / 24, 6) AS avg_los,
    round(avg((NOT survived)::INT) * 100, 6) AS mortality_rate, (SELECT round(avg(floor(value / 20)), 6) FROM hv) AS avg_sofa FROM demo""", "ev hv demo")
def headline_metrics(spark, sf):
    sofa = hv(spark, sf).select(F.floor(F.col("value") / 20).alias("sofa"))
    out = cohort.summary_metrics(demo(spark, sf), sofa)
    return r6(out, *[c for c in out.columns if c != "total_patients"])


@query("""WITH c AS (SELECT substr(p_type, 1, 3) AS category, count(*) AS n FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, category LIMIT 4)
    SELECT category, n FROM t UNION ALL SELECT 'other', CAST(sum(n) AS BIGINT) FROM c WHERE category NOT IN (SELECT category FROM t) HAVING count(*) > 0""")
def top_diagnosis_categories(spark, sf):
    return cohort.diagnosis_shares(table(spark, sf, "part"), "p_type", top=4)


@query("SELECT substr(p_type, 1, 3) AS category, count(*) AS n FROM part GROUP BY 1")
def diagnosis_categories(spark, sf):
    return cohort.diagnosis_shares(table(spark, sf, "part"), "p_type")


@query("SELECT CAST(floor(value / 20) AS BIGINT) AS sofa, count(*) AS n FROM hv GROUP BY 1", "ev hv")
def score_distribution(spark, sf):
    return cohort.score_histogram(hv(spark, sf).select(F.floor(F.col("value") / 20).alias("sofa")), "sofa")


@query("""WITH c AS (SELECT quantile_cont(value, 0.25) AS a, median(value) AS b, quantile_cont(value, 0.75) AS d FROM ev)
    SELECT CASE WHEN value <= a THEN 'Q1' WHEN value <= b THEN 'Q2' WHEN value <= d THEN 'Q3' ELSE 'Q4' END AS quartile, count(*) AS n,
    round(avg((item = 'error')::INT) * 100, 6) AS mortality_pct FROM ev, c GROUP BY 1""", "ev")
def mortality_by_quartile(spark, sf):
    rows = ev(spark, sf).withColumn("died", F.col("item") == "error")
    return r6(cohort.mortality_by_quartile(rows, "value", "died"), "mortality_pct")


# --- data quality -------------------------------------------------------------------

@query("""SELECT variable, count(x) AS n_values, max(lo) AS expected_min, max(hi) AS expected_max, min(x) AS actual_min, max(x) AS actual_max,
    count(*) FILTER (x < lo OR x > hi) AS n_out_of_range, round(100.0 * count(*) FILTER (x < lo OR x > hi) / count(x), 6) AS pct_out_of_range, max(lo) IS NOT NULL AS range_defined
    FROM (SELECT 'temp' AS variable, value AS x, 25.0::DOUBLE AS lo, 45.0::DOUBLE AS hi FROM nv UNION ALL SELECT 'hr', value * 10, 0.0, 300.0 FROM nv UNION ALL SELECT 'own', value, 5.0, 20.0 FROM nv
    UNION ALL SELECT 'free', value, NULL, NULL FROM nv) WHERE x IS NOT NULL GROUP BY 1""", "ev hv nv")
def value_ranges(spark, sf):
    v = F.col("value")
    rows = nv(spark, sf).select(v.alias("temp"), (v * 10).alias("hr"), v.alias("own"), v.alias("free"))
    return r6(quality.validate_ranges(rows, ["temp", "hr", "own", "free"], {"own": (5, 20)}), "pct_out_of_range")


@query("""SELECT variable, n AS n_total, m AS n_missing, n - m AS n_present, round(100.0 * m / n, 6) AS pct_missing, round(100.0 * (n - m) / n, 6) AS pct_present FROM (
    SELECT 'a' AS variable, count(*) AS n, count(*) - count(a) AS m FROM j UNION ALL SELECT 'b', count(*), count(*) - count(b) FROM j)""".replace(
    "FROM j", "FROM (SELECT id, t, a, b FROM item_a FULL JOIN item_b USING (id, t))"), "ev item_a item_b")
def missing_values(spark, sf):
    rows = item_a(spark, sf).join(item_b(spark, sf), ["id", "t"], "full")
    return r6(quality.check_missing(rows, ["id", "t"]), "pct_missing", "pct_present")


@query("""SELECT sum(n)::BIGINT AS n_total_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_duplicate_rows, (sum(n) - coalesce(sum(n) FILTER (n > 1), 0))::BIGINT AS n_unique_rows,
    round(100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS pct_duplicates FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def duplicate_rows(spark, sf):
    return r6(quality.check_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"]), "pct_duplicates")


@query("""WITH x AS (SELECT id, t, value AS temp FROM nv), g AS (SELECT DISTINCT id FROM (SELECT id, t - lag(t) OVER (PARTITION BY id ORDER BY t) AS d FROM x) WHERE d > 2592000)
    SELECT 'basic' AS "check", NULL AS variable, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM x UNION ALL SELECT 'basic', NULL, 'n_columns', 3 UNION ALL SELECT 'basic', NULL, 'n_patients', count(DISTINCT id) FROM x
    UNION ALL SELECT 'missing', 'temp', 'n_missing', count(*) - count(temp) FROM x UNION ALL SELECT 'missing', 'temp', 'pct_missing', round(100.0 * (count(*) - count(temp)) / count(*), 6) FROM x
    UNION ALL SELECT 'duplicates', NULL, 'n_duplicate_rows', 0 UNION ALL SELECT 'duplicates', NULL, 'pct_duplicates', 0
    UNION ALL SELECT 'range', 'temp', 'n_out_of_range', count(*) FILTER (temp < 25 OR temp > 45) FROM x
    UNION ALL SELECT 'range', 'temp', 'pct_out_of_range', round(100.0 * count(*) FILTER (temp < 25 OR temp > 45) / count(temp), 6) FROM x UNION ALL SELECT 'time', NULL, 'n_time_issues', count(*) FROM g""", "ev hv nv")
def quality_report(spark, sf):
    return r6(quality.report(nv(spark, sf).withColumnRenamed("value", "temp"), IDS, TIME), "value")


@query("""SELECT * FROM (SELECT 'lact' AS "column", round(avg((value IS NULL)::INT), 6) AS missing_rate, CASE WHEN avg((value IS NULL)::INT) > 0.5 THEN 'high missing rate' END AS warning FROM nv
    UNION ALL SELECT 'map', round(avg((value IS NULL OR value > 5)::INT), 6), CASE WHEN avg((value IS NULL OR value > 5)::INT) > 0.5 THEN 'high missing rate' END FROM nv
    UNION ALL SELECT 'circ_event', NULL, 'missing column')""", "ev hv nv")
def circulation_inputs(spark, sf):
    v = F.col("value")
    rows = nv(spark, sf).select("id", "t", v.alias("lact"), F.when(v <= 5, v).alias("map"), F.lit(True).alias("lactate_elevated"), F.lit(True).alias("map_low"))
    return r6(quality.validate_circulation(rows), "missing_rate")


@query("""SELECT 'min_rows' AS "check", count(*) >= 10 AS passed FROM nv UNION ALL SELECT 'unique_keys', true UNION ALL SELECT 'no missing id', true UNION ALL SELECT 'no missing t', true
    UNION ALL SELECT 'no missing value', count(value) = count(*) FROM nv""", "ev hv nv")
def table_validation(spark, sf):
    return quality.validate_table(Table(nv(spark, sf), ("id",), "t"), ["value"], 10, ["value"])


@query("SELECT count(value) = count(*) AND count(id) = count(*) AS no_na, count(*) > 0 AS has_rows FROM nv", "ev hv nv")
def table_assertions(spark, sf):
    rows = nv(spark, sf)
    assert quality.has_columns(rows, ["id", "t"]) and not quality.has_time_columns(rows) and quality.same_time_type(rows, rows, "t")
    return stats.beside(quality.no_na(rows, ["value", "id"]), quality.has_rows(rows))


@query("""SELECT 'a' AS concept, round(avg((a IS NULL)::INT), 6) AS missing_rate FROM j UNION ALL SELECT 'b', round(avg((b IS NULL)::INT), 6) FROM j""".replace(
    "FROM j", "FROM (SELECT id, t, a, b FROM item_a FULL JOIN item_b USING (id, t))"), "ev item_a item_b")
def missing_rate_per_concept(spark, sf):
    rows = item_a(spark, sf).join(item_b(spark, sf), ["id", "t"], "full")
    return r6(quality.missing_rates(rows, ["a", "b"]), "missing_rate")


def _side(p, where):
    return f"""SELECT item AS concept, count(*) AS {p}_rows, count(value) AS {p}_non_null, avg(value) AS {p}_mean, max(value) AS {p}_maximum,
        min(t) FILTER (value > 0) AS {p}_first_signal, count(value) / count(*) AS {p}_coverage FROM ev WHERE {where} GROUP BY 1"""


@query(f"""SELECT concept, a_rows, b_rows, a_non_null, b_non_null, round(a_mean, 6) AS a_mean, round(b_mean, 6) AS b_mean, a_maximum, b_maximum, a_first_signal, b_first_signal,
    round(a_coverage, 6) AS a_coverage, round(b_coverage, 6) AS b_coverage, round(coalesce(a_coverage, 0) - coalesce(b_coverage, 0), 6) AS coverage_gap, round(b_mean - a_mean, 6) AS mean_diff,
    CASE WHEN coalesce(b_rows, 0) = 0 THEN 'missing:b' WHEN coalesce(a_rows, 0) = 0 THEN 'missing:a' ELSE 'ok' END AS status
    FROM ({_side('a', "item <> 'view'")}) FULL JOIN ({_side('b', "item <> 'click' AND value < 200")}) USING (concept)""", "ev")
def results_compared(spark, sf):
    e = ev(spark, sf).withColumnRenamed("item", "concept")
    out = quality.compare_results(e.where("concept <> 'view'"), e.where("concept <> 'click' AND value < 200"), "concept", "t", "value")
    return r6(out, "a_mean", "b_mean", "a_coverage", "b_coverage", "coverage_gap", "mean_diff")


@query("""WITH g AS (SELECT id, t FROM item_a UNION SELECT id, t FROM item_b), j AS (SELECT id, t, a, b FROM g LEFT JOIN item_a USING (id, t) LEFT JOIN item_b USING (id, t))
    SELECT 'a' AS concept, count(a) AS a_rows, count(a) AS b_rows, 0.0::DOUBLE AS mean_diff, 'ok' AS status FROM j UNION ALL SELECT 'b', count(b), count(b) FILTER (b > 10), round(avg(b) FILTER (b > 10) - avg(b), 6), 'ok' FROM j""", "ev item_a item_b")
def wide_results_compared(spark, sf):
    a = item_a(spark, sf).join(item_b(spark, sf), ["id", "t"], "full")
    b = a.withColumn("b", F.when(F.col("b") > 10, F.col("b")))
    return r6(quality.compare_wide(a, b, ["id", "t"], "t", ["a", "b"]).select("concept", "a_rows", "b_rows", "mean_diff", "status"), "mean_diff")
