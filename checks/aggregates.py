"""Grouped aggregation and the aggregates behind charts."""

from pyspark.sql import functions as F

from checks.common import IDS, TIME, ev, nv, query, r6, table
from staygrid.operators import aggregate as agg
from staygrid.operators import stats
from staygrid.schema import HOUR


@query("SELECT id, t, median(value) AS value, arg_min(item, (t, seq)) AS item FROM (SELECT id, (t // 3600) * 3600 AS t, value, item, seq FROM ev) GROUP BY 1, 2", "ev")
def series_default_median(spark, sf):
    rows = ev(spark, sf).withColumn("t", F.floor(F.col("t") / HOUR) * HOUR)
    return agg.aggregate_series(rows, IDS, TIME, "value", unit="item", order=["seq"])


@query("SELECT id, t, sum((value > 40)::INT)::BIGINT AS high FROM (SELECT id, (t // 86400) * 86400 AS t, value FROM ev) GROUP BY 1, 2", "ev")
def series_default_of_flags(spark, sf):
    rows = ev(spark, sf).select("id", (F.floor(F.col("t") / 86400) * 86400).alias("t"), (F.col("value") > 40).alias("high"))
    return agg.aggregate_series(rows, IDS, TIME, "high")


@query("""SELECT id, round(avg(value), 6) AS mean, median(value) AS median, min(value) AS min, max(value) AS max,
    round(sum(value), 6) AS sum, round(var_samp(value), 6) AS var, round(stddev_samp(value), 6) AS std, count(value) AS count,
    bool_or(value > 100) AS any_high, bool_and(value < 300) AS all_low, round(product(1 + value / 10000), 6) AS prod,
    arg_min(value, seq) AS first, arg_max(value, seq) AS last FROM ev GROUP BY id""", "ev")
def all_aggregators(spark, sf):
    rows = ev(spark, sf).withColumns({"hi": F.col("value") > 100, "lo": F.col("value") < 300, "f": 1 + F.col("value") / 10000})
    outs = [agg.aggregator(f, "value", ["seq"]).alias(f) for f in ("mean", "median", "min", "max", "sum", "var", "std", "count", "first", "last")]
    out = rows.groupBy("id").agg(
        *outs, agg.aggregator("any", "hi").alias("any_high"), agg.aggregator("all", "lo").alias("all_low"),
        agg.aggregator("prod", "f").alias("prod"))
    return r6(out, "mean", "sum", "var", "std", "prod")


@query("""SELECT id, t, max(CASE WHEN value > 60 THEN value END) AS hi, min(CASE WHEN value < 5 THEN value END) AS lo
    FROM (SELECT id, (t // 86400) * 86400 AS t, value FROM ev) GROUP BY 1, 2""", "ev")
def extremes_or_null(spark, sf):
    v = F.col("value")
    rows = ev(spark, sf).select("id", (F.floor(F.col("t") / 86400) * 86400).alias("t"), F.when(v > 60, v).alias("hi"), F.when(v < 5, v).alias("lo"))
    return agg.aggregate_by(rows, ["id", "t"], {"hi": "max", "lo": "min"})


@query("SELECT id, t, CASE WHEN count(DISTINCT item) = 1 THEN max(item) END AS item FROM (SELECT id, (t // 86400) * 86400 AS t, item FROM ev) GROUP BY 1, 2", "ev")
def single_distinct_value(spark, sf):
    rows = ev(spark, sf).withColumn("t", F.floor(F.col("t") / 86400) * 86400)
    return agg.one_unique(rows, ["id", "t"], "item")


@query("""SELECT id, min(t) AS "start", max(t) AS "end", max(value) AS top FROM ev GROUP BY id""", "ev")
def collapse_to_extent(spark, sf):
    return agg.collapse(ev(spark, sf), IDS, TIME, extra={"top": F.max("value")})


@query("""SELECT id, max(value) FILTER (item = 'click') AS click, max(value) FILTER (item = 'error') AS error FROM ev GROUP BY id""", "ev")
def pivot_to_wide(spark, sf):
    return agg.to_wide(ev(spark, sf), IDS, "item", "value", ["click", "error"], "max")


@query("SELECT id, item, round(sum(value), 6) AS value, 'mL' AS unit FROM ev GROUP BY 1, 2", "ev")
def aggregate_with_unit(spark, sf):
    return r6(agg.with_unit(ev(spark, sf), ["id", "item"], "value", "sum", "unit", "mL"), "value")


@query("""SELECT t, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
    round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci FROM nv WHERE value IS NOT NULL GROUP BY t""", "ev hv nv")
def score_trajectory(spark, sf):
    return r6(agg.trajectory(nv(spark, sf), TIME, "value"), "mean", "sd", "ci")


@query("""WITH c AS (SELECT id, (t // 86400) * 86400 AS t, item, avg(value) AS v FROM ev WHERE item IN ('click', 'view') GROUP BY 1, 2, 3),
    s AS (SELECT id, t, item, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0.5 END AS v
        FROM c WINDOW w AS (PARTITION BY id, item))
    SELECT id, t, round(max(v) FILTER (item = 'click'), 6) AS click, round(max(v) FILTER (item = 'view'), 6) AS view FROM s GROUP BY 1, 2""", "ev")
def lab_time_matrix(spark, sf):
    rows = ev(spark, sf).withColumn("t", F.floor(F.col("t") / 86400) * 86400)
    return r6(agg.lab_matrix(rows, IDS, TIME, "item", "value", ["click", "view"]), "click", "view")


@query("""SELECT item, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.975), 6) AS p97 FROM ev GROUP BY item""", "ev")
def exact_quantiles(spark, sf):
    return r6(stats.quantiles(ev(spark, sf), ["item"], "value", {"p1": 0.01, "p50": 0.5, "p97": 0.975}), "p1", "p50", "p97")


@query("""SELECT id, arg_min(v, (-n, v)) AS mode FROM (SELECT id, floor(value / 10) AS v, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY id""", "ev")
def most_frequent_value(spark, sf):
    rows = ev(spark, sf).select("id", F.floor(F.col("value") / 10).cast("double").alias("v"))
    return stats.mode(rows, IDS, "v", "mode")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    count(*) AS n FROM lineitem GROUP BY 1, 2""")
def grouped_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n"))


