"""Scans, ingestion, bucketed layout and export shapes."""

from pyspark.sql import functions as F

from checks.common import IDS, TIME, ev, hv, query, r6, scratch, table
from staygrid.operators import aggregate, quality, stats
from staygrid.operators.select import Filter
from staygrid.schema import HOUR
from staygrid.sources import buckets, convert, export, tables


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 50000 AND 200000
    AND regexp_matches(o_orderpriority, '(?i)urgent|high')""")
def scan_with_filters(spark, sf):
    return tables.load_table(
        spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"],
        [Filter("o_orderstatus", "in", ["F", "O"]), Filter("o_totalprice", "between", (50000, 200000)),
         Filter("o_orderpriority", "regex", "urgent|HIGH")],
    )


@query("""SELECT c_custkey, c_acctbal, o_orderkey FROM customer JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders) s
    ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def hospital_table_with_stay_id(spark, sf):
    stays = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tables.load_table(
        spark, f"{sf}/customer.parquet", ["c_custkey", "c_acctbal"], [Filter("c_mktsegment", "eq", "BUILDING")],
        stays=stays, hospital_id="c_custkey", stay_id="o_orderkey",
    )


@query("""SELECT r_regionkey AS k, r_name AS name FROM region
    UNION ALL SELECT n_nationkey, n_name FROM nation""")
def union_of_part_files(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    nation = tables.load_src(table(spark, sf, "nation")).select(
        F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return convert.union_widened([region, nation])


@query("""SELECT id, (t // 3600) * 3600 AS t, item, median(value) AS value FROM ev
    WHERE item IN ('click', 'view', 'error') AND value BETWEEN 1 AND 300 GROUP BY 1, 2, 3""", "ev")
def item_grid_median(spark, sf):
    return aggregate.item_grid(ev(spark, sf), IDS, TIME, "item", "value", HOUR, "median", ["click", "view", "error"], 1, 300)


@query("""SELECT l_orderkey AS id, (CAST(floor(date_diff('second', TIMESTAMP '1995-01-01', l_shipdate)) AS BIGINT) // 604800) * 604800 AS t,
    median(l_quantity) AS l_quantity, median(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2""")
def wide_grid_median(spark, sf):
    from staygrid.functions.times import seconds_between

    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        seconds_between(F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'"), "l_shipdate").alias("t"), "l_quantity", "l_discount")
    return aggregate.wide_grid(rows, IDS, TIME, ["l_quantity", "l_discount"], 604_800)


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000")
def predicate_and_columns(spark, sf):
    return tables.load_src(table(spark, sf, "supplier"), F.col("s_acctbal") > 1000, ["s_suppkey", "s_acctbal"])


@query("""SELECT l_orderkey AS o_orderkey, l_linenumber, date_diff('second', o_orderdate, l_shipdate) AS l_shipdate
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def offsets_from_origin(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    return tables.load_difftime(rows, table(spark, sf, "orders"), ["o_orderkey"], "o_orderdate", ["l_shipdate"])


@query("SELECT o_orderkey, c_name FROM customer JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders) o ON o_custkey = c_custkey")
def id_table_in_stay_ids(spark, sf):
    mapping = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return tables.load_id(table(spark, sf, "customer"), ["c_custkey"], ["c_name"], mapping, "o_orderkey").df


@query("""SELECT l_orderkey AS o_orderkey, CAST(floor(date_diff('second', o_orderdate, l_shipdate) / 172800) AS BIGINT) * 172800 AS l_shipdate,
    l_quantity FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def time_series_table(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return tables.load_ts(rows, ["o_orderkey"], "l_shipdate", ["l_quantity"], 172_800, table(spark, sf, "orders"), "o_orderdate").df


@query("""SELECT id, (s // 3600) * 3600 AS s, value, e - s AS dur FROM wins""", "ev wins")
def window_table(spark, sf):
    from checks.common import wins

    return tables.load_win(wins(spark, sf), IDS, "s", "e", ["value"]).df


@query("SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns FROM events")
def parquet_metadata(spark, sf):
    return tables.metadata(table(spark, sf, "events")).drop("schema")


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 7")
def parquet_peek(spark, sf):
    return tables.peek(table(spark, sf, "events").select("event_id", "user_id", "value"), 7, ["event_id"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_import_round_trip(spark, sf):
    folder = scratch(spark)
    table(spark, sf, "customer").write.option("header", True).csv(folder + "-csv")
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return convert.import_table(spark, folder + "-csv", folder, schema)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'")
def csv_filtered_scan(spark, sf):
    folder = scratch(spark)
    table(spark, sf, "customer").write.option("header", True).option("compression", "gzip").csv(folder)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return tables.read_csv(spark, folder, schema, ["c_custkey", "c_acctbal"], [Filter("c_mktsegment", "eq", "MACHINERY")])


@query("""SELECT CAST(1 + (user_id >= 20)::INT + (user_id >= 55)::INT + (user_id >= 90)::INT AS INTEGER) AS part,
    count(*) AS n, sum(event_id)::BIGINT AS s FROM events GROUP BY 1""")
def id_partitions(spark, sf):
    folder = scratch(spark)
    convert.write_id_partitions(table(spark, sf, "events"), folder, "user_id", [20, 55, 90])
    return spark.read.parquet(folder).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))


@query("SELECT p_partkey, p_size FROM part")
def row_shards(spark, sf):
    folder = scratch(spark)
    convert.write_row_shards(table(spark, sf, "part").select("p_partkey", "p_size"), folder, 500)
    return spark.read.parquet(folder)


@query("SELECT event_id, value FROM events WHERE user_id BETWEEN 10 AND 30")
def range_sorted_rewrite(spark, sf):
    folder = scratch(spark)
    convert.write_for_filtering(table(spark, sf, "events").select("event_id", "user_id", "value"), folder, ["user_id"])
    return tables.read_parquet(spark, folder, ["event_id", "value"], [Filter("user_id", "between", (10, 30))])


@query("""SELECT CAST(k AS VARCHAR) AS k, v FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS DOUBLE) AS v FROM orders
    UNION ALL SELECT c_name, c_acctbal FROM customer)""")
def widened_types(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    b = table(spark, sf, "customer").select(F.col("c_name").alias("k"), F.col("c_acctbal").alias("v"))
    return convert.union_widened([a, b])


@query("SELECT CAST(p_size AS VARCHAR) AS p_size, p_name, p_partkey FROM part")
def mixed_columns_to_text(spark, sf):
    return convert.mixed_to_text(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), ["p_size"])


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'error')")
def bucketed_round_trip(spark, sf):
    folder, layout = scratch(spark), buckets.Layout("event_type", 16)
    buckets.write_buckets(table(spark, sf, "events"), folder, layout)
    return buckets.read_buckets(spark, folder, layout, ["click", "error"], ["event_id", "user_id", "event_type", "value"])


@query("SELECT event_id, user_id, value FROM events WHERE user_id IN (3, 17, 40)")
def bucketed_by_preset_column(spark, sf):
    folder, layout = scratch(spark), buckets.preset("miiv", "chartevents", 32)
    buckets.write_buckets(table(spark, sf, "events").withColumnRenamed("user_id", "itemid"), folder, layout)
    return buckets.read_buckets(spark, folder, layout, [3, 17, 40]).select("event_id", F.col("itemid").alias("user_id"), "value")


@query("""SELECT id, (t - min(t) OVER (PARTITION BY id)) / 3600.0 AS t, value FROM nv WHERE value IS NOT NULL""", "ev hv nv")
def psv_round_trip(spark, sf):
    from checks.common import nv

    folder = scratch(spark)
    export.write_psv(nv(spark, sf), folder, "id", TIME, na_rows=False)
    return export.read_psv(spark, folder, "t double, value double").select("id", "t", "value")


@query("""SELECT id, t, variable, value FROM (SELECT id, t, CAST(seq AS DOUBLE) AS seq, value FROM ev)
    UNPIVOT (value FOR variable IN (seq, value)) WHERE value IS NOT NULL""", "ev")
def long_export_rows(spark, sf):
    return export.long_rows(ev(spark, sf), IDS, TIME, ["seq", "value"])


@query("SELECT c_custkey, c_acctbal FROM customer")
def wide_export_round_trip(spark, sf):
    folder = scratch(spark)
    export.write_wide(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), folder)
    return spark.read.option("header", True).option("nullValue", "NA").schema("c_custkey bigint, c_acctbal double").csv(folder)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_round_trip(spark, sf):
    folder = scratch(spark)
    supplier = table(spark, sf, "supplier")
    export.export(supplier, folder, "json")
    return spark.read.schema(supplier.schema).json(folder)


@query("""SELECT v AS variable, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
    round(quantile_cont(x, 0.25), 6) AS q25, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max
    FROM (SELECT 'l_quantity' AS v, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
    GROUP BY 1""")
def summary_statistics(spark, sf):
    out = stats.summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return r6(out, "mean", "std", "q25", "median", "q75")


@query("""SELECT count(DISTINCT id) AS n_patients, count(*) AS n_observations, min(t) AS start_time, max(t) AS end_time,
    max(t) - min(t) AS duration, CAST(1 AS INTEGER) AS n_variables,
    round(100.0 * count(*) FILTER (value IS NULL) / (count(*) * 3), 6) AS missing_pct FROM nv""", "ev hv nv")
def cohort_information(spark, sf):
    from checks.common import nv

    return r6(quality.cohort_info(nv(spark, sf), IDS, TIME), "missing_pct")


@query("""SELECT * FROM (
    SELECT 'value' AS variable, 'double' AS dtype, count(*) AS n_total, count(*) - count(value) AS n_missing,
        round(100.0 * (count(*) - count(value)) / count(*), 6) AS pct_missing, count(DISTINCT value) AS n_distinct,
        round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
        round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median,
        round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM x
    UNION ALL SELECT 'item', 'string', count(*), 0, 0, count(DISTINCT item), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM x)
    """.replace("FROM x", "FROM (SELECT item, CASE WHEN value > 90 THEN NULL ELSE value END AS value, id FROM ev)"), "ev")
def quality_per_column(spark, sf):
    rows = ev(spark, sf).select("id", "item", F.when(F.col("value") <= 90, F.col("value")).alias("value"))
    return r6(quality.column_report(rows, ["id"]), "pct_missing", "mean", "std", "q25", "median", "q75")


@query("SELECT id, t, value FROM hv", "ev hv")
def incremental_ingest(spark, sf):
    from staygrid.streaming import ingest

    folder = scratch(spark)
    hv(spark, sf).write.option("header", True).csv(folder + "-in")
    stream = ingest.csv_stream(spark, folder + "-in", "id bigint, t bigint, value double")
    for running in ingest.ingest(stream, folder + "-out", folder + "-state"):
        running.awaitTermination()
    return spark.read.parquet(folder + "-out").select("id", "t", "value")


@query("""SELECT 'stream' AS way, id || ',' || t || ',' || CASE WHEN id % 7 = 0 THEN 'n/a' ELSE 'x' || id END AS line FROM hv WHERE id % 7 IN (0, 3)
    UNION ALL SELECT 'batch', id || ',' || t || ',' || CASE WHEN id % 7 = 0 THEN 'n/a' ELSE 'x' || id END FROM hv WHERE id % 7 IN (0, 3)
    UNION ALL SELECT 'kept', CAST(2 * count(*) AS VARCHAR) FROM hv WHERE id % 7 NOT IN (0, 3)""", "ev hv")
def ingest_keeps_rejects(spark, sf):
    from staygrid.streaming import ingest

    folder, schema = scratch(spark), "id bigint, t bigint, value double"
    value = F.when(F.col("id") % 7 == 0, F.lit("n/a")).when(F.col("id") % 7 == 3, F.concat(F.lit("x"), "id")).otherwise(F.col("value").cast("string"))
    hv(spark, sf).withColumn("value", value).write.option("header", True).csv(folder + "-in")
    for running in ingest.ingest(ingest.csv_stream(spark, folder + "-in", schema), folder + "-out", folder + "-state"):
        running.awaitTermination()
    good = convert.import_table(spark, folder + "-in", folder + "-batch", schema).select("id").unionByName(spark.read.parquet(folder + "-out").select("id"))
    lines = [spark.read.text(convert.rejects_of(folder + f"-{end}")).select(F.lit(way).alias("way"), F.col("value").alias("line")) for way, end in (("stream", "out"), ("batch", "batch"))]
    kept = good.agg(F.lit("kept").alias("way"), F.count(F.lit(1)).cast("string").alias("line"))
    return lines[0].unionByName(lines[1]).unionByName(kept)
