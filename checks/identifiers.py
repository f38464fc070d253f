"""Selection, identifier conversion, merging, sorting and set tests."""

from pyspark.sql import functions as F

from checks.common import IDS, TIME, ev, hv, item_a, item_b, nv, query, r6, table
from staygrid.operators import ids as idx, merge, select
from staygrid.schema import Table
from staygrid.sources import demographics as demog


@query("SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def rows_of_wanted_ids(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return select.select_ids(table(spark, sf, "events").select("event_id", "user_id", "value"), wanted, "user_id")


@query("SELECT user_id AS patient, event_id, value * 2 AS double_value FROM events WHERE value > 30 AND event_type = 'view'")
def project_rename_compute(spark, sf):
    e = select.filter_rows(table(spark, sf, "events"), "value > 30 AND event_type = 'view'")
    e = select.keep_columns(e, ["user_id", "event_id", "value", "props"])
    e = select.add_column(e, "double_value", F.col("value") * 2)
    return select.rename_columns(select.drop_columns(e, ["props", "value", "absent"]), {"user_id": "patient"})


@query("SELECT id, t, value FROM nv WHERE value IS NOT NULL", "ev hv nv")
def rows_without_missing(spark, sf):
    return select.remove_na(nv(spark, sf), ["value"])


@query("""SELECT id, t, a, b FROM (SELECT id, t, CASE WHEN value > 20 THEN value END AS a, CASE WHEN value < 60 AND value > 40 THEN value END AS b FROM hv)
    WHERE a IS NOT NULL OR b IS NOT NULL""", "ev hv")
def rows_with_any_data(spark, sf):
    v = F.col("value")
    rows = hv(spark, sf).select("id", "t", F.when(v > 20, v).alias("a"), F.when((v < 60) & (v > 40), v).alias("b"))
    return select.remove_gaps(rows, ["id", "t"])


@query("SELECT id, t, item FROM ev WHERE t BETWEEN 86400 AND 604800", "ev")
def rows_in_time_range(spark, sf):
    return select.filter_time(ev(spark, sf), TIME, 86_400, 604_800).select("id", "t", "item")


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_size > 25 THEN 'big' ELSE CAST(p_size AS VARCHAR) END AS BIGINT) AS size FROM part")
def cast_or_null(spark, sf):
    text = F.when(F.col("p_size") > 25, "big").otherwise(F.col("p_size").cast("string"))
    return select.cast_column(table(spark, sf, "part").select("p_partkey", text.alias("size")), "size", "bigint")


@query("SELECT r_regionkey AS k, r_name AS k_1 FROM region")
def repeated_column_names(spark, sf):
    return select.unique_column_names(table(spark, sf, "region").toDF("k", "k"))


@query("""SELECT c_custkey, c_acctbal, o_orderkey FROM customer JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders) s
    ON o_custkey = c_custkey""")
def patients_with_a_stay(spark, sf):
    patients = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return select.in_icu(patients, s, "c_custkey", "o_orderkey")


@query("SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 25")
def first_ids(spark, sf):
    return select.sample_ids(table(spark, sf, "events"), "user_id", 25)


@query("SELECT DISTINCT user_id FROM events")
def all_patient_ids(spark, sf):
    return select.all_ids(table(spark, sf, "events"), "user_id")


@query("SELECT event_id, event_type, value FROM events WHERE regexp_matches(event_type, '(?i)^c|UP$') AND value BETWEEN 5 AND 80")
def rows_of_concept(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return select.concept_rows(e, "event_type", "value", pattern="^C|up$", lo=5, hi=80)


# --- identifiers ----------------------------------------------------------------

_MAP = "SELECT DISTINCT o_custkey AS patient, o_orderkey AS stay FROM orders"


def _map(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("stay"))


def _patients(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("patient"), "c_acctbal", "c_mktsegment")


@query(f"""SELECT c_acctbal, c_mktsegment, stay FROM (SELECT c_custkey AS patient, c_acctbal, c_mktsegment FROM customer) c
    LEFT JOIN ({_MAP}) m USING (patient)""")
def upgrade_ids(spark, sf):
    return idx.upgrade_id(_patients(spark, sf), _map(spark, sf), "patient", "stay")


@query("""SELECT o_custkey AS patient, round(avg(o_totalprice), 6) AS o_totalprice, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus
    FROM orders GROUP BY 1""")
def downgrade_ids(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stay"), "o_totalprice", "o_orderstatus")
    return r6(idx.downgrade_id(rows, _map(spark, sf), "stay", "patient"), "o_totalprice")


@query("SELECT o_custkey AS patient, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def change_ids_by_cardinality(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stay"), "o_totalprice")
    return idx.change_id(rows, _map(spark, sf), "stay", "patient", "down", how={"o_totalprice": "max"})


@query("SELECT id, t - id * 60 AS t FROM hv", "ev hv")
def shift_by_origin(spark, sf):
    rows = hv(spark, sf).withColumn("off", F.col("id") * 60)
    return idx.shift_time(rows, TIME, "off").select("id", "t")


@query("""SELECT DISTINCT o_orderkey AS stay, o_custkey AS patient, s AS "start", e AS "end" FROM orders
    JOIN (SELECT o_custkey, min(o_orderkey) AS s, max(o_orderkey) AS e FROM orders GROUP BY 1) w USING (o_custkey)""")
def id_map_with_windows(spark, sf):
    m = _map(spark, sf)
    windows = idx.id_windows([(m, "patient", "stay", "stay")], m.select("patient", "stay"))
    return idx.id_map(windows, "stay", "patient")


@query("SELECT id, min(t) AS origin FROM ev GROUP BY id", "ev")
def id_origins(spark, sf):
    return idx.id_origin(ev(spark, sf), "id", TIME)


@query("""SELECT patient, stay, patient_start, patient_end, stay_start, stay_end FROM (SELECT DISTINCT o_custkey AS patient, o_orderkey AS stay FROM orders) l
    LEFT JOIN (SELECT o_custkey AS patient, min(o_totalprice) AS patient_start, max(o_totalprice) AS patient_end FROM orders GROUP BY 1) p USING (patient)
    LEFT JOIN (SELECT l_orderkey AS stay, min(l_extendedprice) AS stay_start, max(l_extendedprice) AS stay_end FROM lineitem GROUP BY 1) s USING (stay)""")
def id_hierarchy_windows(spark, sf):
    m = _map(spark, sf)
    top = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), "o_totalprice")
    low = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stay"), "l_extendedprice")
    return idx.id_windows([(top, "patient", "o_totalprice", "o_totalprice"), (low, "stay", "l_extendedprice", "l_extendedprice")], m)


@query("""WITH w AS (SELECT id, min(t) AS lo, max(t) + 10 AS hi FROM ev GROUP BY id),
    c AS (SELECT id, lo, hi, unnest(generate_series(lo, hi - 1, 86400)) AS s FROM w)
    SELECT id, s, least(s + 86400, hi) AS e FROM c""", "ev")
def stay_windows_cut(spark, sf):
    rows = ev(spark, sf).select("id", F.col("t").alias("s"), (F.col("t") + 10).alias("e"))
    return idx.stay_windows(rows, IDS, "s", "e", 86_400)


@query("""WITH w AS (SELECT id, min(t) AS lo, max(t) + 10 AS hi FROM ev GROUP BY id),
    c AS (SELECT id, lo, hi, k, lo + 1 + k * 86400 AS s FROM w, (SELECT unnest(range(0, 400)) AS k) WHERE k = 0 OR lo + 1 + k * 86400 < hi),
    e AS (SELECT id, hi, s, least(CASE WHEN k = 0 THEN lo + 86400 ELSE s + 86400 END, hi) AS e FROM c WHERE lo < hi)
    SELECT id, s, CASE WHEN e = hi THEN e - 1 ELSE e END AS e FROM e""", "ev")
def stay_windows_open(spark, sf):
    rows = ev(spark, sf).select("id", F.col("t").alias("s"), (F.col("t") + 10).alias("e"))
    return idx.stay_windows(rows, IDS, "s", "e", 86_400, left_closed=False, right_closed=False)


@query(f"SELECT stay, c_acctbal FROM (SELECT c_custkey AS patient, c_acctbal FROM customer) c JOIN ({_MAP}) m USING (patient)")
def convert_id_column(spark, sf):
    return idx.convert_id(_patients(spark, sf).select("patient", "c_acctbal"), _map(spark, sf), "patient", "stay")


@query("SELECT DISTINCT o_orderkey AS stay FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'FURNITURE')")
def expand_patient_filter(spark, sf):
    wanted = _patients(spark, sf).where("c_acctbal < 0 OR c_mktsegment = 'FURNITURE'")
    return idx.expand_wanted(wanted, _map(spark, sf), "patient", "stay")


@query(f"{_MAP}")
def id_lookup(spark, sf):
    return idx.id_lookup(_map(spark, sf), ["patient", "stay"])


@query("SELECT id, arg_min(value, t) AS weight FROM nv WHERE value IS NOT NULL GROUP BY id", "ev hv nv")
def weight_per_id(spark, sf):
    return idx.weights(nv(spark, sf).withColumnRenamed("value", "weight"), IDS, "weight", [TIME])


@query("""SELECT id, t, value, coalesce(w, 70.0) AS weight FROM hv LEFT JOIN (SELECT id, arg_min(value, t) AS w FROM nv WHERE value IS NOT NULL AND id % 3 = 0 GROUP BY id)
    USING (id)""", "ev hv nv")
def attach_weight(spark, sf):
    weight = idx.weights(nv(spark, sf).where("id % 3 = 0").withColumnRenamed("value", "weight"), IDS, "weight", [TIME])
    return idx.add_weight(hv(spark, sf), weight, IDS, default=70.0)


# --- merging -----------------------------------------------------------------------

@query("""SELECT id, t, a, b, s FROM (SELECT id, t, a, b FROM item_a FULL JOIN item_b USING (id, t))
    LEFT JOIN (SELECT id, count(*)::DOUBLE AS s FROM ev GROUP BY id) USING (id)""", "ev item_a item_b")
def merge_concepts_wide(spark, sf):
    static = ev(spark, sf).groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("s"))
    return merge.merge_wide({"a": item_a(spark, sf), "b": item_b(spark, sf)}, IDS, TIME, {"s": static})


@query("""SELECT id, t, a, b FROM item_a FULL JOIN item_b USING (id, t)""", "ev item_a item_b")
def merge_by_full_joins(spark, sf):
    return merge.merge_full([item_a(spark, sf), item_b(spark, sf)], ["id", "t"])


_STATIC = "SELECT c_custkey AS id, c_acctbal AS acct FROM customer"


@query(f"""WITH g AS (SELECT id, t FROM item_a UNION SELECT id, t FROM item_b)
    SELECT id, t FROM g UNION ALL SELECT id, NULL FROM ({_STATIC}) WHERE id NOT IN (SELECT id FROM g)""", "ev item_a item_b")
def common_time_grid(spark, sf):
    static = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acct"))
    return merge.time_grid([item_a(spark, sf), item_b(spark, sf), static], IDS, TIME)


@query("""WITH g AS (SELECT id, t FROM item_a UNION SELECT id, t FROM item_b)
    SELECT id, t, a FROM g LEFT JOIN item_a USING (id, t)""", "ev item_a item_b")
def aligned_concept(spark, sf):
    tables = {"a": item_a(spark, sf), "b": item_b(spark, sf)}
    grid = merge.time_grid(list(tables.values()), IDS, TIME)
    return merge.align_to_grid(tables, grid, IDS, TIME)["a"]


@query(f"""WITH w AS (SELECT id, t, a, b FROM item_a FULL JOIN item_b USING (id, t)),
    r AS (SELECT * FROM w UNION ALL SELECT id, NULL, NULL, NULL FROM ({_STATIC}) WHERE id NOT IN (SELECT id FROM w))
    SELECT r.*, acct FROM r LEFT JOIN ({_STATIC}) USING (id)""", "ev item_a item_b")
def merged_with_static_only_ids(spark, sf):
    static = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acct"))
    return merge.merge_concepts({"a": item_a(spark, sf), "b": item_b(spark, sf)}, IDS, TIME, {"acct": static})


@query("SELECT id, t, a, NULL::DOUBLE AS b FROM item_a UNION ALL SELECT id, t, NULL, b FROM item_b", "ev item_a item_b")
def bind_rows(spark, sf):
    a = Table(item_a(spark, sf), ("id",), "t")
    b = Table(item_b(spark, sf).toDF("stay", "time", "b"), ("stay",), "time")
    return merge.bind_tables([a, b]).df


@query("SELECT id, t, a, b FROM item_a JOIN item_b USING (id, t)", "ev item_a item_b")
def bind_columns_by_key(spark, sf):
    return merge.column_bind([item_a(spark, sf), item_b(spark, sf)], ["id", "t"])


@query("SELECT id, t, b FROM item_b", "ev item_a item_b")
def unmerged_concept(spark, sf):
    wide = merge.merge_full([item_a(spark, sf), item_b(spark, sf)], ["id", "t"])
    return merge.unmerge(wide, ["id", "t"])["b"]


@query("SELECT id, t, b, a FROM item_b LEFT JOIN item_a USING (id, t)", "ev item_a item_b")
def attach_concept(spark, sf):
    return merge.add_concept(item_b(spark, sf), item_a(spark, sf), IDS, TIME, "a")


@query(f"""SELECT stay, CAST(floor(c_acctbal) AS BIGINT) AS t FROM (SELECT c_custkey AS patient, c_acctbal FROM customer)
    JOIN ({_MAP}) USING (patient)""")
def align_ids_and_times(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient"), F.floor("c_acctbal").cast("double").alias("t"))
    return idx.align_ids({"x": rows}, "stay", _map(spark, sf), "patient", "t")["x"]


@query("""WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1)
    SELECT o_orderkey AS patient_id, 20 + o_custkey % 70 + (year(o_orderdate) - 1995)::DOUBLE AS age,
    CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, round(o_totalprice / 100000 * 24, 6) AS los_hours,
    o_orderstatus <> 'F' AS survived, o_orderkey = first AS first_icu_stay FROM orders JOIN f USING (o_custkey)""")
def demographics_of_stays(spark, sf):
    o = table(spark, sf, "orders")
    source = {
        "icustays": o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                             F.col("o_orderkey").alias("stay_id"), F.col("o_orderdate").alias("intime"),
                             (F.col("o_totalprice") / 100000).alias("los")),
        "patients": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 70 + 20).alias("anchor_age"), F.lit(1995).alias("anchor_year"),
            F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("female").alias("gender")),
        "admissions": o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                               F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("hospital_expire_flag")),
    }
    return r6(demog.demographics("miiv", source.__getitem__), "los_hours")


@query("""SELECT c_custkey AS patient_id, CASE WHEN c_acctbal > 6000 THEN 89.0 ELSE (c_custkey % 60 + 20)::DOUBLE END AS age, upper(c_mktsegment[1]) AS gender,
    round(c_acctbal / 60, 6) AS los_hours, c_nationkey % 5 <> 0 AS survived, c_nationkey % 3 = 1 AS first_icu_stay FROM customer""")
def demographics_by_offsets(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patientunitstayid"),
        F.when(F.col("c_acctbal") > 6000, "> 89").otherwise((F.col("c_custkey") % 60 + 20).cast("string")).alias("age"),
        F.col("c_mktsegment").alias("gender"), F.col("c_acctbal").alias("unitdischargeoffset"),
        F.when(F.col("c_nationkey") % 5 == 0, "Expired").otherwise("Alive").alias("hospitaldischargestatus"),
        (F.col("c_nationkey") % 3).alias("unitvisitnumber"))
    return r6(demog.demographics("eicu", {"patient": c}.__getitem__), "los_hours")


# --- sorting, uniqueness, sets ---------------------------------------------------------

@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def sorted_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o = select.ranked(o, ["o_totalprice", "o_orderkey"], [False, True], F.floor(F.col("o_totalprice") / 1000))
    return select.sort_rows(o, ["rank"])


@query("SELECT count(*) = count(DISTINCT (l_orderkey, l_partkey)) AS is_unique FROM lineitem")
def key_uniqueness(spark, sf):
    return select.is_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT id, arg_max(item, seq) AS item, arg_max(value, seq) AS value, max(seq) AS seq FROM ev GROUP BY id", "ev")
def last_row_per_key(spark, sf):
    return select.unique_rows(ev(spark, sf).select("id", "item", "value", "seq"), IDS, ["seq"], "last")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def values_not_in_options(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return select.not_in(table(spark, sf, "customer").select("c_custkey"), users, ["c_custkey"])


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 AS is_subset")
def subset_test(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return select.is_subset(o, table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])


@query("SELECT (SELECT count(*) FROM events WHERE user_id IN (SELECT p_size FROM part)) = 0 AS is_disjoint")
def disjoint_test(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("bigint").alias("user_id"))
    return select.is_disjoint(table(spark, sf, "events").select("user_id"), sizes, ["user_id"])


@query("""SELECT l_returnflag, l_linestatus, sum(n)::BIGINT AS surplus FROM (
    SELECT l_returnflag, l_linestatus, 1 AS n FROM lineitem UNION ALL
    SELECT l_returnflag, l_linestatus, -1 FROM lineitem WHERE l_quantity > 25) GROUP BY 1, 2 HAVING sum(n) <> 0""")
def table_differences(spark, sf):
    rows = table(spark, sf, "lineitem")
    cols = ["l_returnflag", "l_linestatus"]
    return select.differences(rows.select(*cols), rows.where("l_quantity > 25").select(*cols))


@query("""SELECT 'same' AS pair, true AS all_equal UNION ALL SELECT 'changed', count(*) FILTER (event_type = 'click') = 0 FROM events
    UNION ALL SELECT 'shorter', count(*) = 0 FROM events WHERE event_id % 1000 = 7 UNION ALL SELECT 'repeated', count(*) = 0 FROM events WHERE event_id % 1000 = 8""")
def table_equality(spark, sf):
    e = table(spark, sf, "events")
    pairs = {
        "same": e.select(*reversed(e.columns)), "changed": e.withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 1).otherwise(F.col("value"))),
        "shorter": e.where("event_id % 1000 <> 7"), "repeated": e.unionByName(e.where("event_id % 1000 = 8")),
    }
    parts = [select.all_equal(e, other).withColumn("pair", F.lit(name)) for name, other in pairs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
