"""Concept loading: specs over the event table, derived concepts, catalogue."""

from pathlib import Path

from pyspark.sql import functions as F

from checks.common import demo, ev, query, r6, table
from staygrid.operators import cohort
from staygrid.plans import modules, spec
from staygrid.plans.catalogue import builtin
from staygrid.plans.loader import Loader, SourceLayout, merge_sources
from staygrid.plans.spec import Concept, Item
from staygrid.schema import HOUR

# Concepts of the demo source: name -> (event type, factor, offset).
ITEMS = {
    "hr": ("click", 2.0, 40.0), "sbp": ("view", 1.5, 60.0), "resp": ("error", 0.5, 8.0), "crea": ("signup", 0.05, 0.3), "bili": ("signup", 0.1, 0.0),
    "plt": ("purchase", 4.0, 5.0), "map": ("view", 1.0, 40.0), "po2": ("click", 1.5, 40.0), "fio2": ("error", 0.5, 21.0), "tgcs": ("purchase", 0.05, 3.0),
    "urine": ("view", 8.0, 0.0), "wbc": ("error", 0.2, 1.0), "hgb": ("click", 0.05, 6.0),
}


def _catalogue():
    c = builtin()
    for name, (item, factor, offset) in ITEMS.items():
        rule = {"rule": "combine_callbacks", "rules": [
            {"rule": "binary_op", "op": "*", "value": factor}, {"rule": "binary_op", "op": "+", "value": offset}]}
        c = c.add_item(name, "demo", Item("events", (item,), item="event_type", value="value", time="ts", rule=rule))
    c = c.add(Concept("tgcs", kind="num", low=3, high=15))
    c = c.add_item("abx", "demo", Item("events", ("click",), item="event_type", value="value", time="ts", rule={"rule": "comp_na", "op": ">", "value": 20}))
    c = c.add_item("samp", "demo", Item("events", ("view",), item="event_type", value="value", time="ts", rule={"rule": "comp_na", "op": ">", "value": 30}))
    return c.add_item("weight", "demo", Item("events", ("signup",), item="event_type", value="value", time="ts", rule={"rule": "binary_op", "op": "+", "value": 50.0}))


def _loader(spark, sf, catalogue=None):
    def read(name):
        if name == "stays":
            e = table(spark, sf, "events").select("user_id").distinct()
            return e.select("user_id", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("intime"), F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'").alias("outtime"))
        return table(spark, sf, name)

    layout = SourceLayout("demo", "user_id", read, time="ts", item="event_type", stays="stays")
    return Loader(spark, catalogue or _catalogue(), layout)


def _agg(name, how="median"):
    item, factor, offset = ITEMS[name]
    c = builtin()[name]
    low, high = (3, 15) if name == "tgcs" else (c.low, c.high)
    bound = " AND ".join([f"v >= {low}"] * (low is not None) + [f"v <= {high}"] * (high is not None)) or "true"
    how = c.aggregate or how
    return f"""(SELECT id, t, v AS {name} FROM (SELECT id, (t // 3600) * 3600 AS t, {how}(value * {factor} + {offset}) AS v FROM ev WHERE item = '{item}' GROUP BY 1, 2) WHERE {bound})"""


def _wide(*names):
    first, *rest = [_agg(n) for n in names]
    return f"SELECT * FROM {first} " + " ".join(f"FULL JOIN {r} USING (id, t)" for r in rest)


def _rounded(names):
    return "id, t, " + ", ".join(f"round({n}, 6) AS {n}" for n in names)


_BASIC = ["hr", "crea", "bili", "sbp"]


@query(f"SELECT {_rounded(_BASIC)} FROM ({_wide(*_BASIC)})", "ev")
def load_concepts_wide(spark, sf):
    return r6(_loader(spark, sf).load(_BASIC), *_BASIC)


@query(f"SELECT {_rounded(['hr'])} FROM ({_wide('hr')}) WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)", "ev")
def load_concepts_for_ids(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("id"))
    return r6(_loader(spark, sf).load(["hr"], wanted), "hr")


@query(f"""SELECT id, t, round(max(v), 6) AS hr FROM (SELECT id, (t // 21600) * 21600 AS t, value * 2.0 + 40 AS v FROM ev WHERE item = 'click') GROUP BY 1, 2 HAVING max(v) BETWEEN 0 AND 300""", "ev")
def load_concepts_other_interval(spark, sf):
    return r6(_loader(spark, sf).load(["hr"], interval=6 * HOUR, aggregate="max"), "hr")


@query(f"SELECT 'crea' AS concept, id, t, round(crea, 6) AS value FROM {_agg('crea')} UNION ALL SELECT 'hr', id, t, round(hr, 6) FROM {_agg('hr')}", "ev")
def load_concepts_as_tables(spark, sf):
    tables = _loader(spark, sf).load_tables(["hr", "crea"])
    a, b = (df.select(F.lit(n).alias("concept"), "id", "t", F.col(n).alias("value")) for n, df in tables.items())
    return r6(a.unionByName(b), "value")


_WEIGHT = """SELECT id, arg_min(v, t) AS w FROM (SELECT id, (t // 3600) * 3600 AS t, median(value + 50) AS v FROM ev
    WHERE item = 'signup' GROUP BY 1, 2) WHERE v BETWEEN 1 AND 500 GROUP BY id"""


@query(f"""SELECT id, t, round(v, 6) AS norepi_rate FROM (SELECT e.id, (e.t // 3600) * 3600 AS t, max(e.value / w.w) AS v FROM ev e LEFT JOIN ({_WEIGHT}) w ON w.id = e.id
    WHERE item = 'error' GROUP BY 1, 2) WHERE v BETWEEN 0 AND 3""", "ev")
def load_rate_per_kg(spark, sf):
    """The rule reads the stay's weight, which nobody asked for as a concept."""
    c = _catalogue().add_item("norepi_rate", "demo", Item("events", ("error",), item="event_type", value="value", time="ts", rule={"rule": "mimic_kg_rate"}))
    return r6(_loader(spark, sf, c).load(["norepi_rate"]), "norepi_rate")


@query(f"""WITH w AS {_agg('wbc')} SELECT id, t, round(median(c), 6) AS neut FROM (SELECT e.id, (e.t // 3600) * 3600 AS t, CASE WHEN w.wbc <> 0 THEN e.value / 500 * 100 / w.wbc END AS c
    FROM ev e LEFT JOIN w ON w.id = e.id AND w.t = (e.t // 3600) * 3600 WHERE item IN ('click', 'error')) WHERE c IS NOT NULL GROUP BY 1, 2 HAVING median(c) BETWEEN 0 AND 100""", "ev")
def load_blood_cell_ratio(spark, sf):
    """The rule reads the white cell count of the row's hour."""
    steps = [{"rule": "binary_op", "op": "/", "value": 500}, {"rule": "blood_cell_ratio"}]
    rule = {"rule": "combine_callbacks", "rules": steps}
    c = _catalogue().add_item("neut", "demo", Item("events", ("click", "error"), item="event_type", value="value", time="ts", rule=rule))
    return r6(_loader(spark, sf, c).load(["neut"]), "neut")


_OXY = f"""w AS ({_wide('po2', 'fio2')}), l AS (SELECT id, t, po2, fio2, last_value(po2 IGNORE NULLS) OVER v AS p, last_value(fio2 IGNORE NULLS) OVER v AS f FROM w
    WINDOW v AS (PARTITION BY id ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_OXY} SELECT id, t, round(p * 100 / coalesce(f, 21), 6) AS pafi FROM l WHERE p IS NOT NULL", "ev")
def load_oxygen_ratio(spark, sf):
    return r6(_loader(spark, sf).load(["pafi"]), "pafi")


_SOFA = f"""{_OXY}, b AS ({_wide('plt', 'bili', 'map', 'crea')}),
    g AS (SELECT id, t, least(coalesce(last_value(tgcs IGNORE NULLS) OVER v, 15), 15) AS gcs FROM {_agg('tgcs')} WINDOW v AS (PARTITION BY id ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)),
    ug AS (SELECT id, unnest(generate_series(lo, hi, 3600)) AS t FROM (SELECT id, min(t) AS lo, max(t) AS hi FROM {_agg('urine', 'sum')} GROUP BY id)),
    u AS (SELECT id, t, CASE WHEN count(*) OVER v >= 12 THEN sum(coalesce(urine, 0)) OVER v * 24 / count(*) OVER v END AS u24 FROM ug LEFT JOIN {_agg('urine', 'sum')} USING (id, t)
        WINDOW v AS (PARTITION BY id ORDER BY t ROWS 23 PRECEDING)),
    c AS (SELECT id, t, CASE WHEN p IS NOT NULL THEN CASE WHEN p * 100 / coalesce(f, 21) < 200 THEN 2 WHEN p * 100 / coalesce(f, 21) < 300 THEN 2 WHEN p * 100 / coalesce(f, 21) < 400 THEN 1 ELSE 0 END END AS resp,
        CASE WHEN plt IS NOT NULL THEN CASE WHEN plt < 20 THEN 4 WHEN plt < 50 THEN 3 WHEN plt < 100 THEN 2 WHEN plt < 150 THEN 1 ELSE 0 END END AS coag,
        CASE WHEN bili IS NOT NULL THEN CASE WHEN bili >= 12 THEN 4 WHEN bili >= 6 THEN 3 WHEN bili >= 2 THEN 2 WHEN bili >= 1.2 THEN 1 ELSE 0 END END AS liver,
        CASE WHEN map < 70 THEN 1 WHEN map IS NOT NULL THEN 0 END AS cardio,
        CASE WHEN gcs < 6 THEN 4 WHEN gcs < 10 THEN 3 WHEN gcs < 13 THEN 2 WHEN gcs < 15 THEN 1 WHEN gcs IS NOT NULL THEN 0 END AS cns,
        CASE WHEN coalesce(crea, u24) IS NOT NULL THEN CASE WHEN coalesce(crea >= 5, false) OR coalesce(u24 < 200, false) THEN 4 WHEN coalesce(crea >= 3.5, false) OR coalesce(u24 < 500, false) THEN 3
            WHEN crea >= 2 THEN 2 WHEN crea >= 1.2 THEN 1 ELSE 0 END END AS renal
        FROM (SELECT id, t, p, f FROM l) FULL JOIN b USING (id, t) FULL JOIN g USING (id, t) FULL JOIN u USING (id, t)),
    k AS (SELECT * FROM c WHERE coalesce(resp, coag, liver, cardio, cns, renal) IS NOT NULL),
    sg AS (SELECT id, unnest(generate_series(lo, hi, 3600)) AS t FROM (SELECT id, min(t) AS lo, max(t) AS hi FROM k GROUP BY id)),
    s AS (SELECT id, t, coalesce(max(resp) OVER v, 0) + coalesce(max(coag) OVER v, 0) + coalesce(max(liver) OVER v, 0) + coalesce(max(cardio) OVER v, 0) + coalesce(max(cns) OVER v, 0) + coalesce(max(renal) OVER v, 0) AS sofa
        FROM sg LEFT JOIN k USING (id, t) WINDOW v AS (PARTITION BY id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_SOFA} SELECT id, t, sofa::INT AS sofa FROM s", "ev")
def load_sofa(spark, sf):
    return _loader(spark, sf).load_sofa()


_SEP = f"""{_SOFA}, abx AS (SELECT DISTINCT id, (t // 3600) * 3600 AS t FROM ev WHERE item = 'click' AND value > 20),
    smp AS (SELECT DISTINCT id, (t // 3600) * 3600 AS t FROM ev WHERE item = 'view'),
    si AS (SELECT id, t FROM abx a WHERE EXISTS (SELECT 1 FROM smp x WHERE x.id = a.id AND x.t >= a.t AND x.t < a.t + 86400)
        UNION SELECT id, t FROM smp x WHERE EXISTS (SELECT 1 FROM abx a WHERE a.id = x.id AND a.t >= x.t AND a.t < x.t + 259200)),
    d AS (SELECT id, t, sofa - min(sofa) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS d FROM s), e AS (SELECT id, min(t) AS t FROM si GROUP BY id)"""


@query(f"WITH {_SEP} SELECT d.id, min(d.t) AS t, 1::INT AS sep3 FROM d JOIN e ON e.id = d.id AND d.t BETWEEN e.t - 172800 AND e.t + 86400 WHERE d >= 2 GROUP BY 1", "ev")
def load_sepsis3(spark, sf):
    return _loader(spark, sf).load_sepsis3()


def _only(*names):
    c = _catalogue()
    return spec.Catalogue({n: x for n, x in c.concepts.items() if n in names or n not in ITEMS})


@query(f"""WITH k AS (SELECT id, (t // 3600) * 3600 AS t, median(value * 0.1) AS v FROM ev WHERE item = 'error' GROUP BY 1, 2), p AS (SELECT id, t, v FROM k WHERE v BETWEEN 0 AND 10)
    SELECT id, t, (coalesce(crea > 1.2, false) AND coalesce(v >= 6, false))::INT AS rrt_criteria FROM {_agg('crea')} FULL JOIN p USING (id, t)""", "ev")
def load_rrt_criteria(spark, sf):
    c = _only("crea").add_item("potassium", "demo", Item("events", ("error",), item="event_type", value="value", time="ts", rule={"rule": "binary_op", "op": "*", "value": 0.1}))
    return _loader(spark, sf, c).load(["rrt_criteria"])


_SOFA2 = f"""c AS (SELECT id, t, CASE WHEN plt <= 50 THEN 4 WHEN plt <= 80 THEN 3 WHEN plt <= 100 THEN 2 WHEN plt <= 150 THEN 1 ELSE 0 END AS coag FROM {_agg('plt')}),
    sg AS (SELECT id, unnest(generate_series(lo, hi, 3600)) AS t FROM (SELECT id, min(t) AS lo, max(t) AS hi FROM c GROUP BY id)),
    s AS (SELECT id, t, coalesce(max(coag) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 0)::INT AS sofa2 FROM sg LEFT JOIN c USING (id, t))"""


@query(f"WITH {_SOFA2} SELECT id, t, sofa2 FROM s", "ev")
def load_sofa2(spark, sf):
    """SOFA-2 of a source that has platelets only."""
    return _loader(spark, sf, _only("plt")).load_sofa2()


_SOFA2_WHOLE = f"""{_OXY}, b AS ({_wide('plt', 'bili', 'map', 'crea')}),
    g AS (SELECT id, t, last_value(tgcs IGNORE NULLS) OVER v AS gcs FROM {_agg('tgcs')} WINDOW v AS (PARTITION BY id ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)),
    u AS (SELECT id, t, CASE WHEN count(*) OVER r6 >= 3 THEN sum(urine) OVER r6 / (w * 6) END AS u6, CASE WHEN count(*) OVER r12 >= 6 THEN sum(urine) OVER r12 / (w * 12) END AS u12,
        CASE WHEN count(*) OVER r24 >= 12 THEN sum(urine) OVER r24 / (w * 24) END AS u24 FROM {_agg('urine', 'sum')} JOIN ({_WEIGHT}) USING (id)
        WINDOW r6 AS (PARTITION BY id ORDER BY t ROWS 5 PRECEDING), r12 AS (PARTITION BY id ORDER BY t ROWS 11 PRECEDING), r24 AS (PARTITION BY id ORDER BY t ROWS 23 PRECEDING)),
    c AS (SELECT id, t, CASE WHEN p IS NOT NULL OR fio2 IS NOT NULL THEN CASE WHEN p * 100 / coalesce(f, 21) <= 225 THEN 2 WHEN p * 100 / coalesce(f, 21) <= 300 THEN 1 ELSE 0 END END AS resp,
        CASE WHEN plt IS NOT NULL THEN CASE WHEN plt <= 50 THEN 4 WHEN plt <= 80 THEN 3 WHEN plt <= 100 THEN 2 WHEN plt <= 150 THEN 1 ELSE 0 END END AS coag,
        CASE WHEN bili IS NOT NULL THEN CASE WHEN bili > 12 THEN 4 WHEN bili > 6 THEN 3 WHEN bili > 3 THEN 2 WHEN bili > 1.2 THEN 1 ELSE 0 END END AS liver,
        CASE WHEN map < 70 THEN 1 WHEN map IS NOT NULL THEN 0 END AS cardio,
        CASE WHEN gcs IS NOT NULL THEN CASE WHEN gcs BETWEEN 3 AND 5 THEN 4 WHEN gcs BETWEEN 6 AND 8 THEN 3 WHEN gcs BETWEEN 9 AND 12 THEN 2 WHEN gcs BETWEEN 13 AND 14 THEN 1 ELSE 0 END END AS cns,
        CASE WHEN coalesce(crea, u6, u12, u24) IS NOT NULL THEN CASE WHEN coalesce(crea > 3.5, false) OR coalesce(u24 < 0.3, false) OR coalesce(u12 = 0, false) THEN 3
            WHEN coalesce(crea > 2.0, false) OR coalesce(u12 < 0.5, false) THEN 2 WHEN coalesce(crea > 1.2, false) OR coalesce(u6 < 0.5, false) THEN 1 ELSE 0 END END AS renal
        FROM (SELECT id, t, p, f, fio2 FROM l) FULL JOIN b USING (id, t) FULL JOIN g USING (id, t) FULL JOIN u USING (id, t)),
    k AS (SELECT * FROM c WHERE coalesce(resp, coag, liver, cardio, cns, renal) IS NOT NULL),
    sg AS (SELECT id, unnest(generate_series(lo, hi, 3600)) AS t FROM (SELECT id, min(t) AS lo, max(t) AS hi FROM k GROUP BY id)),
    s AS (SELECT id, t, (coalesce(max(resp) OVER v, 0) + coalesce(max(coag) OVER v, 0) + coalesce(max(liver) OVER v, 0) + coalesce(max(cardio) OVER v, 0) + coalesce(max(cns) OVER v, 0) + coalesce(max(renal) OVER v, 0))::INT AS sofa2
        FROM sg LEFT JOIN k USING (id, t) WINDOW v AS (PARTITION BY id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))"""


@query(f"""WITH {_SOFA2_WHOLE}, abx AS (SELECT DISTINCT id, (t // 3600) * 3600 AS t FROM ev WHERE item = 'click' AND value > 20),
    smp AS (SELECT DISTINCT id, (t // 3600) * 3600 AS t FROM ev WHERE item = 'view'),
    si AS (SELECT id, t FROM abx a WHERE EXISTS (SELECT 1 FROM smp x WHERE x.id = a.id AND x.t >= a.t AND x.t < a.t + 86400)
        UNION SELECT id, t FROM smp x WHERE EXISTS (SELECT 1 FROM abx a WHERE a.id = x.id AND a.t >= x.t AND a.t < x.t + 259200)),
    e AS (SELECT id, min(t) AS e FROM si GROUP BY id),
    d AS (SELECT id, t, sofa2 - min(sofa2) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS d FROM s JOIN e USING (id) WHERE t BETWEEN e - 172800 AND e + 86400)
    SELECT id, min(t) AS t, 1::INT AS sep3_sofa2 FROM d WHERE d >= 2 GROUP BY id""", "ev")
def load_sepsis3_sofa2(spark, sf):
    """Sepsis by SOFA-2 of all six organ systems."""
    return _loader(spark, sf).load_sepsis3_sofa2()


@query(f"""WITH w AS ({_wide('sbp', 'resp')}), l AS (SELECT id, t, last_value(sbp IGNORE NULLS) OVER v AS s, last_value(resp IGNORE NULLS) OVER v AS r FROM w
    WINDOW v AS (PARTITION BY id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
    SELECT id, t, coalesce((s <= 100)::INT, 0) + coalesce((r >= 22)::INT, 0) AS qsofa FROM l""", "ev")
def load_warning_score(spark, sf):
    c = _catalogue()
    without = {n: x for n, x in c.concepts.items() if n != "tgcs"}
    return _loader(spark, sf, spec.Catalogue(without)).load(["qsofa"])


@query(f"SELECT {_rounded(['hr', 'sbp', 'resp'])} FROM ({_wide('hr', 'sbp', 'resp')})", "ev")
def load_vital_signs(spark, sf):
    return r6(_loader(spark, sf).load_vitals(), "hr", "sbp", "resp")


@query(f"SELECT {_rounded(['wbc', 'hgb', 'plt', 'crea', 'bili'])} FROM ({_wide('wbc', 'hgb', 'plt', 'crea', 'bili')})", "ev")
def load_laboratory(spark, sf):
    return r6(_loader(spark, sf).load_labs(), "wbc", "hgb", "plt", "crea", "bili")


@query(f"SELECT {_rounded(['hr', 'map', 'sbp'])} FROM ({_wide('hr', 'map', 'sbp')})", "ev")
def load_module_vital(spark, sf):
    return r6(_loader(spark, sf).load_module("vital"), "hr", "map", "sbp")


@query(f"""SELECT id, t, round(hr, 6) AS hr, w AS weight, 30.0::DOUBLE AS los_icu FROM {_agg('hr')} LEFT JOIN (SELECT id, arg_min(v, t) AS w FROM (SELECT id, (t // 3600) * 3600 AS t, round(median(value + 50), 6) AS v FROM ev
    WHERE item = 'signup' GROUP BY 1, 2) WHERE v BETWEEN 1 AND 500 GROUP BY id) USING (id)""", "ev")
def load_with_static(spark, sf):
    return r6(_loader(spark, sf).load(["hr", "weight", "los_icu"]), "hr", "weight")


@query(f"""SELECT id, t, round(hr, 6) AS hr FROM {_agg('hr')} WHERE id IN (SELECT patient_id FROM demo WHERE age >= 30 AND gender = 'F' AND survived)""", "ev demo")
def load_filtered_cohort(spark, sf):
    criteria = cohort.Criteria(age_min=30, gender="F", survived=True)
    return r6(_loader(spark, sf).load_filtered(["hr"], demo(spark, sf), criteria), "hr")


@query(f"SELECT id, t, round(hr, 6) AS heart FROM {_agg('hr')}", "ev")
def load_forwarded_concept(spark, sf):
    c = _catalogue().add(Concept("heart", forward="hr"))
    return r6(_loader(spark, sf, c).load(["heart"]), "hr").withColumnRenamed("hr", "heart")


@query(f"SELECT id, t, round(hr * 2, 6) AS twice FROM {_agg('hr')}", "ev")
def load_registered_concept(spark, sf):
    from staygrid.plans import derived

    derived.register("double_rate", lambda wide, ctx, name, parts: wide.withColumn(name, F.col(parts[0]) * 2))
    c = _catalogue().add(Concept("twice", derived="double_rate", parts=("hr",)))
    return r6(_loader(spark, sf, c).load(["twice"]), "twice")


@query(f"""SELECT id, t, round(hr, 6) AS hr, 'one' AS source FROM {_agg('hr')} UNION ALL SELECT id, t, round(hr, 6), 'two' FROM {_agg('hr')} WHERE id % 2 = 0""", "ev")
def load_two_sources(spark, sf):
    a = _loader(spark, sf).load(["hr"])
    return r6(merge_sources({"one": a, "two": a.where("id % 2 = 0")}), "hr")


@query("SELECT DISTINCT user_id AS id FROM events ORDER BY id LIMIT 12")
def sampled_ids(spark, sf):
    return _loader(spark, sf).sample("events", 12)


@query(f"""WITH {_SEP}, qh AS {_agg('hr')}, qw AS {_agg('wbc')} SELECT (SELECT count(DISTINCT id) FROM qh)::DOUBLE AS patients, (SELECT count(*) FROM qh)::DOUBLE AS vitals_records,
    (SELECT count(*) FROM qw)::DOUBLE AS lab_records, (SELECT round(avg(sofa), 6) FROM s) AS sofa_mean,
    (SELECT count(DISTINCT d.id) FROM d JOIN e ON e.id = d.id AND d.t BETWEEN e.t - 172800 AND e.t + 86400 WHERE d >= 2)::DOUBLE AS sepsis_positive""", "ev")
def quick_summary(spark, sf):
    return r6(_loader(spark, sf).quick_summary(), "sofa_mean")


def _modules():
    return {n: modules.find_module(n) for n in ITEMS}


_PAIRS = "(VALUES " + ", ".join(f"('{n}', '{item}', " + (f"'{_modules()[n]}'" if _modules()[n] else "NULL") + ")" for n, (item, _, _) in ITEMS.items()) + ") AS p(concept, item, module)"


@query(f"SELECT concept, module, true AS available, count(*) AS rows, max(t) AS last FROM ev JOIN {_PAIRS} USING (item) GROUP BY 1, 2", "ev")
def catalogue_joined_to_events(spark, sf):
    """Catalogue, availability and modules as tables: how many events each concept of the demo source has."""
    c = _catalogue()
    frame = c.subset("demo").frame(spark).where(F.array_contains("sources", "demo")).select(F.col("name").alias("concept"))
    known = c.availability(spark, list(ITEMS), ["demo"]).select("concept", "available")
    items = spark.createDataFrame([(n, item, modules.find_module(n)) for n, (item, _, _) in ITEMS.items()], "concept string, item string, module string")
    items = items.join(frame, "concept").join(known, "concept")
    return ev(spark, sf).join(F.broadcast(items), "item").groupBy("concept", "module", "available").agg(
        F.count(F.lit(1)).alias("rows"), F.max("t").alias("last"))


_FORMS = f"""WITH a AS (SELECT id, t, v AS hr FROM (SELECT id, (t // 3600) * 3600 AS t, median(value * 2) AS v FROM ev WHERE item = 'click' GROUP BY 1, 2) WHERE v BETWEEN 0 AND 300),
    b AS (SELECT id, t, v AS glu FROM (SELECT id, (t // 3600) * 3600 AS t, median(value * 18.016) AS v FROM ev WHERE item = 'view' GROUP BY 1, 2) WHERE v BETWEEN 0 AND 1000),
    c AS (SELECT id, t, v AS resp FROM (SELECT id, (t // 3600) * 3600 AS t, median(floor(value) * 0.5 + 4) AS v FROM ev WHERE item = 'error' GROUP BY 1, 2) WHERE v BETWEEN 0 AND 120),
    d AS (SELECT id, t, v AS dobu_rate FROM (SELECT e.id, (e.t // 3600) * 3600 AS t, max(e.value / w.w) AS v FROM ev e LEFT JOIN ({_WEIGHT}) w ON w.id = e.id WHERE item = 'purchase' GROUP BY 1, 2) WHERE v >= 0),
    f AS (SELECT id, (t // 3600) * 3600 AS t, CASE WHEN arg_min(value, t) >= 40 THEN 'alert' ELSE 'voice' END AS avpu_text FROM ev WHERE item = 'signup' GROUP BY 1, 2)
    SELECT id, t, round(hr, 6) AS hr, round(glu, 6) AS glu, round(resp, 6) AS resp, round(dobu_rate, 6) AS dobu_rate, avpu_text, 30.0::DOUBLE AS los_icu
    FROM a FULL JOIN b USING (id, t) FULL JOIN c USING (id, t) FULL JOIN d USING (id, t) FULL JOIN f USING (id, t)"""


@query(_FORMS, "ev")
def load_dictionary_forms(spark, sf):
    """A dictionary file with a rule spec of each form: arithmetic, unit, sequence, map, rate by weight, length of stay."""
    c = builtin().update(spec.load_dictionary(str(Path(__file__).parent / "demo_dictionary.json")))
    return r6(_loader(spark, sf, c).load(["hr", "glu", "resp", "dobu_rate", "avpu_text", "los_icu"]), "hr", "glu", "resp", "dobu_rate")


# --- units, levels and intervals of the loader ------------------------------------

# The unit column of the demo source: the concept's own unit in two spellings, another unit, none in two spellings, a foreign one.
_GIVEN = "CASE seq % 6 WHEN 0 THEN '°C' WHEN 1 THEN 'Deg F' WHEN 2 THEN NULL WHEN 3 THEN 'n/a' WHEN 4 THEN 'C' ELSE 'widgets' END"
_DEGREES = f"""(SELECT id, t, seq, {_GIVEN} AS u, CASE WHEN seq % 6 = 1 THEN (32 + value / 100) * 1.8 + 32 ELSE 32 + value / 100 END AS given,
    32 + value / 100 AS v FROM ev WHERE item = 'click')"""


def _measured(spark, sf, **kwargs):
    """The demo source with a table of temperatures in several units and one of words."""
    def read(name):
        if name == "stays":
            return _loader(spark, sf).layout.read(name)
        e = table(spark, sf, "events").withColumn("seq", F.col("event_id"))
        warm = F.col("value") / 100 + 32
        given = F.when(F.col("seq") % 6 == 1, warm * 1.8 + 32).otherwise(warm)
        word = F.concat(F.lit("level "), F.floor(F.col("value") / 100).cast("string"))
        return e.select("user_id", "ts", "event_type", given.alias("valuenum"), F.expr(_GIVEN).alias("valueuom"), word.alias("word"))

    item = Item("charted", ("click",), item="event_type", value="valuenum", time="ts", unit="valueuom")
    c = _catalogue().add(Concept("temp", units=("C", "°C", "celsius"))).add_item("temp", "demo", item)
    c = c.add(Concept("mood", kind="fct", levels=("level 0", "level 2", "level 3")))
    c = c.add_item("mood", "demo", Item("charted", ("view",), item="event_type", value="word", time="ts"))
    layout = SourceLayout("demo", "user_id", read, time="ts", item="event_type", stays="stays")
    return Loader(spark, c, layout, **kwargs)


def _warm(value, where="true"):
    return f"SELECT id, t, round(v, 6) AS temp FROM (SELECT id, (t // 3600) * 3600 AS t, median({value}) AS v FROM {_DEGREES} WHERE {where} GROUP BY 1, 2) WHERE v BETWEEN 32 AND 42"


@query(_warm("CASE WHEN seq % 6 = 1 THEN (given - 32) / 1.8 ELSE given END"), "ev")
def load_mixed_units(spark, sf):
    """Rows in Fahrenheit become Celsius, rows without a unit or in a foreign one stay as they are."""
    return r6(_measured(spark, sf).load(["temp"]), "temp")


@query(_warm("CASE WHEN seq % 6 = 1 THEN (given - 32) / 1.8 ELSE given END", "seq % 6 <> 5"), "ev")
def load_strict_units(spark, sf):
    return r6(_measured(spark, sf, units="strict").load(["temp"]), "temp")


@query(_warm("given"), "ev")
def load_ignoring_units(spark, sf):
    return r6(_measured(spark, sf, units="ignore").load(["temp"]), "temp")


@query(f"""SELECT 'temp' AS concept, u AS unit, CASE WHEN u IN ('°C', 'C') THEN 'own' WHEN u = 'Deg F' THEN 'converted' WHEN u = 'widgets' THEN 'foreign' ELSE 'bare' END AS found,
    count(*) AS n FROM {_DEGREES} GROUP BY 2, 3""", "ev")
def unit_report(spark, sf):
    return _measured(spark, sf).unit_report(["temp"])


@query("""SELECT id, t, 'level ' || CAST(k AS VARCHAR) AS mood FROM (SELECT id, (t // 3600) * 3600 AS t, arg_min(CAST(floor(value / 100) AS BIGINT), t) AS k FROM ev
    WHERE item = 'view' AND floor(value / 100) IN (0, 2, 3) GROUP BY 1, 2)""", "ev")
def load_with_levels(spark, sf):
    return _measured(spark, sf).load(["mood"])


@query("""SELECT 'mood' AS concept, 'level ' || CAST(k AS VARCHAR) AS value, k IN (0, 2, 3) AS known, count(*) AS n FROM (
    SELECT CAST(floor(value / 100) AS BIGINT) AS k FROM ev WHERE item = 'view') GROUP BY k""", "ev")
def level_report(spark, sf):
    return _measured(spark, sf).level_report(["mood"])


@query(f"""WITH c AS (SELECT id, t, v AS crea FROM (SELECT id, (t // 21600) * 21600 AS t, median(value * 0.05 + 0.3) AS v FROM ev WHERE item = 'signup' GROUP BY 1, 2) WHERE v BETWEEN 0 AND 15),
    p AS (SELECT id, t, v AS plt FROM (SELECT id, (t // 3600) * 3600 AS t, median(value * 4.0 + 5) AS v FROM ev WHERE item = 'purchase' GROUP BY 1, 2) WHERE v >= 5 AND v <= 1200)
    SELECT id, t, round(hr, 6) AS hr, round(crea, 6) AS crea, round(plt, 6) AS plt FROM {_agg('hr')} FULL JOIN c USING (id, t) FULL JOIN p USING (id, t)""", "ev")
def load_own_intervals(spark, sf):
    """One concept with six-hour bins of its own and one with minutes, which the hourly grid absorbs."""
    c = _catalogue().add(Concept("crea", interval="06:00:00"), Concept("plt", interval="00:01:00", low=5, high=1200))
    return r6(_loader(spark, sf, c).load(["hr", "crea", "plt"]), "hr", "crea", "plt")
