"""Catalogue and loader."""

import json

import pytest
from pyspark.sql import functions as F

from staygrid.operators.rules import Roles, apply_rule, register_rule, rewrites
from staygrid.plans import modules, spec
from staygrid.plans.catalogue import builtin
from staygrid.plans.loader import Loader, SourceLayout
from staygrid.plans.spec import Catalogue, Concept, Item
from tests.conftest import rows


def test_builtin_catalogue(spark):
    c = builtin()
    assert len(c.concepts) == 146 and c["crea"].high == 15 and c["urine"].how == "sum" and c["abx"].how == "max"
    order = c.order(["sep3"])
    assert order.index("pafi") < order.index("sofa_resp") < order.index("sofa") < order.index("sep3")
    assert c.frame(spark).where("category = 'vitals'").count() == 6
    assert modules.find_module("hr") == "vital" and "gcs" in modules.module_concepts("neu")


def test_dictionary_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "hr": {"unit": ["bpm", "/min"], "min": 0, "max": 300, "sources": {"x": [{"ids": 7, "table": "chart", "sub_var": "itemid", "callback": "floor"}]}},
        "urine": {"sources": {"x": [{"ids": [1, 2], "table": "out", "callback": "convert_unit(a, b)"}]}},
        "bmi": {"concepts": ["weight", "height"], "callback": "bmi", "class": "rec_cncpt"}}))
    (tmp_path / "b.json").write_text(json.dumps({"hr": {"max": 250, "sources": {"y": [{"table": "vital", "val_var": "heartrate", "class_name": "col_itm"}]}}}))
    c = spec.load_dictionary(str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert c["hr"].high == 250 and c["hr"].unit == "bpm" and set(c["hr"].sources) == {"x", "y"}
    assert c["hr"].sources["x"][0].rule == {"rule": "floor"} and c["hr"].sources["x"][0].items == (7,)
    assert c["urine"].sources["x"][0].untranslated and c["bmi"].parts == ("weight", "height")
    assert c.available("hr", "y") and not c.available("urine", "y")


def test_overlay_sets_fields_back(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"bmi": {"class": "num", "max": None}, "los_icu": {"sources": {"x": [{"callback": "los_callback"}]}}}))
    known = builtin().update(spec.load_dictionary(str(tmp_path / "a.json")))
    assert builtin()["bmi"].kind == "rec" and known["bmi"].kind == "num" and known["bmi"].derived == "bmi"
    assert known["los_icu"].sources["x"][0].rule == {"rule": "los_callback"} and known["los_icu"].sources["x"][0].untranslated is None


def test_catalogue_tables(spark):
    c = builtin().add_item("po2", "a", Item("lab")).add_item("hr", "b", Item("vital")).add(Concept("twin", forward="hr"))
    got = {(r.concept, r.source): r.available for r in c.availability(spark, ["pafi", "hr", "twin"]).collect()}
    assert got == {("pafi", "a"): True, ("pafi", "b"): False, ("hr", "a"): False, ("hr", "b"): True, ("twin", "a"): False, ("twin", "b"): True}
    assert rows(spec.table_availability(spark, ["lab", "icu"], {"lab"}.__contains__)) == [("icu", False), ("lab", True)]
    assert spec.explain(spark, c).count() == 147 and set(c.subset("b").concepts) >= {"hr", "mews", "twin"}


def test_infusion_rows_become_windows(spark):
    df = spark.createDataFrame([(1, 0, "12.5"), (1, 3600, "off")], "id long, t long, value string")
    out = apply_rule(df, Roles(("id",), "t"), "eicu_dex_inf")
    assert rows(out.select("t", "value", "dur", "unit")) == [(0, 12.5, 3600, "ml/hr"), (3600, None, 3600, "ml/hr")]


def test_cycles_are_refused():
    c = Catalogue({"a": Concept("a", derived="f", parts=("b",)), "b": Concept("b", derived="f", parts=("a",))})
    with pytest.raises(ValueError):
        c.order(["a"])


@pytest.fixture()
def loader(spark):
    chart = spark.createDataFrame(
        [(1, 7, 100, 80.0), (1, 7, 200, 90.0), (1, 7, 300, 400.0), (1, 8, 4_000, 2.0), (2, 7, 50, 700.0), (2, 9, 60, 5.0)],
        "stay long, itemid int, sec long, valuenum double")
    tables = {"chart": chart}
    layout = SourceLayout("x", "stay", tables.__getitem__, time="sec", value="valuenum", time_unit=1)
    c = Catalogue({}).add(Concept("hr", low=0, high=300), Concept("crea"), Concept("flag", kind="lgl"), Concept("sex", kind="fct"))
    c = c.add_item("hr", "x", Item("chart", (7,))).add_item("crea", "x", Item("chart", (8,), rule={"rule": "binary_op", "op": "*", "value": 10}))
    c = c.add_item("flag", "x", Item("chart", (7, 9), rule={"rule": "comp_na", "op": ">", "value": 85}))
    return Loader(spark, c, layout)


def test_aggregation_comes_before_bounds(loader):
    out = loader.load(["hr", "crea", "flag"])
    assert rows(out, "id", "t") == [(1, 0, 90.0, None, 2.0), (1, 3600, None, 20.0, None), (2, 0, None, None, 1.0)]


def test_items_of_one_table_share_one_scan(loader):
    wide = loader.load(["hr", "crea", "flag"])
    wide.collect()  # the way of crowded ids leaves the plan at run time
    plan = wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("valuenum" in line and ("ExistingRDD" in line or "LocalTableScan" in line) for line in plan.splitlines()) == 1


def test_rules_that_change_rows_get_a_branch(spark, loader):
    register_rule("only_high", lambda df, r: df.where(F.col(r.value) > 85))
    assert rewrites({"rule": "only_high"}) is None and rewrites({"rule": "combine_callbacks", "rules": [{"rule": "floor"}, {"rule": "aumc_rate"}]}) == {"value", "unit"}
    loader.catalogue = loader.catalogue.add_item("high", "x", Item("chart", (7,), rule={"rule": "only_high"}))
    assert rows(loader.load(["high"]), "id", "t") == [(1, 0, 245.0), (2, 0, 700.0)]


def test_unknown_rule_text_is_refused(loader):
    loader.catalogue = loader.catalogue.add_item("odd", "x", Item("chart", (7,), untranslated="f(x)"))
    with pytest.raises(ValueError, match="named rule"):
        loader.load(["odd"])


def test_windows_become_hourly_flags(spark):
    vents = spark.createDataFrame([(1, 1_000, 8_000, 1.0), (2, 0, 0, 1.0)], "stay long, sec long, len long, on double")
    layout = SourceLayout("x", "stay", {"vent": vents}.__getitem__, time="sec", value="on", time_unit=1)
    register_rule("as_window", lambda df, r: df)
    c = Catalogue({}).add(Concept("mech_vent", aggregate="max"), Concept("vent_ind", derived="vent_ind", parts=("vent_start", "vent_end", "mech_vent")))
    c = c.add_item("mech_vent", "x", Item("vent", dur="len", target="win_tbl", rule={"rule": "as_window"}))
    assert rows(Loader(spark, c, layout).load(["vent_ind"]), "id", "t") == [(1, 0, 1), (1, 3600, 1), (1, 7200, 1)]


def test_degrees_convert_by_the_formula(spark):
    """The way back subtracts and divides: a reciprocal lets 89.6 F pass a bound of 32 C that (89.6 - 32) / 1.8 misses."""
    given = [32 + k / 100 for k in range(0, 1000, 7)]
    given = [89.6] + [c * 1.8 + 32 for c in given]
    chart = spark.createDataFrame([(1, 7, i * 3600, f, "Deg F") for i, f in enumerate(given)], "stay long, itemid int, sec long, valuenum double, uom string")
    layout = SourceLayout("x", "stay", {"chart": chart}.__getitem__, time="sec", value="valuenum", unit="uom", time_unit=1)
    c = Catalogue({}).add(Concept("temp", units=("C", "°C"), low=32, high=42)).add_item("temp", "x", Item("chart", (7,)))
    want = [(i * 3600, (f - 32) / 1.8) for i, f in enumerate(given) if 32 <= (f - 32) / 1.8 <= 42]
    for units in ("convert", "strict"):
        assert rows(Loader(spark, c, layout, units=units).load(["temp"]).select("t", "temp"), "t") == want
    assert want[0][0] > 0


def test_rows_are_not_sorted_for_their_stay(spark):
    """The stays are hashed, and concepts become columns in one aggregation."""
    chart = spark.createDataFrame([(1, 7, 7_300, 80.0), (1, 8, 7_400, 2.0), (2, 7, 3_700, 70.0)], "stay long, itemid int, sec long, valuenum double")
    chart = chart.select("stay", "itemid", "valuenum", F.expr("timestampadd(SECOND, sec, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("at"))
    stays = spark.range(1, 3).select(F.col("id").alias("stay"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("intime"), F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'").alias("outtime"))
    layout = SourceLayout("x", "stay", {"chart": chart, "stays": stays}.__getitem__, time="at", value="valuenum", stays="stays")
    c = Catalogue({}).add(Concept("hr"), Concept("crea")).add_item("hr", "x", Item("chart", (7,))).add_item("crea", "x", Item("chart", (8,)))
    wide = Loader(spark, c, layout).load(["hr", "crea"])
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan and "pivotfirst" not in plan.lower()
    assert rows(wide, "id", "t") == [(1, 7200, 80.0, 2.0), (2, 3600, 70.0, None)]


def test_first_text_of_a_second_is_the_earliest(spark):
    words = [(1, "x", f"2024-01-01 00:10:00.{ms}", w) for ms, w in ((100, "voice"), (400, "pain"), (900, "alert"))]
    stays = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00")], "stay long, intime string, outtime string")
    stays = stays.select("stay", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("intime", "outtime")])
    c = Catalogue({}).add(Concept("avpu", kind="fct")).add_item("avpu", "x", Item("chart", ("x",)))
    for given in (words, words[::-1], words[1:] + words[:1]):
        chart = spark.createDataFrame(given, "stay long, itemid string, charttime string, value string").coalesce(1)
        tables = {"chart": chart.withColumn("charttime", F.col("charttime").cast("timestamp_ntz")), "stays": stays}
        timed = Loader(spark, c, SourceLayout("x", "stay", tables.__getitem__, stays="stays"))
        assert rows(timed.load(["avpu"])) == [(1, 0, "voice")]
        numbered = {"chart": spark.createDataFrame([(1, "x", float(t[-3:]) / 1000, w) for *_, t, w in given], "stay long, itemid string, charttime double, value string").coalesce(1)}
        assert rows(Loader(spark, c, SourceLayout("x", "stay", numbered.__getitem__, time_unit=1)).load(["avpu"])) == [(1, 0, "voice")]


def test_scores_and_infections_are_stacked(spark, monkeypatch):
    from staygrid.plans import loader as plan

    hours = [(1, 1, h * 3600, v) for h, v in ((0, 200.0), (30, 200.0), (40, 40.0))] + [(2, 1, 0, 200.0), (2, 1, 7200, 90.0)]
    marks = [(1, 2, 36 * 3600, 1.0), (1, 3, 37 * 3600, 1.0), (2, 2, 3600, 1.0)]
    tables = {"chart": spark.createDataFrame(hours + marks, "stay long, itemid int, sec long, value double")}
    c = builtin().add_item("plt", "x", Item("chart", (1,))).add_item("abx", "x", Item("chart", (2,))).add_item("samp", "x", Item("chart", (3,)))
    made = Loader(spark, c, SourceLayout("x", "stay", tables.__getitem__, time="sec", time_unit=1))
    both = made.load(["sep3_sofa2", "susp_inf"])  # rows that meet
    assert rows(both.where("sep3_sofa2 = 1").select("id", "t", "sep3_sofa2")) == [(1, 40 * 3600, 1)]
    monkeypatch.setattr(plan, "merge_wide", None)  # no row of a score is shuffled to meet the others
    assert rows(made.load_sepsis3_sofa2()) == rows(made.load_sepsis3()) == [(1, 40 * 3600, 1)]


def test_sepsis_counts_every_organ(spark, tmp_path):
    """A rise that only one organ system or two together show; the fifth needs the rate of six hours of urine, the sixth has none."""
    import duckdb

    from checks import ORACLES, QUERIES

    infected = [(10, "click", 200.0), (11, "view", 60.0)]
    rises = {
        1: [(20, "click", 0.0), (20, "error", 158.0)],  # oxygen
        2: [(12, "purchase", 240.0), (20, "purchase", 15.0)],  # platelets
        3: [(20, "signup", 15.0), (20, "view", 10.0)],  # liver and pressure
        4: [(12, "purchase", 240.0), (20, "purchase", 40.0)],  # coma scale
        5: [(10, "signup", 10.0), *[(h, "view", 0.0) for h in range(20, 27)]],  # urine and pressure
        6: [(12, "purchase", 240.0), (20, "purchase", 240.0), (20, "signup", 10.0)],
    }
    given = [(i, id, h * 3600, e, v) for id, more in rises.items() for i, (h, e, v) in enumerate(infected + more)]
    events = spark.createDataFrame(given, "event_id long, user_id long, sec long, event_type string, value double")
    events.withColumn("ts", F.expr("timestampadd(SECOND, sec, TIMESTAMP_NTZ'2024-01-01 00:00:00')")).drop("sec").write.parquet(str(tmp_path / "events.parquet"))
    want = [(id, h * 3600, 1) for id, h in ((1, 20), (2, 20), (3, 20), (4, 20), (5, 25))]
    assert rows(QUERIES["load_sepsis3_sofa2"](spark, str(tmp_path))) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted(con.execute(ORACLES["load_sepsis3_sofa2"]).fetchall()) == want
