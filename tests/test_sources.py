"""Ingestion, layouts, sinks and demographics on small files."""

from pyspark.sql import functions as F

from staygrid.sources import buckets, convert, demographics, export, tables
from staygrid.streaming import ingest
from tests.conftest import rows, series


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,v\n1,2.5\nx,3\n3,\n")
    out = convert.import_table(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "id long, v double", str(tmp_path / "bad"))
    assert rows(out) == [(1, 2.5), (3, None)]
    assert [r[0] for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["x,3"]


def test_partition_numbers(spark):
    df = spark.createDataFrame([(4,), (5,), (9,), (10,), (11,)], "x int")
    assert [r[0] for r in df.select(convert.partition_number("x", [5, 10])).collect()] == [1, 2, 2, 3, 3]
    assert all(b == sorted(b) for _, b in convert.BREAKS.values())


def test_only_wanted_buckets_are_read(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 50).alias("itemid"), "id")
    layout = buckets.preset("aumc", "numericitems", 20)
    buckets.write_buckets(df, str(tmp_path / "b"), layout)
    out = buckets.read_buckets(spark, str(tmp_path / "b"), layout, [3, 7])
    assert out.count() == 40 and {r.itemid for r in out.collect()} == {3, 7}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "xxhash64" not in plan.split("PartitionFilters: [")[1].split("]")[0]  # folded to literals


def test_widening(spark):
    a = spark.sql("SELECT 1 AS x, NULL AS y")
    b = spark.sql("SELECT 2.5D AS x, 'q' AS y, true AS z")
    assert convert.widened_schema([a, b]) == {"x": "double", "y": "string", "z": "boolean"}
    assert convert.union_widened([a, b]).count() == 2


def test_patient_files(spark, tmp_path):
    s = series(spark, [1.0, None, 3.0], [100, 3_700, 7_300])
    export.write_psv(s, str(tmp_path / "psv"), "id", "t")
    assert rows(export.read_psv(spark, str(tmp_path / "psv"), "t double, v double").select("id", "t", "v")) == [(1, 0.0, 1.0), (1, 1.0, None), (1, 2.0, 3.0)]
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "p17.psv").write_text("t|v\n0|1.5\n1|NaN\n")
    assert rows(export.read_psv(spark, str(flat), "t double, v double", flat=True).select("id", "t", "v")) == [(17, 0.0, 1.5), (17, 1.0, None)]


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, layout = tmp_path / "in", buckets.Layout("itemid", 4)
    source.mkdir()
    (source / "a.csv").write_text("itemid,v\n1,2\nbad line,here,too\n2,3\n")

    def run():
        stream = ingest.csv_stream(spark, str(source), "itemid long, v double")
        for running in ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), layout):
            running.awaitTermination()
        assert [r[0] for r in spark.read.text(str(tmp_path / "out-rejects")).collect()] == ["bad line,here,too"]
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 2
    assert run() == 2
    (source / "b.csv").write_text("itemid,v\n9,1\n")
    assert run() == 3


def test_other_demographics(spark):
    general = spark.sql("SELECT 1 AS patientid, 55 AS age, 'F' AS sex, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS admissiontime")
    aumc = spark.sql("""SELECT * FROM VALUES (1, 7, 0L, 3600000L, '80+', 'Vrouw', 'Home'), (2, 7, 7200000L, 14400000L, '18-39', 'Man', 'Died here')
        AS t(admissionid, patientid, admittedat, dischargedat, agegroup, gender, destination)""")
    sic = spark.sql("SELECT 5 AS CaseID, 71 AS Age, 0 AS Sex, 120 AS TimeOfStay, CAST(NULL AS INT) AS OffsetOfDeath")
    assert demographics.demographics("hirid", {"general_table": general}.__getitem__).first().gender == "F"
    got = demographics.demographics("aumc", {"admissions": aumc}.__getitem__).orderBy("patient_id").collect()
    assert [(r.age, r.gender, r.los_hours, r.survived, r.first_icu_stay) for r in got] == [(85.0, "F", 1.0, True, True), (28.5, "M", 2.0, False, False)]
    r = demographics.demographics("sic", {"cases": sic}.__getitem__).first()
    assert (r.gender, r.los_hours, r.survived) == ("F", 2.0, True)


def test_filters_reach_the_scan(spark, tmp_path):
    series(spark, [1.0, 2.0]).write.parquet(str(tmp_path / "p"))
    df = tables.read_parquet(spark, str(tmp_path / "p"), ["v"], [tables.Filter("t", "between", (0, 10))])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,0)" in plan and "ReadSchema: struct<t:bigint,v:double>" in plan


def test_psv_folders_are_listed_by_few_tasks(spark, tmp_path):
    s = spark.range(60).selectExpr("id", "0L AS t", "double(id) AS v")
    export.write_psv(s, str(tmp_path / "psv"), "id", "t")
    before = spark.conf.get(export.LISTINGS, None)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        back = export.read_psv(spark, str(tmp_path / "psv"), "t double, v double")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    tasks = [tracker.getStageInfo(i).numTasks for j in jobs for i in j.stageIds]
    assert tasks and max(tasks) <= export.TASKS * spark.sparkContext.defaultParallelism < 60
    assert spark.conf.get(export.LISTINGS, None) == before and back.count() == 60 and back.selectExpr("sum(v)").first()[0] == 1770
