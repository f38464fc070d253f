"""Choices that must not depend on the data at hand."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from conftest import rows
from staygrid.operators import circulation, cohort, ids, rates, select, sepsis
from staygrid.operators.rules import RULES
from staygrid.session import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_infection_without_diagnosis_refused(spark):
    abx = spark.createDataFrame([(1, 0, 1)], "id long, t long, abx int")
    with pytest.raises(ValueError, match="diagnosis"):
        sepsis.susp_inf(abx, None, ["id"], "t", "auto")
    with pytest.raises(ValueError, match="samples"):
        sepsis.susp_inf(abx, None, ["id"], "t", "and")
    known = spark.createDataFrame([(2,)], "id long")
    assert sepsis.susp_inf(abx, None, ["id"], "t", "auto", diagnosed=known).count() == 0


def test_direction_comes_from_the_caller(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "stay long, v double")
    links = spark.createDataFrame([(1, 10), (2, 10)], "stay long, patient long")
    assert rows(ids.change_id(df, links, "stay", "patient", "up").select("patient", "v")) == [(10, 2.0), (10, 4.0)]
    assert rows(ids.change_id(df, links, "stay", "patient", "down").select("patient", "v")) == [(10, 3.0)]
    with pytest.raises(ValueError):
        ids.change_id(df, links, "stay", "patient", "sideways")


def test_every_unit_stays(spark):
    df = spark.createDataFrame([(1, 0, 60.0, "mg"), (1, 0, 0.06, "g"), (1, 0, 6.0, "IE"), (1, 0, 6.0, None)], "id long, t long, v double, u string")
    out = rates.infusion_rate(df, ["id"], "t", "v", "u", [], "mg").select("u", F.round("v", 6))
    assert sorted(map(tuple, out.collect()), key=str) == [("IE/min", 0.1), ("mg/min", 2.0), (None, 0.1)]


@pytest.mark.parametrize("n", [8, 9])  # nine rows fill a window of 45 minutes
def test_short_series_rule_is_a_parameter(spark, n):
    made = [(1, 300 * k, 3.0 if k % 2 else 1.0, 50.0) for k in range(n)]
    df = spark.createDataFrame(made, "id long, t long, lact double, map double")
    level = lambda short: [r[0] for r in circulation.circ_failure(df, ["id"], "t", short=short).orderBy("t").select("circ_event").collect()]
    single = [1 if k % 2 else 0 for k in range(n)]
    assert (level("point") == single) == (n < 9) and level("window") == [0] * n


def test_shares_add_up(spark):
    df = spark.createDataFrame([("abc1",), ("abc2",), ("xyz",), ("qqq",), (None,)], "code string")
    assert list(map(tuple, cohort.diagnosis_shares(df, "code").collect())) == [("abc", 2), ("qqq", 1), ("xyz", 1)]
    assert list(map(tuple, cohort.diagnosis_shares(df, "code", top=1).collect())) == [("abc", 2), ("other", 2)]
    assert list(map(tuple, cohort.diagnosis_shares(df, "code", top=5).collect())) == [("abc", 2), ("qqq", 1), ("xyz", 1)]


def test_ranks_over_blocks(spark):
    df = spark.createDataFrame([(float(k % 7), k) for k in range(50)] + [(None, 99)], "a double, b long")
    got = rows(select.ranked(df, ["a", "b"], [True, False], F.floor(F.col("a") / 2)), "rank")
    want = sorted([(None, 99)] + [(float(k % 7), k) for k in range(50)], key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [r[:2] for r in got] == want and [r[2] for r in got] == list(range(1, 52))


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_every_rule_is_run_by_a_query():
    text = "".join(open(os.path.join(ROOT, "checks", f), encoding="utf-8").read() for f in os.listdir(os.path.join(ROOT, "checks")) if f.endswith(".py"))
    own = [name for name, f in RULES.items() if f.__module__ == "staygrid.operators.rules"]
    assert len(own) > 50 and [name for name in own if f'"{name}"' not in text] == []
    assert len(QUERIES) > 310


def test_every_survey_row_has_a_query():
    lines = [x.split("|") for x in open(os.path.join(ROOT, "COVERAGE.md"), encoding="utf-8") if x.startswith("| ") and x[2:4].isupper() and "-" in x[:8]]
    checked = {row[1].strip(): [q.strip() for q in row[3].split(",")] for row in lines}
    assert len(checked) > 300
    unknown = {k: q for k, names in checked.items() for q in names if not q.startswith("t:") and q not in QUERIES}
    assert unknown == {} and [k for k, names in checked.items() if not set(names) & set(QUERIES)] == []


def test_entry_works_without_the_training_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("staygrid.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"] and len(e.queries()) > 300 and set(e.oracle_sql()) == set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
