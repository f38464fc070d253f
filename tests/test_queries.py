"""The registered queries: complete, free of cross joins, and equal to their SQL."""

import os
import re

import pytest

import __spark_entry__ as entry_point
from checks import ORACLES, QUERIES
from checks.compare import check, connect

SF = "/root/testdata/sf0.001"
EVERY = os.environ.get("ALL_CHECKS") == "1"
SAMPLE = [
    "item_grid_median", "scan_with_filters", "bucketed_round_trip", "upgrade_ids", "merged_with_static_only_ids", "series_default_of_flags",
    "slide_look_back", "carry_backward_within_gap", "fill_linear", "sessions_by_gap", "gap_free_grid", "charted_rates_by_minute", "merged_ranges",
    "nearest_of_all", "inspired_oxygen_matched", "window_aggregates_closed", "sustained_infusion_rate", "infection_with_components",
    "sepsis_any_infection", "sepsis_sofa2_any", "kidney_injury_stages", "circulatory_failure_windows", "sofa2_components", "news_components",
    "sofa_over_time", "mixed_units_to_one", "drug_text_rates_in_units", "rule_admission_path", "table_one", "density_curves", "quality_report",
    "load_concepts_wide", "load_oxygen_ratio", "load_filtered_cohort",
]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = connect(SF)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 280


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES) if EVERY else SAMPLE)
def test_query_equals_sql(spark, con, name):
    result, _, _ = check(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert result.startswith("ok") and "TYPES" not in result, result


@needs_data
@pytest.mark.parametrize("name", ["cohort_groups", "mortality_by_quartile", "last_before", "window_aggregates_closed", "sepsis_any_infection", "slide_look_back"])
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@needs_data
@pytest.mark.parametrize("name, most", [("table_one", 4), ("quality_report", 3)])
def test_few_scans(spark, name, most):
    df = QUERIES[name](spark, SF)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert 0 < len(re.findall("Scan parquet", ran)) <= most


@needs_data
def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["id", "t", "sofa"] and df.count() > 0
