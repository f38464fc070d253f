"""Every cut of the banded scores: at it, beside it, and missing."""

import pytest

from staygrid.functions import scores
from staygrid.operators import organ

CASES = [
    (scores.sofa_coag, {19.99: 4, 20: 3, 49.99: 3, 50: 2, 100: 1, 149.99: 1, 150: 0, None: 0}),
    (scores.sofa_liver, {12: 4, 11.99: 3, 6: 3, 5.99: 2, 2: 2, 1.99: 1, 1.2: 1, 1.19: 0, None: 0}),
    (scores.sofa_cns, {5: 4, 6: 3, 9: 3, 10: 2, 12: 2, 13: 1, 14: 1, 15: 0, None: None}),
    (scores.sofa_resp, {99: 2, 199: 2, 200: 2, 299: 2, 300: 1, 399: 1, 400: 0, None: 0}),
    (scores.sofa2_coag, {50: 4, 50.1: 3, 80: 3, 100: 2, 150: 1, 151: 0, None: 0}),
    (scores.sofa2_liver, {12.1: 4, 12: 3, 6: 2, 3: 1, 1.2: 0, None: 0}),
    (scores.sofa2_cns, {3: 4, 5: 4, 6: 3, 8: 3, 9: 2, 12: 2, 13: 1, 15: 0, None: 0}),
    (scores.avpu, {2: None, 3: "U", 9: "P", 10: "V", 13: "V", 14: "A", 15: "A", 16: None, None: None}),
]


@pytest.mark.parametrize("score, cuts", CASES, ids=[c[0].__name__ for c in CASES])
def test_cuts(spark, score, cuts):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in cuts], "x double")
    assert [r[0] for r in df.select(score("x")).collect()] == list(cuts.values())


def test_ventilated_ratio(spark):
    df = spark.createDataFrame([(99.0, True), (150.0, True), (150.0, None)], "p double, v boolean")
    assert [r[0] for r in df.select(scores.sofa_resp("p", "v")).collect()] == [4, 3, 2]


def test_saturation_ratio_only_without_pressure_ratio(spark):
    df = spark.createDataFrame(
        [(None, 90.0, 0.4, True), (None, 98.0, 0.4, True), (400.0, 90.0, 0.9, True), (None, 90.0, 0.9, True), (None, 90.0, 0.9, False)],
        "p double, s double, f double, a boolean")
    assert [r[0] for r in df.select(scores.sofa2_resp("p", "s", "f", "a")).collect()] == [2, 0, 0, 4, 2]


def test_unknown_consciousness(spark):
    df = spark.createDataFrame([(None,), ("A",), ("V",)], "a string")
    df = df.selectExpr("a", "16d AS resp", "37d AS temp", "120d AS sbp", "80d AS hr")
    args = ("resp", "temp", "sbp", "hr")
    assert [r[0] for r in df.select(scores.news(*args, avpu="a")).collect()] == [0, 0, 3]
    assert [r[0] for r in df.select(scores.news(*args, avpu="a", unknown_avpu_scores=True)).collect()] == [3, 0, 3]


def test_component_only_where_an_input_is_known(spark):
    df = spark.createDataFrame([(1, 0, 15.0), (1, 3600, None)], "id long, t long, plt double")
    out = organ.component(df, "sofa_coag", ["plt", "absent"], lambda d: scores.sofa_coag("plt"))
    assert [r.sofa_coag for r in out.orderBy("t").collect()] == [4, None]


def test_full_window_needs_the_whole_look_back(spark):
    df = spark.createDataFrame([(1, h * 3600, 1) for h in range(6)], "id long, t long, sofa_coag int")
    out = organ.sofa_score(df, ["id"], "t", window=4 * 3600, full_window=True)
    assert [r.t for r in out.orderBy("t").collect()] == [4 * 3600, 5 * 3600]
