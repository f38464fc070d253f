"""Scores over a panel of variables derived from every event, thresholds and nulls included."""

from pyspark.sql import functions as F

from checks import common
from checks.common import IDS, TIME, ev, hv, query
from staygrid.functions import scalars, scores
from staygrid.operators import organ
from staygrid.schema import HOUR

class Late:
    """A column built when the query runs: columns need a session."""

    def __init__(self, make):
        self.make = make

    def __call__(self):
        return self.make()

    def cast(self, kind):
        return Late(lambda: self().cast(kind))

    def part(self, name):
        return Late(lambda: self()[name])


class _Scores:
    def __getattr__(self, name):
        return lambda *args, **kwargs: Late(lambda: getattr(scores, name)(*args, **kwargs))


late = _Scores()


def rounded(column, digits):
    return Late(lambda: common.rounded(column(), digits))


# One definition serves both engines; value runs from 0 to about 500.
PANEL = {
    "id": "id", "t": "t", "seq": "seq",
    "pafi": "CASE WHEN seq % 9 = 0 THEN NULL ELSE value * 8 END", "vent": "seq % 3 = 0",
    "plt": "CASE WHEN seq % 11 = 0 THEN NULL ELSE value * 3 END",
    "bili": "CASE WHEN seq % 13 = 0 THEN NULL ELSE value / 6 END",
    "map": "CASE WHEN seq % 17 = 0 THEN NULL ELSE value + 30 END",
    "norepi": "CASE WHEN seq % 4 = 0 THEN value / 200 END", "epi": "CASE WHEN seq % 5 = 0 THEN value / 300 END",
    "dopa": "CASE WHEN seq % 6 = 0 THEN value / 3 END", "dobu": "CASE WHEN seq % 7 = 0 THEN value / 10 END",
    "adh": "CASE WHEN seq % 8 = 0 THEN value / 1000 END",
    "gcs": "CASE WHEN seq % 19 = 0 THEN NULL ELSE 1 + seq % 16 END",
    "crea": "CASE WHEN seq % 10 = 0 THEN NULL ELSE value / 20 END",
    "urine24": "CASE WHEN seq % 3 = 1 THEN value * 15 END",
    "spo2": "CASE WHEN seq % 12 = 0 THEN NULL ELSE 80 + value % 20 END", "fio2": "CASE WHEN seq % 14 = 0 THEN NULL ELSE 0.2 + value % 1 END",
    "ecmo": "seq % 29 = 0", "indication": "CASE WHEN seq % 2 = 0 THEN 'respiratory' ELSE 'cardiovascular' END",
    "support": "seq % 4 < 2", "other": "seq % 31 = 0", "mech": "seq % 37 = 0", "dtx": "seq % 5 = 1", "dpos": "seq % 7 = 2",
    "motor": "1 + seq % 6", "rrt": "seq % 41 = 0", "uo6": "CASE WHEN seq % 3 <> 0 THEN value / 60 END",
    "uo12": "CASE WHEN seq % 5 <> 0 THEN (seq % 8) / 8.0 END", "uo24": "CASE WHEN seq % 7 <> 0 THEN value / 90 END",
    "k": "3 + value / 20", "ph": "7.0 + (seq % 60) / 100.0", "bicarb": "5 + seq % 25",
    "temp": "CASE WHEN seq % 23 = 0 THEN NULL ELSE 29 + (seq % 130) / 10.0 END", "hr": "30 + seq % 120", "resp": "CASE WHEN seq % 21 = 0 THEN NULL ELSE 5 + seq % 30 END",
    "pco2": "CASE WHEN seq % 2 = 0 THEN 25 + seq % 20 END", "wbc": "CASE WHEN seq % 3 <> 2 THEN value / 5 END", "bnd": "CASE WHEN seq % 6 = 0 THEN value / 4 END",
    "sbp": "CASE WHEN seq % 27 = 0 THEN NULL ELSE 60 + seq % 170 END", "o2": "85 + seq % 16", "oxy": "seq % 3 = 2",
    "letter": "CASE seq % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'V' WHEN 2 THEN 'P' WHEN 3 THEN 'U' END", "age": "15 + seq % 80",
    "weight": "CASE WHEN seq % 33 = 0 THEN 0 ELSE 40 + value END", "height": "CASE WHEN seq % 35 = 0 THEN NULL ELSE 120 + seq % 90 END",
}
_PANEL_SQL = "p AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PANEL.items()) + " FROM ev)"


def panel(spark, sf):
    return ev(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in PANEL.items()])


def score(**columns):
    """Register a one-projection check: name -> (column, SQL expression)."""

    def add(name, made):
        sql = f"WITH {_PANEL_SQL} SELECT seq, " + ", ".join(f"{s} AS {o}" for o, (_, s) in made.items()) + " FROM p"

        def run(spark, sf):
            return panel(spark, sf).select("seq", *[c().alias(o) for o, (c, _) in made.items()])

        run.__name__ = name
        query(sql, "ev")(run)

    for name, made in columns.items():
        add(name, made)


def _bands(x, *pairs):
    return "CASE " + " ".join(f"WHEN coalesce({x} {cut}, false) THEN {points}" for cut, points in pairs) + " ELSE 0 END"


_ADJ = "(CASE WHEN coalesce(pafi < 200, false) AND NOT vent THEN 200 ELSE pafi END)"
score(sofa_components={
    "resp": (late.sofa_resp("pafi", "vent"), _bands(_ADJ, ("< 100", 4), ("< 200", 3), ("< 300", 2), ("< 400", 1))),
    "coag": (late.sofa_coag("plt"), _bands("plt", ("< 20", 4), ("< 50", 3), ("< 100", 2), ("< 150", 1))),
    "liver": (late.sofa_liver("bili"), _bands("bili", (">= 12", 4), (">= 6", 3), (">= 2", 2), (">= 1.2", 1))),
    "cardio": (late.sofa_cardio("map", "dopa", "norepi", "dobu", "epi"),
               "CASE WHEN coalesce(dopa, 0) > 15 OR coalesce(epi, 0) > 0.1 OR coalesce(norepi, 0) > 0.1 THEN 4"
               " WHEN coalesce(dopa, 0) > 5 OR coalesce(epi, 0) > 0 OR coalesce(norepi, 0) > 0 THEN 3"
               " WHEN coalesce(dopa, 0) > 0 OR coalesce(dobu, 0) > 0 THEN 2 WHEN map < 70 THEN 1 ELSE 0 END"),
    "cns": (late.sofa_cns("gcs"), "CASE WHEN gcs < 6 THEN 4 WHEN gcs < 10 THEN 3 WHEN gcs < 13 THEN 2 WHEN gcs < 15 THEN 1 WHEN gcs IS NOT NULL THEN 0 END"),
    "renal": (late.sofa_renal("crea", "urine24"),
              "CASE WHEN coalesce(crea >= 5, false) OR coalesce(urine24 < 200, false) THEN 4 WHEN coalesce(crea >= 3.5, false) OR coalesce(urine24 < 500, false) THEN 3"
              " WHEN crea >= 2 THEN 2 WHEN crea >= 1.2 THEN 1 ELSE 0 END"),
})

_SF = "(CASE WHEN spo2 < 98 THEN spo2 / fio2 END)"
_RAT = f"coalesce(pafi, {_SF})"
_BY = f"(pafi IS NULL AND {_SF} IS NOT NULL)"


def _below(pf, sf):
    return f"(coalesce({_RAT} <= {pf}, false) OR ({_BY} AND coalesce({_RAT} <= {sf}, false)))"


_RRT = "((coalesce(crea > 1.2, false) OR coalesce(uo6 < 0.3, false)) AND (k >= 6.0 OR (ph <= 7.2 AND bicarb <= 12)))"
_NE = "(coalesce(norepi, 0) + coalesce(epi, 0))"
_DA = f"(CASE WHEN {_NE} = 0 THEN coalesce(dopa, 0) ELSE 0 END)"
_OT = "(other OR coalesce(dobu, 0) > 0)"
score(sofa2_components={
    "resp": (late.sofa2_resp("pafi", "spo2", "fio2", "support", "ecmo", "indication"),
             f"CASE WHEN ({_below(75, 120)} AND support) OR (ecmo AND indication = 'respiratory') THEN 4 WHEN {_below(150, 200)} AND support THEN 3"
             f" WHEN {_below(225, 250)} THEN 2 WHEN {_RAT} <= 300 THEN 1 ELSE 0 END"),
    "coag": (late.sofa2_coag("plt"), _bands("plt", ("<= 50", 4), ("<= 80", 3), ("<= 100", 2), ("<= 150", 1))),
    "liver": (late.sofa2_liver("bili"), _bands("bili", ("> 12", 4), ("> 6", 3), ("> 3", 2), ("> 1.2", 1))),
    "cardio": (late.sofa2_cardio("map", "norepi", "epi", "dopa", "dobu", "other", "mech"),
               f"CASE WHEN {_NE} > 0.4 OR {_DA} > 40 OR ({_NE} > 0.2 AND {_NE} <= 0.4 AND {_OT}) OR mech THEN 4"
               f" WHEN ({_NE} > 0.2 AND {_NE} <= 0.4) OR {_DA} > 20 OR ({_NE} > 0 AND {_NE} <= 0.2 AND {_OT}) THEN 3"
               f" WHEN ({_NE} > 0 AND {_NE} <= 0.2) OR {_DA} > 0 OR {_OT} THEN 2 WHEN map < 70 THEN 1 ELSE 0 END"),
    "cardio_by_map": (late.sofa2_cardio("map", map_only=True), _bands("map", ("< 40", 4), ("< 50", 3), ("< 60", 2), ("< 70", 1))),
    "cns": (late.sofa2_cns("gcs", "dtx", "dpos"),
            "CASE WHEN gcs BETWEEN 3 AND 5 THEN 4 WHEN gcs BETWEEN 6 AND 8 THEN 3 WHEN gcs BETWEEN 9 AND 12 THEN 2 WHEN gcs BETWEEN 13 AND 14 THEN 1"
            " WHEN gcs = 15 AND (dtx OR dpos) THEN 1 ELSE 0 END"),
    "cns_motor": (late.sofa2_cns("gcs", motor_response="motor"),
                  "CASE WHEN gcs IS NULL THEN CASE WHEN motor <= 3 THEN 4 WHEN motor = 4 THEN 3 WHEN motor = 5 THEN 2 ELSE 1 END WHEN gcs BETWEEN 3 AND 5 THEN 4"
                  " WHEN gcs BETWEEN 6 AND 8 THEN 3 WHEN gcs BETWEEN 9 AND 12 THEN 2 WHEN gcs BETWEEN 13 AND 14 THEN 1 ELSE 0 END"),
    "renal": (late.sofa2_renal("crea", "rrt", None, "uo6", "uo12", "uo24", "k", "ph", "bicarb"),
              f"CASE WHEN rrt OR {_RRT} THEN 4 WHEN coalesce(crea > 3.5, false) OR coalesce(uo24 < 0.3, false) OR coalesce(uo12 = 0, false) THEN 3"
              " WHEN coalesce(crea > 2.0, false) OR coalesce(uo12 < 0.5, false) THEN 2"
              " WHEN coalesce(crea > 1.2, false) OR (coalesce(uo6 < 0.5, false) AND NOT coalesce(uo12 < 0.5, false)) THEN 1 ELSE 0 END"),
    "rrt_need": (late.rrt_criteria("crea", "uo6", "k", "ph", "bicarb"), _RRT),
})

score(warning_scores={
    "sirs": (late.sirs("temp", "hr", "resp", "pco2", "wbc", "bnd"),
             "coalesce((temp < 36 OR temp > 38)::INT, 0) + (hr > 90)::INT + (coalesce(resp > 20, false) OR coalesce(pco2 < 32, false))::INT"
             " + (coalesce(wbc < 4 OR wbc > 12, false) OR coalesce(bnd > 10, false))::INT"),
    "qsofa": (late.qsofa("sbp", "resp", "gcs"), "coalesce((sbp <= 100)::INT, 0) + coalesce((resp >= 22)::INT, 0) + coalesce((gcs <= 13)::INT, 0)"),
    "apache_partial": (late.apache_ii_partial("age", "temp"),
                       "2 * (age >= 45)::INT + 3 * (age >= 55)::INT + 5 * (age >= 65)::INT + 6 * (age >= 75)::INT + CASE WHEN temp >= 41 THEN 4 WHEN temp >= 39 THEN 3"
                       " WHEN temp >= 38.5 THEN 1 WHEN temp >= 36 THEN 0 WHEN temp >= 34 THEN 1 WHEN temp >= 32 THEN 2 WHEN temp >= 30 THEN 3 WHEN temp < 30 THEN 4 ELSE 0 END"),
    "avpu": (late.avpu("gcs"), "CASE WHEN gcs <= 2 THEN NULL WHEN gcs <= 3 THEN 'U' WHEN gcs <= 9 THEN 'P' WHEN gcs <= 13 THEN 'V' WHEN gcs <= 15 THEN 'A' END"),
})


def _sql_band(x, pairs, above):
    return f"(CASE WHEN {x} IS NULL THEN 0 " + " ".join(f"WHEN {x} <= {b} THEN {p}" for b, p in pairs) + f" ELSE {above} END)"


_NEWS = {
    "resp_comp": _sql_band("resp", [(8, 3), (11, 1), (20, 0), (24, 2)], 3), "o2sat_comp": _sql_band("o2", [(91, 3), (93, 2), (95, 1)], 0),
    "temp_comp": _sql_band("temp", [(35, 3), (36, 1), (38.4, 0), (39, 1)], 2), "sbp_comp": _sql_band("sbp", [(90, 3), (100, 2), (110, 1), (219, 0)], 3),
    "hr_comp": _sql_band("hr", [(40, 3), (50, 1), (90, 0), (110, 1), (130, 2)], 3), "supp_o2_comp": "(CASE WHEN oxy THEN 2 ELSE 0 END)",
    "avpu_comp": "(CASE WHEN coalesce(letter = 'A', true) THEN 0 ELSE 3 END)",
}
_news = {n: late.news_parts("resp", "temp", "sbp", "hr", "o2", "oxy", "letter").part(n) for n in _NEWS}
score(news_components={
    **{n: (_news[n], s) for n, s in _NEWS.items()},
    "news": (late.news("resp", "temp", "sbp", "hr", "o2", "oxy", "letter"), " + ".join(_NEWS.values())),
    "news_compat": (late.news("resp", "temp", "sbp", "hr", "o2", "oxy", "letter", unknown_avpu_scores=True),
                    " + ".join(_NEWS.values()).replace("true) THEN 0", "false) THEN 0")),
    "news_by_gcs": (late.news("resp", "temp", "sbp", "hr", gcs="gcs"),
                    " + ".join([_NEWS[n] for n in ("resp_comp", "temp_comp", "sbp_comp", "hr_comp")]) + " + (CASE WHEN coalesce(gcs < 15, false) THEN 3 ELSE 0 END)"),
})

_MEWS = {
    "sbp_comp": _sql_band("sbp", [(70, 3), (80, 2), (100, 1), (199, 0)], 2), "hr_comp": _sql_band("hr", [(40, 2), (50, 1), (100, 0), (110, 1), (129, 2)], 3),
    "resp_comp": _sql_band("resp", [(9, 2), (14, 0), (20, 1), (29, 2)], 3), "temp_comp": _sql_band("temp", [(35, 2), (38.4, 0)], 2),
    "avpu_comp": "(CASE letter WHEN 'V' THEN 1 WHEN 'P' THEN 2 WHEN 'U' THEN 3 ELSE 0 END)",
}
_mews = {n: late.mews_parts("sbp", "hr", "resp", "temp", "letter").part(n) for n in _MEWS}
score(mews_components={
    **{n: (_mews[n], s) for n, s in _MEWS.items()},
    "mews": (late.mews("sbp", "hr", "resp", "temp", "letter"), " + ".join(_MEWS.values())),
})

_NEQ = "round(coalesce(epi, 0) + coalesce(norepi, 0) + coalesce(dopa / 150.0, 0) + coalesce(adh * 2.5, 0), 6)"
score(single_measures={
    "bmi": (rounded(late.bmi("weight", "height"), 6),
            "CASE WHEN weight / ((height / 100.0) * (height / 100.0)) BETWEEN 10 AND 100 THEN round(weight / ((height / 100.0) * (height / 100.0)), 6) END"),
    "norepi_equiv": (rounded(late.norepi_equiv("epi", "norepi", "dopa", "adh"), 6),
                     f"CASE WHEN coalesce(epi, norepi, dopa, adh) IS NOT NULL THEN {_NEQ} END"),
    "supp_o2": (late.supp_o2("vent", "bicarb"), "vent OR bicarb > 21"),
    "cells_pct": (rounded(late.blood_cell_ratio("bnd", "wbc"), 6), "CASE WHEN wbc <> 0 THEN round(bnd * 100 / wbc, 6) END"),
    "cells_abs": (rounded(late.blood_cell_count("bnd", "wbc"), 6), "round(bnd / 100 * wbc, 6)"),
    "by_breaks": (late.map_breaks("wbc", [3, 2, 1, 0], [4, 12, 30]), "(CASE WHEN wbc IS NULL THEN NULL WHEN wbc <= 4 THEN 3.0 WHEN wbc <= 12 THEN 2.0 WHEN wbc <= 30 THEN 1.0 ELSE 0.0 END)::DOUBLE"),
    "gcs": (late.gcs_total("bicarb", "motor", "motor", "gcs", "ecmo").cast("double"),
            "(CASE WHEN ecmo THEN 15 WHEN gcs >= 3 THEN gcs ELSE bicarb + motor + motor END)::DOUBLE"),
    "known_sum": (rounded(Late(lambda: scalars.sum_known("epi", "dopa", "dobu")), 6),
                  "CASE WHEN coalesce(epi, dopa, dobu) IS NOT NULL THEN round(coalesce(epi, 0) + coalesce(dopa, 0) + coalesce(dobu, 0), 6) END"),
    "age_capped": (Late(lambda: F.least(F.col("age"), F.lit(60))), "least(age, 60)"),
})


# --- scores over time -----------------------------------------------------------------

_PARTS = """x AS (SELECT id, t, floor(value / 25)::INT % 5 AS sofa_resp, CASE WHEN value > 20 THEN floor(value / 10)::INT % 5 END AS sofa_coag,
    CASE WHEN value < 40 THEN floor(value)::INT % 5 END AS sofa_liver FROM hv),
    g AS (SELECT id, unnest(generate_series(lo, hi, 3600)) AS t FROM (SELECT id, min(t) AS lo, {hi} AS hi FROM x GROUP BY id) WHERE lo <= hi),
    w AS (SELECT id, t, max(sofa_resp) OVER v AS a, max(sofa_coag) OVER v AS b, max(sofa_liver) OVER v AS c FROM g LEFT JOIN x USING (id, t)
        WINDOW v AS (PARTITION BY id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))"""


def _parts(spark, sf):
    v = F.col("value")
    return hv(spark, sf).select(
        "id", "t", (F.floor(v / 25).cast("int") % 5).alias("sofa_resp"), F.when(v > 20, F.floor(v / 10).cast("int") % 5).alias("sofa_coag"),
        F.when(v < 40, F.floor(v).cast("int") % 5).alias("sofa_liver"))


@query(f"WITH {_PARTS.format(hi='max(t)')} SELECT id, t, a AS sofa_resp, b AS sofa_coag, c AS sofa_liver, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS sofa FROM w", "ev hv")
def sofa_over_time(spark, sf):
    return organ.sofa_score(_parts(spark, sf), IDS, TIME, keep_components=True)


@query(f"WITH {_PARTS.format(hi='max(t) - min(t)')} SELECT id, t, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS sofa FROM w", "ev hv")
def sofa_over_time_compat(spark, sf):
    return organ.sofa_score(_parts(spark, sf), IDS, TIME, compat=True)


@query(f"WITH {_PARTS.format(hi='max(t)')} SELECT id, t, coalesce(a, 0) + coalesce(b, 0) AS sofa2 FROM w", "ev hv")
def sofa2_over_time(spark, sf):
    rows = _parts(spark, sf).select("id", "t", F.col("sofa_resp").alias("sofa2_resp"), F.col("sofa_coag").alias("sofa2_coag"))
    # rows without any of the two components do not extend the grid; sofa_resp is always known
    return organ.sofa2_score(rows, IDS, TIME)


_VITALS = """v AS (SELECT id, t, max(CASE WHEN item = 'click' THEN 60 + value END) AS sbp, max(CASE WHEN item = 'view' THEN value / 3 END) AS resp,
    min(CASE WHEN item = 'error' THEN 3 + floor(value) % 13 END) AS gcs FROM (SELECT id, (t // 3600) * 3600 AS t, item, value FROM ev) GROUP BY 1, 2),
    l AS (SELECT id, t, last_value(sbp IGNORE NULLS) OVER w AS sbp, last_value(resp IGNORE NULLS) OVER w AS resp, last_value(gcs IGNORE NULLS) OVER w AS gcs
        FROM v WINDOW w AS (PARTITION BY id ORDER BY t RANGE BETWEEN {win} PRECEDING AND CURRENT ROW))"""


def _vitals(spark, sf):
    v, item = F.col("value"), F.col("item")
    return ev(spark, sf).groupBy("id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t")).agg(
        F.max(F.when(item == "click", v + 60)).alias("sbp"), F.max(F.when(item == "view", v / 3)).alias("resp"),
        F.min(F.when(item == "error", F.floor(v) % 13 + 3)).alias("gcs"))


@query(f"""WITH {_VITALS.format(win=86400)} SELECT id, t, coalesce((sbp <= 100)::INT, 0) + coalesce((resp >= 22)::INT, 0) + coalesce((gcs <= 13)::INT, 0) AS qsofa FROM l""", "ev")
def qsofa_over_time(spark, sf):
    return organ.qsofa(_vitals(spark, sf), IDS, TIME)


@query(f"""WITH {_VITALS.format(win=86400)} SELECT id, t, coalesce((gcs < 4 OR gcs > 12)::INT, 0) + coalesce((sbp > 90)::INT, 0) + coalesce((resp > 20)::INT, 0) AS sirs FROM l""", "ev")
def sirs_over_time(spark, sf):
    rows = _vitals(spark, sf).select("id", "t", (F.col("gcs") * 1.0).alias("wbc"), F.col("sbp").alias("hr"), "resp", F.lit(37.0).alias("temp"))
    return organ.sirs(rows, IDS, TIME)


_GCS = """c AS (SELECT id, t, min(CASE WHEN item = 'click' THEN 1 + floor(value) % 4 END) AS egcs, min(CASE WHEN item = 'view' THEN 1 + floor(value) % 5 END) AS vgcs,
    min(CASE WHEN item = 'error' THEN 1 + floor(value) % 6 END) AS mgcs, min(CASE WHEN item = 'signup' THEN floor(value) % 16 END) AS tgcs
    FROM (SELECT id, (t // 3600) * 3600 AS t, item, value FROM ev) GROUP BY 1, 2),
    l AS (SELECT id, t, last_value(egcs IGNORE NULLS) OVER w AS e, last_value(vgcs IGNORE NULLS) OVER w AS v, last_value(mgcs IGNORE NULLS) OVER w AS m,
        last_value(tgcs IGNORE NULLS) OVER w AS g FROM c WINDOW w AS (PARTITION BY id ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW))"""


@query(f"""WITH {_GCS} SELECT id, t, (CASE WHEN b.id IS NOT NULL THEN 15 WHEN g >= 3 THEN g ELSE coalesce(e, 4) + coalesce(m, 6) + coalesce(v, 5) END)::DOUBLE AS gcs
    FROM l LEFT JOIN (SELECT id, t, true AS tube FROM item_b WHERE b > 100) b USING (id, t)""".replace("b.id IS NOT NULL", "tube"), "ev item_b")
def coma_scale_over_time(spark, sf):
    from checks.common import item_b

    f, item = F.floor("value"), F.col("item")
    rows = ev(spark, sf).groupBy("id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t")).agg(
        F.min(F.when(item == "click", f % 4 + 1)).alias("egcs"), F.min(F.when(item == "view", f % 5 + 1)).alias("vgcs"),
        F.min(F.when(item == "error", f % 6 + 1)).alias("mgcs"), F.min(F.when(item == "signup", f % 16)).alias("tgcs"))
    tube = item_b(spark, sf).where("b > 100").select("id", "t", F.lit(True).alias("ett_gcs"))
    return organ.gcs(rows, IDS, TIME, tube).withColumn("gcs", F.col("gcs").cast("double"))
