"""Cohort filters, group comparison and the tables behind cohort charts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from staygrid.operators import stats

# Code prefixes and words that mark sepsis.
SEPSIS_CODES = ["A40", "A41", "99591", "99592", "78552"]
SEPSIS_WORDS = "sepsis|septic"


@dataclass(frozen=True)
class Criteria:
    """Bounds of a cohort; lengths of stay in hours, both ends included."""

    age_min: float | None = None
    age_max: float | None = None
    first_icu_stay: bool | None = None
    los_min: float | None = None
    los_max: float | None = None
    gender: str | None = None
    survived: bool | None = None
    has_sepsis: bool | None = None

    def steps(self) -> dict[str, Column]:
        """Each bound that is set, as a predicate on the demographics."""
        c = F.col
        rules = {
            "age_min": lambda v: c("age") >= v,
            "age_max": lambda v: c("age") <= v,
            "first_icu_stay": lambda v: c("first_icu_stay") == v,
            "los_min": lambda v: c("los_hours") >= v,
            "los_max": lambda v: c("los_hours") <= v,
            "gender": lambda v: F.upper("gender") == v.upper(),
            "survived": lambda v: c("survived") == v,
        }
        return {name: rule(getattr(self, name)) for name, rule in rules.items() if getattr(self, name) is not None}


def sepsis_ids(diagnoses: DataFrame, id_col: str, code: str | None = None, text: str | None = None) -> DataFrame:
    """Ids with a sepsis code or a diagnosis text that names it."""
    hit = F.lit(False)
    if code:
        hit = hit | F.coalesce(F.col(code).rlike("^(" + "|".join(SEPSIS_CODES) + ")"), F.lit(False))
    if text:
        hit = hit | F.coalesce(F.lower(text).rlike(SEPSIS_WORDS), F.lit(False))
    return diagnoses.where(hit).select(id_col).distinct()


def filter_cohort(demographics: DataFrame, criteria: Criteria, sepsis: DataFrame | None = None, id_col: str = "patient_id") -> DataFrame:
    """Stays that meet all criteria, as a frame."""
    out = demographics
    for predicate in criteria.steps().values():
        out = out.where(predicate)
    if criteria.has_sepsis is not None and sepsis is not None:
        out = out.join(sepsis.select(id_col).distinct(), id_col, "left_semi" if criteria.has_sepsis else "left_anti")
    return out


def attrition(demographics: DataFrame, criteria: Criteria) -> DataFrame:
    """Stays left after each criterion in turn, counted in one pass."""
    met = F.lit(True)
    counts, labels = [F.count(F.lit(1)).alias("all")], ["all"]
    for name, predicate in criteria.steps().items():
        met = met & F.coalesce(predicate, F.lit(False))
        counts.append(F.count_if(met).alias(name))
        labels.append(name)
    steps = F.create_map(*[x for i, n in enumerate(labels) for x in (F.lit(n), F.lit(i))])
    return demographics.agg(*counts).unpivot([], labels, "criterion", "n_left").withColumn("step", steps[F.col("criterion")])


def cohort_stats(demographics: DataFrame) -> DataFrame:
    """One row: size, age, sex, length of stay, survival and first stays."""
    base = demographics.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_sd"),
        F.avg("los_hours").alias("los_mean"),
        F.avg((F.col("gender") == "M").cast("double")).alias("male_share"),
        F.avg(F.col("survived").cast("double")).alias("survival"),
        F.avg(F.col("first_icu_stay").cast("double")).alias("first_stay_share"),
    )
    age = stats.quantiles(demographics, [], "age", {"age_q1": 0.25, "age_median": 0.5, "age_q3": 0.75})
    los = stats.quantiles(demographics, [], "los_hours", {"los_median": 0.5})
    return stats.beside(base, age, los)


def cohort_comparison(demographics: DataFrame, group: str, custom: DataFrame | None = None, id_col: str = "patient_id") -> DataFrame:
    """Per group: size and share, age, length of stay, sex and survival.

    ``custom`` maps ids to a group column; ids without one fall into ``Other``.
    """
    df = demographics
    if custom is not None:
        df = df.join(custom.select(id_col, group), id_col, "left").withColumn(group, F.coalesce(F.col(group), F.lit("Other")))
    df = df.where(F.col(group).isNotNull())
    base = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_sd"),
        (F.avg((F.col("gender") == "M").cast("double")) * 100).alias("male_pct"),
        (F.avg(F.col("survived").cast("double")) * 100).alias("survival_pct"),
    )
    los = stats.quantiles(df, [group], "los_hours", {"los_median": 0.5})
    whole = df.agg(F.count(F.lit(1))).scalar()
    return base.join(los, group, "left").withColumn("pct", F.col("n") * 100.0 / whole)


def summary_table(demographics: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """Table one: both groups' statistics and p-value per feature.

    Numeric features use the rank-sum test, two-valued ones chi-square with
    Yates' correction. One row per feature with numbers, not formatted text; a
    numeric feature without values has no row. Both numeric features share the
    moments, the quantiles and the ranks; the two-valued ones share one count.
    """
    df = demographics.where(F.col(group).isin(first, second))
    in_first = F.col(group) == first
    sides = (("1", in_first), ("2", ~in_first))
    named = {"age": F.col("age"), "los_days": F.col("los_hours") / 24}
    long = df.select(F.col(group).alias("_g"), *[c.cast("double").alias(f) for f, c in named.items()])
    long = long.unpivot("_g", list(named), "feature", "_v").where("_v IS NOT NULL")
    first_rows = F.col("_g") == first
    moments = long.groupBy("feature").agg(*[
        agg.alias(f"{name}_{side}") for side, cond in (("1", first_rows), ("2", ~first_rows)) for name, agg in (
            ("n", F.count_if(cond)), ("mean", F.avg(F.when(cond, F.col("_v")))), ("sd", F.stddev_samp(F.when(cond, F.col("_v")))),
        )
    ])
    q = stats.quantiles(long, ["feature", "_g"], "_v", {"q25": 0.25, "median": 0.5, "q75": 0.75}).groupBy("feature").agg(*[
        F.max(F.when(F.col("_g") == name, F.col(p))).alias(f"{p}_{i}")
        for i, name in (("1", first), ("2", second)) for p in ("median", "q25", "q75")
    ])
    test = stats.rank_sum_test(long, ["feature"], "_v", first_rows).select("feature", F.col("u").alias("statistic"), "p_value")
    numeric = moments.join(q, "feature").join(test, "feature")
    yes = {"male": F.col("gender") == "M", "deceased": F.col("survived") == F.lit(False)}
    no = {"male": F.col("gender") == "F", "deceased": F.col("survived") == F.lit(True)}
    counted = df.agg(
        F.count_if(in_first).alias("_n1"), F.count_if(~in_first).alias("_n2"),
        *[F.count_if(cond & hit).alias(f"_{k}{f}{i}") for f in yes for k, hit in (("y", yes[f]), ("n", no[f])) for i, cond in sides],
    )
    shares = counted.select(F.inline(F.array(*[_share(f) for f in yes]))).withColumn("p_value", stats.chi_square_p("statistic"))
    return numeric.unionByName(shares, allowMissingColumns=True)


def _share(f: str) -> Column:
    """One two-valued feature as a row of the counts."""
    a, b, c, d = F.col(f"_y{f}1"), F.col(f"_n{f}1"), F.col(f"_y{f}2"), F.col(f"_n{f}2")
    return F.struct(
        F.lit(f).alias("feature"), a.alias("n_1"), c.alias("n_2"),
        F.try_divide(a * 100.0, F.col("_n1")).alias("pct_1"), F.try_divide(c * 100.0, F.col("_n2")).alias("pct_2"),
        stats.chi_square_2x2(a, b, c, d).alias("statistic"),
    )


def with_group(df: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """Rows of grouped ids with their group."""
    return df.join(groups.select(id_col, "group"), id_col)


def compare_series(df: DataFrame, group: str, time: str, value: str, how: str = "mean", max_time: int | None = None) -> DataFrame:
    """Per group and time: centre, spread, count and half width of the 95 % interval."""
    rows = df if max_time is None else df.where(F.col(time) <= max_time)
    spread = [
        F.stddev_samp(value).alias("std"), F.count(value).alias("count"),
        (F.lit(1.96) * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("ci"),
    ]
    if how == "mean":
        return rows.groupBy(group, time).agg(F.avg(value).alias("centre"), *spread)
    # a group and time hold a value of every patient: the median comes from value slices
    middle = stats.quantiles(rows, [group, time], value, {"centre": 0.5})
    return rows.groupBy(group, time).agg(*spread).join(middle, [group, time], "left").select(group, time, "centre", "std", "count", "ci")


def feature_distribution(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int = 30) -> DataFrame:
    """Histogram per group and feature over a clipped range."""
    return stats.histogram(df, by, value, lo, hi, bins)


def feature_summary(tables: dict[str, DataFrame], concept: str, value: str) -> DataFrame:
    """Per source and concept: count, mean, spread and quartiles."""
    stacked = None
    for source, df in tables.items():
        part = df.select(F.lit(source).alias("source"), concept, F.col(value).cast("double").alias(value))
        stacked = part if stacked is None else stacked.unionByName(part)
    keys = ["source", concept]
    base = stacked.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    return base.join(stats.quantiles(stacked, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), keys)


def band_label(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the right-closed band ``(edge, next edge]``; null outside."""
    chain = F.when(x <= edges[0], F.lit(None).cast("string"))
    for bound, label in zip(edges[1:], labels):
        chain = chain.when(x <= bound, F.lit(label))
    return chain


# Bands of the age by length-of-stay table.
AGE_EDGES = [0, 30, 40, 50, 60, 70, 100]
AGE_LABELS = ["18-30", "30-40", "40-50", "50-60", "60-70", "70+"]
LOS_EDGES = [0, 1, 2, 3, 5, 7, 10, 14, 1000]
LOS_LABELS = ["0-1", "1-2", "2-3", "3-5", "5-7", "7-10", "10-14", "14+"]


def complexity_matrix(demographics: DataFrame, age: str = "age", los_days: str = "los_days") -> DataFrame:
    """Stays per age band and length-of-stay band."""
    bands = demographics.select(
        band_label(F.col(age), AGE_EDGES, AGE_LABELS).alias("age_group"),
        band_label(F.col(los_days), LOS_EDGES, LOS_LABELS).alias("los_group"),
    ).dropna()
    return bands.groupBy("age_group").pivot("los_group", LOS_LABELS).agg(F.count(F.lit(1))).fillna(0)


def summary_metrics(demographics: DataFrame, scores: DataFrame | None = None, score: str = "sofa") -> DataFrame:
    """Headline numbers of a cohort."""
    base = demographics.agg(
        F.count(F.lit(1)).alias("total_patients"), F.avg("age").alias("avg_age"),
        (F.avg((F.upper("gender") == "M").cast("double")) * 100).alias("male_pct"),
        (F.avg("los_hours") / 24).alias("avg_los"),
        (F.avg((~F.col("survived")).cast("double")) * 100).alias("mortality_rate"),
    )
    if scores is None:
        return base
    return base.withColumn("avg_sofa", scores.agg(F.avg(score)).scalar())


def diagnosis_shares(diagnoses: DataFrame, code: str, hierarchical: bool = False, top: int | None = None, other: str = "other") -> DataFrame:
    """Diagnosis categories (first path level or three characters) by count; with ``top`` the rest is one row, last."""
    category = F.split(code, r"\|")[0] if hierarchical else F.substring(code, 1, 3)
    counts = diagnoses.where(F.col(code).isNotNull()).groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts.orderBy(F.desc("n"), "category")
    first = counts.orderBy(F.desc("n"), "category").limit(top).withColumn("_rest", F.lit(0))
    rest = counts.join(first.select("category"), "category", "left_anti").agg(F.lit(other).alias("category"), F.sum("n").alias("n"), F.lit(1).alias("_rest"))
    return first.unionByName(rest.where("n IS NOT NULL")).orderBy("_rest", F.desc("n"), "category").drop("_rest")


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"))


def mortality_by_quartile(df: DataFrame, score: str, died: str) -> DataFrame:
    """Share of deaths per quartile of a score; cut points come from the whole table."""
    cuts = stats.quantiles(df, [], score, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    rows = stats.with_side(df.where(F.col(score).isNotNull()), cuts, [])
    s = F.col(score)
    quartile = F.when(s <= F.col("_q1"), "Q1").when(s <= F.col("_q2"), "Q2").when(s <= F.col("_q3"), "Q3").otherwise("Q4")
    return rows.groupBy(quartile.alias("quartile")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(died).cast("double")) * 100).alias("mortality_pct")
    )
