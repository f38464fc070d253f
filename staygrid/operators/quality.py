"""Data quality checks and comparison of two result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from staygrid.operators import stats
from staygrid.operators.rolling import time_consistency
from staygrid.schema import Table

# Plausible range per variable (inspired oxygen in percent).
RANGES = {
    "hr": (0, 300), "sbp": (0, 300), "dbp": (0, 200), "mbp": (0, 250), "resp": (0, 100), "temp": (25, 45),
    "spo2": (0, 100), "o2sat": (0, 100), "glucose": (0, 1000), "lactate": (0, 50), "creatinine": (0, 30),
    "bilirubin": (0, 100), "wbc": (0, 500), "platelets": (0, 2000), "hemoglobin": (0, 25), "hematocrit": (0, 100),
    "sodium": (100, 200), "potassium": (0, 15), "chloride": (50, 150), "bicarbonate": (0, 100), "bun": (0, 300),
    "calcium": (0, 20), "magnesium": (0, 10), "phosphate": (0, 20), "albumin": (0, 10), "ph": (6.5, 8.0),
    "pco2": (10, 150), "po2": (10, 700), "fio2": (0, 100), "gcs": (3, 15), "sofa": (0, 24), "sirs": (0, 4),
    "qsofa": (0, 3), "apache": (0, 299), "saps": (0, 163), "weight": (0, 500), "height": (0, 300), "bmi": (5, 100),
    "age": (0, 120),
}


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "value")


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def validate_ranges(df: DataFrame, columns: list[str], custom: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per variable: values, actual and expected range, and how many lie outside."""
    ranges = {**RANGES, **(custom or {})}
    known = {c: ranges[c.lower()] for c in columns if c.lower() in ranges}
    lo = F.coalesce(*[F.when(F.col("variable") == c, F.lit(float(r[0]))) for c, r in known.items()], F.lit(None).cast("double"))
    hi = F.coalesce(*[F.when(F.col("variable") == c, F.lit(float(r[1]))) for c, r in known.items()], F.lit(None).cast("double"))
    values = _long(df, columns).where("value IS NOT NULL").withColumns({"_lo": lo, "_hi": hi})
    outside = F.count_if((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi")))
    return values.groupBy("variable").agg(
        F.count("value").alias("n_values"),
        F.max("_lo").alias("expected_min"), F.max("_hi").alias("expected_max"),
        F.min("value").alias("actual_min"), F.max("value").alias("actual_max"),
        outside.alias("n_out_of_range"), _percent(outside, F.count("value")).alias("pct_out_of_range"),
        F.max("_lo").isNotNull().alias("range_defined"),
    )


def check_missing(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Missing and present values per data column, in one pass over the table."""
    columns = [c for c in df.columns if c not in (keys or [])]
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    ).unpivot("_rows", columns, "variable", "n_missing")
    rows = F.col("_rows")
    return counted.select(
        "variable", rows.alias("n_total"), "n_missing", (rows - F.col("n_missing")).alias("n_present"),
        _percent(F.col("n_missing"), rows).alias("pct_missing"),
        _percent(rows - F.col("n_missing"), rows).alias("pct_present"),
    )


def check_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows that share their keys with another row."""
    keys = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    twice = F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))
    return keys.agg(
        rows.alias("n_total_rows"), twice.alias("n_duplicate_rows"), (rows - twice).alias("n_unique_rows"),
        _percent(twice, rows).alias("pct_duplicates"),
    )


def report(df: DataFrame, ids: list[str], time: str | None, ranges: list[str] | None = None) -> DataFrame:
    """All checks as (check, variable, metric, value) rows."""
    keys = [*ids, *([time] if time else [])]
    data = [c for c in df.columns if c not in keys]

    def flat(frame: DataFrame, check: str, variable: str | None, metrics: list[str]) -> DataFrame:
        name = F.col(variable) if variable else F.lit(None).cast("string")
        typed = frame.select(name.alias("variable"), *[F.col(m).cast("double").alias(m) for m in metrics])
        return typed.unpivot("variable", metrics, "metric", "value").select(F.lit(check).alias("check"), "variable", "metric", "value")

    # rows, patients, missing and out-of-range values come from one aggregate
    ranged = [c for c in (ranges if ranges is not None else data) if c.lower() in RANGES]
    number = {c: F.col(c).try_cast("double") for c in ranged}
    outside = {c: (number[c] < float(RANGES[c.lower()][0])) | (number[c] > float(RANGES[c.lower()][1])) for c in ranged}
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), F.countDistinct(ids[0]).alias("_patients"),
        *[F.count_if(F.col(c).isNull()).alias(f"_missing{i}") for i, c in enumerate(data)],
        *[F.count(number[c]).alias(f"_known{i}") for i, c in enumerate(ranged)],
        *[F.count_if(outside[c]).alias(f"_outside{i}") for i, c in enumerate(ranged)],
    )
    rows = F.col("_rows")
    lines = [("basic", None, "n_rows", rows), ("basic", None, "n_columns", F.lit(len(df.columns))), ("basic", None, "n_patients", F.col("_patients"))]
    for i, c in enumerate(data):
        lines += [("missing", c, "n_missing", F.col(f"_missing{i}")), ("missing", c, "pct_missing", _percent(F.col(f"_missing{i}"), rows))]
    for i, c in enumerate(ranged):
        lines += [("range", c, "n_out_of_range", F.col(f"_outside{i}")), ("range", c, "pct_out_of_range", _percent(F.col(f"_outside{i}"), F.col(f"_known{i}")))]
    cells = [
        F.struct(F.lit(check).alias("check"), F.lit(c).cast("string").alias("variable"), F.lit(metric).alias("metric"), v.cast("double").alias("value"))
        for check, c, metric, v in lines
    ]
    parts = [
        counted.select(F.inline(F.array(*cells))),
        flat(check_duplicates(df, keys), "duplicates", None, ["n_duplicate_rows", "pct_duplicates"]),
    ]
    if time:
        gaps = time_consistency(df, ids, time).agg(F.count(F.lit(1)).alias("n_time_issues"))
        parts.append(flat(gaps, "time", None, ["n_time_issues"]))
    return reduce(DataFrame.unionByName, parts)


def column_report(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per column: type, rows, missing, distinct values, and a summary if numeric."""
    columns = [c for c in df.columns if c not in (keys or [])]
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in columns if isinstance(kinds[c], T.NumericType)]
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "variable", "text")
    # distinct values are counted per (column, value) first, so no column is gathered
    distinct = as_text.groupBy("variable", "text").agg(F.count(F.lit(1)).alias("_n")).groupBy("variable").agg(
        F.sum("_n").alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("_n"))), F.lit(0)).alias("n_missing"),
        F.count("text").alias("n_distinct"),
    )
    types = F.coalesce(*[F.when(F.col("variable") == c, F.lit(kinds[c].simpleString())) for c in columns])
    out = distinct.select(
        "variable", types.alias("dtype"), "n_total", "n_missing",
        _percent(F.col("n_missing"), F.col("n_total")).alias("pct_missing"), "n_distinct",
    )
    if not numeric:
        return out
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in numeric])
    return out.join(stats.summary(doubles, numeric).drop("count"), "variable", "left")


def cohort_info(df: DataFrame, ids: list[str], time: str | None = None) -> DataFrame:
    """One row: patients, rows, time range, number of variables, missing cells."""
    data = [c for c in df.columns if c not in [*ids, time]]
    empty = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    span = [F.min(time).alias("start_time"), F.max(time).alias("end_time"), (F.max(time) - F.min(time)).alias("duration")] if time else []
    return df.agg(
        F.countDistinct(ids[0]).alias("n_patients"), F.count(F.lit(1)).alias("n_observations"), *span,
        F.lit(len(data)).alias("n_variables"),
        _percent(empty, F.count(F.lit(1)) * len(df.columns)).alias("missing_pct"),
    )


def validate_circulation(df: DataFrame) -> DataFrame:
    """Missing rate of each input and a warning above one half; missing columns are listed too."""
    required = ["lactate_elevated", "map_low", "circ_event"]
    inputs = [c for c in ("lact", "lac", "lactate", "map", "norepi_rate", "epi_rate", "vaso_rate") if c in df.columns]
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in inputs]).unpivot([], inputs, "column", "missing_rate")
    found = rates.select("column", "missing_rate", F.when(F.col("missing_rate") > 0.5, "high missing rate").alias("warning"))
    absent = [c for c in required if c not in df.columns]
    if not absent:
        return found
    rows = df.sparkSession.createDataFrame([(c, None, "missing column") for c in absent], "column string, missing_rate double, warning string")
    return found.unionByName(rows)


def validate_table(table: Table, required: list[str] | None = None, min_rows: int = 1, no_na: list[str] | None = None) -> DataFrame:
    """Checks of a table kind as (check, passed) rows."""
    df = table.df
    needed = [*table.meta_vars, *(required or [])]
    absent = [c for c in needed if c not in df.columns]
    if absent:
        return df.sparkSession.createDataFrame([(f"has column {c}", False) for c in absent], "check string, passed boolean")
    keys = df.groupBy(*table.meta_vars).agg(F.count(F.lit(1)).alias("_n"))
    checks = {"min_rows": F.coalesce(F.sum("_n"), F.lit(0)) >= min_rows, "unique_keys": F.coalesce(F.max("_n") <= 1, F.lit(True))}
    for c in table.meta_vars:
        checks[f"no missing {c}"] = F.count_if(F.col(c).isNull()) == 0
    if table.dur:
        checks["durations not negative"] = F.count_if(F.col(table.dur) < 0) == 0
    passed = keys.agg(*[v.alias(k) for k, v in checks.items()]).unpivot([], list(checks), "check", "passed")
    if no_na:
        nulls = df.agg(*[(F.count_if(F.col(c).isNull()) == 0).alias(f"no missing {c}") for c in no_na])
        passed = passed.unionByName(nulls.unpivot([], [f"no missing {c}" for c in no_na], "check", "passed"))
    return passed


def no_na(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: are all these columns free of nulls."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.agg((F.count_if(any_null) == 0).alias("no_na"))


def has_rows(df: DataFrame) -> DataFrame:
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))


def has_columns(df: DataFrame, columns: list[str]) -> bool:
    return set(columns) <= set(df.columns)


def has_time_columns(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) for f in df.schema)


def same_time_type(a: DataFrame, b: DataFrame, time: str) -> bool:
    return a.schema[time].dataType == b.schema[time].dataType


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing values per concept."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).unpivot(
        [], columns, "concept", "missing_rate"
    )


# --- comparing two results -----------------------------------------------------------

def series_stats(long: DataFrame, concept: str, time: str, value: str) -> DataFrame:
    """Rows, coverage, mean, maximum and first positive time per concept."""
    v = F.col(value)
    return long.groupBy(concept).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("non_null"),
        F.avg(v).alias("mean"), F.max(v).alias("maximum"),
        F.min(F.when(v > 0, F.col(time))).alias("first_signal"),
    ).withColumn("coverage", F.try_divide(F.col("non_null"), F.col("rows")))


def compare_results(a: DataFrame, b: DataFrame, concept: str, time: str, value: str) -> DataFrame:
    """Two long results per concept: statistics of both, gaps and a status."""
    left = series_stats(a, concept, time, value)
    right = series_stats(b, concept, time, value)
    columns = ["rows", "non_null", "mean", "maximum", "first_signal", "coverage"]
    joined = left.withColumnsRenamed({c: f"a_{c}" for c in columns}).join(
        right.withColumnsRenamed({c: f"b_{c}" for c in columns}), concept, "full"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (
        F.when((zero("b_rows") == 0) & (zero("a_rows") > 0), "missing:b")
        .when((zero("b_rows") > 0) & (zero("a_rows") == 0), "missing:a")
        .when((zero("a_non_null") > 0) & (zero("b_non_null") == 0), "missing:b")
        .otherwise("ok")
    )
    return joined.withColumns({
        "coverage_gap": zero("a_coverage") - zero("b_coverage"),
        "mean_diff": F.col("b_mean") - F.col("a_mean"),
        "status": status,
    })


def split_wide(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide table to (keys, concept, value) without missing rows."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(keys, columns, "concept", "value").where("value IS NOT NULL")


def compare_wide(a: DataFrame, b: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """Module-wise comparison of two wide tables on their common grid."""
    grid = a.select(*keys).unionByName(b.select(*keys)).distinct()
    sides = [split_wide(grid.join(side, keys, "left"), keys, columns) for side in (a, b)]
    return compare_results(*sides, "concept", time, "value")
