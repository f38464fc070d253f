"""Suspected infection and Sepsis-3 onset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from staygrid.operators.asof import asof
from staygrid.operators.intervals import hop
from staygrid.operators.rolling import delta_cummin, delta_min, delta_start, slide
from staygrid.operators.slices import framed, row_framed
from staygrid.schema import DAY, HOUR

_DELTAS = {"cummin": delta_cummin, "start": delta_start, "min": delta_min}


def antibiotics(abx: DataFrame, ids: list[str], time: str, count_win: int = 24 * HOUR, min_count: int = 1) -> DataFrame:
    """Antibiotic rows with at least ``min_count`` doses from then on within the window."""
    rows = abx.withColumn("abx", F.col("abx").cast("int")) if "abx" in abx.columns else abx.withColumn("abx", F.lit(1))
    if min_count > 1:
        rows = slide(rows, ids, time, 0, count_win, {"abx": ("sum", "abx")})
    return rows.where(F.col("abx") >= min_count)


def samples(samp: DataFrame, positive_only: bool = False) -> DataFrame:
    rows = samp.withColumn("samp", F.col("samp").cast("int")) if "samp" in samp.columns else samp.withColumn("samp", F.lit(1))
    return rows.where(F.col("samp") > 0) if positive_only else rows.where(F.col("samp").isNotNull())


def si_and(
    abx: DataFrame, samp: DataFrame, ids: list[str], time: str, abx_win: int = 24 * HOUR, samp_win: int = 72 * HOUR,
    keep_components: bool = False,
) -> DataFrame:
    """An antibiotic followed by a sample, or a sample followed by an antibiotic.

    Existence only needs the next event of the other kind, so no pairs are built.
    """
    a, s = abx.select(*ids, time).distinct(), samp.select(*ids, time).distinct()
    by_abx = asof(a, s, ids, time, [], "forward", abx_win - 1, "_other").where("_other IS NOT NULL")
    by_samp = asof(s, a, ids, time, [], "forward", samp_win - 1, "_other").where("_other IS NOT NULL")
    both = by_abx.select(*ids, time, F.lit(0).alias("_rank"), F.col(time).alias("abx_time"), F.col("_other").alias("samp_time"))
    both = both.unionByName(
        by_samp.select(*ids, time, F.lit(1).alias("_rank"), F.col("_other").alias("abx_time"), F.col(time).alias("samp_time"))
    )
    one = both.groupBy(*ids, time).agg(
        F.min_by("abx_time", "_rank").alias("abx_time"), F.min_by("samp_time", "_rank").alias("samp_time")
    ).withColumn("susp_inf", F.lit(True))
    return one if keep_components else one.drop("abx_time", "samp_time")


def si_or(abx: DataFrame, samp: DataFrame, ids: list[str], time: str, keep_components: bool = False) -> DataFrame:
    """Any antibiotic or sample time."""
    stacked = abx.select(*ids, time, F.lit(True).alias("_a"), F.lit(False).alias("_s")).unionByName(
        samp.select(*ids, time, F.lit(False).alias("_a"), F.lit(True).alias("_s"))
    )
    any_of = stacked.groupBy(*ids, time).agg(F.bool_or("_a").alias("_a"), F.bool_or("_s").alias("_s"))
    out = any_of.withColumns({
        "abx_time": F.when(F.col("_a"), F.col(time)), "samp_time": F.when(F.col("_s"), F.col(time)),
        "susp_inf": F.lit(True),
    }).drop("_a", "_s")
    return out if keep_components else out.drop("abx_time", "samp_time")


def susp_inf(
    abx: DataFrame, samp: DataFrame | None, ids: list[str], time: str, mode: str = "and", abx_count_win: int = 24 * HOUR,
    abx_min_count: int = 1, positive_cultures: bool = False, abx_win: int = 24 * HOUR, samp_win: int = 72 * HOUR,
    keep_components: bool = False, diagnosed: DataFrame | None = None,
) -> DataFrame:
    """Suspected infection.

    Modes: ``and``, ``or``, ``abx``, ``samp``, ``icd_abx`` (antibiotics of ids
    with an infection diagnosis) and ``auto`` (``and``, or ``icd_abx`` where no
    samples are given; that mode needs the diagnoses and is refused without).
    """
    if mode == "auto":
        mode = "and" if samp is not None else "icd_abx"
    if mode == "icd_abx" and diagnosed is None:
        raise ValueError("without samples a suspected infection needs the ids with an infection diagnosis")
    if mode in ("and", "or", "samp") and samp is None:
        raise ValueError(f"mode {mode} needs samples")
    treated = antibiotics(abx, ids, time, abx_count_win, abx_min_count)
    if mode == "icd_abx":
        treated = treated.join(diagnosed.select(*ids).distinct(), ids, "left_semi")
    if mode in ("abx", "icd_abx"):
        return treated.select(*ids, time, F.lit(True).alias("susp_inf")).distinct()
    taken = samples(samp, positive_cultures)
    if mode == "samp":
        return taken.select(*ids, time, F.lit(True).alias("susp_inf")).distinct()
    if mode == "or":
        return si_or(treated, taken, ids, time, keep_components)
    if mode == "and":
        return si_and(treated, taken, ids, time, abx_win, samp_win, keep_components)
    raise ValueError(f"unknown mode: {mode}")


def sep3(
    sofa: DataFrame, infection: DataFrame, ids: list[str], time: str, score: str = "sofa", si_window: str = "first",
    delta: str = "cummin", threshold: int = 2, si_lwr: int = 48 * HOUR, si_upr: int = 24 * HOUR,
    keep_components: bool = False, out: str = "sep3",
) -> DataFrame:
    """First time per id at which the score has risen enough near an infection.

    ``si_window`` looks at the first, last or any suspected infection. The rise
    is taken over the whole series by ``delta`` (``cummin``, ``start``, ``min``).
    """
    known = infection
    if "susp_inf" in infection.columns:
        known = infection.where(F.coalesce(F.col("susp_inf").cast("boolean"), F.lit(False)))
    extra = [c for c in ("abx_time", "samp_time") if c in infection.columns]
    events = known.select(*ids, F.col(time).alias("_si"), *extra)
    risen = _DELTAS[delta](sofa.select(*ids, time, score), ids, time, score, out="delta_sofa")
    risen = risen.where(F.col("delta_sofa") >= threshold)
    at = F.struct(F.col("_si").alias("si"), *[F.col(c) for c in extra])
    if si_window in ("first", "last"):
        pick = F.min if si_window == "first" else F.max
        hit = risen.join(events.groupBy(*ids).agg(pick(at).alias("_at")), ids)
        hit = hit.where(F.col(time).between(F.col("_at.si") - si_lwr, F.col("_at.si") + si_upr))
    else:
        # earliest infection whose window covers the row: one window pass over both tables
        marks = events.select(*ids, F.col("_si").alias(time), at.alias("_event"))
        stacked = risen.withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
        near = framed(stacked, ids, time, si_upr, si_lwr, {"_at": lambda w: F.min("_event").over(w)})
        hit = near.where(F.col("_row") & F.col("_at").isNotNull())
    first = hit.groupBy(*ids).agg(F.min_by(F.struct(time, "delta_sofa", "_at"), time).alias("_hit"))
    kept = [F.col("_hit.delta_sofa").alias("delta_sofa"), *[F.col(f"_hit._at.{c}").alias(c) for c in extra]]
    return first.select(*ids, F.col(f"_hit.{time}").alias(time), F.lit(True).alias(out), *(kept if keep_components else []))


def sep3_sofa2(
    sofa2: DataFrame, infection: DataFrame, ids: list[str], time: str, score: str = "sofa2", si_window: str = "first",
    delta: str = "cummin", threshold: int = 2, si_lwr: int = 48 * HOUR, si_upr: int = 24 * HOUR,
    keep_components: bool = False,
) -> DataFrame:
    """The same by SOFA-2, with the rise taken inside each infection window only."""
    events = infection
    if "susp_inf" in infection.columns:
        events = infection.where(F.coalesce(F.col("susp_inf").cast("boolean"), F.lit(False)))
    events = events.groupBy(*ids, F.col(time).alias("_si")).agg(F.lit(1).alias("_one")).drop("_one")
    if si_window in ("first", "last"):
        events = events.groupBy(*ids).agg((F.min if si_window == "first" else F.max)("_si").alias("_si"))
    rows = sofa2.select(*ids, time, F.col(score).alias("_score"))
    if si_window == "any" and delta in ("cummin", "min"):
        # of the windows that cover a row the earliest reaches back furthest, so its rise is the greatest
        ahead = rows.withColumn("_from", F.col(time) - si_upr)
        near = asof(ahead, events.withColumnRenamed("_si", "_from"), ids, "_from", [], "forward", si_lwr + si_upr, "_si").where("_si IS NOT NULL")
        opens = F.col("_si") - si_lwr
        if delta == "min":
            near = row_framed(near.drop("_from"), ids, time, 23, 0, {"_back": lambda w: F.min(time).over(w)})
            opens = F.greatest(opens, F.col("_back"))
        near = near.select(*ids, time, "_score", "_si", opens.alias("_open"))
        spans = near.select(*ids, "_open", F.col(time).alias("_close")).distinct()
        low = hop(rows, spans, ids, time, "_open", "_close", {"_low": ("min", "_score")}).withColumnRenamed("_close", time)
        return _first_rise(near.join(low, [*ids, "_open", time]).withColumn("delta_sofa2", F.col("_score") - F.col("_low")), ids, time, threshold, keep_components)
    # rows meet the windows of their time tile; a group is one window of one series
    lo, hi = F.col("_si") - si_lwr, F.col("_si") + si_upr
    tiles = events.withColumn("_tile", F.explode(F.sequence(F.floor(lo / DAY), F.floor(hi / DAY))))
    # the few windows are hashed, so that the rows of the score are not sorted for them
    near = rows.withColumn("_tile", F.floor(F.col(time) / DAY)).join(tiles.hint("shuffle_hash"), [*ids, "_tile"]).where(F.col(time).between(lo, hi))
    window = Window.partitionBy(*ids, "_si").orderBy(time)
    base = {
        "cummin": F.min("_score").over(window.rowsBetween(Window.unboundedPreceding, 0)),
        "start": F.first("_score", ignorenulls=True).over(
            window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "min": F.min("_score").over(window.rowsBetween(-23, 0)),
    }[delta]
    return _first_rise(near.withColumn("delta_sofa2", F.col("_score") - base), ids, time, threshold, keep_components)


def _first_rise(rises: DataFrame, ids: list[str], time: str, threshold: int, keep_components: bool) -> DataFrame:
    risen = rises.where(F.col("delta_sofa2") >= threshold)
    first = risen.groupBy(*ids).agg(F.min_by(F.struct(time, "delta_sofa2"), F.struct(time, "_si")).alias("_hit"))
    kept = [F.col("_hit.delta_sofa2").alias("delta_sofa2")] if keep_components else []
    return first.select(*ids, F.col(f"_hit.{time}").alias(time), F.lit(True).alias("sep3_sofa2"), *kept)


def label_sep3(sofa: DataFrame, infection: DataFrame, ids: list[str], time: str, delta_sofa: int = 2, **kwargs) -> DataFrame:
    return sep3(sofa, infection, ids, time, threshold=delta_sofa, **kwargs)


def onset(
    sofa: DataFrame, infection: DataFrame, ids: list[str], time: str, score: str = "sofa", system: str = "SOFA-1", **kwargs
) -> DataFrame:
    """Onset table of one scoring system."""
    found = sep3(sofa, infection, ids, time, score=score, keep_components=True, **kwargs)
    return found.select(*ids, F.col(time).alias("onset_time"), "delta_sofa", F.lit(system).alias("sofa_system"), "sep3")


def compare_onsets(first: DataFrame, second: DataFrame, ids: list[str], tolerance: int = HOUR) -> DataFrame:
    """Onset by two scoring systems side by side, times in seconds."""
    a = first.select(*ids, F.col("onset_time").alias("onset_time_sofa1")).distinct()
    b = second.select(*ids, F.col("onset_time").alias("onset_time_sofa2")).distinct()
    gap = (F.col("onset_time_sofa2") - F.col("onset_time_sofa1")) / HOUR
    earlier = (
        F.when(F.col("onset_time_sofa1").isNull(), "SOFA-2").when(F.col("onset_time_sofa2").isNull(), "SOFA-1")
        .when(gap < 0, "SOFA-2 earlier").when(gap > 0, "SOFA-1 earlier").otherwise("same")
    )
    return a.join(b, ids, "full").withColumns({
        "time_diff_hours": gap,
        "agreement": F.coalesce(F.abs(gap) <= tolerance / HOUR, F.lit(False)),
        "earlier_onset": earlier,
    })
