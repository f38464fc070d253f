"""Windows over long series without putting one series into one task.

A single stay may hold a large share of all rows, so no operator sorts more of a
series in one place than a task can hold. Long series are cut into slices and the
cluster works on (series, slice) groups:

* ``scan``     running aggregates over everything before a row: local running
               value inside the slice, plus a carry from the earlier slices of
               the series. Series of up to ``ROWS`` rows are one slice. The few
               that have more are counted per point of the series first, and cut
               where a count is full, so their slices have equal numbers of rows
               however the rows lie in time.
* ``framed``   aggregates over a bounded range around a row: rows are copied
               into the neighbouring slices they can reach, and copies are
               dropped after the window.
* ``row_framed``  the same for a bounded number of rows.
* ``fill_framed``  aggregates over the last points of a completed grid, from the
               rows alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from staygrid.schema import DAY, as_column, names

SLICE = "_slice"
OWN = "_own"
CELL = "_cell"
ROWS = 1 << 22  # rows of one series that a task sorts
PARTS = 1 << 10  # slices of one series, at most
POINTS = 1 << 12  # grid points of a slice


def time_slice(time: str | Column, width: int = DAY) -> Column:
    return F.floor(as_column(time) / F.lit(width))


def value_slice(value: str | Column, per_octave: int = 16) -> Column:
    """Monotone bucket of a number: fine near zero, logarithmic further out.

    At most about 32 thousand buckets exist over the whole double range.
    """
    v = as_column(value).cast("double")
    return F.signum(v).cast("long") * F.floor(F.log2(F.abs(v) + 1) * per_octave)


@dataclass(frozen=True)
class Acc:
    """One accumulated column: ``kind`` of ``value`` written to ``out``.

    Kinds: ``sum``, ``count``, ``min``, ``max`` (nulls skipped), and ``last`` /
    ``first`` (last or first non-null value in scan order).
    """

    out: str
    kind: str
    value: Column


def _over(kind: str, value: Column, window: WindowSpec) -> Column:
    if kind in ("last", "first"):
        return getattr(F, kind)(value, ignorenulls=True).over(window)
    return getattr(F, kind)(value).over(window)


def _total(acc: Acc, position: Column, reverse: bool) -> Column:
    if acc.kind in ("last", "first"):
        latest = (acc.kind == "last") != reverse
        pick = F.max_by if latest else F.min_by
        return pick(acc.value, F.when(acc.value.isNotNull(), position))
    return getattr(F, acc.kind)(acc.value)


def _across(kind: str, name: str, window: WindowSpec) -> Column:
    """Aggregate the per-slice totals; counts of slices add up."""
    return _over("sum" if kind == "count" else kind, F.col(name), window)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + local
    if kind == "sum":
        return F.coalesce(carry + local, carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "first":
        return F.coalesce(carry, local)
    raise ValueError(f"unknown kind: {kind}")


def _matches(df: DataFrame, side: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys of ``df`` and of ``side``, whose first columns they are; nulls are equal."""
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(side[s]) for k, s in zip(keys, side.columns)])


def crowded(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """The groups with more than ``rows`` rows: their keys as ``_key0``, ``_key1``, ... and ``_limit``, the rows of one slice.

    There is one such group for every ``rows`` rows of the table at most, which is what makes it a side to broadcast: some millions of
    short rows for 10^13 rows.
    """
    rows = rows or ROWS
    sizes = df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows)
    return sizes.withColumn("_limit", F.greatest(F.lit(rows), F.ceil(F.col("_rows") / PARTS))).drop("_rows")


def of_crowded(df: DataFrame, many: DataFrame, keys: list[str], others: bool = False) -> DataFrame:
    """The rows of the crowded groups, or of all ``others``."""
    return df.join(F.broadcast(many), _matches(df, many, keys), "left_anti" if others else "left_semi")


def _again(kind: str, name: str, position: str, reverse: bool) -> Column:
    """Totals of cells as the total of a slice."""
    if kind in ("last", "first"):
        pick = F.max_by if (kind == "last") != reverse else F.min_by
        return pick(name, F.when(F.col(name).isNotNull(), F.col(position)))
    return getattr(F, "sum" if kind == "count" else kind)(name)


def cuts(df: DataFrame, ids: list[str], order: list[str], accs: list[Acc], cell: Column, reverse: bool = False, rows: int | None = None,
         many: DataFrame | None = None) -> DataFrame:
    """Where crowded series are cut: a row for each of them, none for any other.

    Its rows are counted per cell and the counts run on from cell to cell; a slice ends where the count is full, so only a single cell
    can exceed it. ``_cuts`` has, for each slice, where it begins, its number and what the slices before it carry.
    """
    many, carried = crowded(df, ids, rows) if many is None else many, [f"_carry{i}" for i in range(len(accs))]
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    # the limit of the whole table is a scalar, not a join
    near = df.join(F.broadcast(many), _matches(df, many, ids)) if ids else df.withColumn("_limit", many.select("_limit").scalar()).where("_limit IS NOT NULL")
    cells = near.groupBy(*[df[c] for c in ids], cell.alias(CELL)).agg(
        F.min(order[0]).alias("_from"), F.count(F.lit(1)).alias("_n"), F.max("_limit").alias("_limit"),
        *[_total(a, position, reverse).alias(n) for a, n in zip(accs, carried)])
    so_far = Window.partitionBy(*ids).orderBy(CELL).rowsBetween(Window.unboundedPreceding, 0)
    numbered = cells.withColumn(SLICE, F.floor((F.sum("_n").over(so_far) - F.col("_n")) / F.col("_limit")))
    slices = numbered.groupBy(*ids, SLICE).agg(F.min("_from").alias("_from"), *[_again(a.kind, n, CELL, reverse).alias(n) for a, n in zip(accs, carried)])
    along = Window.partitionBy(*ids).orderBy(F.col(SLICE).desc() if reverse else F.col(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*ids, "_from", SLICE, *[_across(a.kind, n, along).alias(n) for a, n in zip(accs, carried)])
    found = slices.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("_from", SLICE, *carried))).alias("_cuts"))
    return found if ids else found.where(F.size("_cuts") > 0)


def with_slices(df: DataFrame, ids: list[str], point: str, cut: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Rows with the number of their slice, 0 for series that are not cut, and what earlier slices carry."""
    side = cut.withColumnsRenamed({c: f"_cut_{c}" for c in ids})
    here = F.element_at(F.filter("_cuts", lambda c: c["_from"] <= F.col(point)), -1)
    near = df.join(F.broadcast(side), _matches(df, side, ids), "left") if ids else df.withColumn("_cuts", side.select("_cuts").scalar())
    found = near.select(*df.columns, here.alias("_here"))
    return found.select(*df.columns, F.coalesce(f"_here.{SLICE}", F.lit(0)).alias(SLICE), *[F.col(f"_here.{n}").alias(n) for n in carried or []])


def scan(
    df: DataFrame,
    ids: list[str],
    order: str | list[str],
    accs: list[Acc],
    cell: Column | None = None,
    reverse: bool = False,
    exclusive: bool = False,
    rows: int | None = None,
    many: DataFrame | None = None,
) -> DataFrame:
    """Running aggregates over all rows up to (or before) the current one.

    ``reverse`` scans from the end; ``exclusive`` leaves the current row out.
    Adds one column per accumulator and keeps every row and column. A series of
    more than ``rows`` rows is cut into slices; ``cell``, a monotone expression of
    the first order column (that column itself by default: seconds), says in which
    steps it is counted before. ``many`` may name the ``crowded`` series where
    they are cheaper to find in another table. Without ``ids`` all rows are one series.
    """
    order = names(order)
    cell = cell if cell is not None else F.col(order[0])
    carried = [f"_carry{i}" for i in range(len(accs))]
    cut = with_slices(df, ids, order[0], cuts(df, ids, order, accs, cell, reverse, rows, many), carried)

    def sort(c: str) -> Column:
        return F.col(c).desc() if reverse else F.col(c).asc()

    inside = (
        Window.partitionBy(*ids, SLICE)
        .orderBy(*[sort(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    found = [f"_local{i}" for i in range(len(accs))]
    local = cut.select("*", *[_over(a.kind, a.value, inside).alias(n) for a, n in zip(accs, found)])
    outs = {a.out for a in accs}
    return local.select(
        *[c for c in df.columns if c not in outs],
        *[_combine(a.kind, F.col(c), F.col(n)).alias(a.out) for a, c, n in zip(accs, carried, found)],
    )


def totals(df: DataFrame, ids: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Attach whole-series aggregates to every row.

    The per-series side is pre-aggregated to one row; a hot series is then a
    skewed join partition, which adaptive execution splits.
    """
    per_id = df.groupBy(*ids).agg(*[v.alias(k) for k, v in aggregates.items()])
    return df.drop(*[c for c in aggregates if c in df.columns]).join(per_id, list(ids), "left")


def framed(
    df: DataFrame,
    ids: list[str],
    time: str,
    before: int,
    after: int,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    width: int | None = None,
    frame: tuple[int, int] | None = None,
) -> DataFrame:
    """Window expressions over ``[t - before, t + after]`` of each series.

    ``exprs`` map an output name to a function of the window. ``frame`` narrows
    the range inside the reach, for example ``(-172800, -1)``. One shuffle; each
    row is copied at most ``(before + after) / width`` extra times.
    """
    width = width or max(4 * (before + after), 1)
    spread = df.withColumn(
        SLICE,
        F.explode(F.sequence(
            F.floor((F.col(time) - F.lit(after)) / width),
            F.floor((F.col(time) + F.lit(before)) / width),
        )),
    )
    lo, hi = frame or (-before, after)
    window = Window.partitionBy(*ids, SLICE).orderBy(time).rangeBetween(lo, hi)
    own = (F.floor(F.col(time) / width) == F.col(SLICE)).alias(OWN)
    return (
        spread.select(
            *[c for c in df.columns if c not in exprs],
            own,
            *[make(window).alias(out) for out, make in exprs.items()],
        )
        .where(OWN)
        .drop(OWN)
    )


_MERGE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: F.coalesce(a + b, a, b),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


def grid_framed(
    df: DataFrame, ids: list[str], time: str, step: int, back: int, accs: list[Acc], slice_rows: int = 0,
) -> DataFrame:
    """Sums, counts, minima and maxima over the current and ``back`` grid points before.

    The series must be a complete grid. Time is cut into blocks as long as the
    frame, so a frame is the end of one block and the start of the next: two
    running aggregates and one lookup per row, however long the frame is.
    """
    rows = back + 1
    width = max(slice_rows, 4 * rows) * step
    t = F.col(time)
    spread = df.withColumns({
        SLICE: F.explode(F.sequence(F.floor(t / width), F.floor((t + back * step) / width))),
        "_block": F.floor(t / (rows * step)),
    }).withColumn(OWN, F.floor(t / width) == F.col(SLICE))
    block = Window.partitionBy(*ids, SLICE, "_block")
    up_to = (Window.unboundedPreceding, 0)
    rest = spread.select(
        "*", *[_over(a.kind, a.value, block.orderBy(t.desc()).rowsBetween(*up_to)).alias(f"_rest{i}") for i, a in enumerate(accs)]
    )
    along = Window.partitionBy(*ids, SLICE).orderBy("_block", time)
    tail = F.struct("_block", *[f"_rest{i}" for i in range(len(accs))])
    seen = rest.select(
        "*", *[_over(a.kind, a.value, block.orderBy(time).rowsBetween(*up_to)).alias(f"_head{i}") for i, a in enumerate(accs)],
    ).withColumn("_tail", F.coalesce(F.lag(tail, back).over(along), F.first(tail).over(along.rowsBetween(*up_to))))
    before = F.col("_tail._block") < F.col("_block")
    outs = {a.out for a in accs}
    return seen.where(OWN).select(
        *[c for c in df.columns if c not in outs],
        *[
            _MERGE[a.kind](F.col(f"_head{i}"), F.when(before, F.col(f"_tail._rest{i}"))).alias(a.out)
            for i, a in enumerate(accs)
        ],
    )


def fill_framed(
    df: DataFrame, ids: list[str], time: str, step: int, back: int, accs: list[Acc], end: Column | None = None, width: int = POINTS,
) -> DataFrame:
    """What ``grid_framed`` gives on the completed grid of each series, from the rows that are there.

    The grid runs from a series' first time to ``end``, an aggregate of the series (by default its last time); ``count`` counts grid
    points. Aggregates change only where a row comes in and where it leaves the frame, so those points are sorted and each of them is
    stretched to the next afterwards: no grid point is shuffled or sorted. A row leaves unseen where another row stands. Time is cut
    into slices of ``width`` grid points, whose first point is added.
    """
    rows, width, t = back + 1, max(width, 4 * (back + 1)), F.col(time)
    extent = df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(ids)]).agg(F.min(time).alias("_first"), (F.max(time) if end is None else end).alias("_end"))
    extent = extent.select(*[c for c in extent.columns if c != "_end"], F.floor((F.col("_end") - F.col("_first")) / step).alias("_size"))
    found = {f"_v{i}": a for i, a in enumerate(accs) if a.kind != "count"}
    placed = df.select("*", *[a.value.alias(n) for n, a in found.items()])
    placed = placed.join(extent, _matches(placed, extent, ids)).select(*ids, "_first", "_size", F.floor((t - F.col("_first")) / step).alias("_at"), *found)
    met = framed(placed.where("_at <= _size"), ids, "_at", 0, rows, {"_met": lambda w: F.count(F.lit(1)).over(w)}, width, (rows, rows))

    at, size, kind = F.col("_at"), F.col("_size"), F.col("_kind")
    here = F.floor(at / width)
    # 0: the row, 1: its copy in the next slice, 2: where it leaves, above: the first points of all later slices, made by the first row
    kinds = F.filter(F.array(
        F.lit(0).cast("long"), F.when(F.floor(F.least(at + back, size) / width) > here, F.lit(1)),
        F.when((F.col("_met") == 0) & (at + rows <= size), F.lit(2))), lambda x: x.isNotNull())
    later = F.transform(F.sequence(F.lit(1).cast("long"), F.floor(size / width)), lambda x: x + 2)
    points = met.select("*", F.explode(F.when((at == 0) & (size >= width), F.concat(kinds, later)).otherwise(kinds)).alias("_kind"))
    points = points.select(
        *ids, "_first", "_size",
        F.when(kind == 0, here).when(kind == 1, here + 1).when(kind == 2, F.floor((at + rows) / width)).otherwise(kind - 2).alias(SLICE),
        F.when(kind <= 1, at).when(kind == 2, at + rows).otherwise((kind - 2) * width).alias("_at"), *[F.when(kind <= 1, F.col(n)).alias(n) for n in found])

    along = Window.partitionBy(*ids, SLICE).orderBy("_at")
    seen = points.select(
        *ids, "_first", "_at", SLICE, F.coalesce(F.lead("_at").over(along), F.least(size + 1, (F.col(SLICE) + 1) * width)).alias("_next"),
        *[_over(a.kind, F.col(n), along.rangeBetween(-back, 0)).alias(n.replace("_v", "_w")) for n, a in found.items()])
    spans = seen.where((at >= F.col(SLICE) * width) & (F.col("_next") > at))
    grid = spans.select(*ids, "_first", F.explode(F.sequence(at, F.col("_next") - 1)).alias("_at"), *[n.replace("_v", "_w") for n in found])
    outs = [F.least(at + 1, F.lit(rows)) if a.kind == "count" else F.col(f"_w{i}") for i, a in enumerate(accs)]
    return grid.select(*ids, (F.col("_first") + at * step).cast(df.schema[time].dataType).alias(time), *[c.alias(a.out) for c, a in zip(outs, accs)])


def numbered(df: DataFrame, ids: list[str], order: str | list[str], out: str, cell: Column | None = None) -> DataFrame:
    """Row number within each series, from 1."""
    return scan(df, ids, order, [Acc(out, "count", F.lit(1))], cell)


def row_framed(
    df: DataFrame,
    ids: list[str],
    order: str | list[str],
    before: int,
    after: int,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    cell: Column | None = None,
    width: int = 4_096,
) -> DataFrame:
    """Window expressions over ``before`` rows back to ``after`` rows ahead."""
    with_row = numbered(df, ids, order, "_row", cell)
    return framed(with_row, ids, "_row", before, after, exprs, width=max(width, before + after + 1)).drop("_row")
