"""Operators on (start, end) windows: merging, lookup, aggregation inside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from staygrid.operators.asof import asof
from staygrid.operators.slices import Acc, crowded, scan
from staygrid.schema import HOUR


def merge_ranges(df: DataFrame, ids: list[str], start: str, end: str, max_gap: int = 0) -> DataFrame:
    """Union of windows that overlap or lie at most ``max_gap`` apart."""
    rows = df.select(*ids, start, end).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    order = [start, end]
    reach = scan(rows, ids, order, [Acc("_reach", "max", F.col(end))], exclusive=True)
    fresh = F.when(F.coalesce(F.col(start) > F.col("_reach") + max_gap, F.lit(True)), 1)
    islands = scan(reach, ids, order, [Acc("_island", "count", fresh)])
    return islands.groupBy(*ids, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def inside(df: DataFrame, windows: DataFrame, ids: list[str], time: str, start: str, end: str) -> DataFrame:
    """Rows inside one of the disjoint windows of their series, ends included."""
    hit = asof(df, windows.select(*ids, F.col(start).alias(time), F.col(end).alias("_until")), ids, time, ["_until"])
    return hit.where(F.col(time) <= F.col("_until")).drop("_until")


# Running values each aggregate is read from.
_PARTS = {
    "sum": ("sum", "count"), "count": ("count",), "mean": ("sum", "count"), "std": ("sum", "count", "squares"), "min": (), "max": (),
}
BLOCK = 512  # rows in a block whose least and greatest values are known


def hop(
    df: DataFrame, windows: DataFrame, ids: list[str], time: str, start: str, end: str,
    aggs: dict[str, tuple[str, str]], left_closed: bool = True, right_closed: bool = True, rows: int | None = None,
) -> DataFrame:
    """Aggregates of the rows inside each window; windows without rows give none.

    No row is paired with a window. Rows and both ends of each window are laid into one
    series; a running count and running sums are read at the ends, and their
    differences are the count, sum, mean and deviation of the window. A least or
    greatest value has no difference: ``_extremes`` finds it in blocks of rows, from
    the first to the last row number of the window. Repeated windows are computed once.
    """
    used = sorted({c for _, c in aggs.values()})
    parts = sorted({(part, c) for f, c in aggs.values() for part in _PARTS[f]})
    slot = {key: f"_p{i}" for i, key in enumerate(parts)}
    t = F.col(time)
    spans = windows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*ids, start, end).agg(F.count(F.lit(1)).alias("_copies"))
    # at one time: starts of closed windows, ends of open ones, rows, starts of open windows, ends of closed ones
    before, after = (F.lit(0) if left_closed else F.lit(2)), (F.lit(2) if right_closed else F.lit(0))
    edges = F.explode(F.array(F.struct(F.col(start).alias("at"), before.alias("kind"), F.lit(False).alias("last")),
                              F.struct(F.col(end).alias("at"), after.alias("kind"), F.lit(True).alias("last"))))
    marks = spans.select(*ids, start, end, "_copies", edges.alias("_edge")).select(
        *ids, F.col("_edge.at").alias(time), F.col("_edge.kind").alias("_kind"), F.col("_edge.last").alias("_last"), start, end, "_copies")
    stacked = df.where(t.isNotNull()).select(*ids, time, F.lit(1).alias("_kind"), *used).unionByName(marks, allowMissingColumns=True)

    def acc(key: tuple[str, str]) -> Acc:
        part, c = key
        return Acc(slot[key], "sum", F.col(c) * F.col(c)) if part == "squares" else Acc(slot[key], part, F.col(c))

    accs = [Acc("_row", "count", F.when(F.col("_last").isNull(), 1)), *[acc(k) for k in parts]]
    read = scan(stacked, ids, [time, "_kind"], accs, rows=rows, many=crowded(df, ids, rows))
    at = lambda c, last: F.coalesce(F.max(F.when(F.col("_last") == last, F.col(c))), F.lit(0))
    found = read.where("_last IS NOT NULL").groupBy(*ids, start, end).agg(
        F.max("_copies").alias("_copies"), at("_row", False).alias("_from"), at("_row", True).alias("_to"),
        *[(at(n, True) - at(n, False)).alias(n) for n in slot.values()]).where("_to > _from")

    lowest = {o: (f, c) for o, (f, c) in aggs.items() if f in ("min", "max")}
    if lowest:
        found = _extremes(read.where("_last IS NULL").select(*ids, "_row", *used), found, ids, lowest)

    def final(out: str, f: str, c: str) -> Column:
        if out in lowest:
            return F.col(out)
        n = F.col(slot[("count", c)])
        if f == "count":
            return n
        total = F.col(slot[("sum", c)])
        if f == "mean":
            return F.try_divide(total, n)
        if f == "std":
            return F.when(n > 1, F.sqrt(F.greatest(F.col(slot[("squares", c)]) - total * total / n, F.lit(0.0)) / (n - 1)))
        return F.when(n > 0, total)

    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return found.select(*ids, start, end, *[final(o, f, c).alias(o) for o, (f, c) in aggs.items()], copies).drop("_copy")


def _extremes(numbered: DataFrame, spans: DataFrame, ids: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Least and greatest values of the rows ``_from + 1`` to ``_to`` of each span.

    The rows of a series lie in blocks of ``BLOCK``, the blocks in larger blocks, and those in one array per series. A span asks for a
    part of its first and last block, of the larger blocks that hold the whole blocks between, and of that array: five parts at most,
    however many rows it covers.
    """
    outs = list(aggs)
    items = numbered.select(*ids, (F.col("_row") - 1).alias("_at"), *[F.col(c).alias(o) for o, (_, c) in aggs.items()])
    levels = []
    for level in range(3):
        node = F.expr(f"_at div {BLOCK}") if level < 2 else F.lit(0).cast("long")
        blocks = items.groupBy(*ids, node.alias("_node")).agg(
            F.array_sort(F.collect_list(F.struct("_at", *outs))).alias("_items"), *[getattr(F, f)(o).alias(o) for o, (f, _) in aggs.items()])
        levels.append(blocks.select(*ids, F.lit(level).alias("_level"), "_node", "_items"))
        items = blocks.select(*ids, F.col("_node").alias("_at"), *outs)
    nodes = reduce(DataFrame.unionByName, levels)

    def parts(level: int, first: Column, last: Column, some: Column) -> tuple[list[Column], Column, Column, Column]:
        """What a range of items asks of a level, and the range of whole blocks that is left for the next."""
        a, b = F.floor(first / BLOCK), F.floor(last / BLOCK)
        ask = lambda node, at, n: F.struct(F.lit(level).alias("level"), node.cast("long").alias("node"), at.cast("int").alias("at"), n.cast("int").alias("n"))
        left = F.when(some, ask(a, first - a * BLOCK + 1, F.when(a == b, last - first + 1).otherwise(BLOCK)))
        right = F.when(some & (a != b), ask(b, F.lit(1), last - b * BLOCK + 1))
        return [left, right], a + 1, b - 1, some & (b - a > 1)

    asked, first, last, some = parts(0, F.col("_from"), F.col("_to") - 1, F.lit(True))
    more, first, last, some = parts(1, first, last, some)
    top = F.when(some, F.struct(F.lit(2).alias("level"), F.lit(0).cast("long").alias("node"), (first + 1).cast("int").alias("at"), (last - first + 1).cast("int").alias("n")))
    kept = [c for c in spans.columns if c not in ids]
    wanted = spans.select(*[F.col(c).alias(f"_of_{c}") for c in ids], F.struct(*kept).alias("_span"), F.explode(F.filter(F.array(*asked, *more, top), lambda r: r.isNotNull())).alias("_ask"))
    met = wanted.join(nodes, reduce(lambda x, y: x & y, [F.col(f"_of_{c}").eqNullSafe(F.col(c)) for c in ids]) & (F.col("_ask.level") == F.col("_level")) & (F.col("_ask.node") == F.col("_node")))
    part = F.slice("_items", F.col("_ask.at"), F.col("_ask.n"))
    pick = {"min": F.array_min, "max": F.array_max}
    found = met.select(*ids, "_span", *[pick[f](part[o]).alias(o) for o, (f, _) in aggs.items()])
    both = found.groupBy(*ids, "_span").agg(*[getattr(F, f)(o).alias(o) for o, (f, _) in aggs.items()])
    return both.select(*ids, *[F.col(f"_span.{c}").alias(c) for c in kept], *outs)


def sustained_rate(
    rates: DataFrame, durations: DataFrame, ids: list[str], time: str, rate: str, dur: str,
    out: str, min_length: int = HOUR, max_gap: int = 300, step: int = HOUR,
) -> DataFrame:
    """Highest rate per interval during infusions that last at least ``min_length``.

    Start times are floored to the hour, windows at most ``max_gap`` apart are
    joined, and rates outside the remaining windows are dropped.
    """
    hour = lambda c: F.floor(F.col(c) / HOUR) * HOUR
    windows = durations.where(F.col(dur) > 0).select(*ids, hour(time).alias("_start"), (hour(time) + F.col(dur)).alias("_end"))
    lasting = merge_ranges(windows, ids, "_start", "_end", max_gap).where(F.col("_end") - F.col("_start") >= min_length)
    rows = rates.where(F.col(rate).isNotNull()).select(*ids, hour(time).alias(time), rate)
    kept = inside(rows, lasting, ids, time, "_start", "_end")
    return kept.groupBy(*ids, (F.floor(F.col(time) / step) * step).alias(time)).agg(F.max(rate).alias(out))
