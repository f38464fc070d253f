"""Shards by a k-d tree: nodes split at weighted medians along their widest dimension until the leaves have the target size.

All nodes of a level are split together. A split looks for the row at which the node's running weight, in the order (dimension,
tie column, id), reaches the left side's share. It narrows an interval of values: one aggregation counts the weight in at most
``BUCKETS`` equal parts of every node's interval, and the part that holds the median becomes the next interval. Where one value
holds the median the search goes on in the next column of the order, so a value or a text that a third of all rows share is split
between its rows like anything else. The driver sees one row for each node; rows are never sorted or gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from staygrid.llm.shared import settle

BUCKETS = 1024
BLOCK = 100_000  # rows numbered together
_STATE = "node int, dim int, col int, p0 long, p1 long, lo long, hi long, width long, below long, target double"
_CUT = "node int, dim int, col int, v0 long, v1 long, v2 long, upto boolean, left_shards int"


@dataclass
class _Search:
    """Where a node's weighted median is looked for: an interval of one column, given values of the columns before it."""

    node: int
    shards: int
    target: float
    dim: int
    lo: int
    hi: int
    ids: tuple[int, int]
    prefix: list[int] = field(default_factory=list)
    below: int = 0
    cut: tuple | None = None

    def row(self) -> tuple:
        p = [*self.prefix, 0, 0]
        return (self.node, self.dim, len(self.prefix), p[0], p[1], self.lo, self.hi, (self.hi - self.lo) // BUCKETS + 1, self.below, self.target)

    def narrow(self, part) -> None:
        before = self.below + part["cum"] - part["weight"]
        if part["n"] == 1 or part["low"] == part["high"] and len(self.prefix) == 2:
            values = [*self.prefix, part["low"], 0, 0][:3]
            self.cut = (self.node, self.dim, len(self.prefix), *values, bool(2 * (self.target - before) >= part["weight"]), self.shards // 2)
        elif part["low"] == part["high"]:
            self.prefix.append(part["low"])
            self.lo, self.hi = (0, 2**32 - 1) if len(self.prefix) == 1 else self.ids
            self.below = before
        else:
            self.lo, self.hi, self.below = part["low"], part["high"], before


def _choose(col: str, dims: int) -> Column:
    return F.coalesce(*[F.when(F.col(col) == i, F.col(f"d{i}")) for i in range(dims)])


def _medians(rows: DataFrame, searches: list[_Search], dims: int) -> None:
    spark = rows.sparkSession
    while open_ := [s for s in searches if s.cut is None]:
        state = F.broadcast(spark.createDataFrame([s.row() for s in open_], _STATE))  # a row for each node
        value = F.when(F.col("col") == 0, F.col("v")).when(F.col("col") == 1, F.col("tie")).otherwise(F.col("id"))
        looked = rows.join(state, "node").withColumn("v", _choose("dim", dims))
        looked = looked.where("col = 0 OR v = p0").where("col < 2 OR tie = p1").withColumn("value", value).where("value BETWEEN lo AND hi")
        parts = looked.groupBy("node", F.expr("(value - lo) div width").alias("part"), "below", "target").agg(
            F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        run = Window.partitionBy("node").orderBy("part")  # at most BUCKETS rows for each node
        parts = parts.withColumn("cum", F.sum("weight").over(run)).withColumn("last", F.lead("part").over(run).isNull())
        reached = parts.where("below + cum - weight < target OR part = 0 OR cum = weight").where("below + cum >= target OR last")
        best = {}
        for part in reached.collect():
            if part["node"] not in best or part["cum"] < best[part["node"]]["cum"]:
                best[part["node"]] = part
        for s in open_:
            s.narrow(best[s.node])


def kd_shards(rows: DataFrame, dimensions: list[str], weight: str, tie: str, id: str, shards: int) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 in each shard, any order) and ``leaf_weight``.

    ``dimensions``, ``tie`` and ``id`` are integer columns without nulls, ``tie`` within 32 bits, ``weight`` a positive integer. Shard
    weights differ by no more than the heaviest rows at the cuts. Rows that agree in the dimension, tie and id of a cut stay
    together. A node with fewer rows than shards leaves shards empty. An empty table gives no rows.
    """
    n = len(dimensions)
    kept = rows.columns
    slim = rows.select("*", *[F.col(c).cast("long").alias(f"d{i}") for i, c in enumerate(dimensions)], F.lit(0).alias("node"))
    slim = slim.select(F.struct(*kept).alias("row"), *[f"d{i}" for i in range(n)], F.col(tie).cast("long").alias("tie"), F.col(id).cast("long").alias("id"), F.col(weight).cast("long").alias("weight"), "node")
    slim = settle(slim)
    widths: list[int] = []
    nodes = {0: shards}
    while any(k > 1 for k in nodes.values()):
        ranges = [f(f"d{i}").alias(f"{name}{i}") for i in range(n) for name, f in (("lo", F.min), ("hi", F.max))]
        stats = {s["node"]: s for s in slim.groupBy("node").agg(F.sum("weight").alias("weight"), F.min("id").alias("first"), F.max("id").alias("final"), *ranges).collect()}
        if not stats:
            break
        widths = widths or [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) for i in range(n)]
        searches, after = [], {}
        for node, k in nodes.items():
            if k == 1 or node not in stats:
                after[node] = 1
                continue
            s = stats[node]
            dim = max(range(n), key=lambda i: ((s[f"hi{i}"] - s[f"lo{i}"]) / widths[i], -i))
            searches.append(_Search(node, k, s["weight"] * (k // 2) / k, dim, s[f"lo{dim}"], s[f"hi{dim}"], (s["first"], s["final"])))
            after |= {node: k // 2, node + k // 2: k - k // 2}
        _medians(slim, searches, n)
        cuts = F.broadcast(slim.sparkSession.createDataFrame([s.cut for s in searches], _CUT))  # a row for each node
        key = [_choose("dim", n), F.col("tie"), F.col("id")]
        left = F.when(F.col("col") < 2, F.col("upto")).otherwise((key[2] < F.col("v2")) | ((key[2] == F.col("v2")) & F.col("upto")))
        left = F.when(F.col("col") < 1, F.col("upto")).otherwise((key[1] < F.col("v1")) | ((key[1] == F.col("v1")) & left))
        left = (key[0] < F.col("v0")) | ((key[0] == F.col("v0")) & left)
        moved = slim.join(cuts, "node", "left").withColumn("node", F.when(left, F.col("node")).otherwise(F.col("node") + F.coalesce("left_shards", F.lit(0))))
        slim = settle(moved.select("row", *[f"d{i}" for i in range(n)], "tie", "id", "weight", "node"))
        nodes = after
    return _slots(slim)


def _slots(slim: DataFrame) -> DataFrame:
    """Number each shard's rows: row numbers inside blocks of about ``BLOCK`` rows plus the rows of the blocks before."""
    blocks = slim.count() // BLOCK + 16
    dealt = settle(slim.select("row", F.col("node").alias("shard"), "id", "tie", "weight", F.pmod(F.xxhash64("id", "tie"), F.lit(blocks)).cast("int").alias("block")))
    sizes = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    run = Window.partitionBy("shard").orderBy("block")
    everything = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("shard", "block", (F.sum("n").over(run) - F.col("n")).alias("before"), F.sum("w").over(everything).alias("leaf_weight"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("tie", "id")) - 1
    return dealt.withColumn("inside", inside).join(sizes, ["shard", "block"]).select("row.*", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), "leaf_weight")


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shards of nearly equal bytes: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``.

    The dimensions are taken from the text (its size, the bytes beyond one for each character, its lines), and ties go by its crc32, so
    equal texts are neighbours in every order: a group of copies is in one shard unless a cut runs through it. A null text
    counts as none, with crc32 0; a null ``doc_id`` sorts before all others.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (size + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (size - F.length(text)).alias("wide"), F.regexp_count(text, F.lit("\n")).alias("lines"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("id"),
    )
    return kd_shards(measured, ["size", "wide", "lines"], "size", "text_crc32", "id", shards).select("doc_id", "size", "text_crc32", "shard", "slot")
