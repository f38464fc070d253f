"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staygrid.llm.shared import settle


def _nearest(links: DataFrame) -> DataFrame:
    """Each ``u`` with its neighbours and the least of itself and them."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node reachable) for every node of ``links`` (longs ``a``, ``b``).

    Nulls, self-links and repeated links are ignored; an empty table gives no rows. Each round writes its links, one row for each
    node and neighbour at most, so a lost executor costs one round; a hub's row set is split by the joins.
    """
    links = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _nearest(large)
        links = settle(near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m"))).where("u <> v").distinct())
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
