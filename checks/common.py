"""Registry and the shared inputs: the given tables in clinical roles.

``events`` plays an item-long measurement table (id = user, t = seconds since
2024-01-01), ``customer`` the patients, ``orders`` the stays and ``lineitem``
the stay-level measurements.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from staygrid.functions.times import seconds_between
from staygrid.schema import HOUR
from staygrid.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
IDS, TIME = ["id"], "t"


def query(sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    """Register a query under its function name; ``base`` names the inputs the SQL uses."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ctes = [f"{n} AS ({BASES[n]})" for n in base.split()]
            body = re.sub(r", ([456])\)", r" + 1e-9, \1)", sql.strip())  # as in rounded()
            if ctes and body.upper().startswith("WITH "):
                body = ", " + body[5:]
            ORACLES[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
        return f

    return add


# Inputs in SQL; each may use the ones before it.
BASES = {
    "ev": """SELECT user_id AS id, CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000) AS BIGINT) AS t,
        event_type AS item, value, event_id AS seq FROM events""",
    "hv": "SELECT id, (t // 3600) * 3600 AS t, max(value) AS value FROM ev GROUP BY 1, 2",
    "nv": "SELECT id, t, CASE WHEN value > 50 THEN NULL ELSE value END AS value FROM hv",
    "grid": """SELECT id, unnest(generate_series(lo, hi, 3600)) AS t
        FROM (SELECT id, min(t) AS lo, max(t) AS hi FROM hv GROUP BY id)""",
    "item_a": "SELECT id, (t // 3600) * 3600 AS t, min(value) AS a FROM ev WHERE item IN ('click', 'view') GROUP BY 1, 2",
    "item_b": "SELECT id, (t // 3600) * 3600 AS t, max(value) AS b FROM ev WHERE item IN ('error', 'signup', 'purchase') GROUP BY 1, 2",
    "wins": """SELECT id, t AS s, t + CAST(floor(value * 600) AS BIGINT) AS e, value, seq FROM ev WHERE item = 'purchase'""",
    "demo": """SELECT o_orderkey AS patient_id, 18 + o_totalprice / 6000 AS age,
        CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, o_totalprice / 1000 AS los_hours,
        o_orderstatus <> 'F' AS survived, o_orderpriority = '1-URGENT' AS first_icu_stay, o_orderstatus AS grp FROM orders""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"),
        seconds_between(F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), "ts").alias("t"),
        F.col("event_type").alias("item"), "value", F.col("event_id").alias("seq"),
    )


def hv(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).groupBy("id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t")).agg(F.max("value").alias("value"))


def nv(spark: SparkSession, sf: str) -> DataFrame:
    return hv(spark, sf).withColumn("value", F.when(F.col("value") <= 50, F.col("value")))


def _items(spark: SparkSession, sf: str, items: list[str], f, out: str) -> DataFrame:
    rows = ev(spark, sf).where(F.col("item").isin(items))
    return rows.groupBy("id", (F.floor(F.col("t") / HOUR) * HOUR).alias("t")).agg(f("value").alias(out))


def item_a(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf, ["click", "view"], F.min, "a")


def item_b(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf, ["error", "signup", "purchase"], F.max, "b")


def wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev(spark, sf).where("item = 'purchase'")
    return rows.select("id", F.col("t").alias("s"), (F.col("t") + F.floor(F.col("value") * 600)).alias("e"), "value", "seq")


def demo(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("patient_id"), (F.col("o_totalprice") / 6000 + 18).alias("age"),
        F.when(F.col("o_orderkey") % 2 == 0, "M").otherwise("F").alias("gender"),
        (F.col("o_totalprice") / 1000).alias("los_hours"), (F.col("o_orderstatus") != "F").alias("survived"),
        (F.col("o_orderpriority") == "1-URGENT").alias("first_icu_stay"), F.col("o_orderstatus").alias("grp"),
    )


def rounded(c, digits: int = 6):
    """Rounded for comparison, moved off ties: two engines may add in a different order."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in columns})


def scratch(spark: SparkSession) -> str:
    """A fresh folder for a written table: shared on a cluster, temporary in local sessions."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"
