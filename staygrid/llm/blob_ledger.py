"""Incremental secret scans over a ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its bytes. The ledger is a table with one row for each (blob, rule version)
that was ever scanned, with its findings, none included. A run scans only the pairs the ledger lacks, appends them, and joins
the findings back to all paths that hold the blob. Copies, however many, are scanned once; a new rule version scans old blobs
with that version only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from staygrid.llm.shared import bound_batches, settle, text_bytes


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts and the least length. Failing matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: Rule versions and their rules; kinds rank in this order where two spans start together.
BASE = ("base-1", (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
))
KEYS = ("keys-1", (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("hosted", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
    Rule("login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/@]+)@", 1, 6),
))
#: The whole of a private key: header lines, base64 lines and the END marker, or up to the last base64 line where that is missing.
BODIES = ("bodies-1", (
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:\s|\\[rn])+(?:[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*|[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]+={0,2}(?=(?:\s|\\[rn])*-----END)))*(?:(?:\s|\\[rn])*-----END [A-Z ]*PRIVATE KEY-----)?"),
))
RULES = (BASE, KEYS)
MASKING = (BASE, KEYS, BODIES)  # RULES and what has to go from a text with the markers they find
LEDGER = "blob binary, rule_version string, findings array<struct<kind: string, start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(rules: tuple[Rule, ...], text: str) -> list[dict]:
    """Spans of leftmost non-overlapping matches of each rule, in code points, by start and then rule order."""
    found = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), rank, {"kind": rule.kind, "start": m.start(), "end": m.end()}))
    return [x for _, _, x in sorted(found, key=lambda x: x[:2])]


def _scan(rules: dict[str, tuple[Rule, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, versions, findings = [], [], []
            for blob, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = text.as_buffer().to_pybytes().decode("utf-8", "replace")
                for version in wanted.as_py():
                    blobs.append(blob.as_py())
                    versions.append(version)
                    findings.append(find(rules[version], text))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(versions, pa.string()), pa.array(findings, _SPANS)], ["blob", "rule_version", "findings"])

    return run


class BlobLedger:
    """The ledger at ``folder``, a path every executor reaches."""

    def __init__(self, spark: SparkSession, folder: str, rules=RULES):
        self.spark, self.folder, self.rules = spark, folder, dict(rules)

    def rows(self) -> DataFrame:
        """All ledger rows; repeats, as left by a retried run, carry equal findings."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def add(self, versions: DataFrame) -> None:
        """Scan the (blob, rule version) pairs of ``versions`` (column ``text``) that the ledger lacks."""
        bound_batches(self.spark)
        blobs = versions.select(F.sha2(text_bytes(), 256).alias("hex"), text_bytes().alias("text"))
        blobs = blobs.groupBy("hex").agg(F.first("text").alias("text")).select(F.unhex("hex").alias("blob"), "text")
        seen = self.rows().select("blob", "rule_version").where(F.col("rule_version").isin(list(self.rules)))
        seen = seen.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        every = F.array(*map(F.lit, self.rules))
        todo = blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("wanted"))
        todo.where(F.size("wanted") > 0).mapInArrow(_scan(self.rules), LEDGER).write.mode("append").parquet(self.folder)

    def findings(self, versions: DataFrame) -> DataFrame:
        """``versions`` with ``findings``: the spans of all rule versions, by start and then rule order, an empty array without any.

        All rows and columns stay, copies each with their blob's spans. A null text is an empty blob. A column of ``versions``
        called ``findings`` is replaced.
        """
        kinds = F.create_map(*[F.lit(x) for n, r in enumerate(r for _, rules in self.rules.items() for r in rules) for x in (r.kind, n)])
        known = self.rows().where(F.col("rule_version").isin(list(self.rules))).groupBy("blob", "rule_version").agg(F.first("findings").alias("found"))
        known = known.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
        ranked = F.transform("found", lambda f: F.struct(f["start"].alias("start"), kinds[f["kind"]].alias("rank"), f["kind"].alias("kind"), f["end"].alias("end")))
        spans = F.transform(F.array_sort(ranked), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
        known = known.where(F.size("found") > 0).select(F.col("blob").alias("__blob"), spans.alias("__findings"))
        known = settle(known)  # few blobs have findings; as a plain table they let the join split a blob that many paths hold
        keyed = versions.drop("findings").withColumn("__blob", F.unhex(F.sha2(text_bytes(), 256)))
        none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
        found = keyed.join(known, "__blob", "left").withColumn("findings", F.coalesce("__findings", none))
        return found.drop("__blob", "__findings")


def scanned(versions: DataFrame, folder: str, rules=RULES) -> DataFrame:
    """Bring the ledger at ``folder`` up to date with ``versions`` and return them with their findings."""
    ledger = BlobLedger(versions.sparkSession, folder, rules)
    ledger.add(versions)
    return ledger.findings(versions)


def spans_text(found):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def masked(text, found, mark: str = "<secret>"):
    """The text with every span replaced by ``mark``; spans that overlap become one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, f):
        before = F.substring(text, acc["at"] + 1, F.greatest(f["start"] - acc["at"], F.lit(0)))
        new = F.struct(F.concat(acc["out"], before, F.lit(mark)).alias("out"), f["end"].alias("at"))
        inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], f["end"]).alias("at"))
        return F.when((f["start"] >= acc["at"]) | (acc["at"] == 0), new).otherwise(inside)

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
