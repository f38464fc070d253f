"""From raw documents to packed training sequences, one operator after the other.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of ``documents``:

1. quality rules: documents that fail the base rules or diverge from their language's reference go;
2. exact dedup: of equal texts the row with the largest id stays;
3. n-gram Jaccard join: of each component the document with the least id stays;
4. secret scans: every span found is replaced by ``<secret>`` and ``n_chars`` counted again; no document goes;
5. packing: the pieces of all documents in their sequences.

An id names one document: rows that repeat an id and its text are one. Rows without an id stay in stages 2 and 3 only if their
text (component) has no row with an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from staygrid.llm import blob_ledger, divergence, golomb_dedup, queries, signature_trees, tier_packing
from staygrid.llm.shared import settle, work_folder


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids, each once; the join's partitions serve the removal of repeated rows too."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__key")
    kept = docs.select("*", key).join(ids.select(key).distinct(), "__key", "left_semi")
    return kept.dropDuplicates(["__key", "text"]).select(*[f"`{c}`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return divergence.quality_filtered(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, golomb_dedup.exact_duplicates(docs).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, signature_trees.jaccard_components(docs).where("doc_id <=> component_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = blob_ledger.scanned(docs, work_folder(spark), blob_ledger.MASKING)
    hit = F.size("findings") > 0
    text = F.when(hit, blob_ledger.masked(F.col("text"), F.col("findings"))).otherwise(F.col("text"))
    clean = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return clean.select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packing_digest(tier_packing.packed(docs, queries.tokenizer_file("word_bpe_49k.json")))


STAGES = [("quality_rules", quality), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies), ("secret_scans", secrets), ("packing", packing)]
ORACLE_SQL = None  # SQL has no tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
