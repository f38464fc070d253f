"""Exact duplicates by exchanging Golomb-coded fingerprints.

Every partition hashes its normalised texts, sorts the fingerprints by the owner of their range and sends each owner one
Golomb-Rice coded list. Owners answer each list with a bitmap: set where another sender holds the same fingerprint. Only the
documents behind set bits, and repeats inside a sender, are suspects; their bytes are shuffled and grouped, so that a group
is a set of equal byte strings and not of equal hashes.

Copies collapse before each shuffle (one entry for each fingerprint and sender, one row for each text and map task), so a text
that a third of all rows share costs an owner one entry from each sender.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from staygrid.llm.shared import document_columns, record_batch, settle

CHUNK = 1 << 16  # documents in one sender's lists
OWNED = 1 << 17  # documents for each owner, about
PAIR = pa.schema([
    ("doc_id", pa.int64()), ("sha", pa.binary()), ("uid", pa.int64()), ("sender", pa.int64()), ("owner", pa.int32()), ("rank", pa.int32()),
    ("repeated", pa.bool_()), ("coded", pa.binary()),
])
PAIR_SQL = "doc_id long, sha binary, uid long, sender long, owner int, rank int, repeated boolean, coded binary"


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as Golomb-Rice coded gaps.

    Layout: count (4 bytes), remainder width (1), first value (8), remainders at that width, then quotients in unary.
    """
    n = len(values)
    if n == 0:
        return (0).to_bytes(4, "little")
    gaps = np.diff(values)
    mean = int(values[-1] - values[0]) // max(1, n - 1)
    k = max(0, min(63, int(mean * 0.69).bit_length() - 1))
    low = gaps & np.uint64((1 << k) - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    bits = ((low[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
    unary = np.ones(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    return n.to_bytes(4, "little") + bytes([k]) + int(values[0]).to_bytes(8, "little") + np.packbits(np.concatenate([bits, unary])).tobytes()


def rice_decode(coded: bytes) -> np.ndarray:
    n = int.from_bytes(coded[:4], "little")
    if n == 0:
        return np.zeros(0, np.uint64)
    k, first = coded[4], int.from_bytes(coded[5:13], "little")
    bits = np.unpackbits(np.frombuffer(coded, np.uint8, offset=13))
    low = bits[: (n - 1) * k].reshape(n - 1, k).astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64)) if k else np.zeros(n - 1, np.uint64)
    stops = np.flatnonzero(bits[(n - 1) * k :] == 0)[: n - 1]
    high = np.diff(stops, prepend=-1) - 1
    gaps = (high.astype(np.uint64) << np.uint64(k)) + low.astype(np.uint64)
    return np.concatenate([np.array([first], np.uint64), np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    return (((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int32)


def _send(owners: int, fp_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, ids, shas = TaskContext.get().partitionId(), 0, [], []

        def flush():
            nonlocal chunk, ids, shas
            sender = (part << 24) | chunk
            found = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64) >> np.uint64(64 - fp_bits) << np.uint64(64 - fp_bits)
            values, at, counts = np.unique(found, return_inverse=True, return_counts=True)
            owner = owner_of(values, owners)
            firsts = np.searchsorted(owner, np.arange(owners + 1))
            n = len(ids)
            uid = (sender << 17) + np.arange(n, dtype=np.int64)
            yield record_batch(PAIR, ids, shas, uid, np.full(n, sender), owner[at], (at - firsts[owner[at]]).astype(np.int32), counts[at] > 1, [None] * n)
            lists = [(o, rice_encode(values[firsts[o] : firsts[o + 1]])) for o in range(owners) if firsts[o + 1] > firsts[o]]
            m = len(lists)
            yield record_batch(PAIR, [None] * m, [None] * m, [None] * m, [sender] * m, [o for o, _ in lists], [None] * m, [None] * m, [c for _, c in lists])
            chunk, ids, shas = chunk + 1, [], []

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                shas.append(hashlib.sha256(text.as_buffer().to_pybytes().lower()).digest())
                if len(ids) == CHUNK:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _answer(pdf):
    """One owner: which fingerprints come from several senders, as a bitmap for each list."""
    lists = [rice_decode(c) for c in pdf["coded"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    pdf = pdf[["sender", "owner"]].copy()
    pdf["bitmap"] = [np.packbits(np.isin(x, shared)).tobytes() for x in lists]
    return pdf


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_buffer().to_pybytes().lower() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "sha", "norm"])


def exact_duplicates(docs: DataFrame, fp_bits: int = 64) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z.

    Returns one row per row of ``docs``: ``doc_id``, ``keep_id`` (largest ``doc_id`` of its group), ``group_size``, ``kept`` and
    ``sha`` (binary SHA-256 of the normalised text). A null text counts as empty. A null ``doc_id`` is smaller than any other. Rows
    that repeat an id and its text are copies like any other: one of them is kept. An empty table gives an empty result.
    ``fp_bits`` shortens the exchanged fingerprint (for tests): that gives more suspects, never another result.
    """
    owners = max(16, docs.count() // OWNED + 1)
    sent = settle(document_columns(docs).mapInArrow(_send(owners, fp_bits), PAIR_SQL))
    rows = sent.where("coded IS NULL").drop("coded")
    bitmaps = sent.where("coded IS NOT NULL").select("sender", "owner", "coded").groupBy("owner").applyInPandas(_answer, "sender long, owner int, bitmap binary")
    byte = F.conv(F.hex(F.expr("substring(bitmap, int(rank div 8) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, 7 - rank % 8) & 1")
    marked = settle(rows.join(bitmaps, ["sender", "owner"], "left").withColumn("byte", byte).select("doc_id", "sha", "uid", (F.col("repeated") | (bit == 1)).alias("suspect")))

    suspects = marked.where("suspect").select(F.col("doc_id").alias("suspect_id"))
    texts = document_columns(docs).join(suspects, F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi")
    texts = texts.mapInArrow(_normalised, "doc_id long, sha binary, norm binary")
    same_bytes = texts.groupBy("sha", "norm").agg(F.count(F.lit(1)).alias("n")).select("sha", F.lit(1).alias("one"))
    strings = same_bytes.groupBy("sha").agg(F.count("one").alias("strings"))
    checked = F.when(F.col("strings") > 1, F.raise_error(F.lit("different texts with one SHA-256"))).otherwise(F.lit(True))

    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "uid")
    groups = marked.where("suspect").groupBy("sha").agg(F.max(key).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.join(strings, "sha").where(checked).select("sha", F.col("top.uid").alias("top_uid"), F.col("top.id").alias("top_id"), "group_size")
    groups = settle(groups)  # a plain table on this side lets the join split the rows of one large group
    joined = marked.join(groups, "sha", "left")
    top = F.when(F.col("top_id") != -(1 << 63), F.col("top_id"))
    return joined.select(
        "doc_id", F.when(F.col("top_uid").isNull(), F.col("doc_id")).otherwise(top).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("top_uid").isNull() | (F.col("top_uid") == F.col("uid"))).alias("kept"), "sha",
    )
