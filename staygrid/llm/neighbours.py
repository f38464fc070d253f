"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes, calibration.

Terms are six-byte n-grams of the folded text (letters and single spaces): all whose chi-square between the labels is ``CHI`` or more.
As they come from the examples only, the examples bound them. Their document frequencies come from all documents. All other n-grams of a text are one background term, so that a stray
hit in a long text weighs little. The examples are at most ``EXAMPLES`` distinct labelled texts of each label (those with the highest
hash), a bounded sample, so a group of copies counts once; every document is scored against all of them.

The index keeps each term's postings, and no zeros, in blocks of ``BLOCK`` examples with the block's largest weight. A query adds these up to an upper
bound for each block, visits the ``HEAD`` blocks with the highest bounds together and then, together too, all whose bound is not below the
k-th best cosine found. A visit adds up weights in single precision; what it cannot tell from the k-th best is added up again in double
precision: the result is that of a full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staygrid.llm.language_masks import grams
from staygrid.llm.shared import pieces, remainder, settle, text_bytes

WIDTH = 6
CHI = 15.0  # least chi-square of a term: by chance in one of ten thousand n-grams
EXAMPLES = 4096
BLOCK = 64
HEAD = 4  # blocks visited before the bounds of the others are looked at
DENSE = 16  # a term that one of so many examples has is kept as a row of all examples: at most so many rows as 16 examples have terms
HELD = 8_000_000  # n-grams a task keeps before it counts them
SPAN = 4096  # terms whose counts make one row
FOLD = 64  # tasks whose counts are added up together
NEAREST = 25
BACKGROUND = 0.02
SEARCHES = 4000  # documents in one scoring task
PORTION = 128  # terms whose rows are added up together
MEMO = 50_000  # query vectors whose result a task remembers
VECTOR_SQL = "doc_id long, held_out boolean, terms array<int>, counts array<int>, n long"


def spread(values: np.ndarray) -> np.ndarray:
    """A hash of integers, other ones for other integers."""
    return values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def chosen_terms(grams_: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """All n-grams with a chi-square of ``CHI`` or more, sorted."""
    return np.sort(grams_[chi >= CHI])


def _sample(known: DataFrame, label: int, total: int) -> list:
    """``EXAMPLES`` of the label's ``total`` texts, those with the highest hash, or all if they are fewer.

    Twice as many are expected above the bound that the driver gets them from, so it neither lacks any nor gets more than a few.
    """
    parts = 1 << 30
    place = F.pmod(F.xxhash64("sha"), F.lit(parts))
    rows = known.where((F.col("toxic") == label) & (place >= parts - parts * 2 * EXAMPLES // max(1, total))).select("doc_id", "sha", "toxic", place.alias("place")).collect()
    return [(r["doc_id"], r["sha"], r["toxic"]) for r in sorted(rows, key=lambda r: (-r["place"], r["sha"]))[:EXAMPLES]]


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, pos, neg): in how many examples of each label a partition has it."""
    held = {0: [], 1: []}

    def flush():
        for label, parts in held.items():
            if parts:
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                columns = [n, np.zeros_like(n)] if label else [np.zeros_like(n), n]
                yield pa.RecordBatch.from_arrays([pa.array(values), *[pa.array(c) for c in columns]], ["gram", "pos", "neg"])
                parts.clear()

    for batch in pieces(batches):
        found, first = grams(batch.column(0), WIDTH)
        for label, a, b in zip(batch.column(1).to_pylist(), first[:-1], first[1:]):
            held[label].append(np.unique(found[a:b]))
        if sum(len(x) for parts in held.values() for x in parts) > HELD:
            yield from flush()
    yield from flush()


def _vectors(terms: np.ndarray):
    """``terms``: sorted n-grams. Counts of the terms in each text and the number of its n-grams."""
    bits = min(24, max(16, len(terms).bit_length() + 5))
    bucket = lambda g: (spread(g) >> np.uint64(64 - bits)).astype(np.int64)
    likely = np.zeros(1 << bits, bool)
    likely[bucket(terms)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, first = grams(batch.column(2), WIDTH)
            some = np.flatnonzero(likely[bucket(found)])
            at = np.minimum(np.searchsorted(terms, found[some]), max(0, len(terms) - 1))
            hit = terms[at] == found[some] if len(terms) else np.zeros(len(some), bool)
            some, at = some[hit], at[hit]
            doc = np.searchsorted(first, some, side="right") - 1
            pairs, counts = np.unique(doc * max(1, len(terms)) + at, return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(len(batch) + 1) * max(1, len(terms))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(terms)), counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(np.diff(first))], ["doc_id", "held_out", "terms", "counts", "n"])

    return run


def _frequencies(size: int):
    """Rows (span, counts): in how many of a task's texts each of ``SPAN`` terms occurs; one row for each span that any of them is in."""
    spans = -(-size // SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(spans * SPAN, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(held))
        held = held.reshape(spans, SPAN)
        some = np.flatnonzero(held.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([row.tobytes() for row in held[some]])], ["span", "counts"])

    return run


def _summed(pdf):
    """One span's counts, added up."""
    return pdf[["span"]].iloc[:1].assign(counts=[sum(np.frombuffer(c, np.int64) for c in pdf["counts"]).tobytes()])


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many rows each of ``size`` terms occurs. Tasks count their rows, so a row for each text and term is never made.

    Parts of a span meet ``FOLD`` at a time, and then what they gave; the driver gets one row of each span.
    """
    rows = vectors.select("terms").mapInArrow(_frequencies(size), "span int, counts binary").withColumn("part", F.spark_partition_id())
    some = rows.groupBy("span", F.floor(F.col("part") / FOLD)).applyInPandas(_summed, "span int, counts binary")
    out = np.zeros(-(-size // SPAN) * SPAN)
    for r in some.groupBy("span").applyInPandas(_summed, "span int, counts binary").toLocalIterator():
        out[r["span"] * SPAN : (r["span"] + 1) * SPAN] = np.frombuffer(r["counts"], np.int64)
    return out[:size]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The five columns of ``VECTOR_SQL`` row by row, terms and counts as arrays."""
    terms, counts = (batch.column(k) for k in (2, 3))
    offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
    t, c = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.float64)
    for i, y, n, a, b in zip(*[batch.column(k).to_pylist() for k in (0, 1, 4)], offsets[:-1], offsets[1:]):
        yield i, y, t[a:b], c[a:b], n


def unit_vector(terms: np.ndarray, counts: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the terms and, last, of the background, divided by their length."""
    weights = np.append(counts * idf[terms], BACKGROUND * max(0, n - int(counts.sum())))
    return weights / max(float(np.sqrt(weights @ weights)), 1e-12)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class BlockMaxIndex:
    """Examples in blocks of ``BLOCK``. An entry is a block and a term that occurs in it; entries go by term, then block.

    ``first[term]`` is a term's first entry, ``block`` and ``most`` an entry's block and largest weight, ``begin`` where its postings
    (``place`` in the block, ``weight``) begin. The last term is the background.
    """

    ids: np.ndarray
    labels: np.ndarray
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    begin: np.ndarray
    place: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, vectors: list[tuple], idf: np.ndarray) -> "BlockMaxIndex":
        """``vectors``: (doc_id, label, terms, counts, n). Examples with like shares of background are neighbours, so block bounds are tight."""
        rows = [(i, y, t, unit_vector(t, c, n, idf)) for i, y, t, c, n in vectors]
        rows.sort(key=lambda r: (r[3][-1], r[1], r[0]))
        terms = np.concatenate([np.zeros(0, np.int64), *[np.append(t, len(idf)) for _, _, t, _ in rows]]).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(w) for _, _, _, w in rows]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *[w for _, _, _, w in rows]])
        order = np.argsort(terms, kind="stable")  # and so by example within a term
        terms, owner, weight = terms[order], owner[order], weight[order]
        block = owner // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(new)
        most = np.maximum.reduceat(weight, begin) if len(begin) else np.zeros(0)
        first = np.searchsorted(terms[begin], np.arange(len(idf) + 2))
        ids, labels = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        return cls(ids, labels, first, block[begin].astype(np.int32), most, np.append(begin, len(terms)), (owner % BLOCK).astype(np.uint8), weight)

    @cached_property
    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each term, -1 for those with few postings, and the rows: weights in all places, filled up to whole blocks."""
        cuts = self.begin[self.first]
        many = np.flatnonzero(np.diff(cuts) * DENSE >= len(self.ids))
        of = np.full(len(cuts) - 1, -1)
        of[many] = np.arange(len(many))
        out = np.zeros((len(many), -(-len(self.ids) // BLOCK) * BLOCK), np.float32)
        for row, a, b in zip(out, cuts[many], cuts[many + 1]):
            row[self.places[a:b]] = self.weight[a:b]
        return of, out

    @cached_property
    def room(self) -> np.ndarray:
        return np.empty((PORTION, self.rows[1].shape[1]), np.float32)

    @cached_property
    def places(self) -> np.ndarray:
        """The place of each posting among all examples."""
        return np.repeat(self.block.astype(np.int64) * BLOCK, np.diff(self.begin)) + self.place

    @cached_property
    def vectors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each example's terms begin, the terms and their weights."""
        order = np.argsort(self.places, kind="stable")  # and so by term within an example
        terms = np.repeat(np.arange(len(self.first) - 1), np.diff(self.begin[self.first]))
        return np.searchsorted(self.places[order], np.arange(len(self.ids) + 1)), terms[order], self.weight[order]

    def __getstate__(self) -> dict:
        """What follows from the fields is made again where the index arrives."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def search(self, terms: np.ndarray, vector: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, ties by id; ``without`` is left out."""
        used = np.append(terms, len(self.first) - 2)
        sizes = self.first[used + 1] - self.first[used]
        entries, factor = _ranges(self.first[used], sizes), np.repeat(vector, sizes)
        blocks = -(-len(self.ids) // BLOCK)
        bounds = np.bincount(self.block[entries], factor * self.most[entries], blocks)
        row_of, rows = self.rows
        dense = row_of[used] >= 0
        mine, single = row_of[used[dense]], vector[dense].astype(np.float32)
        rare = np.zeros(blocks * BLOCK)
        if not dense.all():
            cuts = self.begin[self.first]
            sizes = cuts[used[~dense] + 1] - cuts[used[~dense]]
            at = _ranges(cuts[used[~dense]], sizes)
            rare = np.bincount(self.places[at], np.repeat(vector[~dense], sizes) * self.weight[at], blocks * BLOCK)
        rare[len(self.ids) :] = -4.0
        if without is not None:
            rare[: len(self.ids)][self.ids == without] = -4.0
        slack = 1.2e-7 * (len(used) + 4)  # twice the error of a sum in single precision

        def visit(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            here = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = rare[here]
            whole = 2 * len(chosen) >= blocks
            for a in range(0, len(mine), PORTION):  # a portion of terms fits the room that is used again
                part = mine[a : a + PORTION]
                if whole:
                    found += (single[a : a + PORTION] @ np.take(rows, part, axis=0, out=self.room[: len(part)], mode="clip"))[here]
                else:
                    room = self.room.ravel()[: len(part) * len(here)].reshape(-1, BLOCK)
                    tiles = np.take(rows.reshape(-1, BLOCK), (part[:, None] * blocks + chosen).ravel(), axis=0, out=room, mode="clip")
                    found += single[a : a + PORTION] @ tiles.reshape(len(part), len(here))
            return here, found

        order = np.argsort(-bounds, kind="stable")
        place, sim = visit(order[: HEAD + k // BLOCK])
        least = np.partition(sim, -k)[-k] if len(sim) >= k else -1.0
        rest = order[HEAD + k // BLOCK :]
        more = visit(rest[bounds[rest] >= least - slack])
        place, sim = np.append(place, more[0]), np.append(sim, more[1])
        place = place[sim >= max(np.partition(sim, -k)[-k] if len(sim) >= k else -1.0, -1.0) - slack]

        begin, its, weight = self.vectors
        query = np.zeros(len(self.first) - 1)
        query[used] = vector
        sizes = begin[place + 1] - begin[place]
        at = _ranges(begin[place], sizes)
        sim = np.round(np.bincount(np.repeat(np.arange(len(place)), sizes), query[its[at]] * weight[at], len(place)), 12)
        best = np.lexsort((self.ids[place], -sim))[:k]
        return place[best], sim[best]


def rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression (pool adjacent violators): the points of a rising step curve."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted y, weighted x
    for a, b, c in zip(x[order], y[order], w[order]):
        pools.append([c, b * c, a * c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    table = np.array(pools)
    return table[:, 2] / table[:, 0], table[:, 1] / table[:, 0]


@dataclass
class Voter:
    """Nearest examples vote with cosine times their label's share in all training labels; the vote is calibrated."""

    index: BlockMaxIndex
    idf: np.ndarray
    share: tuple[float, float]
    prior: float  # of texts without any term
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def vote(self, terms: np.ndarray, counts: np.ndarray, n: int, without: int | None = None) -> tuple[float, np.ndarray]:
        place, sim = self.index.search(terms, unit_vector(terms, counts, n, self.idf), NEAREST, without)
        weight = np.maximum(sim, 1e-6) ** 4 * np.where(self.index.labels[place] == 1, self.share[1], self.share[0])
        return (float(weight @ self.index.labels[place]) / weight.sum() if len(place) else self.prior), self.index.ids[place[:3]]

    def score(self, terms: np.ndarray, counts: np.ndarray, n: int) -> tuple[float, np.ndarray]:
        if not len(terms) or self.curve is None:
            return self.prior, np.zeros(0, np.int64)
        raw, ids = self.vote(terms, counts, n)
        return float(np.clip(np.interp(raw, *self.curve), 0, 1)), ids


def _voter(examples: list[tuple], idf: np.ndarray, totals: dict[int, int]) -> Voter:
    """``examples``: (doc_id, label, terms, counts, n) of the whole sample."""
    count = {y: sum(1 for e in examples if e[1] == y) for y in (0, 1)}
    share = tuple(totals.get(y, 0) / max(1, count[y]) for y in (0, 1))
    bare = [sum(share[y] for _, y, t, _, _ in examples if y == want and not len(t)) for want in (0, 1)]
    voter = Voter(BlockMaxIndex.of([e for e in examples if len(e[2])], idf), idf, share, bare[1] / sum(bare) if sum(bare) else 0.0)
    placed = [e for e in examples if len(e[2])]
    if placed and all(count.values()):
        raw = np.array([voter.vote(t, c, n, without=i)[0] for i, _, t, c, n in placed])
        labels = np.array([e[1] for e in placed], float)
        voter.curve = rising(raw, labels, np.array([share[e[1]] for e in placed]))
    return voter


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, kept_back: int = 0) -> DataFrame:
    """Score every text; labels of documents whose id's crc32 modulo ``modulus`` is ``kept_back`` are not used.

    Returns one row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5) and ``nearest`` (ids of the three
    nearest examples). A text without any term (an empty or null one too) has the weighted share of label 1 among such
    examples. Without labels of both kinds all scores are 0. A null label is none; an id with several labels has the
    largest, a text whose copies differ the more frequent one (1 if both are). An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(remainder(modulus) != kept_back)
    digest = F.sha2("text", 256).alias("sha")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    labelled = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(texts.select("doc_id", digest), "doc_id")
    known = settle(labelled.groupBy("sha").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"), F.min("doc_id").alias("doc_id")))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [r for y in (0, 1) for r in _sample(known, y, totals.get(y, 0))]
    few = F.broadcast(spark.createDataFrame(chosen, "doc_id long, sha string, toxic int"))  # at most 2 * EXAMPLES rows

    source = texts.select("doc_id", (remainder(modulus) == kept_back).alias("held_out"), "text")
    sample = settle(source.join(few, "doc_id").where(F.sha2("text", 256) == F.col("sha")).dropDuplicates(["sha"]))
    counts = sample.select("text", "toxic").mapInArrow(_label_counts, "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, n = (sum(1 for r in chosen if r[2] == y) for y in (1, 0))
    apart = F.col("pos") * float(n) - F.col("neg") * float(p)
    square = apart * apart * (float(p + n) / max(1, p * n)) / ((F.col("pos") + F.col("neg")) * (F.lit(float(p + n)) - F.col("pos") - F.col("neg") + 1e-9))
    found = counts.where(apart > 0).select("gram", square.alias("chi")).where(F.col("chi") >= CHI).toArrow()
    terms = chosen_terms(found["gram"].to_numpy(), found["chi"].to_numpy())

    vectors = settle(source.mapInArrow(_vectors(terms), VECTOR_SQL))
    total = vectors.count()
    idf = np.log((total + 1) / (document_frequencies(vectors, len(terms)) + 1))

    # the label takes the place of held_out
    rows = sample.select("doc_id", F.col("toxic").cast("boolean").alias("held_out"), "text").mapInArrow(_vectors(terms), VECTOR_SQL).toArrow()
    examples = [(i, int(y), t, c, n) for batch in rows.to_batches() for i, y, t, c, n in _rows(batch)]
    shared = spark.sparkContext.broadcast(_voter(sorted(examples, key=lambda e: e[0]), idf, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter, memo = shared.value, {}
        for batch in batches:
            out, near = [], []
            for _, _, t, c, n in _rows(batch):
                key = hashlib.blake2b(t.tobytes() + c.tobytes() + n.to_bytes(8), digest_size=16).digest() if len(t) else None
                if key not in memo:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[key] = voter.score(t, c, n)
                out.append(memo[key][0])
                near.append(memo[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array(near, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "nearest"])

    # the vectors are few bytes but a search each: tasks are cut by rows
    scored = vectors.repartition(total // SEARCHES + 1).mapInArrow(run, "doc_id long, held_out boolean, score double, nearest array<long>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest")
