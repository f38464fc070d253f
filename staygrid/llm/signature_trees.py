"""Exact components of an n-gram Jaccard join by signature trees.

The result is the components, not the links: pairs inside a component that is known already are never decided, so neither the link
set nor the number of links can be had from here.

A document is the set of its five-word shingles (64-bit hashes). Equal sets are one class. Two classes can reach the threshold only
if they share a shingle among their first few in a common order (those a set may miss and still reach it, and one more), so each such
shingle that at least two classes have puts them into a tree. The order is by hash, with the most frequent shingles last. One document
of each class speaks for it (a filter of their ids lets few others through), so a shingle that is met twice is shared: to find those,
tasks send four bytes of a hash for each, in groups by its first bits, and neither a class nor a row. A hash that two shingles have by
chance makes a tree more and loses nothing.

A class's bitmap has a bit set where an odd number of its shingles fall, so the bits in which two bitmaps differ are never more than
the shingles in which the sets differ, and hardly fewer. A tree's nodes hold the AND and the OR of their members' bitmaps and their size
range. Two trees (or a tree and itself) are walked together from the roots: a pair of nodes is dropped when its size ranges lie too far
apart, or when more bits are set in all members of the one and in none of the other than the sizes allow differences. Trees have
bitmaps of one or two bits for each shingle, the pairs of classes that come through are held against bitmaps of four to eight, and what is
left is decided on the sets themselves.

Near copies share many shingles, so shingles with the same two representatives (the least of their classes in two random orders) have one
tree over the classes of all of them: a class is in a few trees and not in one for each shingle, and a pair is given a few times.

Work is kept off the pairs that cannot matter: the classes of some shingles are first linked to one of them and decided, and trees
only look between the components this gives. A tree with more than ``BLOCK`` classes is walked as pairs of blocks, each a task's
unit, so no group is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from staygrid.llm.components import components
from staygrid.llm.shared import document_columns, highest, pieces, record_batch, settle
from staygrid.llm.words import mix, words_of

SHINGLE = 5
HOT = 1 << 16  # frequent shingles that come last in the order
LOCAL = 8  # copies in one partition's share that make a shingle a candidate for that list
SHARE = 4_000_000  # shingles counted together
KEY_BITS = 44  # of a prefix shingle, where those that two classes have are looked for
PART_BITS = 12  # of these, the first ones: the group it is looked for in
FILTER_BITS = 26
BLOCK_WORDS = 1 << 13  # words of the filter in one row
BLOCK = 2048
FIRST = 8  # shingles at either end of a class's prefix that are linked before the trees are walked
ROUNDS = 2  # times that is done, each with other leaders
FANOUT = 8
PAIRS_SENT = 1_000_000  # pairs up to which they, not the sets, go to all executors
WEIGHTS = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(SHINGLE)]

PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingle", pa.int64())])
PROFILE_SQL = "doc_id long, n long, s1 long, s2 long, shingle long"
CLASS = pa.schema([("uid", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.list_(pa.int64())), ("bits", pa.binary()), ("coarse", pa.binary())])
CLASS_SQL = "uid long, doc long, n long, s1 long, s2 long, shingles array<long>, bits binary, coarse binary"
MEMBERS = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a text of one to four words has its whole sequence as one."""
    found = words_of(column)
    h = found.hashes()
    counts = found.counts()
    long = len(h) - SHINGLE + 1
    grams = mix(sum(h[k : k + long] * WEIGHTS[k] for k in range(SHINGLE))) if long > 0 else np.zeros(0, np.uint64)
    for first, n in zip(found.first[:-1].tolist(), counts.tolist()):
        if n >= SHINGLE:
            values = np.sort(grams[first : first + n - SHINGLE + 1])
            yield values[np.concatenate([[True], values[1:] != values[:-1]])]
        elif n:
            whole = (h[first : first + n] * np.array(WEIGHTS[:n], np.uint64)).sum(dtype=np.uint64) + np.uint64(n)
            yield mix(mix(np.array([whole], np.uint64)))
        else:
            yield np.zeros(0, np.uint64)


def marks(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set, as signed numbers."""
    m = mix(values + np.uint64(0x632BE59BD9B4E019))
    return int(m.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(m)).astype(np.int64)) if len(m) else 0


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows (null id) of shingles frequent within a share of the partition with their counts."""
    held, total, seen = [], 0, set()

    def frequent():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        values, counts = values[counts >= LOCAL], counts[counts >= LOCAL]
        empty = [None] * len(values)
        yield record_batch(PROFILE, empty, counts, empty, empty, values.astype(np.int64))

    for batch in pieces(batches):
        rows = []
        for values in shingle_sets(batch.column(1)):
            mark = marks(values)
            rows.append((len(values), *mark))
            if mark not in seen and len(values):
                seen.add(mark)
                held.append(values)
                total += len(values)
        yield record_batch(PROFILE, batch.column(0), *map(list, zip(*rows)), [None] * len(rows))
        if total > SHARE:
            yield from frequent()
            held, total, seen = [], 0, set()
    if held:
        yield from frequent()


def prefix(values: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which any set that reaches the threshold shares one: ``n - ceil(0.8 n) + 1``, frequent ones last."""
    n = len(values)
    length = n - (4 * n + 4) // 5 + 1 if n else 0
    at = np.minimum(np.searchsorted(hot, values), max(len(hot) - 1, 0))
    often = hot[at] == values if len(hot) else np.zeros(n, bool)
    rare = values[~often]
    if len(rare) >= length:
        return rare[:length]
    late = values[often][np.argsort(rank[at[often]])]
    return np.concatenate([rare, late[: length - len(rare)]])


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """The first ``KEY_BITS`` bits of shingles."""
    return shingles >> np.uint64(64 - KEY_BITS)


def _prefixes(hot, rank, owners):
    """Rows (part, keys): the keys of the prefixes, sorted, four bytes each; one that is met again in a share of the partition is there twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def counted():
            keys, counts = np.unique(keys_of(np.concatenate(held)), return_counts=True)
            keys = np.repeat(keys, np.minimum(counts, 2))
            parts = (keys >> np.uint64(KEY_BITS - PART_BITS)).astype(np.int64)
            cuts = [*np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])).tolist(), len(keys)]
            rest = (keys & np.uint64((1 << (KEY_BITS - PART_BITS)) - 1)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(parts[cuts[:-1]]), pa.array([rest[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["part", "keys"])

        for batch in pieces(_chosen(batches, owners.value)):
            for values in shingle_sets(batch.column(1)):
                if len(values):
                    held.append(prefix(values, hot.value, rank.value))
                    total += len(held[-1])
            if total > SHARE:
                yield counted()
                held, total = [], 0
        if held:
            yield counted()

    return run


def twice(part: int, rest: list[bytes]) -> np.ndarray:
    """The keys of a part that are there more than once."""
    found = np.sort(np.concatenate([np.frombuffer(k, np.uint32) for k in rest]))
    return (part << (KEY_BITS - PART_BITS)) + np.unique(found[1:][found[1:] == found[:-1]]).astype(np.int64)


def _twice(pdf):
    """The filter words of a part's keys that are there more than once: one Python worker does both."""
    word, bits = place_words(twice(int(pdf["part"].iloc[0]), pdf["keys"].tolist()))
    return pd.DataFrame({"word": word, "bits": bits})


def bit_places(values: np.ndarray) -> list[np.ndarray]:
    """Two places of each value in a filter of ``2^FILTER_BITS`` bits."""
    m = mix(values.astype(np.uint64))
    return [m >> np.uint64(64 - FILTER_BITS), m & np.uint64((1 << FILTER_BITS) - 1)]


def place_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the filter that values set bits in, and those bits."""
    places = np.concatenate(bit_places(values))
    return (places >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (places & np.uint64(63))).view(np.int64)


def _place_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in place_words(batch.column(0).to_numpy(zero_copy_only=False))], ["word", "bits"])


def _block_bits(pdf):
    """One block's words as bytes."""
    out = np.zeros(BLOCK_WORDS, np.uint64)
    out[pdf["word"].to_numpy(np.int64) % BLOCK_WORDS] = pdf["bits"].to_numpy(np.int64).view(np.uint64)
    return pdf[["block"]].iloc[:1].assign(bits=[out.tobytes()])


def filter_of(values: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column of longs; it passes all of them and few others. The driver gets its bytes, block by block."""
    return filter_from(values.mapInArrow(_place_words, "word long, bits long"))


def filter_from(words: DataFrame) -> np.ndarray:
    """The same from rows (word, bits)."""
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    blocks = words.withColumn("block", F.expr(f"word div {BLOCK_WORDS}")).groupBy("block").applyInPandas(_block_bits, "block long, bits binary")
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in blocks.collect():
        out[r["block"] * BLOCK_WORDS : (r["block"] + 1) * BLOCK_WORDS] = np.frombuffer(r["bits"], np.uint64)
    return out


def passes(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for p in bit_places(values):
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids, 0 for null."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)


def _chosen(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents whose ids pass a filter."""
    for batch in batches:
        yield batch.filter(pa.array(passes(ids, ids_of(batch.column(0))), pa.bool_()))


def bitmap(values: np.ndarray, bits: int = 4) -> bytes:
    """A bitmap with ``bits`` to twice as many bits for each shingle, a power of two and at least 64, set where an odd number of shingles fall.

    ``halved`` gives what half the bits would be."""
    size = max(64, 1 << int(bits * len(values) - 1).bit_length())
    bits = np.bincount((mix(values) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def halved(bits: np.ndarray) -> np.ndarray:
    return bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]


def _classes(hot, rank, owners, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, row = set(), TaskContext.get().partitionId() << 36
        for batch in pieces(_chosen(batches, owners.value)):
            rows = []
            for doc, values in zip(ids_of(batch.column(0)).tolist(), shingle_sets(batch.column(1))):
                mark = marks(values)
                if mark in seen or not len(values):
                    continue
                chosen = prefix(values, hot.value, rank.value)
                chosen = chosen[passes(shared.value, keys_of(chosen))]
                if len(chosen):
                    if len(seen) < SHARE:
                        seen.add(mark)
                    row += 1
                    rows.append((row, doc, len(values), *mark, chosen.astype(np.int64), bitmap(values), bitmap(values, 1)))
            if rows:
                yield record_batch(CLASS, *map(list, zip(*rows)))

    return run


class Tree:
    """Levels from the members up: bits that all members have, bits that any has, size ranges and component ranges."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.levels = [(bits, bits, sizes, sizes, comps, comps)]
        while len(self.levels[-1][0]) > 1:
            cut = np.arange(0, len(self.levels[-1][0]), FANOUT)
            folds = (np.bitwise_and, np.bitwise_or, np.minimum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, cut, axis=0) for f, x in zip(folds, self.levels[-1])))

    def at(self, level: int) -> tuple:
        return self.levels[min(level, len(self.levels) - 1)]


def _children(nodes: np.ndarray, level: int, tree: Tree) -> list[np.ndarray]:
    """For each node the indices one level down, or itself where the tree is not that high."""
    if level >= len(tree.levels):
        return [np.array([x]) for x in nodes]
    return [np.arange(x * FANOUT, min((x + 1) * FANOUT, len(tree.levels[level - 1][0]))) for x in nodes]


def walk(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Members of ``a`` and ``b`` in different components whose overlap may reach the threshold; ``i < j`` if they are one tree.

    Sets of ``n`` and ``m`` shingles reach it if they differ in ``(n + m) / 9`` of them at most.
    """
    one = a is b
    level = max(len(a.levels), len(b.levels)) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        x, y = a.at(level), b.at(level)
        step = max(1, (32 << 20) // (8 * x[0].shape[1]))
        kept = []
        for s in range(0, len(i), step):
            p, q = i[s : s + step], j[s : s + step]
            ok = (5 * x[3][p] >= 4 * y[2][q]) & (5 * y[3][q] >= 4 * x[2][p])
            ok &= ~((x[4][p] == x[5][p]) & (y[4][q] == y[5][q]) & (x[4][p] == y[4][q]))
            p, q = p[ok], q[ok]
            apart = np.bitwise_count((x[0][p] & ~y[1][q]) | (y[0][q] & ~x[1][p])).sum(axis=1, dtype=np.int64)
            ok = 9 * apart <= x[3][p] + y[3][q]
            kept.append((p[ok], q[ok]))
        i, j = (np.concatenate(z) for z in zip(*kept)) if kept else (i[:0], j[:0])
        if level == 0 or not len(i):
            return (i[i < j], j[i < j]) if one else (i, j)
        down = [(c, d) for c, d in zip(_children(i, level, a), _children(j, level, b))]
        i = np.concatenate([np.repeat(c, len(d)) for c, d in down])
        j = np.concatenate([np.tile(d, len(c)) for c, d in down])
        if one:
            i, j = i[i <= j], j[i <= j]
        level -= 1


def candidates(uids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, bitmaps: list[bytes], side: np.ndarray) -> list[tuple]:
    """Pairs of one group that come through the trees; with two sides (0 and 1) only pairs across them."""
    two = len(np.unique(side)) > 1
    widths = np.array([len(b) for b in bitmaps])
    out = []

    def tree(chosen: np.ndarray, width: int) -> Tree:
        rows = []
        for k in chosen:
            row = np.frombuffer(bitmaps[k], np.uint64)
            rows.append(row if len(bitmaps[k]) == width else halved(row))
        return Tree(np.stack(rows), sizes[chosen], comps[chosen])

    def meet(p: np.ndarray, q: np.ndarray, width: int) -> None:
        if len(p) and len(q):
            a = tree(p, width)
            x, y = walk(a, a if p is q else tree(q, width))
            out.extend(zip(uids[p[x]].tolist(), uids[q[y]].tolist()))

    for width in np.unique(widths).tolist():
        here = np.flatnonzero(widths == width)
        wider = np.flatnonzero(widths == 2 * width)
        wider = wider[4 * sizes[wider] <= 5 * sizes[here].max()]
        if two:
            for s in (0, 1):
                meet(here[side[here] == s], wider[side[wider] != s], width)
            meet(here[side[here] == 0], here[side[here] == 1], width)
        else:
            meet(here, here, width)
            meet(here, wider, width)
    return out


def _walk_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (one, two, lo, hi): the pairs that each group's trees let through."""
    held = None

    def pairs(table):
        bounds = [table.column(c).to_numpy() for c in ("one", "two", "lo", "hi")]
        n = len(table)
        new = np.flatnonzero(np.any([b[1:] != b[:-1] for b in bounds], axis=0)) + 1
        uid, comp, size, side = (table.column(c).to_numpy() for c in ("uid", "comp", "n", "side"))
        bits = table.column("bits").to_pylist()
        found = []
        for a, b in zip([0, *new.tolist()], [*new.tolist(), n]):
            order = a + np.lexsort((size[a:b], comp[a:b]))  # members of one component are alike
            found += candidates(uid[order], comp[order], size[order], [bits[k] for k in order], side[order])
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not len(table):
            continue
        bounds = [table.column(c).to_numpy() for c in ("one", "two", "lo", "hi")]
        last = int(np.flatnonzero(np.any([np.concatenate([[True], b[1:] != b[:-1]]) for b in bounds], axis=0))[-1])
        if last:
            yield pairs(table.slice(0, last))
        held = table.slice(last)
    if held is not None and len(held):
        yield pairs(held)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps allow the threshold: what a tree would ask of two members."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) != len(y):  # sizes within the threshold differ by one doubling at most
                x, y = (z if len(z) == min(len(x), len(y)) else halved(z) for z in (x, y))
            keep.append(9 * int(np.bitwise_count(x ^ y).sum()) <= n + m)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _members(wanted):
    """The sets of the documents whose ids pass a filter, each set once in a share of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in pieces(_chosen(batches, wanted.value)):
            rows = []
            for values in shingle_sets(batch.column(1)):
                mark = marks(values)
                if len(values) and mark not in seen:
                    if len(seen) < SHARE:
                        seen.add(mark)
                    rows.append((*mark, len(values), values.tobytes()))
            if rows:
                yield record_batch(MEMBERS, *map(list, zip(*rows)))

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, uid, members) in order, ``a`` itself first in its group: the pairs that reach the threshold."""
    group, own = None, None
    for batch in batches:
        out = []
        for a, salt, uid, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            values = np.frombuffer(members.as_buffer(), np.uint64)
            if group != (a, salt):
                group, own = (a, salt), values.copy()
            elif uid != a and 9 * len(np.intersect1d(own, values, assume_unique=True)) >= 4 * (len(own) + len(values)):
                out.append((a, uid))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def _few(pairs: DataFrame):
    """Up to ``PAIRS_SENT`` pairs travel to the other table, more meet it in shuffles."""
    return F.broadcast if pairs.count() <= PAIRS_SENT else (lambda df: df)


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (settled) that size and bitmaps allow."""
    few = _few(pairs)
    right = classes.select(F.col("uid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")).join(few(pairs), "b")
    left = classes.select(F.col("uid").alias("a"), "n", F.col("bits").alias("x")).join(few(pairs.select("a").distinct()), "a", "left_semi")
    both = right.join(left, "a").where("5 * n >= 4 * m AND 5 * m >= 4 * n")
    return settle(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_possible, "a long, b long"))


def _decided(pairs: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (settled) whose sets reach the threshold.

    The texts are read again for the sets of the classes in pairs. A set goes to every partner that names it second; a partner
    with many is a group of several salts, each with its own copy of the partner's set.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    second = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("uid"))
    first = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("uid"))
    goals = settle(second.union(first).join(classes.select("uid", "doc", "s1", "s2", "n"), "uid"))
    wanted = source.sparkSession.sparkContext.broadcast(filter_of(goals.select("doc").distinct()))  # 2^FILTER_BITS bits
    sets = source.mapInArrow(_members(wanted), "s1 long, s2 long, n long, members binary")
    sent = sets.join(_few(goals)(goals.drop("doc")), ["s1", "s2", "n"]).select("a", "salt", "uid", "members")
    ordered = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("uid") != F.col("a"))
    return settle(ordered.mapInArrow(_decide, "a long, b long").distinct())


def _stars(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a leader of a shingle and the others that have it and lie in another component.

    The first shingles of a prefix are rare and the last the most frequent: the ones find single copies, the others tie large
    families together. Every turn has its own leaders.
    """
    ends = F.array_distinct(F.concat(F.slice("shingles", 1, FIRST), F.slice(F.reverse("shingles"), 1, FIRST)))
    heads = placed.select("uid", "n", "comp", F.explode(ends).alias("shingle"))
    order = F.xxhash64("uid", F.lit(turn)) if turn else F.col("uid")
    leader = heads.groupBy("shingle").agg(F.min(F.struct(order.alias("o"), F.col("uid").alias("a"), F.col("n").alias("m"), F.col("comp").alias("c"))).alias("top")).select("shingle", "top.a", "top.m", "top.c")
    pairs = heads.join(leader, "shingle").where("comp <> c AND 5 * n >= 4 * m AND 5 * m >= 4 * n")
    return pairs.select("a", F.col("uid").alias("b")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Components of documents under "shingle sets with Jaccard similarity of 0.8 or more".

    Returns one row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the least ``doc_id`` reachable by links. A null
    or wordless text has no shingles and no links, its component is itself. A null ``doc_id`` counts for links but never names a
    component unless all its members are null. Repeated rows are in one component. An empty table gives no rows. Enough links to
    connect each component are found, not all of them.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    source = document_columns(docs)
    profile = settle(source.mapInArrow(_profile, PROFILE_SQL))
    often = profile.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = highest(often, F.floor(F.log2("n") * 16), HOT).toPandas().sort_values(["n", "shingle"], ascending=[False, True])
    hot = often["shingle"].to_numpy(np.int64).view(np.uint64)
    place = np.argsort(hot)
    rank = (len(hot) - place).astype(np.int64)  # the rarer first
    hot, rank = sc.broadcast(hot[place]), sc.broadcast(rank)  # at most HOT numbers each

    sets = profile.where("shingle IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2")
    owners = sets.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc"))
    owners = sc.broadcast(filter_of(owners.select("doc")))  # 2^FILTER_BITS bits
    keys = source.mapInArrow(_prefixes(hot, rank, owners), "part long, keys binary")
    shared = sc.broadcast(filter_from(keys.groupBy("part").applyInPandas(_twice, "word long, bits long")))  # 2^FILTER_BITS bits
    classes = settle(source.mapInArrow(_classes(hot, rank, owners, shared), CLASS_SQL))
    chosen = classes.groupBy("s1", "s2", "n").agg(F.min("uid").alias("uid"))
    few = settle(classes.select("uid", "n", "shingles").join(chosen.select("uid"), "uid", "left_semi"))

    placed, links = few.withColumn("comp", F.col("uid")), None
    for k in range(ROUNDS):
        found = _decided(_allowed(settle(_stars(placed, k)), classes), classes, source)
        links = found if links is None else links.union(found)
        comps = components(links)
        placed = few.join(comps, F.col("uid") == F.col("node"), "left").select("uid", "n", F.coalesce("component", "uid").alias("comp"), "shingles")

    edges = settle(placed.select("uid", "n", "comp", F.explode("shingles").alias("shingle")))
    # shingles with the same representatives share a tree
    groups = edges.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *[F.min(F.xxhash64("uid", F.lit(k))).alias(c) for k, c in enumerate(("one", "two"))])
    placed = settle(edges.join(groups.where("lo <> hi").drop("lo", "hi"), "shingle").select("one", "two", "uid", "n", "comp").distinct())
    blocks = placed.groupBy("one", "two").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    open_ = placed.join(blocks, ["one", "two"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    open_ = open_.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    open_ = open_.select("one", "two", "uid", "n", "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    bits = classes.select(F.col("uid").alias("k"), F.col("coarse").alias("bits"))
    rows = open_.join(bits, F.col("uid") == F.col("k")).drop("k").repartition("one", "two", "lo", "hi").sortWithinPartitions("one", "two", "lo", "hi")
    pairs = settle(rows.mapInArrow(_walk_groups, "a long, b long").distinct())
    comps = components(links.union(_decided(_allowed(pairs, classes), classes, source)))

    named = sets.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("least"))
    keys = chosen.select(F.col("n").alias("n_shingles"), "s1", "s2", "uid").join(comps, F.col("uid") == F.col("node")).select("n_shingles", "s1", "s2", "component")
    named = settle(named.join(keys, ["n_shingles", "s1", "s2"], "left"))
    tops = named.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("top"))
    named = named.join(tops, "component", "left").select("n_shingles", "s1", "s2", F.coalesce("top", "least").alias("component_id"))
    joined = sets.join(named, ["n_shingles", "s1", "s2"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
