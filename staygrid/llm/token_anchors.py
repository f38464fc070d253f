"""Alignment of two tokenizers over the same texts, by windows between whitespace tokens.

Both tokenizers encode a whole text; their tokens cover the same bytes (a leading space and the text). Where a space-marked token of
the one and a space-marked token of the other begin at the same byte, the tokens before them end there in both: such a verified shared
end is an anchor. Anchors cut a document into windows, pairs of id tuples whose alignment depends on nothing else, so each distinct
window is aligned once and remembered. Inside a window every shared end closes a group, and the tokens of a group are linked.

Link counts (how many documents hold an id pair linked) need the whole corpus. Each document's distinct pairs are written once, packed;
tasks add up counts and send one row per pair and task. To bring the counts back, the pair table is cut into slices of whole first
ids with at most ``SLICE`` pairs (an id has no more pairs than the other vocabulary has ids): one slice at a time is broadcast, every
document looks its pairs up, and the sums of a document over the slices are added. No pair is ever a shuffle key together with its
documents, so a pair that every document holds is no hot key, and no table of unknown size is broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from staygrid.llm.shared import document_columns, pieces, record_batch, settle
from staygrid.llm.words import BASE, INVERSE, mix, powers

SLICE = 1 << 20  # pairs in one broadcast slice, 17 bytes each
MEMO_BYTES = 128 << 20  # of remembered windows in a worker
LONG_WINDOW = 64  # tokens; longer windows seldom come again
HELD = 1 << 21  # pairs whose counts a counting task holds
ALIGNED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()),
])
ALIGNED_SQL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
COUNTS = pa.schema([("pair", pa.int64()), ("held", pa.int64())])
SUMS = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
_tokenizers: dict = {}


class ByteLevel:
    """A byte-level tokenizer file: ids of a text without special tokens, and each id's bytes.

    The ids are those of the file's merges, which its ids rank; the names of special tokens are ordinary text.
    """

    def __init__(self, data: bytes):
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        spec = json.loads(data)
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, piece)): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self._encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encode(" " + t) for t in texts]


class Pieces:
    """A piece model file: ids of a text, before which it puts a space, and each id's bytes."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        named = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self._encode = model.encode

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._encode(texts, num_threads=1) if texts else []


class Side:
    """One tokenizer with what alignment needs of each id: bytes, length, whether it begins with a space, decimal digits."""

    def __init__(self, tokenizer):
        self.encode, self.bytes = tokenizer.encode, tokenizer.bytes
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.spaced = np.array([b[:1] == b" " for b in self.bytes], bool)
        self.size = len(self.bytes)
        names = [str(i).encode() for i in range(self.size)]
        self.digits = np.array([len(n) for n in names], np.int64)
        self.decimal = np.array([list(n.ljust(self.digits.max())) for n in names], np.uint8)


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges that begin at ``low``, one range after the other."""
    return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)


class Windows:
    """Aligned windows, end to end, in arrays with room to grow.

    ``text`` holds the groups of each window, every group closed by ``;``, ``pairs`` its linked pairs, ``times`` how often each is
    linked, ``ids_a`` and ``ids_b`` its tokens; ``n_...`` and ``size_...`` are the sizes of these parts, a number per window.
    """

    PARTS = {"text": "n_text", "pairs": "n_pairs", "times": "n_pairs", "ids_a": "size_a", "ids_b": "size_b"}
    COUNTS = ("n_text", "n_pairs", "size_a", "size_b", "n_groups", "n_links")

    def __init__(self):
        self.room = {name: np.zeros(1 << 12, np.uint8 if name == "text" else np.int64) for name in (*self.PARTS, *self.COUNTS)}
        self.used = dict.fromkeys(self.room, 0)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.room[name][: self.used[name]]

    def __len__(self) -> int:
        return self.used["n_text"]

    def add(self, more: dict[str, np.ndarray]) -> None:
        for name, values in more.items():
            have, room = self.used[name], self.room[name]
            if have + len(values) > len(room):
                self.room[name] = np.concatenate([room[:have], np.zeros(max(have, len(values)), room.dtype)])
            self.room[name][have : have + len(values)] = values
            self.used[name] = have + len(values)

    def cut(self, windows: int) -> None:
        """Forget all windows after the first ones."""
        for name, count in self.PARTS.items():
            self.used[name] = int(self[count][:windows].sum())
        self.used.update(dict.fromkeys(self.COUNTS, windows))

    def begins(self, count: str) -> np.ndarray:
        return np.cumsum(self[count]) - self[count]

    def nbytes(self) -> int:
        return sum(self[name].nbytes for name in self.room)


class Aligner:
    """Both tokenizers and the windows seen so far: ``known``, found by a hash of their id tuples (sorted in ``codes``, with each one's
    number in ``numbers``) and taken for the same only if the ids are."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        self.known, self.codes, self.numbers = Windows(), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def windows(self, ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> dict[str, np.ndarray]:
        """Align windows laid end to end, with ``size_a`` and ``size_b`` tokens each."""
        end_a, end_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b])
        shared = np.zeros(end_a[-1] + 1 if len(end_a) else 1, np.uint8)
        shared[end_a] |= 1
        shared[end_b] |= 2
        last_a, last_b = np.flatnonzero(shared[end_a] == 3), np.flatnonzero(shared[end_b] == 3)  # last tokens of each group
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        from_a, from_b = last_a + 1 - n_a, last_b + 1 - n_b
        groups = np.arange(len(n_a))
        # a group's tokens of the one, then those of the other
        place_a = np.arange(len(ids_a)) + np.repeat(from_b, n_a)
        place_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, n_b)
        digits = np.empty(len(ids_a) + len(ids_b), np.int64)
        digits[place_a], digits[place_b] = self.a.digits[ids_a], self.b.digits[ids_b]
        at = np.cumsum(digits + 1) - digits - 1
        text = np.full(int(digits.sum()) + len(digits), ord(","), np.uint8)
        for side, ids, place, last, mark in ((self.a, ids_a, place_a, last_a, "|"), (self.b, ids_b, place_b, last_b, ";")):
            own, n = at[place], side.digits[ids]
            for d in range(side.decimal.shape[1]):
                some = n > d
                text[own[some] + d] = side.decimal[ids[some], d]
            text[own[last] + n[last]] = ord(mark)
        window = np.searchsorted(np.cumsum(size_a), from_a, "right")  # of each group
        token_window = np.searchsorted(np.cumsum(size_a + size_b), np.arange(len(digits)), "right")
        links = n_a * n_b
        small = links <= LONG_WINDOW
        g = np.repeat(groups[small], links[small])
        r = _ranges(np.zeros(small.sum(), np.int64), links[small])
        pairs = ids_a[from_a[g] + r // n_b[g]] * self.b.size + ids_b[from_b[g] + r % n_b[g]]
        times, owner = np.ones(len(pairs), np.int64), window[g]
        more = [(pairs, times, owner)]
        for k in np.flatnonzero(~small).tolist():  # equal ids of a long group are linked together
            x, n = np.unique(ids_a[from_a[k] : from_a[k] + n_a[k]], return_counts=True)
            y, m = np.unique(ids_b[from_b[k] : from_b[k] + n_b[k]], return_counts=True)
            more.append(((x[:, None] * self.b.size + y).ravel(), (n[:, None] * m).ravel(), np.full(len(x) * len(y), window[k])))
        if len(more) > 1:
            pairs, times, owner = (np.concatenate(c) for c in zip(*more))
            order = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[order], times[order], owner[order]
        count = len(size_a)
        return {
            "text": text, "pairs": pairs, "times": times, "ids_a": ids_a, "ids_b": ids_b, "size_a": size_a, "size_b": size_b,
            "n_text": np.bincount(token_window, digits + 1, count).astype(np.int64), "n_pairs": np.bincount(owner, minlength=count),
            "n_groups": np.bincount(window, minlength=count), "n_links": np.bincount(window, links, count).astype(np.int64),
        }

    def looked_up(self, codes: np.ndarray, ids: list[np.ndarray], first: list[np.ndarray], size: list[np.ndarray]) -> np.ndarray:
        """The numbers in ``known`` of distinct windows with sorted ``codes``; those not seen before are aligned now."""
        if self.known.nbytes() + self.codes.nbytes * 2 > MEMO_BYTES:
            self.forget()
        known, at = self.known, np.searchsorted(self.codes, codes)
        hit = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        hit[inside] = self.codes[at[inside]] == codes[inside]
        slot = np.full(len(codes), -1)
        slot[hit] = self.numbers[at[hit]]
        for name, i, f, n in zip("ab", ids, first, size):
            same = np.flatnonzero(hit)
            hit[same] = known[f"size_{name}"][slot[same]] == n[same]
            same = np.flatnonzero(hit)
            other = known[f"ids_{name}"][_ranges(known.begins(f"size_{name}")[slot[same]], n[same])] != i[_ranges(f[same], n[same])]
            hit[np.repeat(same, n[same])[other]] = False
        new = np.flatnonzero(~hit)
        if len(new):
            free = (slot[new] < 0) & ((size[0] + size[1])[new] <= LONG_WINDOW)
            new = np.concatenate([new[free], new[~free]])  # long windows, and any with another one's code, come last and are not kept
            base, kept = len(known), int(free.sum())
            known.add(self.windows(*[i[_ranges(f[new], n[new])] for i, f, n in zip(ids, first, size)], size[0][new], size[1][new]))
            slot[new] = base + np.arange(len(new))
            self.kept = base + kept
            self.numbers = np.insert(self.numbers, at[new[:kept]], slot[new[:kept]])
            self.codes = np.insert(self.codes, at[new[:kept]], codes[new[:kept]])
        else:
            self.kept = len(known)
        return slot

    def align(self, texts: list[bytes]) -> list[tuple]:
        """For each text ``n_a, n_b, n_groups, n_links, groups, pairs, times``; zeros where the two do not cover the same bytes."""
        out: list[tuple] = [(0, 0, 0, 0, b"", b"", b"")] * len(texts)
        at = [k for k, t in enumerate(texts) if t]
        decoded = [texts[k].decode("utf-8", "replace") for k in at]
        tokens = zip(at, self.a.encode(decoded), self.b.encode(decoded))
        whole = [(k, a, b) for k, a, b in tokens if b"".join(map(self.a.bytes.__getitem__, a)) == b"".join(map(self.b.bytes.__getitem__, b)) == b" " + texts[k]]
        if not whole:
            return out
        ids = [np.fromiter(chain.from_iterable(w[side] for w in whole), np.int64) for side in (1, 2)]
        docs = np.cumsum([0] + [len(texts[k]) + 1 for k, _, _ in whole])
        starts, anchors = [], []
        for side, i in zip((self.a, self.b), ids):
            length = side.length[i]
            start = np.cumsum(length) - length
            anchor = np.zeros(docs[-1] + 1, bool)
            anchor[start[side.spaced[i]]] = True
            starts.append(start)
            anchors.append(anchor)
        anchor = anchors[0] & anchors[1]  # both begin a space-marked token here, so both end one
        anchor[docs] = True
        first = [np.flatnonzero(anchor[s]) for s in starts]
        size = [np.diff(f, append=len(s)) for f, s in zip(first, starts)]
        codes = np.zeros(len(first[0]), np.uint64)
        for i, f, n in zip(ids, first, size):
            sums = np.zeros(len(i) + 1, np.uint64)
            np.cumsum(mix(i.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(i)), out=sums[1:])
            codes = mix(codes + (sums[f + n] - sums[f]) * powers(INVERSE, len(i))[f] + n.astype(np.uint64))
        codes, rep, which = np.unique(codes, return_index=True, return_inverse=True)
        slot = self.looked_up(codes, ids, [f[rep] for f in first], [n[rep] for n in size])[which]  # of every window
        known = self.known
        cuts = np.searchsorted(starts[0][first[0]], docs)  # the first window of each document
        owner = np.repeat(np.arange(len(whole)), np.diff(cuts))
        n = known["n_pairs"][slot]
        place = _ranges(known.begins("n_pairs")[slot], n)
        space = self.a.size * self.b.size
        keys, place_of = np.unique(np.repeat(owner, n) * space + known["pairs"][place], return_inverse=True)
        times = np.bincount(place_of, known["times"][place], len(keys)).astype(np.int64)
        edges = np.searchsorted(keys, np.arange(len(whole) + 1) * space).tolist()
        n = known["n_text"][slot]
        text = known["text"][_ranges(known.begins("n_text")[slot], n)].tobytes()
        ends = np.append(0, np.cumsum(n))[cuts].tolist()
        n_groups, n_links = (np.bincount(owner, known[c][slot], len(whole)).astype(np.int64).tolist() for c in ("n_groups", "n_links"))
        known.cut(self.kept)
        for d, (k, a, b) in enumerate(whole):
            e = slice(edges[d], edges[d + 1])
            out[k] = (len(a), len(b), n_groups[d], n_links[d], text[ends[d] : ends[d + 1] - 1], _packed(np.diff(keys[e] - d * space, prepend=0)), _packed(times[e]))
        return out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes: the planes of high bytes are nearly all zero, which any codec takes away."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column and the row each comes from."""
    values = column.to_pylist()
    sizes = np.array([len(v) // 8 for v in values], np.int64)
    numbers = [np.frombuffer(v, np.uint8).reshape(8, -1).T.ravel().view("<i8") for v in values]
    return np.concatenate(numbers) if numbers else np.zeros(0, np.int64), np.repeat(np.arange(len(values)), sizes)


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a packed column of differences and the row each comes from."""
    steps, row = _unpacked(column)
    total = np.cumsum(steps)
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    return total - np.repeat(total[heads] - steps[heads], np.diff(np.append(heads, len(row)))), row


def _align(files: Broadcast, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _tokenizers:
            _tokenizers[key] = Aligner(Side(ByteLevel(files.value[0])), Side(Pieces(files.value[1])))
        aligner, row = _tokenizers[key], TaskContext.get().partitionId() << 36
        for batch in pieces(batches, 1 << 20):
            found = aligner.align(batch.column(1).to_pylist())
            n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*found)
            text = pa.array(groups, pa.binary()).cast(pa.string())
            yield record_batch(ALIGNED, np.arange(row, row + len(found)), batch.column(0), n_a, n_b, n_groups, n_links, text, pairs, times)
            row += len(found)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    size = 0

    def fold():
        every = np.concatenate([held, *waiting])
        weight = np.concatenate([n, np.ones(len(every) - len(held), np.int64)])
        keys, place = np.unique(every, return_inverse=True)
        return keys, np.bincount(place, weight, len(keys)).astype(np.int64)

    for batch in batches:
        waiting.append(_pairs(batch.column(0))[0])
        size += len(waiting[-1])
        if size > HELD:
            held, n = fold()
            waiting, size = [], 0
            if len(held) > HELD:
                yield record_batch(COUNTS, held, n)
                held, n = held[:0], n[:0]
    held, n = fold()
    if len(held):
        yield record_batch(COUNTS, held, n)


def _look_up(table: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, top = table.value
        for batch in batches:
            pairs, row = _pairs(batch.column(1))
            times, _ = _unpacked(batch.column(2))
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            times = np.where(known[at] == pairs, times, 0)
            # exact: the sums stay far below the 2^53 of the doubles that are added
            sums = [np.bincount(row, w, batch.num_rows).astype(np.int64) for w in (times * top[at], times * counts[at])]
            yield record_batch(SUMS, batch.column(0), *sums)

    return run


def alignments(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """Tokens of both tokenizers aligned in each document.

    ``byte_level`` (a byte-level tokenizer's JSON file) encodes a space and the text, ``piece_model`` (a piece model, which adds the
    space itself) the text. Returns one row per document: ``row`` (a number of the row), ``doc_id``, ``n_a`` and ``n_b`` tokens,
    ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``), and its distinct linked pairs with their occurrences packed in
    ``pairs`` and ``times``. The files are read by the driver and travel to the tasks, a few megabytes whatever the data.

    A null or empty text, and one that a tokenizer does not give back byte by byte, has no tokens: zeros and empty text. A null
    ``doc_id`` stays null; repeated rows give a row each; an empty table gives no rows; other columns are not read.
    """
    files = [Path(path).read_bytes() for path in (byte_level, piece_model)]
    key = hashlib.sha256(b"".join(files)).hexdigest()
    return document_columns(docs).mapInArrow(_align(docs.sparkSession.sparkContext.broadcast(files), key), ALIGNED_SQL)


def piece_count(piece_model: str) -> int:
    return len(Pieces(Path(piece_model).read_bytes()).bytes)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``pair`` (first id times ``size_b`` plus second id), ``a``, ``held`` (documents that hold it linked) and ``best`` (the highest of
    its first id)."""
    counts = aligned.select("pairs").mapInArrow(_count, "pair long, held long").groupBy("pair").agg(F.sum("held").alias("held"))
    counts = settle(counts.withColumn("a", F.expr(f"pair div {size_b}")))
    highest = counts.groupBy("a").agg(F.max("held").alias("highest"))
    return counts.join(highest, "a").select("pair", "a", "held", (F.col("held") == F.col("highest")).alias("best"))


def link_sums(aligned: DataFrame, size_b: int) -> DataFrame:
    """For each ``row`` of written ``alignments``: ``n_best``, links whose count is their first id's highest, and ``count_sum``."""
    spark = aligned.sparkSession
    counts = settle(pair_counts(aligned, size_b))
    sizes = [(r["a"], r["n"]) for r in counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy("a").collect()]  # a row per id of the vocabulary
    slices: list[list[int]] = []
    for a, n in sizes:
        if not slices or slices[-1][2] + n > SLICE:
            slices.append([a, a, 0])
        slices[-1][1], slices[-1][2] = a, slices[-1][2] + n
    parts = [aligned.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))]
    for low, high, _ in slices:
        table = counts.where(F.col("a").between(low, high)).select("pair", "held", "best").toArrow().sort_by("pair")
        columns = [table.column(c).to_numpy() for c in ("pair", "held", "best")]
        parts.append(aligned.select("row", "pairs", "times").mapInArrow(_look_up(spark.sparkContext.broadcast(columns)), "row long, n_best long, count_sum long"))
    return reduce(DataFrame.union, parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
