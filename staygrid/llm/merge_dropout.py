"""SentencePiece BPE with seeded merge-dropout, and its decoder.

A text is cut before every run of spaces; no piece reaches over such a cut, so the units are encoded apart. Within a unit the best
candidate merge (lowest piece rank, then leftmost) is taken from an agenda until none is left. A candidate is skipped for good
when the keyed hash of (seed, variant, unit, where its two parts begin and end) falls below the dropout rate: other merges are
then made, so a seed gives its own segmentation, the same on every run and machine. Documents are dealt to ``VARIANTS``
variants by a hash of their id. Characters that are no piece become byte pieces, and so does U+2581, which stands for a space
in pieces; decoding any segmentation returns the text's bytes.

Equal units of a variant are encoded once. Units of up to ``SHORT`` symbols go through the agenda together as arrays; longer ones use
a heap.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from staygrid.llm.shared import document_columns, pieces
from staygrid.llm.words import mix

RATE = 0.1
VARIANTS = 4
SHORT = 32
ROWS = 4000  # units in one round of arrays
CACHE = 300_000  # units whose ids a worker keeps
UNIT = re.compile(rb" *[^ ]+| +$")
SPACE = "▁"
KEYS = tuple(np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F))
NEVER = np.int64(1 << 40)
WORD = (1 << 64) - 1
_coders: dict = {}


@dataclass
class Vocabulary:
    """Pieces of a model: ids of characters and bytes, and for each mergeable pair of pieces the merged one."""

    chars: dict[str, int]
    bytes_: list[int]
    pairs: np.ndarray  # sorted left * size + right
    merged: np.ndarray
    rank: np.ndarray  # by piece id, lower is better
    raw: list[bytes]  # a piece's bytes in the text
    size: int
    lookup: dict[int, int]
    of_point: np.ndarray  # piece id of a code point, -1 without one

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = i
        keys = np.array(sorted(pairs), np.int64)
        scores = np.array([model.get_score(i) for i in range(size)])
        rank = np.empty(size, np.int64)
        rank[np.lexsort((np.arange(size), -scores))] = np.arange(size)
        raw = [b""] * size
        for piece, i in normal.items():
            raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(bytes_):
            raw[i] = bytes([b])
        chars = {piece: i for piece, i in normal.items() if len(piece) == 1 and piece != SPACE} | ({" ": normal[SPACE]} if SPACE in normal else {})
        of_point = np.full(0x110000, -1, np.int32)
        of_point[[ord(c) for c in chars]] = list(chars.values())
        return cls(chars, bytes_, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), rank, raw, size, pairs, of_point)

    def symbols(self, unit: str) -> list[int]:
        """A piece for each character; a character that has none gives its bytes' pieces, negative as they never merge."""
        out = []
        for ch in unit:
            i = self.chars.get(ch)
            if i is None:
                out += [-self.bytes_[b] - 1 for b in ch.encode()]
            else:
                out.append(i)
        return out


def skipped(keys, begin, middle, end, rate: float) -> np.ndarray:
    """Whether a candidate merge of the symbols ``begin`` to ``middle`` and ``middle`` to ``end`` is dropped."""
    h = keys + begin.astype(np.uint64) * KEYS[0] + middle.astype(np.uint64) * KEYS[1] + end.astype(np.uint64) * KEYS[2]
    return (mix(h) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def skipped_one(key: int, begin: int, middle: int, end: int, rate: float) -> bool:
    """``skipped`` for one candidate."""
    h = (key + begin * int(KEYS[0]) + middle * int(KEYS[1]) + end * int(KEYS[2])) & WORD
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & WORD
    return ((h ^ (h >> 31)) >> 11) * 2.0**-53 < rate


def by_agenda(vocabulary: Vocabulary, symbols: list[int], key: int, rate: float) -> list[int]:
    """One unit through a heap of candidates."""
    n = len(symbols)
    symbols, after, before, end = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and symbols[i] >= 0 and symbols[j] >= 0:
            merged = vocabulary.lookup.get(symbols[i] * vocabulary.size + symbols[j])
            if merged is not None and not skipped_one(key, i, j, end[j], rate):
                heapq.heappush(agenda, (int(vocabulary.rank[merged]), i, j, end[j], merged))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while agenda:
        _, i, j, e, merged = heapq.heappop(agenda)
        if gone[i] or gone[j] or after[i] != j or end[j] != e:
            continue
        symbols[i], after[i], end[i], gone[j] = merged, after[j], e, True
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s if s >= 0 else -s - 1 for s, dead in zip(symbols, gone) if not dead]


def together(vocabulary: Vocabulary, symbols: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Many units of one length at once (rows of ``symbols``): in each round every unit makes its best merge.

    Returns the symbols and which of them are left; the result is that of ``by_agenda``.
    """
    rows, width = symbols.shape
    pairs, merged, rank, size = vocabulary.pairs, vocabulary.merged, vocabulary.rank, vocabulary.size
    # flat arrays with one place to spare after each row, its symbol is negative like all that never merge
    step = width + 1
    flat = np.full((rows, step), -1, np.int64)
    flat[:, :width] = symbols
    live = np.zeros((rows, step), bool)
    live[:, :width] = True
    flat, live = flat.ravel(), live.ravel()
    after = np.minimum(np.tile(np.arange(1, step + 1), rows), step - 1) + np.repeat(np.arange(rows) * step, step)
    before = np.arange(rows * step) - 1
    end = after - np.repeat(np.arange(rows) * step, step)
    cost = np.full(rows * step, NEVER)

    def price(at: np.ndarray) -> None:
        """The rank of merging each place with the next, NEVER if there is no such piece or the candidate is skipped."""
        right = after[at]
        x, y = flat[at], flat[right]
        pair = x * size + y
        found = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        cost[at] = NEVER
        some = np.flatnonzero((pairs[found] == pair) & (x >= 0) & (y >= 0) & (at != right))
        if len(some):
            place, line = at[some], at[some] // step
            some = some[~skipped(keys[line], place - line * step, right[some] - line * step, end[right[some]], rate)]
            cost[at[some]] = rank[merged[found[some]]]

    price(np.flatnonzero(live))
    grid, lines = cost.reshape(rows, step), np.arange(rows)
    while len(lines):
        best = grid[lines].argmin(axis=1) + lines * step
        go = cost[best] < NEVER
        lines, best = lines[go], best[go]
        if not len(lines):
            break
        right = after[best]
        flat[best] = merged[np.searchsorted(pairs, flat[best] * size + flat[right])]
        live[right] = False
        cost[right] = NEVER
        end[best] = end[right]
        after[best] = after[right]  # the spare place stands for the row's end and never merges
        before[after[right]] = best
        price(best)
        left = before[best]
        left = left[(left >= lines * step) & live[np.maximum(left, 0)]]
        if len(left):
            price(left)
    return flat.reshape(rows, step), live.reshape(rows, step)


class Coder:
    """Encodes and decodes with one model, seed and rate; keeps the units it has seen."""

    def __init__(self, path: str, seed: int = 1, rate: float = RATE):
        self.vocabulary, self.seed, self.rate = Vocabulary.load(path), seed, rate
        self.known: list[dict[bytes, bytes]] = [{} for _ in range(VARIANTS)]
        self.lengths = np.array([len(x) for x in self.vocabulary.raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.vocabulary.raw), np.uint8)

    def variant(self, doc_id) -> int:
        return xxhash.xxh3_64_intdigest(str(doc_id).encode(), self.seed) % VARIANTS

    def _learn(self, variant: int, units: list[bytes]) -> None:
        known, vocabulary = self.known[variant], self.vocabulary
        salt = (self.seed * 1_000_003 + variant) & 0xFFFFFFFFFFFFFFFF
        keys = np.array([xxhash.xxh3_64_intdigest(u, salt) for u in units], np.uint64)
        texts = [u.decode("utf-8", "replace") for u in units]
        sizes = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.concatenate([[0], np.cumsum(sizes)])
        symbols = vocabulary.of_point[points]
        odd = np.concatenate([[0], np.cumsum(symbols < 0)])
        plain = (odd[first[1:]] == odd[first[:-1]]) & (sizes <= SHORT)
        other: dict[int, list] = {}
        for k in np.flatnonzero(~plain).tolist():
            found = vocabulary.symbols(texts[k])
            if len(found) > SHORT:
                known[units[k]] = np.array(by_agenda(vocabulary, found, int(keys[k]), self.rate), "<u4").tobytes()
            else:
                other.setdefault(len(found), []).append((k, found))
        for pairs in other.values():
            which, found = zip(*pairs)
            self._keep(known, units, np.array(which), np.array(found, np.int64), keys)
        for n in np.unique(sizes[plain]).tolist():
            which = np.flatnonzero(plain & (sizes == n))
            self._keep(known, units, which, symbols[first[which][:, None] + np.arange(n)], keys)

    def _keep(self, known: dict, units: list[bytes], which: np.ndarray, symbols: np.ndarray, keys: np.ndarray) -> None:
        for a in range(0, len(which), ROWS):
            some = which[a : a + ROWS]
            ids, live = together(self.vocabulary, symbols[a : a + ROWS], keys[some], self.rate)
            cuts = (4 * np.concatenate([[0], np.cumsum(live.sum(axis=1))])).tolist()
            ids = ids[live]
            raw = np.where(ids >= 0, ids, -ids - 1).astype("<u4").tobytes()
            for k, x, y in zip(some.tolist(), cuts, cuts[1:]):
                known[units[k]] = raw[x:y]

    def encode(self, texts: list[bytes], variants: list[int]) -> list[bytes]:
        """Little-endian 32-bit ids of each text (UTF-8); no ids for an empty one."""
        if sum(map(len, self.known)) > CACHE:
            self.known = [{} for _ in range(VARIANTS)]
        split = [UNIT.findall(b" " + t) if t else [] for t in texts]
        wanted: list[set] = [set() for _ in range(VARIANTS)]
        for units, v in zip(split, variants):
            wanted[v].update(units)
        for v, units in enumerate(wanted):
            if new := [u for u in units if u not in self.known[v]]:
                self._learn(v, new)
        return [b"".join(map(self.known[v].__getitem__, units)) for units, v in zip(split, variants)]

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes, whatever the segmentation."""
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.lengths[found]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[found] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes()[1:]


def coder(path: str, seed: int, rate: float) -> Coder:
    """This worker's coder."""
    if (path, seed, rate) not in _coders:
        _coders[path, seed, rate] = Coder(path, seed, rate)
    return _coders[path, seed, rate]


def encoded(docs: DataFrame, model: str, seed: int = 1, rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``variant``, ``ids`` (little-endian 32-bit, binary) and ``lossless`` (decoding gives the text).

    A null or empty text has no ids; a null ``doc_id`` has a variant of its own. Equal rows get equal ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model, seed, rate)
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            variants = [own.variant(d) for d in batch.column(0).to_pylist()]
            ids = own.encode(texts, variants)
            lossless = [own.decode(i) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(variants, pa.int32()), pa.array(ids, pa.binary()), pa.array(lossless)], ["doc_id", "variant", "ids", "lossless"])

    return document_columns(docs).mapInArrow(run, "doc_id long, variant int, ids binary, lossless boolean")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` (``doc_id``, ``ids``) as ``doc_id``, ``text``; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model, 1, 0.0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(i).decode() for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", F.coalesce("ids", F.lit("").cast("binary")).alias("ids")).mapInArrow(run, "doc_id long, text string")
