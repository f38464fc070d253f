"""Hierarchical packing of tokenised documents into windows of several lengths.

A document longer than the longest window gives whole windows of its own; what remains of it goes to the tier of the smallest
window that holds it. Tiers are packed from the longest to the shortest: the gap a piece leaves in its window is filled by the
largest shorter pieces that fit, and closed by cutting one. So every window is full but for the last tokens of a partition, which
are laid into the largest windows they fill, and the final rest is the one padded sequence. Sequences are then dealt to step groups
of equal token load, longest first to the lightest group.

Each partition is packed by itself while it is read: nothing is shuffled and a task holds one pool of pieces (``POOL`` tokens) and
one batch. A copy group, a hot source or a very long text changes nothing.
"""

from __future__ import annotations

import heapq
import os
import struct
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from staygrid.llm.shared import document_columns, pieces

TIERS = (4096, 2048, 1024, 512, 256)
POOL = 1 << 20  # tokens that are packed together
STEP = 16  # longest windows in one step group
CACHE = 192 << 20  # bytes of words and their ids that a worker keeps
ENTRY = 160  # bytes of an entry besides its word and ids
LONGEST = 64  # bytes of a word that is kept
MARK = "<|startoftext|>"  # a special token, put between new words so that many are encoded in one call and told apart after it
MARKED = 256  # words in such a call
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_id", pa.int64()),
])
PIECES_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_id long"
_encoders: dict = {}


class WordEncoder:
    """Token ids of a text, word by word.

    The tokenizer drops white space, lower-cases and never joins characters across it, so a text's ids are those of its words in
    order; equal words are encoded once. Words outside ASCII and texts with the start of a special token's name keep their case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.mark, self.size = self.tokenizer.token_to_id(MARK), 0

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        """Words as they are remembered: lower-cased where that cannot change the ids. The tokenizer composes characters before it
        lower-cases them, and a capital with a mark may compose where its small letter does not, or the other way round."""
        if b"<|" in text:
            return text.split()
        return text.lower().split() if text.isascii() else [w.lower() if w.isascii() else w for w in text.split()]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known = self.known
        if self.size > CACHE:
            known.clear()
            self.size = 0
        split = [self._words(t) for t in texts]
        new = list({w for words in split for w in words if w not in known})
        plain = [] if self.mark is None else [w for w in new if b"<|" not in w]
        for i in range(0, len(plain), MARKED):
            some = plain[i : i + MARKED]
            ids = np.array(self._ids([MARK.join([w.decode("utf-8", "replace") for w in some])])[0], "<u4")
            cuts = (4 * np.flatnonzero(ids == self.mark)).tolist()
            raw = ids.tobytes()
            known.update(zip(some, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]))
        rest = [w for w in new if w not in known]
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for word, ids in zip(some, self._ids([w.decode("utf-8", "replace") for w in some])):
                known[word] = struct.pack(f"<{len(ids)}I", *ids)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
            else:
                self.size += ENTRY + len(word) + len(known[word])
        return out


def encoder(path: str) -> WordEncoder:
    """This worker's encoder: its words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Pieces waiting for a window: ``(length, number, doc_id, start, ids, doc_tokens)`` in one list sorted by length."""

    def __init__(self, tiers=TIERS):
        self.tiers, self.waiting, self.tokens, self.number = tiers, [], 0, 0
        self.out: list[tuple[int, list]] = []  # window, pieces

    def _put(self, piece: tuple) -> None:
        self.number += 1
        insort(self.waiting, (piece[0], self.number, *piece[2:]))

    def add(self, doc_id, ids: bytes) -> None:
        total, longest = len(ids) // 4, self.tiers[0]
        full = total - total % longest
        view = memoryview(ids)
        for start in range(0, full, longest):
            self.out.append((longest, [(longest, 0, doc_id, start, view[4 * start : 4 * (start + longest)], total)]))
        if total > full:
            self._put((total - full, 0, doc_id, full, view[4 * full :], total))
            self.tokens += total - full

    def _fill(self, window: int, chosen: list) -> None:
        """Fill a window that already has ``chosen`` from the waiting pieces, which must suffice; the last may be cut."""
        gap = window - sum(p[0] for p in chosen)
        while gap:
            at = bisect_right(self.waiting, (gap, float("inf")))
            if at:
                chosen.append(self.waiting.pop(at - 1))
                gap -= chosen[-1][0]
            else:  # all are longer than the gap: cut the shortest
                n, _, doc_id, start, ids, total = self.waiting.pop(0)
                chosen.append((gap, 0, doc_id, start, ids[: 4 * gap], total))
                self._put((n - gap, 0, doc_id, start + gap, ids[4 * gap :], total))
                gap = 0
        self.tokens -= window
        self.out.append((window, chosen))

    def pack(self, last: bool) -> None:
        for window, shorter in zip(self.tiers, (*self.tiers[1:], 0)):
            while self.waiting and shorter < self.waiting[-1][0] <= window and self.tokens >= window:
                self._fill(window, [self.waiting.pop()])
        if last:
            for window in self.tiers:
                while self.tokens >= window:
                    self._fill(window, [])
            if self.waiting:
                self.out.append((self.tiers[0], self.waiting))
                self.waiting, self.tokens = [], 0

    def take(self) -> list[tuple[int, list]]:
        out, self.out = self.out, []
        return out


def _steps(windows: list[int], longest: int) -> list[int]:
    """A step group for each sequence: the longest first, each to the group with the least tokens so far."""
    groups = max(1, -(-sum(windows) // (STEP * longest)))
    heap, step = [(0, g) for g in range(groups)], [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i]):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + windows[i], g))
        step[i] = g
    return step


def _pack(path: str, end: int, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = encoder(path).encode, Packer(tiers), TaskContext.get().partitionId() << 36
        sequences = steps = 0
        tail = struct.pack("<I", end)

        def emit():
            nonlocal sequences, steps
            done = packer.take()
            step = _steps([w for w, _ in done], tiers[0])
            rows = []
            for (window, chosen), g in zip(done, step):
                offset = 0
                for n, _, doc_id, start, ids, total in chosen:
                    rows.append((doc_id, start, n, bytes(ids), total, base + sequences, offset, window, base + steps + g))
                    offset += n
                sequences += 1
            steps += max(step, default=-1) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

        held = 0
        for batch in pieces(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                packer.add(doc_id, ids + tail)
                held += len(ids) // 4 + 1
                if held >= POOL:
                    packer.pack(last=False)
                    yield from emit()
                    held = packer.tokens
        packer.pack(last=True)
        yield from emit()

    return run


def packed(docs: DataFrame, tokenizer: str, end: int = 2, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of all documents laid into sequences of at most ``tiers[0]`` tokens.

    A document is the ids of its text and then ``end``. Returns one row per piece: ``doc_id``, ``start`` and ``length`` in its
    document, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` there, ``window`` (the length its sequence is
    padded to) and ``step_id``. A null or empty text is a document of the one id ``end``; a null ``doc_id`` stays null; repeated rows
    are packed each; an empty table gives no rows. ``sequence_id`` and ``step_id`` are unique, not gapless.
    """
    return document_columns(docs).mapInArrow(_pack(tokenizer, end, tiers), PIECES_SQL)
