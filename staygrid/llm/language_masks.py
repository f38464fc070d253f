"""Language identification by bit-sliced Bloom filters over character n-grams.

The filter is an array of bit masks, one bit for each language. An n-gram that is frequent in a language sets that language's bit in
its slots; the conjunction of an n-gram's slots gives all languages that contain it, in one look-up for all languages. A document's
hits are counted by language, corrected for the share of n-grams that a filter of that fill would accept by chance, and the
language with the most decides.

An n-gram is five consecutive bytes of the lower-cased text (A-Z), letters and spaces only: other ASCII characters and runs of
white space count as one space. A language's n-grams are those that make up at least ``1 / GRAMS`` of all its n-grams, so there
are never more than ``GRAMS`` of them, and the filter's size is bounded by the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staygrid.llm.shared import bound_batches, flat_bytes, pieces, remainder, text_bytes
from staygrid.llm.words import mix

GRAMS = 1 << 16
SLOTS = 1 << 21
HASHES = 3
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (``width`` bytes in an int64, at most 7) of each value, and where each value's begin."""
    raw, offsets = flat_bytes(column)
    sizes = np.diff(offsets)
    # a space before and after each value, then no two spaces in a row
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
    data = np.full(len(raw) + 2 * len(sizes), 32, np.uint8)
    data[at] = FOLD[raw]
    begins = offsets + 2 * np.arange(len(offsets))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[begins[:-1]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    data, begins = data[keep].astype(np.int64), place[begins]
    counts = np.maximum(np.diff(begins) - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), first
    packed = data[:n].copy()
    for k in range(1, width):
        packed <<= 8
        packed |= data[k : k + n]
    return packed[np.repeat(begins[:-1] - first[:-1], counts) + np.arange(first[-1])], first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n) summed over some batches of a partition at a time."""
    held: dict[str, list] = {}

    def flush():
        for lang, parts in held.items():
            values, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    def merged(parts):
        values = np.concatenate([v for v, _ in parts])
        values, at = np.unique(values, return_inverse=True)
        return values, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in pieces(batches):
        found, first = grams(batch.column(1))
        langs, code = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
        owner = np.repeat(code, np.diff(first))
        for i, lang in enumerate(langs):
            values, n = np.unique(found[owner == i], return_counts=True)
            held.setdefault(str(lang), []).append((values, n))
        for lang, parts in held.items():
            if len(parts) > 8:
                held[lang] = [merged(parts)]
        if sum(len(v) for parts in held.values() for v, _ in parts) > 2_000_000:
            yield from flush()
    yield from flush()


def slots_of(values: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    """The slots of each n-gram, by double hashing."""
    h = mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


class LanguageMasks:
    """The learned filter: ``masks[word][slot]``, each word for 32 languages."""

    def __init__(self, languages: list[str], grams_by_language: list[np.ndarray], slots: int = SLOTS):
        self.languages = languages
        self.masks = np.zeros((max(1, -(-len(languages) // 32)), slots), np.uint32)
        self.chance = np.zeros(len(languages))
        for i, found in enumerate(grams_by_language):
            word, bit = self.masks[i // 32], np.uint32(1 << (i % 32))
            for s in slots_of(found, slots):
                word[s] |= bit
            self.chance[i] = np.count_nonzero(word & bit) / slots
        self.chance **= HASHES

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By document: n-grams found in each language, corrected for chance, and the number of n-grams."""
        found, first = grams(column)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        slots = slots_of(found, self.masks.shape[1])
        for w, words in enumerate(self.masks):
            mask = words[slots[0]]
            for s in slots[1:]:
                mask &= words[s]
            for i in range(32 * w, min(32 * w + 32, len(self.languages))):
                total = np.concatenate([[0], np.cumsum((mask >> np.uint32(i % 32)) & np.uint32(1), dtype=np.int64)])
                out[:, i] = total[first[1:]] - total[first[:-1]]
        return np.maximum((out - n[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9), 0), n

    def decide(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column))
        hits, n = self.hits(column)
        best = hits.argmax(axis=1)
        top = hits[np.arange(len(n)), best]
        rest = hits.copy()
        rest[np.arange(len(n)), best] = 0
        second = rest.max(axis=1)
        score = np.where(n > 0, np.clip(0.5 + 0.5 * (top - second) / np.maximum(top, 1e-9), 0, 1), 0.0)
        return [self.languages[b] for b in best], score


def learn(docs: DataFrame) -> LanguageMasks:
    """Count all n-grams of ``docs`` (``text``, ``lang`` not null) by language and build the filter."""
    bound_batches(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL").select("lang", text_bytes().alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "lang").where(F.col("n") * GRAMS >= F.col("total")).select("lang", "gram")
    table: pd.DataFrame = frequent.toPandas()  # at most GRAMS rows for each language
    languages = sorted(table["lang"].unique())
    return LanguageMasks(languages, [np.sort(table.loc[table["lang"] == x, "gram"].to_numpy(np.int64)) for x in languages])


def identified(docs: DataFrame, model: LanguageMasks) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``lang_pred`` and ``score`` (0 to 1, by the lead over the second language).

    ``und`` with score 0 for a null text or one without a letter. A text with letters always gets a learned language (the first by
    name where nothing is found); ``und`` for all if none was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            langs, score = model.decide(batch.column(1))
            known = np.array(batch.column(2).to_pylist(), bool)
            langs = [x if k else "und" for x, k in zip(langs, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), letters.alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out_languages(docs: DataFrame, modulus: int = 4, kept_back: int = 2) -> DataFrame:
    """Learn from the documents whose id's crc32 modulo ``modulus`` is not ``kept_back`` and predict all, with ``held_out``."""
    model = learn(docs.where(remainder(modulus) != kept_back))
    return identified(docs, model).select("doc_id", (remainder(modulus) == kept_back).alias("held_out"), "lang_pred", "score")
