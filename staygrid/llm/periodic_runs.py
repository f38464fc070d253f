"""Runs of words that repeat with a period, found on a grammar of the text.

1. Re-Pair: adjacent word ids that occur together twice or more become a new symbol, the most frequent pair first wherever two
   overlap, round after round until no pair is left that repeats. The text is then a sequence of symbols and a set of rules.
2. Borders: a run either crosses the border of two symbols of the final sequence, or lies inside one symbol. Inside, it crosses the
   border between the two halves of exactly one rule that holds it whole. So it is enough to look at the borders of the sequence, and
   at each rule's border once, at the first place where the rule occurs.
3. What a rule's border showed, cut to the rule's words, holds at all other places that derive from the rule: it is translated there.
4. Stretches of equal period that overlap by a period or more belong to one run and are merged.

At a border, a run of least period q and three periods repeats its grams of 8, 16, 32, ... words (the first length not below q) at a
distance of exactly q and no less, so next occurrences of grams around the border give period and place; the words themselves are
then compared to both sides, which makes start and end exact.

A document is handled whole in the task that reads it, in time near linear in its words; nothing is shuffled. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from staygrid.llm.shared import document_columns, pieces
from staygrid.llm.words import SAME, mix, words_of

WORDS, PERIODS = 24, 3  # least words and periods of a run
GRAM = 8  # words of the shortest gram; a run of WORDS words holds a gram and its repetition at any period up to it
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_SQL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@dataclass
class Grammar:
    """Symbols below ``words`` are word ids; ``words + k`` is rule k, made of ``left[k]`` and ``right[k]``."""

    words: int
    symbols: np.ndarray  # the final sequence of all documents
    places: np.ndarray  # the word at which each of its symbols begins
    left: np.ndarray
    right: np.ndarray
    start: np.ndarray  # first place of each rule, the border between its halves, and its end
    border: np.ndarray
    end: np.ndarray
    rounds: list[int] = field(default_factory=list)  # rules made before each round; a rule's parts come from earlier rounds


def _chosen(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the pairs at ``at`` those to replace: the heaviest first, none that overlaps a chosen one. Equal neighbours, as in a stretch
    of one repeated symbol, are taken alternately from its left end."""
    out = []
    while len(at):
        touch = np.diff(at) == 1
        lead, trail = np.zeros(len(at), weight.dtype), np.zeros(len(at), weight.dtype)
        lead[1:][touch] = weight[:-1][touch]
        trail[:-1][touch] = weight[1:][touch]
        order = np.arange(len(at))
        odd = (order - np.maximum.accumulate(np.where(lead == weight, 0, order))) & 1
        top = (weight >= lead) & (weight >= trail) & (odd == 0)
        out.append(at[top])
        gone = top.copy()
        gone[1:] |= top[:-1] & touch
        gone[:-1] |= top[1:] & touch
        at, weight = at[~gone], weight[~gone]
    return np.sort(np.concatenate(out)) if out else at


def compressed(ids: np.ndarray, first: np.ndarray) -> Grammar:
    """Re-Pair over word ids; ``first`` holds the first word of each document and the number of words. No pair joins two documents."""
    n = len(ids)
    words = int(ids.max()) + 1 if n else 0
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    symbols, places, ends = ids.astype(np.int64), np.arange(n), np.arange(n) + 1
    open_ = ~begins[1:n]
    parts: list[tuple[np.ndarray, ...]] = []
    total, rounds = 0, []
    while True:
        at = np.flatnonzero(open_)
        pairs, which, counts = np.unique(symbols[at] << 32 | symbols[at + 1], return_inverse=True, return_counts=True)
        often = counts[which] > 1
        at, which = at[often], which[often]
        if not len(at):
            break
        weight = (counts.astype(np.uint64) << np.uint64(32)) | (mix(pairs.astype(np.uint64)) >> np.uint64(32))
        at = _chosen(at, weight[which])
        pairs, place, which = np.unique(symbols[at] << 32 | symbols[at + 1], return_index=True, return_inverse=True)
        where = at[place]
        parts.append((pairs >> 32, pairs & 0xFFFFFFFF, places[where], places[where + 1], ends[where + 1]))
        rounds.append(total)
        symbols[at], ends[at] = words + total + which, ends[at + 1]
        total += len(pairs)
        stays, new = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
        stays[at + 1], new[at] = False, True
        symbols, places, ends, new = symbols[stays], places[stays], ends[stays], new[stays]
        open_ = (new[:-1] | new[1:]) & ~begins[places[1:]]  # pairs without a new symbol occur once from now on
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
    return Grammar(words, symbols, places, *columns, rounds=[*rounds, total])


def _same(ids: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The stretch of words around ``at`` that equal the words ``period`` further on, as far as the run reaches."""
    start, step = at, 32
    while start > low:
        a = max(low, start - step)
        other = np.flatnonzero(ids[a:start] != ids[a + period : start + period])
        if len(other):
            start = a + int(other[-1]) + 1
            break
        start, step = a, 4 * step
    end, step = at + period, 32
    while end < high:
        b = min(high, end + step)
        other = np.flatnonzero(ids[end:b] != ids[end - period : b - period])
        if len(other):
            end += int(other[0])
            break
        end, step = b, 4 * step
    return start, end


def border_runs(ids: np.ndarray, first: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Rows of start, end and period: all runs that hold the words on both sides of one of ``borders``, sorted by start."""
    n = len(ids)
    lengths = np.diff(first)
    if not n or lengths.max() < WORDS or not len(borders):
        return np.zeros((0, 3), np.int64)
    last, low = np.repeat(first[1:], lengths), np.repeat(first[:-1], lengths)
    marks = np.zeros(n + 2, np.int64)
    marks[borders + 1] = 1
    before = np.cumsum(marks)  # borders before a word position
    code = mix(ids.astype(np.uint64) + np.uint64(1))

    def doubled(code: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        if size < n:
            out[: n - size] = mix(code[: n - size] * np.uint64(0x9E3779B97F4A7C15) + code[size:])
        return out

    size = 1
    while size < GRAM:
        code, size = doubled(code, size), 2 * size
    at = np.flatnonzero(np.arange(n) + GRAM <= last)
    order = np.argsort(code[at])
    sorted_ = code[at][order]
    twice = np.zeros(len(at) + 1, bool)
    twice[1:-1] = sorted_[1:] == sorted_[:-1]
    alive = np.sort(at[order[twice[1:] | twice[:-1]]])  # no other gram can be part of a run
    out: set[tuple[int, int, int]] = set()
    while len(alive) and size < 2 * lengths.max() // PERIODS + GRAM:
        at = alive[alive + size <= last[alive]]
        at = at[before[np.minimum(at + 2 * size, n)] > before[np.maximum(at - size + 1, 0)]]
        order = np.lexsort((at, code[at]))
        at, grams = at[order], code[at][order]
        distance = np.diff(at)
        near = (grams[1:] == grams[:-1]) & (distance <= size) & (distance > (size // 2 if size > GRAM else 0))
        seeds, periods = at[:-1][near], distance[near]
        crosses = before[np.minimum(seeds + size + periods, n)] > before[seeds + 1]
        seeds, periods = seeds[crosses], periods[crosses]
        order = np.lexsort((seeds, periods))
        seeds, periods = seeds[order], periods[order]
        heads = np.ones(len(seeds), bool)
        heads[1:] = (np.diff(seeds) != 1) | (np.diff(periods) != 0)
        period, reached = 0, 0
        for seed, q in zip(seeds[heads].tolist(), periods[heads].tolist()):
            if q == period and seed + q < reached:  # in the run found last
                continue
            start, end = _same(ids, seed, q, int(low[seed]), int(last[seed]))
            period, reached = q, end
            if end - start >= max(WORDS, PERIODS * q):
                out.add((start, end, q))
        code, size = doubled(code, size), 2 * size
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges from ``low`` to ``high``, each with the range it comes from."""
    counts = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + low[owner]


def translated(grammar: Grammar, runs: np.ndarray) -> np.ndarray:
    """What ``runs`` show at the first place of each rule, carried to all places that derive from it."""
    rules = len(grammar.left)
    if not rules or not len(runs):
        return np.zeros((0, 3), np.int64)
    by_border = np.argsort(grammar.border, kind="stable")
    sorted_ = grammar.border[by_border]
    run, k = _spread(np.searchsorted(sorted_, runs[:, 0], "right"), np.searchsorted(sorted_, runs[:, 1], "left"))
    rule = by_border[k]
    start, end, period = np.maximum(runs[run, 0], grammar.start[rule]), np.minimum(runs[run, 1], grammar.end[rule]), runs[run, 2]
    long_ = end - start >= np.maximum(WORDS, PERIODS * period)
    rule, start, end, period = rule[long_], start[long_] - grammar.start[rule[long_]], end[long_] - grammar.start[rule[long_]], period[long_]
    order = np.argsort(rule, kind="stable")
    rule, start, end, period = rule[order], start[order], end[order], period[order]
    holds = np.zeros(grammar.words + rules, bool)  # symbols with a stretch somewhere inside
    holds[grammar.words + rule] = True
    for a, b in zip(grammar.rounds, grammar.rounds[1:]):
        holds[grammar.words + a : grammar.words + b] |= holds[grammar.left[a:b]] | holds[grammar.right[a:b]]
    symbols, places, out = grammar.symbols, grammar.places, []
    while True:
        inside = holds[symbols]
        k, places = symbols[inside] - grammar.words, places[inside]
        if not len(k):
            break
        owner, stretch = _spread(np.searchsorted(rule, k, "left"), np.searchsorted(rule, k, "right"))
        out.append(np.stack([places[owner] + start[stretch], places[owner] + end[stretch], period[stretch]], 1))
        symbols = np.concatenate([grammar.left[k], grammar.right[k]])
        places = np.concatenate([places, places + grammar.border[k] - grammar.start[k]])
    return np.concatenate([np.zeros((0, 3), np.int64), *out])


def merged(runs: np.ndarray) -> np.ndarray:
    """Stretches of one period that share a period or more made one; sorted by start, then period."""
    out: list[list[int]] = []
    for start, end, period in runs[np.lexsort((runs[:, 0], runs[:, 2]))].tolist():
        if out and out[-1][2] == period and start <= out[-1][1] - period:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, period])
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def runs_of(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All runs of documents laid end to end: rows of start, end and period. ``ids`` of different documents must differ."""
    grammar = compressed(ids, first)
    begins = np.zeros(len(ids) + 1, bool)
    begins[first] = True
    large = grammar.end - grammar.start >= WORDS
    borders = np.concatenate([grammar.places[~begins[grammar.places]], grammar.border[large]])
    runs = border_runs(ids, first, borders)
    return merged(np.concatenate([runs, translated(grammar, runs)]))


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that stands at each of a document's ``n`` places once its end repeats, for the tenth of ids that do; else None."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    return source


def _find(loops: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            words = words_of(texts, SAME)
            first, counts = words.first, words.counts()
            source, changed = np.arange(len(words.starts)), set()
            for k in range(len(ids)) if loops else ():
                own = looped(ids[k], int(counts[k]))
                if own is not None:
                    source[first[k] : first[k + 1]] = first[k] + own
                    changed.add(k)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint64), counts)
            codes = np.unique(mix(words.hashes() ^ mix(owner + np.uint64(1))), return_inverse=True)[1]
            runs = runs_of(codes[source], first)
            own_runs: dict[int, list] = {}
            for k, (start, end, period) in zip((np.searchsorted(first, runs[:, 0], "right") - 1).tolist(), runs.tolist()):
                own_runs.setdefault(k, []).append((start - int(first[k]), end - start, period))
            collapsed = []
            for k in range(len(ids)):
                own = texts[k].as_py().split()
                if k in changed or k in own_runs:
                    own = [own[i] for i in (source[first[k] : first[k + 1]] - first[k]).tolist()]
                if k in own_runs:
                    drop = np.zeros(len(own) + 1, np.int64)
                    for start, length, period in own_runs[k]:
                        drop[start + period] += 1
                        drop[start + length] -= 1
                    own = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(own))
            found = [[{"start": s, "length": n, "period": p} for s, n, p in own_runs.get(k, [])] for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, FOUND.field("runs").type), pa.array(collapsed, pa.binary()).cast(pa.string())], schema=FOUND)

    return run


def periodic_runs(docs: DataFrame, loops: bool = False) -> DataFrame:
    """The maximal periodic runs of each document's words, and the text with each run cut to its first period.

    A run has at least ``WORDS`` words and ``PERIODS`` of its least period. Returns one row per document: ``doc_id``, ``n_words``,
    ``runs`` (``start``, ``length``, ``period`` in words, by start, then period) and ``collapsed`` (the words that no run holds after
    its first period, joined by one space). With ``loops``, the end of the tenth of documents named by ``looped`` repeats first.

    A null or empty text has no words, no runs and an empty ``collapsed``; a null ``doc_id`` stays null and is never looped; repeated
    rows give a row each; an empty table gives no rows; other columns are not read. Equal stretches at several places are runs each.
    """
    return document_columns(docs).mapInArrow(_find(loops), FOUND_SQL)
