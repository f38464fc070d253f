"""Runs found on the grammar against all runs found by comparing every pair of words a period apart."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from staygrid.llm import periodic_runs, queries


def plain_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and not any(all(words[k] == words[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_document(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(160))]
    if kind == 1:
        return [rng.randrange(3) for _ in range(rng.randrange(60))] * rng.randrange(1, 6)
    if kind == 2:
        unit = [rng.randrange(50) for _ in range(rng.randrange(1, 40))]
        noise = lambda: [rng.randrange(50) for _ in range(rng.randrange(30))]
        return noise() + (unit * 5)[: rng.randrange(1, len(unit) * 5 + 1)] + noise() + (unit * 4)[rng.randrange(len(unit)):]
    if kind == 3:
        a, b = [0], [0, 1]
        for _ in range(10):
            a, b = b, b + a
        return b[: rng.randrange(200)]
    if kind == 4:
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        return (unit * rng.randrange(3, 7) + [9]) * rng.randrange(1, 6) + unit * rng.randrange(6)
    return [7] * rng.randrange(100) + [8] + [7] * rng.randrange(100)


def test_runs_of_many_documents():
    rng, total = random.Random(5), 0
    for _ in range(300):
        docs = [odd_document(rng) for _ in range(rng.randrange(1, 5))]
        first = np.cumsum([0, *map(len, docs)])
        ids = np.unique(np.array([1000 * k + w for k, d in enumerate(docs) for w in d], np.int64), return_inverse=True)[1]
        got = [tuple(r) for r in periodic_runs.runs_of(ids, first).tolist()]
        want = [(first[k] + s, first[k] + s + n, q) for k, d in enumerate(docs) for s, n, q in plain_runs(d)]
        assert got == sorted(want, key=lambda r: (r[0], r[2]))
        total += len(want)
    assert total > 500


def test_grammar_derives_its_text_and_repeats_no_pair():
    rng = random.Random(8)
    for _ in range(100):
        docs = [odd_document(rng) for _ in range(3)]
        first = np.cumsum([0, *map(len, docs)])
        ids = np.unique(np.array([1000 * k + w for k, d in enumerate(docs) for w in d], np.int64), return_inverse=True)[1]
        g = periodic_runs.compressed(ids, first)

        def words(symbol):
            return [symbol] if symbol < g.words else words(g.left[symbol - g.words]) + words(g.right[symbol - g.words])

        assert [w for s in g.symbols for w in words(s)] == ids.tolist()
        seen, last = set(), None
        for i in range(len(g.symbols) - 1):
            pair = (g.symbols[i], g.symbols[i + 1])
            if g.places[i + 1] in first or (last == pair and pair[0] == pair[1]):  # two documents, or an overlap in a stretch of one symbol
                last = None
                continue
            assert pair not in seen
            seen.add(pair)
            last = pair


def test_rule_borders_are_looked_at_once():
    """A stretch that lies inside one symbol is seen at the rule's first place only and translated to the others."""
    unit = list(range(5)) * 8
    words = unit + [90] + unit + [91] + unit + [92]
    ids, first = np.array(words, np.int64), np.array([0, len(words)])
    g = periodic_runs.compressed(ids, first)
    large = g.end - g.start >= 24
    direct = periodic_runs.border_runs(ids, first, g.border[large])
    assert len(direct) < 3
    found = periodic_runs.merged(np.concatenate([direct, periodic_runs.translated(g, direct)]))
    assert {(0, 40, 5), (41, 81, 5), (82, 122, 5)} <= {tuple(r) for r in found.tolist()}


def test_query(spark, tmp_path):
    rng = random.Random(11)
    words = ["Wort", "wort", "a", "é", "x.", "日本"]
    texts = [" ".join(words[w % 6] + str(w // 6 or "") for w in odd_document(rng)) for _ in range(120)]
    texts += [None, "", " \t\n ", "one", "a " * 60_000, ("ab\x0bcd\x0cef " * 30), "\x85 \xa0 " * 40, texts[3], "long " + " ".join(f"w{i % 7_000}" for i in range(22_000))]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[1], 0)]
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3).write.parquet(folder)
    got = sorted((tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s).hexdigest()
    want, looped = [], 0
    for doc_id, text, _ in rows:
        own = (text or "").encode().split()
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and own:
            g, n = h // 10, len(own)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own, looped = [w if i < a else own[a + (i - a) % p] for i, w in enumerate(own)], looped + 1
        runs = [(0, 60_000, 1)] if len(own) == 60_000 and len(set(own)) == 1 else plain_runs(own) if len(own) < 2_000 else [(1, 22_000, 7_000)]
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        want.append((doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
                     sha(b" ".join(w for i, w in enumerate(own) if i not in dropped))))
    assert got == sorted(want, key=repr) and looped > 5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(empty).collect() == []
