"""Alignments and link counts against plain loops over both tokenizers."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staygrid.llm import queries, token_anchors


def plain(texts):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(shown))}
    out = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append([])
            continue
        ends, total = [], [0, 0]
        for side, tokens in enumerate((bytes_a, bytes_b)):
            at = 0
            ends.append([at := at + len(t) for t in tokens])
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for high in shared:
            groups.append(([i for i, e in zip(ids_a, ends[0]) if low < e <= high], [i for i, e in zip(ids_b, ends[1]) if low < e <= high]))
            low = high
        out.append(groups)
    held = Counter(p for groups in out for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for groups in out:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links),
                     sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows


def texts():
    rng = random.Random(4)
    words = "the of house über straße naïve tokenization 12345 don't O'Neil x=1; 日本語 🙂 é <s> <|endoftext|> </s> ▁ ﬁ foo_bar    \n\n\t\r\n http://a.b/c?d=e".split(" ")
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    out += ["".join(chr(rng.randrange(1, 0x500)) for _ in range(40)) for _ in range(40)]
    return out + [None, "", " ", "  two", "end ", "\x00", "a", "1" * 3_000, "x" * 3_000, "ab" * 20, "é" * 900, " " * 50, out[0], out[0]]


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_query(spark, tmp_path, size, monkeypatch):
    """Also with slices of a few pairs, so that counts come back in many turns."""
    monkeypatch.setattr(token_anchors, "SLICE", size)
    own = [(i, t, "x") for i, t in enumerate(texts())] + [(3, texts()[3], "x"), (None, "no id", "x")]
    if size < 100:
        own = own[:8]
    spark.createDataFrame(own, "doc_id long, text string, row string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, (tuple(r) for r in queries.QUERIES["op11_anchored_alignment"](spark, str(tmp_path)).collect())))
    want = [(i, *r) for (i, _, _), r in zip(own, plain([t for _, t, _ in own]))]
    assert got == sorted(map(repr, want))
    assert size < 100 or sum(r[1] == 0 for r in want) >= 5


def test_windows_are_remembered_and_bounded(monkeypatch):
    names = [open(queries.tokenizer_file(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligner = token_anchors.Aligner(token_anchors.Side(token_anchors.ByteLevel(names[0])), token_anchors.Side(token_anchors.Pieces(names[1])))
    text = b"the strange house of the strange house"
    first = aligner.align([text])
    assert len(aligner.known) == 4  # the, strange, house, of
    monkeypatch.setattr(aligner, "windows", None)  # not needed again
    assert aligner.align([text, text]) == first * 2
    monkeypatch.undo()
    aligner.align([b"y" * 4_000])
    assert len(aligner.known) == 4
    aligner.numbers = np.roll(aligner.numbers, 1)  # windows that are found by the code of others are told apart by their ids
    assert aligner.align([text]) == first and len(aligner.known) == 4
    monkeypatch.setattr(token_anchors, "MEMO_BYTES", 0)
    assert aligner.align([text]) == first and len(aligner.known) == 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    aligned = token_anchors.settle(token_anchors.alignments(empty, queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")))
    assert aligned.collect() == [] and token_anchors.link_sums(aligned, 32_000).collect() == []


def test_packing():
    import numpy as np
    import pyarrow as pa

    rows = [np.array(sorted({3, 9, 2**40}), np.int64), np.zeros(0, np.int64), np.array([7], np.int64)]
    pairs, row = token_anchors._pairs(pa.array([token_anchors._packed(np.diff(r, prepend=0)) for r in rows], pa.binary()))
    assert pairs.tolist() == [3, 9, 2**40, 7] and row.tolist() == [0, 0, 0, 2]
