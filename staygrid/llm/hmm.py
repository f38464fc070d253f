"""A hidden Markov language model: Baum-Welch on counts summed over partitions, exact likelihoods by the scaled forward recursion.

States emit word classes. Each of the ``OWN`` most frequent words and the end of a text is a class of its own; any other word's
class is a hash of its last three bytes, and within a class a word has add-one probability from its count. All counts come from all
training documents: word counts, class counts, and in each Baum-Welch step the expected counts of every training token.

Training reads a document as sequences of at most ``SEGMENT`` tokens; scoring runs the recursion over the whole text. Words are
looked up in two ways: the ``FREQUENT`` most frequent counts travel to all tasks (a fixed size), the rest are joined.
The model that reaches the driver has ``STATES`` x classes numbers, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from staygrid.llm.shared import highest, pieces, record_batch, remainder, settle, text_bytes
from staygrid.llm.words import Words, mix, words_of

STATES = 6
ROUNDS = 5
OWN = 8192
SUFFIXES = 1024
FREQUENT = 1 << 18
SEGMENT = 512
SHARE = 4_000_000  # tokens counted together
BATCH = 2_000_000  # tokens in one E-step batch
END = -1  # the end's hash
PSEUDO = 0.05
CODED = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("classes", pa.binary()), ("common_known", pa.int64()),
    ("common_base", pa.float64()), ("in_class", pa.float64()), ("rare", pa.list_(pa.int64())),
])
CODED_SQL = "uid long, doc_id long, held_out boolean, n_tokens long, classes binary, common_known long, common_base double, in_class double, rare array<long>"


def suffix_classes(found: Words) -> np.ndarray:
    """A class for each word from its last three bytes."""
    size = found.ends - found.starts
    code = np.zeros(len(size), np.uint64)
    for k in (1, 2, 3):
        at = np.where(size >= k, found.ends - k, found.ends - 1)
        code = code * np.uint64(257) + np.where(size >= k, found.data[at].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(code) % np.uint64(SUFFIXES)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total, docs = [], 0, 0

    def flush():
        words, counts, suffix = (np.concatenate(x) for x in zip(*held))
        words, first, at = np.unique(words, return_index=True, return_inverse=True)
        counts = np.bincount(at, weights=counts).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(suffix[first]), pa.array(counts)], ["word", "suffix", "n"])

    for batch in pieces(batches):
        docs += len(batch)
        found = words_of(batch.column(0))
        words, first, counts = np.unique(found.hashes(), return_index=True, return_counts=True)
        held.append((words, counts, suffix_classes(found)[first]))
        total += len(words)
        if total > SHARE:
            yield from flush()
            held, total = [], 0
    if held:
        yield from flush()
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([SUFFIXES]), pa.array([docs])], ["word", "suffix", "n"])


@dataclass
class Lexicon:
    """The frequent words (sorted hashes) with their counts and classes, and the classes' add-one denominators."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    room: np.ndarray  # count + distinct + 1 of each suffix class; 1 for words of their own class
    end_count: int
    total: int
    distinct: int

    @property
    def n_classes(self) -> int:
        return OWN + SUFFIXES + 1


def lexicon(counts: DataFrame) -> Lexicon:
    """From the settled counts (word, suffix, c): the frequent words and the sums of all."""
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = counts.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    sums = counts.where(F.col("word") != END).groupBy("suffix").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()  # SUFFIXES rows
    top = highest(counts.where(F.col("word") != END), F.floor(F.log2("c") * 16), FREQUENT).toPandas()  # at most FREQUENT rows
    top = top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    room = np.ones(OWN + SUFFIXES + 1)
    room[OWN + sums["suffix"].to_numpy(np.int64)] += (sums["c"] + sums["v"]).to_numpy(np.float64)
    own = top.iloc[:OWN]
    np.subtract.at(room, OWN + own["suffix"].to_numpy(np.int64), own["c"].to_numpy(np.float64) + 1)
    classes = OWN + top["suffix"].to_numpy(np.int64)
    classes[:OWN] = np.arange(len(own))
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return Lexicon(words[order], top["c"].to_numpy(np.int64)[order], classes[order], room, int(ends), int(totals[0] or 0), int(totals[1]))


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, uid = shared.value, TaskContext.get().partitionId() << 36
        log_counts, log_room = np.log10(lex.counts + 1.0), np.log10(lex.room)
        for batch in pieces(batches):
            found = words_of(batch.column(2))
            h, first = found.hashes(), found.first
            at = np.minimum(np.searchsorted(lex.words, h), max(0, len(lex.words) - 1))
            common = lex.words[at] == h if len(lex.words) else np.zeros(len(h), bool)
            classes = OWN + suffix_classes(found)
            classes[common] = lex.classes[at[common]]
            own = np.where(common, log_counts[at], 0.0) if len(lex.words) else np.zeros(len(h))
            # each text's sums, with its end
            sums = lambda x: np.concatenate([[0], np.cumsum(x)])[first]
            base = np.diff(sums(own)) + np.log10(lex.end_count + 1.0)
            inner = np.where(classes >= OWN, own - log_room[classes], 0.0)
            known = np.diff(sums(common.astype(np.int64))) + (lex.end_count > 0)
            rows = len(batch)
            end = OWN + SUFFIXES
            coded = [np.append(classes[a:b], end).astype("<u2").tobytes() for a, b in zip(first[:-1], first[1:])]
            rare_first = np.concatenate([[0], np.cumsum(~common)])[first]
            rare = pa.ListArray.from_arrays(pa.array(rare_first.astype(np.int32)), pa.array(h[~common].astype(np.int64)))
            yield record_batch(CODED, np.arange(uid, uid + rows), batch.column(0), batch.column(1), np.diff(first) + 1, coded, known, base, np.diff(sums(inner)), rare)
            uid += rows

    return run


@dataclass
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # classes x STATES


def first_model(class_counts: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
    """Class frequencies, bent at random for each state, and states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = (class_counts[:, None] + PSEUDO) * np.exp(rng.normal(0, 0.5, (len(class_counts), states)))
    move = np.full((states, states), 0.02 / max(1, states - 1))
    np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _ranked(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Order by falling length; the observations of each time step; how many sequences reach each step."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([sequences[k] for k in order]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes[order])])[:-1]
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
    return order, [flat[begin[:n] + t] for t, n in enumerate(active)], active


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence (none empty), by the scaled forward recursion over all of them at once."""
    order, steps, _ = _ranked(sequences)
    out = np.zeros(len(sequences))
    a = model.start * model.emit[steps[0]]
    for t, seen in enumerate(steps):
        if t:
            a = (a[: len(seen)] @ model.move) * model.emit[seen]
        scale = a.sum(axis=1)
        a /= scale[:, None]
        out[: len(seen)] += np.log10(scale)
    back = np.empty(len(out))
    back[order] = out
    return back


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of the sequences: starts, moves, emissions (classes x states), and their log10 likelihood."""
    _, steps, active = _ranked(sequences)
    emit, move, start = (x.astype(np.float32) for x in (model.emit, model.move, model.start))
    alphas, scales, likelihood = [], [], 0.0
    a = start * emit[steps[0]]
    for t, seen in enumerate(steps):
        if t:
            a = (a[: len(seen)] @ move) * emit[seen]
        scale = a.sum(axis=1)
        a = a / scale[:, None]
        likelihood += float(np.log10(scale.astype(np.float64)).sum())
        alphas.append(a)
        scales.append(scale)
    moves = np.zeros_like(model.move)
    b = np.ones_like(alphas[-1])
    for t in range(len(steps) - 1, 0, -1):
        ahead = emit[steps[t]] * b / scales[t][:, None]
        n = len(steps[t])
        moves += alphas[t - 1][:n].T @ ahead
        alphas[t] *= b
        b = np.ones_like(alphas[t - 1])
        b[:n] = ahead @ move.T
    alphas[0] *= b
    seen, weight = np.concatenate(steps), np.concatenate(alphas)
    emissions = np.stack([np.bincount(seen, weights=weight[:, k], minlength=len(emit)) for k in range(emit.shape[1])], axis=1)
    return alphas[0].sum(axis=0, dtype=np.float64), moves * model.move, emissions, likelihood


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


def _expect(shared):
    """Rows (row, k0, k1, ...): emissions by class, then moves by state, then starts, then the likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, tokens, sums = shared.value, [], 0, None

        def add():
            nonlocal sums
            starts, moves, emissions, likelihood = expected(model, held)
            rows = np.vstack([emissions, moves, starts, np.eye(1, len(starts)) * likelihood])
            sums = rows if sums is None else sums + rows

        for batch in batches:
            for text in _sequences(batch.column(0)):
                held += [text[s : s + SEGMENT] for s in range(0, len(text), SEGMENT)]
                tokens += len(text)
                if tokens > BATCH:
                    add()
                    held, tokens = [], 0
        if held:
            add()
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), *[pa.array(np.ascontiguousarray(c)) for c in sums.T]], ["row", *[f"k{k}" for k in range(sums.shape[1])]])

    return run


def trained(coded: DataFrame, model: Model, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch rounds over all rows of ``coded`` (``classes``), and the log10 likelihood before each."""
    states, history = len(model.start), []
    names = [f"k{k}" for k in range(states)]
    schema = ", ".join(["row long", *[f"{n} double" for n in names]])
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model)
        sums = coded.select("classes").mapInArrow(_expect(shared), schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("row")
        if not len(sums):
            break
        table = sums[names].to_numpy()
        emissions, moves, starts = table[: -states - 2] + PSEUDO, table[-states - 2 : -2] + 1.0, table[-2] + 1.0
        history.append(float(table[-1, 0]))
        model = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))
    return model, history


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            found = forward(shared.value, _sequences(table.column("classes").combine_chunks()))
            yield from table.drop_columns(["classes"]).append_column("hidden", pa.array(found)).to_batches()

        tokens = 0
        for batch in batches:
            held.append(batch)
            tokens += sum(batch.column(batch.schema.get_field_index("n_tokens")).to_pylist())
            if tokens > 2 * BATCH:
                yield from flush()
                held, tokens = [], 0
        if held:
            yield from flush()

    return run


def hmm_scores(docs: DataFrame, modulus: int = 7, kept_back: int = 2, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Score every text by a model of those whose id's crc32 modulo ``modulus`` is not ``kept_back``.

    Returns one row per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one
    unigrams) and ``score``, both log10 probabilities. A null text is empty: one token, its end. Without training rows every word
    is unknown. Repeated rows count and are scored each; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(modulus) == kept_back).alias("held_out"), text_bytes().alias("text"))
    counts = source.where("NOT held_out").select("text").mapInArrow(_count, "word long, suffix long, n long")
    counts = settle(counts.groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("c")))
    lex = lexicon(counts)
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    coded = settle(source.mapInArrow(_code(shared), CODED_SQL))
    own = np.zeros(lex.n_classes)
    own[OWN : OWN + SUFFIXES] = lex.room[OWN : OWN + SUFFIXES]
    frequent = lex.classes < OWN
    own[lex.classes[frequent]] = lex.counts[frequent]
    own[-1] = lex.end_count
    model, _ = trained(coded.where("NOT held_out"), first_model(own, states), rounds)

    words = coded.select("uid", F.explode("rare").alias("word")).groupBy("uid", "word").agg(F.count(F.lit(1)).alias("n"))
    known = words.join(counts.select("word", "c"), "word", "left").where("c IS NOT NULL")
    known = known.groupBy("uid").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_sum"))
    fields = ["uid", "doc_id", "held_out", "n_tokens", "common_known", "common_base", "in_class"]
    scored = coded.select(*fields, "classes").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "uid long, doc_id long, held_out boolean, n_tokens long, common_known long, common_base double, in_class double, hidden double")
    joined = scored.join(known, "uid", "left")
    rare = F.coalesce("rare_sum", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("common_base") + rare - F.col("n_tokens") * float(np.log10(lex.total + lex.distinct + 1))).alias("base_score"),
        (F.col("hidden") + F.col("in_class") + rare).alias("score"),
    )
