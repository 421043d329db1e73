"""Language-model scores by a hidden Markov model over words.

Tokens are a text's words (white space between, A-Z in lower case) and one end. The SYMBOLS most frequent words are
symbols of their own, the end is one, and all other words share one symbol for each length in bytes up to LENGTHS. Each
of STATES latent states emits a symbol and passes to the next state; the start and passing probabilities and the
emissions are trained by ROUNDS of Baum-Welch from a fixed start: every partition of the training texts sums its
expected counts, which are then added across partitions. A word of a shared symbol has the further probability
(c + 0.1) / (C + 0.1 * (V + 1)) within it (c: the word's training count, C and V: the symbol's tokens and distinct words).
The scaled forward recursion gives the exact log likelihood of a text, all its tokens included.

A text is cut into words once for training and scores, and a text of more than CELLS tokens is trained on piece by piece.
Counts of words are corpus-wide tables; only the KNOWN most frequent words and sums by symbol are broadcast, both of
bounded size. The words of a text that are not among them meet their counts in a join, summed for each text before.

Training texts are those whose crc32 of the id's decimal digits is not divisible by FOLDS.

Defined results: a null or empty text is the end alone; a null id counts as the empty string in the fold; without
training texts all counts are 0; repeated rows each give a row (and each count in training); an empty table gives none;
other columns of any name are not looked at; a very long text is scored whole.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim, written
from .words import partial_counts, top, words_of

STATES, SYMBOLS, LENGTHS, ROUNDS, KNOWN, FOLDS = 8, 8192, 24, 3, 131_072, 10
SMOOTH = 0.1
#: Cells (texts times steps) of one array of the recursions.
CELLS = 1 << 20
#: Symbols of the texts that are recursed on together: a step costs much the same for one text as for hundreds, and the few
#: longest texts of some rows take as many steps as those of many rows. They are int16, so a few megabytes.
TOGETHER = 1 << 21
END = 0


def held_out(row_id: str):
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Symbols:
    """Numbers of words: 0 is the end, then the shared symbols by length, then the most frequent words; known words have
    the logarithm of their smoothed count as well."""

    def __init__(self, top: dict[str, int], own: int = SYMBOLS):
        self.size = 1 + LENGTHS + min(own, len(top))
        self.own = list(top)[:own]
        self.index = {w.encode(): k for k, w in enumerate(top)}
        lengths = [min(len(w), LENGTHS) for w in self.index]
        self.symbol = np.array([1 + LENGTHS + k if k < own else n for k, n in enumerate(lengths)], dtype=np.int32)
        self.log = np.array([math.log10(c + SMOOTH) for c in top.values()])
        self.inner = np.where(np.arange(len(top)) < own, 0.0, self.log)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the known ones, or -1."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int32, count=len(words))

    def __call__(self, words: list[bytes], at: np.ndarray | None = None) -> np.ndarray:
        at = self.places(words) if at is None else at
        out = np.empty(len(words) + 1, dtype=np.int16)
        out[:-1] = self.symbol[at] if len(self.symbol) else 0
        for k in np.flatnonzero(at < 0):
            out[k] = min(len(words[k]), LENGTHS)
        out[-1] = END
        return out


class Model:
    """start (K), moves (K, K), emissions (K, symbols)."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emissions: np.ndarray):
        self.start, self.moves, self.emissions = start, moves, emissions

    @classmethod
    def fresh(cls, totals: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """The unigram distribution of the symbols' training counts times noise that tells states apart; states that stay long,
        so that the first rounds find what whole texts have in common."""
        rng = np.random.default_rng(seed)
        base = (totals + SMOOTH) / (totals + SMOOTH).sum()
        emissions = base * rng.lognormal(0.0, 1.0, (states, len(totals)))
        moves = np.full((states, states), 0.02 / states) + np.eye(states) * 0.98
        return cls(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emissions / emissions.sum(1, keepdims=True))

    @classmethod
    def counted(cls, start: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> Model:
        norm = lambda x: (x + SMOOTH) / (x + SMOOTH).sum(-1, keepdims=True)
        return cls(norm(start), norm(moves), norm(emissions))

    def _groups(self, texts: list[np.ndarray]) -> Iterator[list[int]]:
        """Texts of like length, longest first, so that at every step the running ones stand first."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        at = 0
        while at < len(order):
            n = max(1, CELLS // len(texts[order[at]]))
            yield order[at : at + n]
            at += n

    def _forward(self, texts: list[np.ndarray], keep: bool):
        """Scaled forward recursion over texts that are sorted by falling length."""
        lengths = np.array([len(x) for x in texts])
        steps, running = lengths[0], np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        padded = np.zeros((steps, len(texts)), dtype=np.int32)
        for k, x in enumerate(texts):
            padded[: len(x), k] = x
        emitted = np.ascontiguousarray(self.emissions.T)
        log = np.zeros(len(texts))
        alphas = np.zeros((steps, len(texts), len(self.start))) if keep else None
        scales = np.ones((steps, len(texts))) if keep else None
        alpha = None
        for t in range(steps):
            n = running[t]
            alpha = (np.broadcast_to(self.start, (n, len(self.start))) if t == 0 else alpha[:n] @ self.moves) * emitted[padded[t, :n]]
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            log[:n] += np.log10(scale)
            if keep:
                alphas[t, :n], scales[t, :n] = alpha, scale
        return log, padded, running, alphas, scales, emitted

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence of symbols."""
        out = np.zeros(len(texts))
        for group in self._groups(texts):
            out[group] = self._forward([texts[k] for k in group], False)[0]
        return out

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions: one step of Baum-Welch over these texts."""
        states, size = self.emissions.shape
        start, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((states, size))
        for group in self._groups(texts):
            if len(texts[group[0]]) > CELLS:
                for total, part in zip((start, moves, emissions), self._long(texts[group[0]]), strict=True):
                    total += part
                continue
            _, padded, running, alphas, scales, emitted = self._forward([texts[k] for k in group], True)
            steps, width = padded.shape
            beta = np.ones((width, states))
            for t in range(steps - 1, -1, -1):
                n = running[t]
                if t < steps - 1:
                    m = running[t + 1]
                    ahead = emitted[padded[t + 1, :m]] * beta[:m] / scales[t + 1, :m, None]
                    moves += self.moves * (alphas[t, :m].T @ ahead)
                    beta[:m] = ahead @ self.moves.T
                    alphas[t + 1, :m] = after[:m]
                after = alphas[t, :n] * beta[:n]
            start += after.sum(0)
            alphas[0] = after
            on = np.arange(width)[None, :] < running[:, None]
            seen, flat = padded[on], np.ascontiguousarray(alphas[on].T)
            for k in range(states):
                emissions[k] += np.bincount(seen, weights=flat[k], minlength=size)
        return start, moves, emissions

    def _long(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """expected() of one long text, a piece of CELLS steps at a time: the first pass keeps the state before each piece, the
        second goes back piece by piece and makes the states inside anew."""
        states, size = self.emissions.shape
        emitted = np.ascontiguousarray(self.emissions.T)
        moves, emissions = np.zeros((states, states)), np.zeros((states, size))
        cuts = range(0, len(text), CELLS)

        def forward(a: int, before: np.ndarray | None):
            piece = text[a : a + CELLS]
            alphas, scales = np.empty((len(piece), states)), np.empty(len(piece))
            for t, x in enumerate(piece):
                before = (self.start if before is None else before @ self.moves) * emitted[x]
                scales[t] = before.sum()
                before = alphas[t] = before / scales[t]
            return alphas, scales

        held: list[np.ndarray | None] = [None]
        for a in cuts[:-1]:
            held.append(forward(a, held[-1])[0][-1].copy())
        beta, first = np.ones(states), np.zeros(states)
        for a, before in zip(reversed(cuts), reversed(held), strict=True):
            piece = text[a : a + CELLS]
            alphas, scales = forward(a, before)
            after = np.empty_like(alphas)
            for t in range(len(piece) - 1, -1, -1):
                after[t] = alphas[t] * beta
                ahead = emitted[piece[t]] * beta / scales[t]
                earlier = alphas[t - 1] if t else before
                if earlier is not None:
                    moves += self.moves * np.outer(earlier, ahead)
                beta = self.moves @ ahead
            for k in range(states):
                emissions[k] += np.bincount(piece, weights=after[:, k], minlength=size)
            first = after[0]
        return first, moves, emissions


def _batches(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[tuple[int, list[list[bytes]]]]:
    """A batch's words, a few megabytes of text at a time; with the first row's number."""
    column, at, out, size = batch.column(batch.schema.get_field_index("text")), 0, [], 0
    for k, value in enumerate(column):
        text = value.as_py()
        out.append(words_of(text))
        size += len(text or "")
        if size > most:
            yield at, out
            at, out, size = k + 1, [], 0
    if out:
        yield at, out


def encoded(docs: DataFrame, symbols, shared: np.ndarray, end_log: float) -> DataFrame:
    """docs (id, held_out, text) without the texts, but with the symbols of each, its tokens, and those parts of its scores
    that its known words and shared symbols make; and its words beyond the broadcast ones. Training and scores both read
    this, so a text is cut into words once."""
    kinds = {"n_tokens": pa.int64(), "seen": pa.int64(), "base": pa.float64(), "inner": pa.float64(), "rare": pa.list_(pa.string()), "times": pa.list_(pa.int64()), "symbols": pa.list_(pa.int16())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = symbols.value
        for batch in batches:
            for at, lists in _batches(batch):
                made: dict[str, list] = {c: [] for c in kinds}
                for words in lists:
                    places = held.places(words)
                    found = places[places >= 0]
                    sequence = held(words, places)
                    rest = Counter(words[k] for k in np.flatnonzero(places < 0))
                    inner = float(held.inner[found].sum()) - float(shared[sequence[:-1][sequence[:-1] <= LENGTHS]].sum())
                    row = (len(sequence), len(found), float(held.log[found].sum()) + end_log, inner, [w.decode("utf-8", "replace") for w in rest], list(rest.values()), sequence)
                    for values, value in zip(made.values(), row, strict=True):
                        values.append(value)
                part = batch.slice(at, len(lists))
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), *(pa.array(made[c], kind) for c, kind in kinds.items())], names=[*rest, *kinds])
        trim()

    schema = f"id {docs.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, seen long, base double, inner double, rare array<string>, times array<long>, symbols array<smallint>"
    return docs.select("id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches of so many symbols (last column), and their sequences."""
    held: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        held.append(batch)
        texts += [flat[x:y] for x, y in itertools.pairwise(ends)]
        size += int(ends[-1] - ends[0]) if len(ends) else 0
        if size > TOGETHER:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def train(sequences: DataFrame, totals: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all sequences (column symbols). totals: training counts by symbol."""
    model = Model.fresh(totals)
    spark = sequences.sparkSession
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            start, moves, emissions = (np.zeros(x.shape) for x in (now.value.start, now.value.moves, now.value.emissions))
            for _, texts in _together(batches):
                a, b, c = now.value.expected(texts)
                start, moves, emissions = start + a, moves + b, emissions + c
            states = len(start)
            rows = np.concatenate([start[:, None], moves, emissions], axis=1)  # a column for each parameter
            used = np.flatnonzero(rows.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(rows[k, used]) for k in range(states))], names=["p", *(f"c{k}" for k in range(states))])
            trim()

        states = len(model.start)
        counts = sequences.mapInArrow(run, "p int, " + ", ".join(f"c{k} double" for k in range(states)))
        rows = np.zeros((states, 1 + states + len(totals)))
        for r in counts.groupBy("p").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(states))).collect():
            rows[:, r["p"]] = r[1:]
        model = Model.counted(rows[:, 0], rows[:, 1 : 1 + states], rows[:, 1 + states :])
    return model


def scores(df: DataFrame, text: str = "text", row_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row a document: its id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    docs = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), held_out(row_id).alias("held_out"))
    training = docs.where("NOT held_out").select("text")
    counts = written(partial_counts(training).groupBy("word").agg(F.sum("n").alias("c")), "counts")
    ends = training.count()
    known = top(counts, KNOWN, "c")
    symbols = Symbols(known, SYMBOLS)

    # training tokens, and tokens and distinct words by symbol
    length = F.least(F.octet_length("word"), F.lit(LENGTHS))
    sums = {r["l"]: (r["c"], r["v"]) for r in counts.groupBy(length.alias("l")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    tokens, distinct = sum(c for c, _ in sums.values()) + ends, sum(v for _, v in sums.values()) + bool(ends)
    totals = np.zeros(symbols.size)
    shared = np.zeros(LENGTHS + 1)
    totals[END] = ends
    for k, word in enumerate(symbols.own):
        totals[1 + LENGTHS + k] = known[word]
    for k in range(1, LENGTHS + 1):
        own = [w for w in symbols.own if min(len(w.encode()), LENGTHS) == k]
        c, v = sums.get(k, (0, 0))
        totals[k] = c - sum(known[w] for w in own)
        shared[k] = math.log10(totals[k] + SMOOTH * (v - len(own) + 1))

    send = spark.sparkContext.broadcast
    unit, end_log = math.log10(tokens + SMOOTH * (distinct + 1)), math.log10(ends + SMOOTH)
    parts = written(encoded(docs, send(symbols), shared, end_log), "parts")
    model = send(train(parts.where("NOT held_out").select("symbols"), totals, rounds))

    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _together(batches):
            found, at = model.value.score(texts), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found[at : at + batch.num_rows])], names=[*batch.schema.names[:-1], "latent"])
                at += batch.num_rows
        trim()

    narrow = parts.select("row", "id", "held_out", "n_tokens", "seen", "base", "inner", "symbols")
    scored = narrow.mapInArrow(latent, T.StructType([*narrow.schema.fields[:-1], T.StructField("latent", T.DoubleType())]))
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    met = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"))
    both = scored.join(met, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return both.select(
        F.col("id").alias(row_id),
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("k", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("latent") + F.col("inner") + log).alias("score"),
    )
