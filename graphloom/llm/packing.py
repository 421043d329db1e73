"""Best-fit packing of documents into sequences of tokens by linear grouping.

Only counts of lengths decide how sequences are composed. Lengths above a threshold are sorted and cut into groups of equal
cardinality, each rounded up to its largest length; a linear program over these few sizes chooses configurations (which
sizes share a sequence), its columns generated by a knapsack over the dual prices. Whole numbers of configurations are then
filled with the actual lengths of each group, longest first. What rounding of the program leaves over, and all small
lengths, go to the sequence with the least room that holds them, longest first, and to new ones where none does. All of
this is arithmetic on at most capacity counts, whatever the number of documents.

Documents meet their places by rank: the nth piece of its length in a task, after those of earlier tasks. Places are runs of
ranks, few for each length, and are looked up by bisection; no piece is gathered or sorted.

Defined results: a null or empty text has the end token alone; a longer document than the capacity is cut into pieces of
the capacity, the last of what is left; repeated rows and null ids are pieces of their own; an empty table gives no rows;
columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _PLAIN as NOT_PLAIN
from .bpe import _WORD_END as PRE_TOKENS
from .common import maybe_broadcast, trim, written

CAPACITY, END = 4096, 1
#: Lengths above such a part of the capacity are large, and make so many groups; the fewest sequences win.
TRIED = ((2, 8), (2, 16), (4, 16), (4, 64), (8, 8), (8, 16), (8, 32), (8, 64))
#: Words whose ids a worker remembers, and bytes of one of them; others are encoded each time.
REMEMBERED, LONGEST = 800_000, 64
#: Documents that a worker encodes together.
ROWS = 500


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers. The vocabulary drops white space, and no token reaches over it,
    so texts are made of the ids of their words between ASCII white space, which are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values()), dtype=bool)  # ids that end a pre-token
        self.last[[k for t, k in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of common characters are encoded as one text, and cut after as many pre-tokens as each has; in others a special
        token may stand, or a character whose class the library alone knows."""
        texts = [w.decode("utf-8") for w in words]
        plain = [k for k, t in enumerate(texts) if "<" not in t and not NOT_PLAIN.search(t)]
        out: dict[bytes, bytes] = {}
        if plain:
            ids = np.array(self.library.encode_batch_fast([" ".join([texts[k] for k in plain])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            cuts = np.cumsum([len(PRE_TOKENS.findall(texts[k].lower())) for k in plain])
            if len(ends) == cuts[-1]:
                to, raw = (4 * ends[cuts - 1]).tolist(), ids.tobytes()
                out = {words[k]: raw[a:b] for k, a, b in zip(plain, [0, *to], to)}  # noqa: B905
        rest = [k for k, w in enumerate(words) if w not in out]
        for k, e in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[words[k]] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode("utf-8").split() for t in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [w for w in words if w not in known]
        known.update(self.encode_words(new))
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
    return Encoder(path)


def pieces(df: DataFrame, path: str, text: str = "text", row_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc, task, nth): the pieces of every document, nth of its length in its task. ids: their
    tokens too, as little-endian unsigned 32-bit integers."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[row_id].dataType
    kinds = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("crc", T.LongType()), ("task", T.IntegerType()), ("nth", T.LongType())] + ([("ids", T.BinaryType())] if ids else [])
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(n, t) for n, t in kinds)])
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, library = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64).tolist(), encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, rows = [], []
                for k, raw in enumerate(library.encode(part.column(1).to_pylist())):
                    raw += last
                    for n, start in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[start : start + 4 * capacity]
                        length = len(piece) // 4
                        owner.append(k)
                        rows.append((n, start // 4, length, zlib.crc32(piece), task, seen[length], *([piece] if ids else [])))
                        seen[length] += 1
                columns = [pa.array(c, type=to_arrow_type(t)) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.nulls(0, to_arrow_type(t)) for _, t in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, type=pa.int64())), *columns], names=schema.names)
        trim()

    return df.select(row_id, text).mapInArrow(run, schema)


# composition of sequences out of counts of lengths


def grouped(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) pairs, longest first, cut into groups of equal cardinality; a length that fills a group by itself is one
    by itself, with all its count, and needs no rounding."""
    each = -(-sum(n for _, n in counts) // groups)
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in counts:
        if n >= each:
            out.append([(length, n)])
            n = room = 0
        while n:
            if not room:
                out.append([])
                room = each
            taken = min(n, room)
            out[-1].append((length, taken))
            n, room = n - taken, room - taken
    return out


def best_column(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most value: the best value for each room and number of items, one more item at a time."""
    value, back = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, pick = value.copy(), np.full(capacity + 1, -1)
        for g, (s, p) in enumerate(zip(sizes.tolist(), prices.tolist(), strict=True)):
            if p > 0:
                with_g = value[: capacity + 1 - s] + p
                better = with_g > new[s:] + 1e-12
                new[s:][better], pick[s:][better] = with_g[better], g
        back.append(pick)
        value = new
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(back):
        g = pick[room]
        if g >= 0:
            column[g] += 1
            room -= int(sizes[g])
    return float(value[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how many such sequences): the linear program's solution, rounded down."""
    basis = np.diag(np.floor(capacity / sizes))
    for _ in range(rounds):
        amounts, prices = np.linalg.solve(basis, demand), np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_column(sizes, prices, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(amounts, 0.0) / np.where(step > 1e-9, step, 1.0), np.inf)
        basis[:, int(ratio.argmin())] = column
    amounts = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), int(np.floor(amounts[j] + 1e-6))) for j in np.argsort(-basis.sum(axis=0), kind="stable") if amounts[j] >= 1 - 1e-6]


class Places:
    """Runs of places. A run (length, rank, sequence, each, offset) puts the i-th piece of a length after that rank into
    sequence + i // each, at offset + i % each * length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, part: int = 8, groups: int = 64):
        self.capacity, self.left, self.used = capacity, dict(counts), dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)
        self.rooms = 0  # bit r: there is a sequence with room r
        self._configure(part, groups)
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)

    def _put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.used[length], sequence, each, offset))
        self.used[length] += n
        self.left[length] -= n

    def _opened(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.open.setdefault(room, []).append((first, n))
            self.rooms |= 1 << room

    def _configure(self, part: int, groups: int) -> None:
        large = [(s, n) for s, n in sorted(self.left.items(), reverse=True) if s > self.capacity // part and n]
        if not large:
            return
        lots = grouped(large, groups)
        sizes = np.array([g[0][0] for g in lots])
        demand = np.array([sum(n for _, n in g) for g in lots], dtype=np.float64)
        queues = [list(reversed(g)) for g in lots]
        for column, m in configurations(sizes, demand, self.capacity):
            slots = [g for g, a in enumerate(column.tolist()) for _ in range(a)]
            m = min([m, *(sum(n for _, n in queues[g]) // a for g, a in enumerate(column.tolist()) if a)])
            # each slot takes the next m of its group, longest first; lengths change at few places
            taken = [self._take(queues[g], m) for g in slots]
            cuts = sorted({0, m, *(at for slot in taken for at, _ in slot)})
            at_slot = [dict(slot) for slot in taken]
            now = [0] * len(slots)
            for lo, hi in pairwise(cuts):
                now = [at_slot[k].get(lo, now[k]) for k in range(len(slots))]
                offset = 0
                for length in now:
                    self._put(length, hi - lo, self.sequences + lo, 1, offset)
                    offset += length
                self._opened(self.capacity - offset, self.sequences + lo, hi - lo)
            self.sequences += m

    @staticmethod
    def _take(queue: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
        """(place, length) wherever the length changes among the next m of a group."""
        out, at = [], 0
        while at < m:
            length, n = queue.pop()
            k = min(n, m - at)
            out.append((at, length))
            at += k
            if n > k:
                queue.append((length, n - k))
        return out

    def _best_fit(self, length: int) -> None:
        """All that is left of a length, into the sequences with the least room for it."""
        while self.left[length]:
            n, fitting = self.left[length], self.rooms >> length
            if not fitting:
                each = self.capacity // length
                m = n // each
                for count, k in ((m, each), (1, n - m * each)):
                    if count and k:
                        self._put(length, count * k, self.sequences, k, 0)
                        self._opened(self.capacity - k * length, self.sequences, count)
                        self.sequences += count
                continue
            room = length + (fitting & -fitting).bit_length() - 1
            first, have = self.open[room].pop()
            each = room // length
            m, k = (min(have, n // each), each) if n >= each else (1, n)
            if have > m:
                self.open[room].append((first + m, have - m))
            if not self.open[room]:
                self.rooms &= ~(1 << room)
            self._put(length, m * k, first, k, self.capacity - room)
            self._opened(room - k * length, first, m)


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> Places:
    return min((Places(counts, capacity, *tried) for tried in TRIED), key=lambda p: p.sequences)


def pack(df: DataFrame, path: str, text: str = "text", row_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """(id, piece, start, length, crc, ids, sequence_id, offset): every document's pieces and their places. ids: whether the tokens
    are kept (little-endian unsigned 32-bit integers)."""
    made = written(pieces(df, path, text, row_id, capacity, end, ids), "pieces")
    counts = written(made.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = np.array(sorted(planned(totals, capacity).runs), dtype=np.int64).reshape(-1, 5)
    # a window holds at most one row a task
    order = Window.partitionBy("length").orderBy("task")
    before = counts.select("task", "length", (F.sum("n").over(order) - F.col("n")).alias("before"))
    ranked = made.join(maybe_broadcast(written(before, "before"), 32), ["task", "length"])
    table = df.sparkSession.sparkContext.broadcast(runs)
    kept = ["id", "piece", "start", "length", "crc", *(["ids"] if ids else [])]
    schema = T.StructType([*(made.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        first = np.searchsorted(known[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = np.zeros(len(length), dtype=np.int64)
            for s in np.unique(length):
                mine = length == s
                run[mine] = first[s] + np.searchsorted(known[first[s] : first[s + 1], 1], rank[mine], side="right") - 1
            i, each = rank - known[run, 1], known[run, 3]
            places = [pa.array(known[run, 2] + i // each), pa.array(known[run, 4] + i % each * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *places], names=schema.names)
        trim()

    return ranked.select(*kept, (F.col("nth") + F.col("before")).alias("rank")).mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids, starts): the tokens of each sequence, at most the capacity, and where its pieces start.
    packed: as of pack() with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    sums = packed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return sums.select("sequence_id", F.size("p").alias("n_pieces"), joined.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))


def report(df: DataFrame, path: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row a piece: its document, place in it, digest, and place in a sequence."""
    out = pack(df, path, text, row_id, ids=False)
    return out.select(F.col("id").alias(row_id), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
