"""Alignment of two tokenizers' tokens by the places where both end.

Both vocabularies cut a text in front of a lone space, so a text is a row of chunks, and a chunk's tokens, groups and links are
made once while a worker remembers it. Chunks that are new to the worker are encoded together: the intersection of the two
sides' arrays of token ends gives the ends of groups, their places in each side's array cut groups and links out, and all of
that is array arithmetic over many chunks at once. A document is the sum of its chunks. A pair of ids is one whole number; a
document's row holds its distinct pairs and how often each is linked.

How many documents hold a pair is counted from these. The pairs in most documents, at most PAIRS of them, are broadcast to the
documents' pairs; rarer ones, if there are more, meet their counts in a shuffle, where no key has more rows than the rarest
broadcast pair has documents.

Defined results: a null or empty text, and one whose tokens on a side do not give back its bytes (it holds U+2581), have no
tokens: zeros and an empty digest; repeated rows and null ids are documents of their own; long texts are one batch, whole; an
empty table gives no rows; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import trim, written

#: Characters of a batch of documents (more for one longer document), and documents.
CHARS, DOCS = 1 << 17, 1000
#: Chunks that a worker remembers, in two halves, the older of which is dropped; and characters of one of them.
REMEMBERED, LONGEST = 400_000, 64
#: Pairs that are broadcast, at some 24 bytes each.
PAIRS = 1 << 20
#: Chunks that are encoded as one text.
TOGETHER = 2000
#: In front of a lone space that something other than white space follows.
CUT = re.compile(r"(?<! ) (?=\S)")


class Sides:
    """Both tokenizers. A chunk is known without its leading space, which both sides' ids include."""

    def __init__(self, left: str, right: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(left)
        self.left.encode_special_tokens = True
        self.left.no_padding()
        self.left.no_truncation()
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        spec = json.load(open(left, encoding="utf-8"))
        entries = {**spec["model"]["vocab"], **{x["content"]: x["id"] for x in spec["added_tokens"]}}
        a = [b""] * (1 + max(entries.values()))
        for token, k in entries.items():
            a[k] = b"".join(back.get(c) or c.encode() for c in token)
        b = [self.right.id_to_piece(k) for k in range(self.right.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if self.right.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(b)]
        self.bytes, self.sizes = (a, b), tuple(np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        # what is said of a token: one inside a side of a group, and a side's last one
        self.said = [b"%d%s" % (k, end) for side, ends in ((a, (b",", b"|")), (b, (b",", b";"))) for end in ends for k in range(len(side))]
        self.pair = np.dtype(np.int32 if len(a) * len(b) < 1 << 31 else np.int64)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    @property
    def base(self) -> int:
        return len(self.bytes[1])

    def look_up(self, chunks: set[str]) -> list[tuple[str, tuple | None]]:
        """Each chunk with what is known of it."""
        if len(self.known) + len(chunks) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        known.update((c, older[c]) for c in chunks if c not in known and c in older)
        new = [c for c in chunks if c not in known]
        self.learn(new)
        out = [(c, known[c]) for c in chunks]
        for c in new:
            if len(c) > LONGEST:
                del known[c]
        return out

    def learn(self, chunks: list[str]) -> None:
        """What is known of a chunk: numbers of tokens of both sides and of groups, what is said of the groups, and the links'
        pairs as bytes; None where a side does not give the chunk back. Chunks that start and end without white space are cut
        from one another by both sides, so that they are encoded as one text; the others are encoded one by one."""
        alone: list[str] = []
        joined = [c for c in chunks if c and not c[0].isspace() and c[-1] != " " or alone.append(c)]
        todo = [*([c] for c in alone), *(joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER))]
        while todo:
            some = todo.pop()
            if not self._learn(some):
                if len(some) == 1:
                    self.known[some[0]] = None
                else:
                    todo += [some[: len(some) // 2], some[len(some) // 2 :]]

    def _learn(self, chunks: list[str]) -> bool:
        text = " ".join(chunks)
        raw = (" " + text).encode("utf-8")
        cuts = np.cumsum([len(c.encode("utf-8")) + 1 for c in chunks])
        ids, ends = [], []
        for side, found in enumerate((self.left.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.right.encode(text))):
            if b"".join(map(self.bytes[side].__getitem__, found)) != raw:
                return False
            ids.append(np.array(found, dtype=np.int64))
            ends.append(np.cumsum(self.sizes[side][ids[side]]))
        common = np.intersect1d(*ends, assume_unique=True)
        stop = np.searchsorted(common, cuts) + 1  # groups up to each chunk's end
        if stop[-1] > len(common) or (common[stop - 1] != cuts).any():
            return False
        # each group's tokens on each side: from, to and how many
        to = [np.searchsorted(e, common) + 1 for e in ends]
        size = [np.diff(t, prepend=0) for t in to]
        start = [t - n for t, n in zip(to, size, strict=True)]
        links = size[0] * size[1]
        upto = np.cumsum(links)
        of = np.repeat(np.arange(len(common)), links)
        place = np.arange(len(of)) - (upto - links)[of]
        i, j = start[0][of] + place // size[1][of], start[1][of] + place % size[1][of]
        pairs = (ids[0][i] * self.base + ids[1][j]).astype(self.pair).tobytes()
        # what is said: a group's left tokens, then its right ones
        order, before = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64), 0
        for side, others in ((0, start[1]), (1, to[0])):
            codes = ids[side] + before
            codes[to[side] - 1] += len(self.bytes[side])
            order[np.arange(len(codes)) + np.repeat(others, size[side])] = codes
            before += 2 * len(self.bytes[side])
        said = list(map(self.said.__getitem__, order.tolist()))
        a, b, g = to[0][stop - 1], to[1][stop - 1], stop
        bounds = ((a + b).tolist(), (upto[stop - 1] * self.pair.itemsize).tolist())
        x = y = 0
        for c, n_a, n_b, n, x_to, y_to in zip(chunks, *(np.diff(v, prepend=0).tolist() for v in (a, b, g)), *bounds, strict=True):
            self.known[c] = (n_a, n_b, n, b"".join(said[x:x_to]), pairs[y:y_to])
            x, y = x_to, y_to
        return True

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        parts = CUT.split(" " + text)
        return [*([parts[0][1:]] if parts[0] else []), *parts[1:]]


@functools.lru_cache(maxsize=2)
def sides(left: str, right: str) -> Sides:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
    return Sides(left, right)


def described(df: DataFrame, left: str, right: str, text: str, row_id: str) -> DataFrame:
    """A row for each document: key, id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs of linked ids, a * base +
    b, with the times that each is linked."""
    from pyspark.sql.pandas.types import to_arrow_type

    pair = T.IntegerType() if sides(left, right).pair == np.int32 else T.LongType()
    names = ("n_a", "n_b", "n_groups")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", df.schema[row_id].dataType), *(T.StructField(c, T.LongType()) for c in (*names, "n_links")), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(pair, False)), T.StructField("times", T.ArrayType(T.IntegerType(), False))])

    def lists(parts: list[np.ndarray], kind: str) -> pa.Array:
        starts = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(parts)), type=to_arrow_type(schema[kind].dataType))

    def made(ids: pa.Array, split: list[list[str]], key: int, both: Sides) -> pa.RecordBatch:
        known = both.look_up(set().union(*split))
        bad = {c for c, f in known if f is None}
        if bad:  # a text with a chunk that a side does not give back has none
            split = [[] if bad.intersection(parts) else parts for parts in split]
        found = [f for _, f in known if f is not None]
        index = {c: k for k, c in enumerate(c for c, f in known if f is not None)}
        starts = np.cumsum([0, *map(len, split)])
        numbers = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=starts[-1])
        sums = [np.diff(np.concatenate([[0], np.cumsum(np.array([f[k] for f in found], dtype=np.int64)[numbers])])[starts]) for k in range(3)]
        said, pairs, numbers = [f[3] for f in found], [f[4] for f in found], numbers.tolist()
        digests, links, distinct, times = [], [], [], []
        for at, to in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            mine = numbers[at:to]
            digests.append(hashlib.sha256(b"".join([said[k] for k in mine])[:-1]).hexdigest() if mine else "")
            linked = np.frombuffer(b"".join([pairs[k] for k in mine]), dtype=both.pair)
            values, counts = np.unique(linked, return_counts=True)
            links.append(len(linked))
            distinct.append(values)
            times.append(counts.astype(np.int32))
        arrays = [pa.array(np.arange(key, key + len(split))), ids, *map(pa.array, sums), pa.array(links, pa.int64()), pa.array(digests, pa.string()), lists(distinct, "pairs"), lists(times, "times")]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, key = sides(left, right), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and to - at < DOCS and (to == at or size + len(texts[to] or "") <= CHARS):
                    size += len(texts[to] or "")
                    to += 1
                yield made(batch.column(0).slice(at, to - at), [both.chunks(t) for t in texts[at:to]], key, both)
                key, at = key + to - at, to
        trim()

    return df.select(row_id, text).mapInArrow(run, schema)


def pair_counts(described: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its left id is in more."""
    counts = written(described.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    left = F.floor(F.col("pair") / base)
    most = counts.groupBy(left.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, left == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most so many pairs are in that many documents; 1 if all pairs are few enough."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("m")).collect()  # a row a power
    taken, bar = 0, None
    for k, m in sorted(((r["k"], r["m"]) for r in levels), reverse=True):
        taken += m
        if taken > most:
            break
        bar = k
    return 1 << bar if bar is not None else 1 << 62


def align(df: DataFrame, left: str, right: str, text: str = "text", row_id: str = "doc_id", most: int = PAIRS) -> DataFrame:
    """One row a document: id, tokens of both sides, groups, links, the digest of its groups, how many of its links are of a
    pair that is its left id's most common, and the sum of its links' counts."""
    base = sides(left, right).base
    docs = written(described(df, left, right, text, row_id), "aligned")
    counts = written(pair_counts(docs, base), "counts")
    bar = _frequent(counts, most)
    sums = [F.sum(F.col("n") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    links = docs.select("key", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))
    frequent = F.broadcast(counts.where(F.col("n") >= bar))  # at most PAIRS rows
    if bar == 1:
        found = links.join(frequent, "pair").groupBy("key").agg(*sums)
    else:
        rare = links.join(frequent, "pair", "left_anti").join(counts.where(F.col("n") < bar).hint("shuffle_merge"), "pair")
        found = links.join(frequent, "pair").groupBy("key").agg(*sums).unionAll(rare.groupBy("key").agg(*sums))
        found = found.groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.drop("pairs", "times").join(found, "key", "left").select(F.col("id").alias(row_id), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
