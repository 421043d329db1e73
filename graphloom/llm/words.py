"""Counts of words over all texts, each partition's counts summed before anything is shuffled.

Words are what stands between the bytes of ASCII white space, with A-Z in lower case; null texts have none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

#: A sample of frequent words: rows of a task, and tasks.
SAMPLE_ROWS, SAMPLE_TASKS = 2048, 8
#: Words a worker counts before it hands its sums on.
HELD = 600_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def partial_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) rows, a few for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out(items: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.binary()).cast(pa.string()), pa.array([n for _, n in items], pa.int64())], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                counts.update(words_of(value.as_py()))
                if len(counts) > HELD:
                    yield out(list(counts.items()))
                    counts.clear()
        yield out(list(counts.items()))
        counts.clear()
        trim()

    return df.select(text).mapInArrow(run, "word string, n long")


#: Parts into which words of one count are cut by their hash, where not all of them are taken.
PARTS = 1024


def top(counts: DataFrame, most: int, count: str = "n") -> dict[str, int]:
    """At most that many of the most frequent of (word, count), most frequent first, ties by the word. A histogram by
    powers of 2 ** (1 / 16) finds the least level to take, and within the first level that is too large another one finds
    the least count, and of that count's words the parts by hash; so no task sorts or gathers more than is returned, and
    fewer than asked for are returned only by less than a part."""
    level, part = F.floor(16 * F.log2(F.col(count))).cast("int"), F.pmod(F.xxhash64("word"), F.lit(PARTS))

    def taken(rows: list[tuple], room: int) -> tuple[tuple | None, int]:
        """The first of (key.., size) that does not fit, in order, and the room that is left before it."""
        for *key, n in rows:
            if n > room:
                return tuple(key), room
            room -= n
        return None, room

    size = F.count("*").alias("m")
    full, room = taken(sorted(map(tuple, counts.groupBy(level.alias("k")).agg(size).collect()), reverse=True), most)
    wanted = F.lit(True)
    if full:
        inside = counts.where(level == full[0])
        # exact counts of one level, and then parts of one count: few rows each
        least, room = taken(sorted(map(tuple, inside.groupBy(F.col(count).alias("k")).agg(size).collect()), reverse=True), room)
        last, _ = taken(sorted(map(tuple, inside.where(F.col(count) == least[0]).groupBy(part.alias("k")).agg(size).collect())), room)
        wanted = (F.col(count) > least[0]) | (F.col(count) == least[0]) & (part < last[0])
    rows = counts.where(wanted).select("word", count).toLocalIterator()
    return dict(sorted(((w, n) for w, n in rows), key=lambda x: (-x[1], x[0])))


def sampled(df: DataFrame, most: int, text: str = "text") -> dict[str, int]:
    """At most that many frequent words of a sample, with their counts there: the first SAMPLE_ROWS rows of the first SAMPLE_TASKS
    tasks. A table that only saves work; the other tasks read nothing, and no word is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() >= SAMPLE_TASKS:
            return
        counts: Counter[bytes] = Counter()
        for value in islice((v for batch in batches for v in batch.column(0)), SAMPLE_ROWS):
            counts.update(words_of(value.as_py()))
        items = nlargest(most, counts.items(), key=lambda x: x[1])
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.binary()).cast(pa.string()), pa.array([n for _, n in items], pa.int64())], names=["word", "n"])
        trim()

    sums: Counter[str] = Counter()
    for word, n in df.select(text).mapInArrow(run, "word string, n long").collect():  # at most SAMPLE_TASKS * most rows
        sums[word] += n
    return dict(sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:most])
