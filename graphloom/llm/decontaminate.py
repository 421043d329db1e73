"""Benchmark decontamination: Aho-Corasick over the normalised test items, one scan of each text.

Texts are normalised on bytes: A-Z in lower case, every other ASCII byte that is not a digit or letter as a blank, runs of
blanks as one. As UTF-8 bytes from 0x80 are letters here, the bytes are matched as they are. A window is WINDOW
consecutive words of an item; an item with fewer words is one window. The automaton's letters are words: each word of the
items is known by two characters, a first and a second one of two alphabets of about the root of their number (a state
looks through its ways one by one), and all others by two that stand in no window. So a word is two states, whatever its
length, and a text is scanned as a string of two characters for each word. Matches map back to places in the original text.

The items are read in blocks of at most NODES states, an upper bound that is counted before a block is built (twice the
words times WINDOW; STATE_BYTES each, measured), and each block is broadcast as one list of items. Texts pass through all
blocks in one stage, without a shuffle; so a larger benchmark costs more scans, not more memory.

Defined results: null and empty texts have no words and no hits; items without words are skipped; repeated item texts
count each under its own id; null item ids are reported as the empty string; extra columns stay, and one named as the
result is replaced; an empty benchmark hits nothing; an item with more words than a block holds is cut into parts that
overlap, so that no window is lost; very long texts are scanned whole.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column

WINDOW = 13
#: States of a block's automaton at most, and about what one takes.
NODES, STATE_BYTES = 1 << 20, 64
#: Bytes of words keep their place, A-Z turn to a-z, all others to blanks.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def windows_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """Each window's words, and the ids of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words, name = words_of(text), "" if item is None else str(item)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(name)
    return found


class Machine:
    """The automaton of some items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        import ahocorasick

        windows = windows_of(items, window)
        known = dict.fromkeys(w for part in windows for w in part)
        base = math.isqrt(len(known)) + 1
        self.letters = {w: chr(0x100 + k // base) + chr(0x8000 + k % base) for k, w in enumerate(known)}
        self.found = ahocorasick.Automaton()
        for part, ids in windows.items():
            self.found.add_word("".join([self.letters[w] for w in part]), (len(part), ids))
        if len(self.found):
            self.found.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, the merged spans of hit words (first, one past the last), the items found."""
        words = words_of(text)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(self.found) and words:
            for end, (size, ids) in self.found.iter("".join(map(self.letters.get, words, repeat("  ")))):
                spans.append((end // 2 + 1 - size, end // 2 + 1))
                items.update(ids)
        return len(words), _merge(spans), items


@functools.lru_cache(maxsize=2)
def _machine(key: str, items: tuple[tuple[object, str | None], ...], window: int) -> Machine:
    return Machine(list(items), window)


def char_spans(text: str | None, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of code points of the original text."""
    if not spans:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_KEEP))]
    starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to each byte, its own included
    return [(int(starts[at[a][0]]) - 1, int(starts[at[b - 1][1] - 1])) for a, b in spans]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("words", _SPANS),  # spans of hit words, counted from 0, and one past the last
    T.StructField("chars", _SPANS),  # the same as code points of the original text
])


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[list[tuple[object, str | None]]]:
    most = max(1, NODES // (2 * window))
    block, size = [], 0
    for row in benchmark.select(item, text).toLocalIterator():
        words = words_of(row[1])
        step = max(1, most - window)
        parts = [row[1]] if len(words) <= most else [b" ".join(words[k : k + step + window - 1]).decode("utf-8", "surrogatepass") for k in range(0, len(words) - window + 1, step)]
        for part in parts:
            n = min(len(words), most)
            if block and size + n > most:
                yield block
                block, size = [], 0
            block.append((row[0], part))
            size += n
    yield block


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "hits", window: int = WINDOW) -> DataFrame:
    """df with a struct column: words, hit words, the items found, and the spans of hit words as words and code points."""
    out = df.drop(into)
    for k, block in enumerate(_blocks(benchmark, item, item_text, window)):
        said = df.sparkSession.sparkContext.broadcast(tuple(block))
        key = hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest()

        def make(columns: dict, said=said, key=key, first=not k) -> list[dict]:
            machine, rows = _machine(key, said.value, window), []
            for i, value in enumerate(columns[text]):
                n, spans, items = machine.scan(value)
                if not first:
                    old = columns[into][i]
                    spans, items = _merge([*spans, *((x["first"], x["end"]) for x in old["words"])]), items | set(old["items"])
                pairs = lambda found: [{"first": a, "end": b} for a, b in found]
                rows.append({"n_words": n, "n_hit": sum(b - a for a, b in spans), "items": sorted(items), "words": pairs(spans), "chars": pairs(char_spans(value, spans))})
            return rows

        out = add_column(out, into, HITS, make, [text, into] if k else [text])
    return out


def contaminated(hits: str = "hits"):
    h = F.col(hits)
    return (h["n_hit"] > 0) & (20 * h["n_hit"] >= h["n_words"])


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that hold no benchmark text by the rule of contaminated(), with df's columns."""
    return find(df, benchmark, text, into="__hits").where(~contaminated("__hits")).drop("__hits")


def report(df: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row a document: its id, words, hit words, items found (number and digest) and the verdict."""
    found = find(df.select(row_id, text), benchmark, text, into="__hits")
    h = F.col("__hits")
    return found.select(row_id, h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"), contaminated("__hits").alias("contaminated"))
