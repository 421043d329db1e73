"""Token counts by a map-side lookup in two tiers.

First tier: the lengths in tokens of the pre-tokens in frequent words, at most FREQUENT of them, broadcast as one small
hash table. They come from a bounded sample (words.sampled: 2,048 rows of each of the first eight tasks), which changes no
result. Second tier: what a worker has encoded so far, kept between its tasks. No word or pre-token is shuffled.

Defined results: a null or empty text has no bytes and no tokens; texts of any length are counted whole; repeated rows
each give a row; an empty table gives none; extra columns stay in count().
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CACHE, CACHE_CHARS, CHUNK, Bpe, vocabulary
from .common import add_column
from .words import sampled

FREQUENT, LIMIT = 32_768, 2048
KIND = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


class Lengths(dict):
    """The first tier; what it lacks is in the second, which is emptied when full."""

    def __init__(self, bpe: Bpe, first: dict[str, int]):
        super().__init__(first)
        self.bpe, self.second, self.chars = bpe, {}, 0

    def __missing__(self, piece: str) -> int:
        return self.second[piece]

    def learn(self, pieces: set[str]) -> None:
        todo = [p for p in pieces if p not in self and p not in self.second]
        if todo:
            if len(self.second) + len(todo) > CACHE or self.chars + sum(map(len, todo)) > CACHE_CHARS:
                self.second.clear()
                self.chars, todo = 0, [p for p in pieces if p not in self]
            self.chars += sum(map(len, todo))
            self.second.update(zip(todo, map(len, self.bpe.encode_pieces(todo)), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and size < CHUNK:
                lists.append([(k, None if k is not None else self.bpe.pieces(s)) for k, s in self.bpe.parts(texts[at])])
                size += len(texts[at] or "")
                at += 1
            self.learn(set().union(*(x for parts in lists for _, x in parts if x)))
            out += [sum(1 if x is None else sum(map(self.__getitem__, x)) for _, x in parts) for parts in lists]
        return out


@functools.lru_cache(maxsize=2)
def _lengths(path: str, first: tuple[tuple[str, int], ...]) -> Lengths:
    return Lengths(vocabulary(path), dict(first))


def first_tier(df: DataFrame, path: str, text: str = "text", most: int = FREQUENT) -> dict[str, int]:
    bpe = vocabulary(path)
    pieces: dict[str, int] = {}
    for word, n in sampled(df, most // 2, text).items():
        for piece in bpe.pieces(word):
            pieces[piece] = pieces.get(piece, 0) + n
    top = sorted(pieces, key=lambda p: (-pieces[p], p))[:most]
    return dict(zip(top, map(len, bpe.encode_pieces(top)), strict=True))


def count(df: DataFrame, path: str, text: str = "text", into: str = "tokens", limit: int = LIMIT, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with a struct column: bytes, tokens, and whether these are more than the limit."""
    table = df.sparkSession.sparkContext.broadcast(tuple(first_tier(df, path, text).items()))

    def make(columns: dict) -> list[dict]:
        texts = columns[text]
        tokens = _lengths(path, table.value).count(texts)
        return [{"n_bytes": len((s or "").encode("utf-8", "surrogatepass")), "n_tokens": n, "over_limit": n > limit} for s, n in zip(texts, tokens, strict=True)]

    return add_column(df, into, KIND, make, [text], drop)


def counts(df: DataFrame, path: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row a document: its id, bytes, tokens, and whether it is over the limit."""
    out = count(df.select(row_id, text), path, text, "__tokens", drop=(text,))
    return out.select(row_id, *(F.col(f"__tokens.{c}").alias(c) for c in KIND.names))
