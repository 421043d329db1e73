"""Byte-pair encoding by a segment tree over adjacent pair ranks, and what token counting needs of it.

A piece (a pre-token) is a row of symbols. Leaf i of its tree holds rank * leaves + i for the pair of symbol i and the
next one, or NONE. So the root is the leftmost pair of the lowest rank. Merging it changes three leaves, each with a
logarithmic path to the root; the piece is done when the root is NONE. Many pieces of a like length go through these
steps together as columns of one array; a lone piece goes through them on plain lists.

Pre-tokens of texts of common letters come from a plain regular expression; all other texts go through the normaliser
and pre-tokeniser of the tokenizers library, whose tables of characters then hold.

Defined results: null is the empty text, which has no tokens. Texts of any length are encoded whole: the tree takes
n log n steps, and rows are handled a few megabytes at a time.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column

NONE = np.iinfo(np.int64).max
#: Pieces a worker remembers, and cells of one array of trees.
CACHE, CACHE_CHARS, CELLS = 200_000, 1 << 23, 1 << 18
#: Characters of a text, and texts, that a worker pre-tokenises before it looks pieces up.
CHUNK = 1 << 20
_PLAIN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: By kind of file. Alternatives that start with different characters are in order of frequency.
_BYTE_LEVEL = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_WORD_END = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LETTER}0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible ones for themselves, others from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Bpe:
    """One vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.path, self.suffix = path, model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] if not self.suffix else vocab[a.removesuffix(self.suffix) + b] for a, b in merges], dtype=np.int64)
        self.rank_of = dict(zip(pairs.tolist(), range(len(merges)), strict=True))
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        self.bytes_of = [b""] * self.size
        for token, k in vocab.items():
            self.bytes_of[k] = b"".join(back.get(c) or c.encode() for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = _WORD_END if self.suffix else _BYTE_LEVEL
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens, as text."""
        if not _PLAIN.search(text):
            return self.plain.findall(text.lower() if self.suffix else text)
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        if not _PLAIN.search(text):
            return self.plain.findall(text)
        back = _letters_back()
        return [bytes(map(back.__getitem__, p)).decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str | None) -> list[tuple[int | None, str]]:
        """A text cut at the strings of special tokens: (id, string) for these, (None, text) for the rest."""
        if not text:
            return []
        if not self.splits or "<" not in text:
            return [(None, text)]
        return [(self.special.get(x), x) for x in self.splits.split(text) if x]

    # encoding of pieces

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece."""
        raw = [p.encode("utf-8") for p in pieces]
        out: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        sizes: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            sizes.setdefault(max(1, 1 << (len(b) - 1).bit_length()), []).append(i)
        for leaves, rows in sizes.items():
            step = max(1, CELLS // (2 * leaves))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                if len(part) * 40 < leaves:
                    for i in part:
                        out[i] = np.array(self._one(raw[i]), dtype=np.uint32)
                else:
                    for i, ids in zip(part, self._many([raw[i] for i in part], leaves), strict=True):
                        out[i] = ids
        return out

    def _symbols(self, raw: bytes) -> np.ndarray:
        ids = self.first[np.frombuffer(raw, dtype=np.uint8)]
        ids[-1] = self.last[raw[-1]]
        return ids

    def _one(self, raw: bytes) -> list[int]:
        """One piece, on plain lists."""
        ids = self._symbols(raw).tolist()
        n, size, rank_of, made = len(ids), self.size, self.rank_of, self.made
        leaves = max(1, 1 << (n - 1).bit_length())
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            if i < 0 or after[i] >= n:
                return NONE
            rank = rank_of.get(ids[i] * size + ids[after[i]])
            return NONE if rank is None else rank * leaves + i

        tree = [NONE] * (2 * leaves)
        for i in range(n):
            tree[leaves + i] = leaf(i)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] != NONE:
            rank, i = divmod(tree[1], leaves)
            j = after[i]
            ids[i], after[i] = int(made[rank]), after[j]
            if after[j] < n:
                before[after[j]] = i
            after[j] = n
            for k, value in ((j, NONE), (i, leaf(i)), (before[i], leaf(before[i]))):
                if k < 0:
                    continue
                k += leaves
                tree[k] = value
                while k > 1:
                    k >>= 1
                    low = min(tree[2 * k], tree[2 * k + 1])
                    if tree[k] == low:
                        break
                    tree[k] = low
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where there is no merge or a symbol is missing."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == keys), self.ranks[at], -1)

    def _many(self, raw: list[bytes], leaves: int) -> list[np.ndarray]:
        """Pieces of at most as many bytes as leaves, in step; row k of an array is position or tree node k."""
        count = len(raw)
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=count)
        joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
        column = np.repeat(np.arange(count), lengths)
        start = np.cumsum(lengths) - lengths
        row = np.arange(len(joined)) - start[column]
        ids = np.full((leaves + 1, count), -1, dtype=np.int64)
        ids[row, column] = self.first[joined]
        ids[lengths - 1, np.arange(count)] = self.last[joined[start + lengths - 1]]
        # the last row stands for "none" at either end
        after = np.repeat(np.arange(1, leaves + 2)[:, None], count, axis=1)
        after = np.where(after < lengths, after, leaves)
        before = np.repeat(np.arange(-1, leaves)[:, None], count, axis=1)
        before[0] = leaves
        tree = np.full((2 * leaves, count), NONE, dtype=np.int64)
        rank = self._ranked(ids[:-1], ids[1:])
        tree[leaves:] = np.where(rank >= 0, rank * leaves + np.arange(leaves)[:, None], NONE)
        for k in range(leaves - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        live = np.flatnonzero(tree[1] != NONE)
        while len(live):
            rank, i = np.divmod(tree[1, live], leaves)
            j = after[i, live]
            k, p = after[j, live], before[i, live]
            merged = self.made[rank]
            ids[i, live], ids[j, live] = merged, -1
            after[i, live] = k
            before[k, live] = i
            ids[leaves, live] = -1
            tree[leaves + j, live] = NONE
            found = self._ranked(merged, ids[k, live])
            tree[leaves + i, live] = np.where(found >= 0, found * leaves + i, NONE)
            has = p < leaves
            found = self._ranked(ids[p, live], merged)
            value = np.where(found >= 0, found * leaves + p, NONE)
            tree[leaves + p[has], live[has]] = value[has]
            nodes = [leaves + i, leaves + j, leaves + np.where(has, p, i)]
            for _ in range(leaves.bit_length() - 1):
                for x in range(3):
                    nodes[x] = nodes[x] >> 1
                    n = nodes[x]
                    tree[n, live] = np.minimum(tree[2 * n, live], tree[2 * n + 1, live])
            live = live[tree[1, live] != NONE]
        kept = ids[:-1].T.ravel()
        full = kept >= 0
        flat = kept[full].astype(np.uint32)
        ends = np.cumsum(full.reshape(count, leaves).sum(axis=1))
        return np.split(flat, ends[:-1])


@functools.cache
def _letters_back() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


class Cache(dict):
    """What a worker remembers of pieces: their ids as little-endian 32-bit integers. It is emptied when full."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.chars = bpe, 0

    def learn(self, pieces: Iterable[str]) -> None:
        seen = set(pieces)
        todo = [p for p in seen if p not in self]
        if todo:
            if len(self) + len(todo) > CACHE or self.chars + sum(map(len, todo)) > CACHE_CHARS:
                self.clear()
                self.chars, todo = 0, list(seen)
            self.chars += sum(map(len, todo))
            self.update(zip(todo, (x.astype("<u4").tobytes() for x in self.bpe.encode_pieces(todo)), strict=True))


@functools.lru_cache(maxsize=4)
def worker_cache(path: str) -> Cache:
    return Cache(vocabulary(path))


def encode_all(texts: list[str | None], path: str) -> Iterable[bytes]:
    """The packed ids of each text."""
    cache = worker_cache(path)
    bpe = cache.bpe
    at = 0
    while at < len(texts):
        cut, size, lists = at, 0, []
        while cut < len(texts) and size < CHUNK:
            lists.append([(k, s if k is not None else bpe.pieces(s)) for k, s in bpe.parts(texts[cut])])
            size += len(texts[cut] or "")
            cut += 1
        cache.learn(set().union(*(x for parts in lists for k, x in parts if k is None)))
        for parts in lists:
            yield b"".join(np.uint32(k).astype("<u4").tobytes() if k is not None else b"".join(map(cache.__getitem__, x)) for k, x in parts)
        at = cut


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 give U+FFFD."""
    table = vocabulary(path).bytes_of
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with the ids of each whole text."""

    def make(columns: dict) -> list[np.ndarray]:
        return [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in encode_all(columns[text], path)]

    return add_column(df, into, T.ArrayType(T.IntegerType(), False), make, [text])


def round_trip(df: DataFrame, path: str, text: str = "text", into: str = "coded", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with a struct column: the number of tokens, and digests of the ids and of the text decoded from them."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make(columns: dict) -> list[dict]:
        out = []
        for b in encode_all(columns[text], path):
            back = decode(np.frombuffer(b, dtype="<u4"), path).encode("utf-8")
            out.append({"n_tokens": len(b) // 4, "ids_sha256": hashlib.sha256(b).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()})
        return out

    return add_column(df, into, kind, make, [text], drop)


def digests(df: DataFrame, path: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row a document: its id, number of tokens and digests."""
    out = round_trip(df.select(row_id, text), path, text, "__coded", (text,))
    return out.select(row_id, *(F.col(f"__coded.{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")))
