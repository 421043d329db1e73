"""N-gram Jaccard join by prefixes under several global orders of the shingles, whose filters are intersected.

A document's set holds its distinct shingles of consecutive words (white space between, A-Z in lower case); fewer words
make one shingle. Sets A and B link when |A & B| / |A | B| >= num / den. Equal sets are one set from the start.

1. Shingles of no other set can be in no intersection. One pass over the texts counts them for a half of the hash space:
   sorted runs of short hashes are dealt by range to buckets, a shingle of several sets of a run goes as one entry, and
   what is counted as shared by mistake only lets more through. A set of which too little is left links with nothing.
2. The sets that remain are built from their texts, and each shingle's number of sets is counted.
3. Every global order puts the shingles of one set first, so that they use up the prefix; then the orders differ: rarest
   first, and two by salted hashes. Sets that link share a shingle among the first n - ceil(n * num / den) + 1 of each,
   under every order. Postings are dealt by the first order's prefix; a pair is a candidate if its places in the posting
   list still allow a link, at the first shingle its prefixes share, and if its prefixes under the second and the third
   order meet as well. Whole sets verify what is left.
4. Not all pairs of a list are made: first its members meet the one with the fewest shingles of its own (of near copies:
   the one next to the original), links are contracted to components, and lists within one component are done. This
   goes on with other centres while it pays; then what is left between components is enumerated. Each pair that could
   link is either verified or within one component, so no link between components is lost.

Shingles and sets are known by 64-bit hashes.

Defined results: null and empty texts have an empty set and link with nothing; a null id never is the smallest, and a
component of null ids only has a null id; repeated rows are equal sets; an empty table gives no rows; very long texts are
hashed piece by piece; other columns of any name are not looked at, and one_of_each() hands them on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, discard, maybe_broadcast, trim, written

#: Pairs of a list that are compared by place alone, for each posting, before its members meet centres instead.
FEW, CENTRES = 1024, 8
#: Bytes of text that are hashed at once; shingles and sets of a sorted run.
SEGMENT, RUN, RUN_SETS = 1 << 19, 1 << 20, 60_000
#: Shingles before a posting's own that are compared, so that a pair is made once and not at each shingle it shares.
BEFORE = 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte; the powers of an odd number up to n, and those of its inverse."""
    base = 0xD1342543DE82EF95
    with np.errstate(over="ignore"):
        letters = _scatter(np.arange(1, 257, dtype=np.uint64) * _MIX[0])
        return letters, *(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, np.uint64(x)))]) for x in (base, pow(base, -1, 1 << 64)))


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word of a text, from running sums over its bytes; long texts are cut at white space."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    out, at = [], 0
    while at < len(raw):
        part = raw[at : at + SEGMENT]
        if at + SEGMENT < len(raw):
            blank = np.flatnonzero(_BLANK[raw[at : at + SEGMENT]])
            if len(blank):
                part = part[: blank[-1] + 1]
            else:  # one long word
                rest = np.flatnonzero(_BLANK[raw[at:]])
                part = raw[at : at + rest[0]] if len(rest) else raw[at:]
        out.append(_segment(part))
        at += len(part)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _segment(a: np.ndarray) -> np.ndarray:
    letters, powers, inverse = _powers(max(SEGMENT, 1 << len(a).bit_length()))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[a], [True]])))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[a] * powers[: len(a)])])
        return _scatter((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX[0])


class Shingler:
    """Sets of shingle hashes."""

    def __init__(self, width: int):
        self.width = width

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes, sorted."""
        x = word_hashes(text)
        if not len(x):
            return x
        size = min(self.width, len(x))
        count = len(x) - size + 1
        total = np.full(count, np.uint64(size))
        with np.errstate(over="ignore"):
            for k in range(size):
                total = total * _MIX[0] + x[k : k + count]
            return np.unique(_scatter(total))

    @staticmethod
    def sig(found: np.ndarray) -> int | None:
        import xxhash

        return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None


#: Rows of the first pass: a bucket's part of a run (low and high bytes of sorted hashes, the place of the set of each
#: among sigs or MANY), a set's number of shingles that its run holds elsewhere, or a document; then a bucket's part of
#: the counts of sets.
_RUN_ROW = T.StructType([T.StructField(c, T.BinaryType()) for c in ("low", "high", "at", "sigs")])
_SUM_ROW = T.StructType([T.StructField(c, T.BinaryType()) for c in ("sigs", "counts")])
_SET_ROW = T.StructType([T.StructField(c, T.LongType()) for c in ("sig", "n", "half", "near", "shared")])
MANY = 0xFFFF


def _half(found: np.ndarray) -> np.ndarray:
    return found[found & np.uint64(1) == 0]


class Run:
    """Shingles of some sets, handed on sorted; see the head of this module."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.sigs: dict[int, int] = {}
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, sig: int, half: np.ndarray) -> bool:
        """Whether the run is full."""
        if sig not in self.sigs:
            self.sigs[sig] = len(self.sigs)
            self.found.append(half)
            self.size += len(half)
        return self.size >= RUN or len(self.sigs) >= RUN_SETS

    def rows(self) -> Iterator[dict]:
        sigs = np.fromiter(self.sigs, np.int64, len(self.sigs))
        v = np.concatenate([*self.found, np.empty(0, np.uint64)])
        at = np.repeat(np.arange(len(sigs)), [len(x) for x in self.found])
        order = np.argsort(v)
        v, at = v[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(v)))
        near = np.bincount(at[np.repeat(size > 1, size)], minlength=len(sigs))
        v, at = v[first], np.where(size > 1, MANY, at[first])
        bucket = (v >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(v)], strict=True):
            if a < b:
                own = at[a:b] != MANY
                used, place = np.unique(at[a:b][own], return_inverse=True)
                places = np.full(b - a, MANY, np.uint16)
                places[own] = place
                yield {
                    "bucket": int(bucket[a]),
                    "run": {"low": v[a:b].astype(np.uint32).tobytes(), "high": (v[a:b] >> np.uint64(32)).astype(np.uint8).tobytes(), "at": places.tobytes(), "sigs": sigs[used].tobytes()},
                }
        for k in np.flatnonzero(near):
            yield {"bucket": int(k) % self.buckets, "set": {"sig": int(sigs[k]), "near": int(near[k])}}
        self.clear()


def _meet(runs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: sets, and for each the number of its shingles that another set has too."""
    whole = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in runs])
    v = whole("high", np.uint8).astype(np.uint64) << np.uint64(32) | whole("low", np.uint32)
    at = whole("at", np.uint16)
    sizes = [len(r["at"]) // 2 for r in runs]
    starts = np.cumsum([0, *(len(r["sigs"]) // 8 for r in runs)])[:-1]
    own = at != MANY
    sig = np.zeros(len(v), np.int64)
    sig[own] = whole("sigs", np.int64)[(at + np.repeat(starts, sizes))[own]]
    order = np.lexsort((sig, v))
    v, sig, own = v[order], sig[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    size = np.diff(np.append(first, len(v)))
    shared = ~np.logical_and.reduceat(own, first) | (sig[first] != sig[first + size - 1])
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (sig[1:] != sig[:-1])])
    return np.unique(sig[own & new & np.repeat(shared, size)], return_counts=True)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the counts of each set."""
    sigs, place = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
    return sigs, np.bincount(place, weights=np.concatenate([c for _, c in parts]), minlength=len(sigs)).astype(np.int64)


def _by_bucket(column: str, plain: tuple[str, ...], close, done, kind: pa.Schema):
    """Over rows in order of their bucket: rows without the column pass with the others named, close() gets all values of
    a bucket, done() what is left at the end; both return rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        out = lambda rows: pa.RecordBatch.from_pylist(rows, schema=kind)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            rest = batch.filter(values.is_null())
            yield pa.RecordBatch.from_arrays([rest.column(rest.schema.get_field_index(f.name)) if f.name in plain else pa.nulls(rest.num_rows, f.type) for f in kind], schema=kind)
            rows = batch.filter(values.is_valid())
            for b, r in zip(rows.column(0).to_pylist(), rows.column(rows.schema.get_field_index(column)).to_pylist(), strict=True):
                if b != bucket:
                    if held:
                        yield out(close(held))
                    held, bucket = [], b
                held.append(r)
        if held:
            yield out(close(held))
        yield out(done())
        held.clear()
        trim()

    return run


def marks(docs: DataFrame, width: int) -> DataFrame:
    """Of docs (id, text, text_hash): a row a document with id, text_hash and sig, n, half of its set, and rows of sets with
    near or shared. Two shuffles: of seven bytes and a part of the set's name for each counted shingle, and of sums."""
    from pyspark.sql.pandas.types import to_arrow_schema

    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc = T.StructType([docs.schema["id"], docs.schema["text_hash"]])
    bucket, both = T.StructField("bucket", T.IntegerType()), [T.StructField("set", _SET_ROW), T.StructField("doc", doc)]
    dealt, summed = T.StructType([bucket, T.StructField("run", _RUN_ROW), *both]), T.StructType([bucket, T.StructField("sum", _SUM_ROW), *both])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, shingler, run, count = to_arrow_schema(dealt), Shingler(width), Run(buckets), 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(run.rows())
            for k in range(0, len(rows), 1 << 12):
                yield pa.RecordBatch.from_pylist(rows[k : k + (1 << 12)], schema=kind)

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
                rows = []
                for i, h, text in zip(column("id").to_pylist(), column("text_hash").to_pylist(), column("text"), strict=True):
                    found = shingler.shingles(text.as_py())
                    sig, half = shingler.sig(found), _half(found)
                    count += 1
                    rows.append({"bucket": count % buckets, "set": {"sig": sig, "n": len(found), "half": len(half)}, "doc": {"id": i, "text_hash": h}})
                    if sig is not None and run.add(sig, half):
                        yield from flush()
                yield pa.RecordBatch.from_pylist(rows, schema=kind)
        yield from flush()
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> list[dict]:
            if not held:
                return []
            sigs, counts = _added(held)
            held.clear()
            to = (sigs.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(to, kind="stable")
            sigs, counts, to = sigs[order], counts[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            return [{"bucket": int(to[a]), "sum": {"sigs": sigs[a:b].tobytes(), "counts": counts[a:b].astype(np.uint32).tobytes()}} for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True) if a < b]

        def close(runs: list[dict]) -> list[dict]:
            held.append(_meet(runs))
            return flush() if sum(len(s) for s, _ in held) >= RUN else []

        return _by_bucket("run", ("bucket", "set", "doc"), close, flush, to_arrow_schema(summed))(batches)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(sums: list[dict]) -> list[dict]:
            sigs, counts = _added([(np.frombuffer(x["sigs"], np.int64), np.frombuffer(x["counts"], np.uint32)) for x in sums])
            return [{"set": {"sig": s, "shared": k}} for s, k in zip(sigs.tolist(), counts.tolist(), strict=True)]

        return _by_bucket("sum", ("set", "doc"), close, list, to_arrow_schema(T.StructType(both)))(batches)

    met = docs.mapInArrow(cut, dealt).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, summed)
    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, T.StructType(both))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b), by contraction to the least neighbour until no edge is left. Nodes
    are hashes, so that chains in order of their names are short."""
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps.append(written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents"))
        of = lambda side: steps[-1].select(F.col("a").alias(side), F.col("p").alias(f"p_{side}"))
        met = edges.join(of("a"), "a").join(of("b"), "b").where("p_a <> p_b")
        new = written(met.select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).distinct(), "edges")
        discard(edges)
        edges = new
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps[0].select(F.col("a").alias("node"), F.col("p").alias("component"))
    for k, step in enumerate(steps[1:]):
        step = step.select(F.col("a").alias("component"), F.col("p").alias(f"p{k}"))
        labels = labels.join(step, "component", "left").select("node", F.coalesce(f"p{k}", "component").alias("component"))
    labels = written(labels, "labels")
    discard(edges, *steps)
    return labels


class Join:
    """One join over the documents of df; see the head of this module."""

    def __init__(self, df: DataFrame, width: int, num: int, den: int, text: str = "text", row_id: str = "doc_id"):
        if not (0 < num <= den and width > 0):
            raise ValueError("width must be positive and the similarity above 0 and at most 1")
        self.num, self.den, self.width = num, den, width
        docs = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
        found = written(marks(docs, width), "marks")
        #: id, text_hash, n and sig of each row of df
        self.base = found.where("doc IS NOT NULL").select("doc.*", "set.n", "set.sig")
        sums = found.where("set.sig IS NOT NULL").groupBy(F.col("set.sig").alias("sig"))
        sums = sums.agg(F.max("set.n").alias("n"), F.max("set.half").alias("half"), F.max("set.near").alias("near"), F.sum("set.shared").alias("shared"), F.min("doc.id").alias("id"), F.min("doc.text_hash").alias("text_hash"))
        left = F.col("n") - F.col("half") + F.least(F.col("half"), F.coalesce("near", F.lit(0)) + F.coalesce("shared", F.lit(0)))
        # one more shingle is in the union at least, as equal sets are one
        some = (left * den >= F.col("n") * num) & (F.col("n") * den >= (F.col("n") + 1) * num)
        #: sig, the least id, a text's hash, and whether the set could link with another
        self.sigs = written(sums.select("sig", "id", "text_hash", some.alias("some")), "sigs")
        self.sets = written(self._orders(self._sets(docs)), "sets")
        self.members = written(self._members(), "members")
        #: tables of the rounds, removed after the last one
        self.tables: list[DataFrame] = []

    def _sets(self, docs: DataFrame) -> DataFrame:
        """sig and the shingles of the sets that could link; one text is read for each."""
        width, kind = self.width, T.StructType([T.StructField("sig", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            shingler, seen, rows, size = Shingler(width), set(), [], 0
            for batch in batches:
                for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if h not in seen:
                        seen.add(h)
                        found = shingler.shingles(text.as_py())
                        rows.append({"sig": shingler.sig(found), "shingles": found.view(np.int64)})
                        size += len(found)
                    if size > RUN:
                        yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(kind))
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(kind))
            trim()

        chosen = self.sigs.where("some").select("text_hash")
        texts = docs.select("text_hash", "text").join(F.broadcast(chosen) if chosen.count() * 16 <= 32 << 20 else chosen, "text_hash", "left_semi")
        return written(texts.mapInArrow(build, kind).dropDuplicates(["sig"]), "built")

    def _orders(self, sets: DataFrame) -> DataFrame:
        """sig, n, m, own: how many shingles it has, how many of them another of the sets has too, and the part that none
        has; those shared, rarest first; the prefix's length p; the prefixes under the second and the third order."""
        rows = sets.select("sig", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("token"))
        counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        near = rows.join(counts, "token").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        out = near.select("sig", "n", F.size("t").cast("long").alias("m"), F.transform("t", lambda x: x["token"]).alias("shingles"))
        out = out.withColumn("p", (F.col("m") - F.floor((F.col("n") * self.num + (self.den - 1)) / self.den) + 1).cast("int")).where("p > 0")
        salted = lambda k: F.slice(F.sort_array(F.transform("shingles", lambda x: F.xxhash64(x, F.lit(k)))), F.lit(1), F.col("p"))
        return out.select("*", ((F.col("n") - F.col("m")) / F.col("n")).alias("own"), salted(2).alias("second"), salted(3).alias("third"))

    def _members(self) -> DataFrame:
        """The posting lists with two sets or more: token, and of each member sig, n, m, own, its place i and the shingles
        before it."""
        cut = self.sets.withColumn("prefix", F.slice("shingles", F.lit(1), F.col("p")))
        rows = cut.select("sig", "n", "m", "own", "prefix", F.posexplode("prefix").alias("i", "token"))
        first = F.greatest(F.col("i") - BEFORE, F.lit(0))
        rows = rows.select("token", F.struct("own", "sig", "n", "m", "i", F.slice("prefix", first + 1, F.col("i") - first).alias("before")).alias("x"))
        many = rows.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
        return rows.join(many, "token")

    def _could(self, a: str, b: str) -> Column:
        """Whether members of a list can link, and share no shingle just before this one."""
        part = lambda x, name: F.col(f"{x}.{name}").cast("long")
        most = F.least(part(a, "i"), part(b, "i")) + F.least(part(a, "m") - part(a, "i"), part(b, "m") - part(b, "i"))
        return (self.den * most >= self.num * (part(a, "n") + part(b, "n") - most)) & ~F.arrays_overlap(f"{a}.before", f"{b}.before")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that share a prefix shingle under the other orders and that link."""
        meet = lambda pairs, some: pairs.join(self.sets.select(F.col("sig").alias("a"), *(F.col(c).alias(f"{c}_a") for c in some)), "a").join(self.sets.select(F.col("sig").alias("b"), *(F.col(c).alias(f"{c}_b") for c in some)), "b")
        near = meet(pairs, ("second", "third")).where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
        both = meet(near, ("n", "shingles")).withColumn("common", F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long"))
        return both.where(self.den * F.col("common") >= self.num * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")

    def _centred(self, members: DataFrame, order: Column, apart: Column) -> DataFrame:
        """Pairs of each list's centre, the least by order, with the other members. The centres are written first, so that the
        join reads two plain shuffles, and a list of very many members can be split among tasks."""
        centre = members.groupBy("token").agg(F.min_by("x", order).alias("y"), *([F.min_by("c", order).alias("d")] if "c" in members.columns else []))
        centre = written(centre, "centres")
        self.tables.append(centre)
        return members.join(centre, "token").where(apart & self._could("x", "y")).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct()

    def components(self) -> DataFrame:
        """(node, component) by sig, of all sets that link with another."""
        pairs = self._centred(self.members, F.struct("x.own", "x.sig"), F.col("x.sig") != F.col("y.sig"))
        links = written(self.verify(pairs), "links")
        labels, centres = connected(links), 1
        self.tables.append(links)
        held = self.members.count()
        while True:
            rest = self.members.join(labels, F.col("x.sig") == F.col("node"), "left").select("token", "x", F.coalesce("component", "x.sig").alias("c"))
            sizes = rest.groupBy("token", "c").agg(F.count("*").cast("double").alias("k"))
            open_ = written(sizes.groupBy("token").agg((F.pow(F.sum("k"), F.lit(2)) - F.sum(F.col("k") * F.col("k"))).alias("pairs")).where("pairs > 0"), "open")
            left = open_.agg(F.sum("pairs")).first()[0]
            if not left:
                break
            last = left / 2 <= FEW * max(held, 1 << 14) or centres >= CENTRES
            rest = written(rest.join(open_.select("token"), "token"), "rest")
            if last:
                one = rest.select("token", F.col("x").alias("y"), F.col("c").alias("d"))
                before = F.struct("x.own", "x.sig") < F.struct("y.own", "y.sig")
                pairs = rest.join(one, "token").where((F.col("c") != F.col("d")) & before & self._could("x", "y")).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct()
            else:
                pairs = self._centred(rest, F.xxhash64("x.sig", F.lit(centres)), F.col("c") != F.col("d"))
            new = written(self.verify(pairs), "links")
            discard(open_, rest)
            self.tables.append(new)
            found = not new.isEmpty()
            if found:
                links, old = links.union(new), labels
                labels = connected(links)
                if hasattr(old, "_path"):
                    discard(old)
            if last:
                break
            centres = centres + 1 if found else CENTRES
        discard(*self.tables)
        return labels

    def keys(self) -> DataFrame:
        """(sig, id, key) of each set: the least id of its documents; equal keys: one component."""
        labels = self.components()
        out = self.sigs.join(labels, self.sigs["sig"] == labels["node"], "left").select("sig", "id", F.coalesce("component", "sig").alias("key"))
        out = written(out, "keys")
        discard(self.sets, self.members, *([labels] if hasattr(labels, "_path") else []))
        return out


def components(df: DataFrame, width: int = 3, num: int = 90, den: int = 100, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row a document: its id, the size of its set, and the least id of its component."""
    join = Join(df, width, num, den, text, row_id)
    keys = join.keys()
    # written, as are the best of each group below: a join with plain shuffles on both sides can split a large group
    least = written(keys.groupBy("key").agg(F.min("id").alias("least")), "least")
    of = keys.join(least, "key").select("sig", "least")
    out = join.base.where("sig IS NOT NULL").join(of, "sig").select("id", "n", "least")
    out = out.union(join.base.where("sig IS NULL").select("id", "n", F.col("id").alias("least")))
    return out.select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of df with one document of each component, that of the least id (null last); documents without words all
    stay. Of rows that are alike in id and text one stays."""
    join = Join(df, width, num, den, text, row_id)
    rows = join.base.where("sig IS NOT NULL").join(join.keys().select("sig", "key"), "sig").select("key", "id", "text_hash")
    rows = written(rows, "rows")
    order = F.struct(F.col("id").isNull(), "id", "text_hash")
    best = written(rows.groupBy("key").agg(F.min(order).alias("best")), "best")
    lost = rows.join(best, "key").where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.text_hash"))))
    lost = written(lost.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "lost")
    match = lambda d: d[row_id].eqNullSafe(F.col("__id")) & (F.xxhash64(d[text]) == F.col("__hash"))
    kept = df.join(maybe_broadcast(lost, 24), match(df), "left_anti")
    alike = written(rows.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("k")).where("k > 1").drop("k"), "alike")
    discard(rows, best)
    if alike.isEmpty():
        return kept
    alike = maybe_broadcast(alike, 24)
    again = kept.join(alike, match(kept), "left_semi").withColumn("__hash", F.xxhash64(text)).dropDuplicates([row_id, "__hash"]).drop("__hash")
    return kept.join(alike, match(kept), "left_anti").unionByName(again)
