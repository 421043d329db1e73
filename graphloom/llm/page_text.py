"""HTML extraction by page differencing: each page against the page of the nearest URL on its host.

Pages are put in order by host and URL path. A page's partner is the neighbour, before or after it, whose path has the
longer common beginning with its own (the one before it in a tie). The two pages' lines (blocks of text) are aligned by
a longest common subsequence, and lines that both have are deleted as the host's template: the menus, headers, footers
and notices that repeat from page to page. Two kinds of line are out of its reach and are told by the page's markup:
prose that an article shares with the next page's (its own paragraphs, headings, list items and table cells stay), and
boxes that differ on every page, such as adverts and readers' comments (elements, roles and names that say so are
deleted). If the page marks an article, only lines in it are text; without one all lines that are left are.

The partner must be another page, not a copy of this one. A template is on the other neighbour as well, a copy's own lines
are not: of the text that the other neighbour lacks, a partner that shares more than COPY is a copy, and the other neighbour
takes its place. Where the other neighbour lacks nothing of the page, or there is none, a partner is a copy if it has
all of the page's text. A page between copies keeps its text. So the share of the template makes no difference.

Pages are dealt by ranges of URLs before they are parsed, once each, so a host of any size is cut into many tasks. A page
at the edge of a task meets its neighbour in an equi-join of the tasks' numbers, two rows a task.

Defined results: a null or empty page has an empty text; pages without ``://`` in their URL share the empty host; pages
that are alike in host and path are ordered by URL and id; repeated rows each give a row; an empty table gives none;
other columns of any name are not looked at; very long and deeply nested pages are read whole.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column
from .html_blocks import blocks
from .url_rules import host_of, path_of

#: A neighbour that shares more than this part of the characters that the other neighbour lacks is a copy of the page.
COPY = 0.8
#: A partner, or what a page needs of itself to be compared: its path and hashed lines.
SIDE = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("lines", T.ArrayType(T.LongType(), False))])
READ = T.StructType([
    T.StructField("lines", T.ArrayType(T.LongType(), False)),
    T.StructField("at", T.ArrayType(T.IntegerType(), False)),  # the place among the lines of each block that may be text
    T.StructField("prose", T.ArrayType(T.BooleanType(), False)),  # whether it is protected as an article's own
    T.StructField("texts", T.ArrayType(T.StringType(), False)),
])


def read(page: str | None) -> dict:
    """A page's lines, and the blocks of it that may be text: the article's, or without one all but the silent ones."""
    import xxhash

    found = blocks(page)
    article = any(b.article and not b.silent for b in found)
    at = [k for k, b in enumerate(found) if not b.silent and (b.article or not article)]
    lines = [xxhash.xxh3_64_intdigest(b.text.encode("utf-8", "surrogatepass")) - (1 << 63) for b in found]
    return {"lines": lines, "at": at, "prose": [found[k].prose for k in at], "texts": [found[k].text for k in at]}


def shared(a: list[int], b: list[int]) -> set[int]:
    """The places in a of a longest common subsequence of a and b. Common ends are cut off; the rest is aligned by rows of
    bits, one bit for each line of a."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    places = {*range(head), *range(len(a) - tail, len(a))}
    common = set(x) & set(y)
    if not common:
        return places
    keep = [k for k, v in enumerate(x) if v in common]
    x, y = [x[k] for k in keep], [v for v in y if v in common]
    full, masks = (1 << len(x)) - 1, {}
    for k, v in enumerate(x):
        masks[v] = masks.get(v, 0) | 1 << k
    # a zero bit k of row j: the subsequence of x[:k+1] and y[:j] is longer than that of x[:k] and y[:j]
    rows = [full]
    for v in y:
        row = rows[-1]
        u = row & masks[v]
        rows.append((row + u | row - u) & full)
    k, j = len(x) - 1, len(y)
    while k >= 0 and j > 0:
        if rows[j] >> k & 1:
            k -= 1  # x[k] lengthens nothing
        elif not rows[j - 1] >> k & 1:
            j -= 1  # nor does y[j - 1]
        else:
            places.add(head + keep[k])
            k, j = k - 1, j - 1
    return places


def nearest(path: str, sides: list[dict | None], host: str) -> list[dict]:
    """The neighbours on the host, the one whose path begins as path does for longest before the other; in order in a tie."""
    mine = [s for s in sides if s and s["host"] == host]
    return sorted(mine, key=lambda s: -len(os.path.commonprefix([path, s["path"]])))


def difference(row: dict, partners: list[dict]) -> dict:
    """The page's text, its length, and how many of its lines that may be text were deleted because its partner, the first that
    is no copy, has them too."""
    size = {k: len(t) for k, t in zip(row["at"], row["texts"], strict=True)}
    both = [size.keys() & shared(row["lines"], p["lines"]) for p in partners]
    chars = lambda places: sum(size[k] for k in places)

    def copy(n: int) -> bool:
        lacking = size.keys() - both[1 - n] if len(both) > 1 else set()
        if lacking:
            return chars(lacking & both[n]) > COPY * chars(lacking)
        return both[n] == size.keys()

    found = next((d for n, d in enumerate(both) if not copy(n)), set())
    deleted = found - {k for k, prose in zip(row["at"], row["prose"], strict=True) if prose}
    text = "\n".join(t for k, t in zip(row["at"], row["texts"], strict=True) if k not in deleted)
    return {"text": text, "n_chars": len(text), "n_shared": len(deleted)}


def extract(pages: DataFrame, page: str = "html", url: str = "url", row_id: str = "page_id") -> DataFrame:
    """One row a page: its id, url, text, n_chars and n_shared."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    order = ["host", "path", "url", "id"]
    step = pages.select(F.col(row_id).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(page).alias("page"))
    # the last key of each range, from the keys alone: as many rows as the ranges
    keys = step.select(*order).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ends = keys.groupBy(F.spark_partition_id().alias("k")).agg(F.max(F.struct(*order)).alias("end")).select("end.*")
    ends = sorted(_key(r) for r in ends.collect())

    def parse(columns: dict) -> list[dict]:
        found = zip(*(columns[c] for c in order), strict=True)
        return [{"part": bisect_left(ends, _key(k)), **read(x)} for k, x in zip(found, columns["page"], strict=True)]

    part = T.StructField("part", T.IntegerType())
    step = add_column(step, "r", T.StructType([part, *READ.fields]), parse, [*order, "page"], ("page",)).select("id", "url", "host", "path", "r.*")
    step = step.repartitionById(max(1, len(ends)), F.col("part")).sortWithinPartitions(*order)
    done = T.StructType([step.schema["id"], step.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_shared", T.LongType())])
    edge = T.StructType([part, T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("own", step.schema), T.StructField("inner", SIDE)])

    def side(row: dict | None) -> dict | None:
        return row and {k: row[k] for k in SIDE.names}

    def closed(before: dict | None, row: dict, after: dict | None, edges: bool) -> list[dict]:
        """A page between its neighbours in the task: as an edge of the task, or else with its text."""
        if (before is None or after is None) != edges:
            return []
        if edges:
            return [{"part": row["part"], "first": before is None, "last": after is None, "own": row, "inner": side(before or after)}]
        return [{"id": row["id"], "url": row["url"], **difference(row, nearest(row["path"], [side(before), side(after)], row["host"]))}]

    def walk(kind: T.StructType, edges: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = to_arrow_schema(kind)
            before = row = None
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    out: list[dict] = []
                    for after in batch.slice(at, 200).to_pylist():
                        if row is not None:
                            out += closed(before, row, after, edges)
                        before, row = row, after
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
            if row is not None:
                yield pa.RecordBatch.from_pylist(closed(before, row, None, edges), schema=schema)

        return step.mapInArrow(run, kind)

    # both walks read one shuffle; the sorted pages are not written a second time
    inside, edges = walk(done, False), walk(edge, True)
    # each task is sent its own edges, the last page of the task before and the first of the task after it
    own_kind = T.StructType(edge.fields[1:])
    me, none = F.struct(*(F.col(f"own.{c}").alias(c) for c in SIDE.names)), F.lit(None)
    own = F.struct(F.col("part").alias("to"), F.struct("first", "last", "own", "inner").alias("edge"), none.cast(SIDE).alias("before"), none.cast(SIDE).alias("after"))
    sent = lambda to, b, a: F.struct(to.alias("to"), none.cast(own_kind).alias("edge"), b.alias("before"), a.alias("after"))
    forth = F.when(F.col("last"), sent(F.col("part") + 1, me, none.cast(SIDE)))
    back = F.when(F.col("first"), sent(F.col("part") - 1, none.cast(SIDE), me))
    mail = edges.select(F.explode(F.array_compact(F.array(own, forth, back))).alias("m")).select("m.*")
    met = mail.groupBy("to").agg(F.collect_list("edge").alias("edges"), F.max("before").alias("before"), F.max("after").alias("after"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                out = []
                for row in batch.slice(at, 50).to_pylist():
                    for e in row["edges"]:
                        sides = [row["before"] if e["first"] else e["inner"], row["after"] if e["last"] else e["inner"]]
                        out.append({"id": e["own"]["id"], "url": e["own"]["url"], **difference(e["own"], nearest(e["own"]["path"], sides, e["own"]["host"]))})
                yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(done))

    return inside.union(met.select("edges", "before", "after").mapInArrow(meet, done)).withColumnRenamed("id", row_id)


def _key(values) -> tuple:
    """Ordered as Spark orders these values: null first, text by its bytes."""
    return tuple((x is not None, x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x) if x is not None else (False,) for x in values)
