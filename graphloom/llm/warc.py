"""WARC: records read and written, and the derivative builder.

derive() turns each response into two linked records. The metadata record (application/warc-fields) refers to the
response and carries its digests, HTTP status and headers, title, language and links; the conversion record
(text/plain) refers to the response and holds the page's text. Both keep target URI and date. A new record's identifier
is made from the response's identifier and the kind of record, so that a second run writes the same records.

Digests are ``sha1:`` and base 32 of the block or, for payloads, of the HTTP body.

Defined results: a response without an HTTP body has an empty text; a null page is an empty body, a null URL an empty
target; other kinds of records pass derive() unheeded; a record cut off by the end of the file is given with the bytes
that are there, and flagged; repeated responses each give their two records; no responses give no records; other columns
of any name are not looked at, but for those that derive() is asked to keep; a block of any length is read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_blocks import blocks, links, title

#: Bytes of a file that are inflated at once.
PIECE = 1 << 20
_BLANK_LINE = re.compile(rb"\r?\n\r?\n")
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:graphloom:warc")
HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()), T.StructField("headers", HEADERS), T.StructField("block", T.BinaryType()), T.StructField("cut_off", T.BooleanType())])
DERIVED = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("warc_type", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("warc_date", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_length", T.LongType()),
    T.StructField("block_digest", T.StringType()),
    T.StructField("source_block_digest", T.StringType()),
    T.StructField("source_payload_digest", T.StringType()),
    T.StructField("block", T.BinaryType()),
])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(map(str, parts)))}>"


# files


def inflated(data: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A file's bytes in pieces, gzip members (one or many, the last perhaps cut off) inflated as they are asked for."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + most] for k in range(0, len(data), most))
        return
    rest = memoryview(data)
    while rest[:2] == b"\x1f\x8b":
        member, k = zlib.decompressobj(31), 0
        try:
            while not member.eof and (k < len(rest) or member.unconsumed_tail):
                fresh = b"" if member.unconsumed_tail else bytes(rest[k : k + most])
                k += len(fresh)
                yield member.decompress(member.unconsumed_tail + fresh, most)
            yield member.flush()
        except zlib.error:  # a damaged member: what could be read stays, and nothing after it
            return
        rest = rest[k - len(member.unused_data) :]


def parse(data: bytes | Iterable[bytes]) -> Iterator[dict]:
    """The records of a file, whole or gzipped, or of its inflated pieces. One record is held at a time, and a piece."""
    pieces = iter(inflated(data) if isinstance(data, bytes) else data)
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = None if ended else next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[: max(0, len(held) - 4)]
            if not more():
                return
        del held[:at]
        looked = 0
        while not (stop := _BLANK_LINE.search(held, looked)):
            looked = max(0, len(held) - 4)
            if not more():
                break
        head = bytes(held[: stop.start() if stop else len(held)])
        headers: list[dict] = []
        for line in re.split(rb"\r?\n", head)[1:]:
            if line[:1] in b" \t" and headers:
                headers[-1]["value"] += " " + line.strip().decode("utf-8", "replace")
            elif b":" in line:
                key, _, value = line.partition(b":")
                headers.append({"name": key.strip().decode("utf-8", "replace"), "value": value.strip().decode("utf-8", "replace")})
        length = value_of(headers, "Content-Length") or "0"
        size, begin = int(length) if length.isdigit() else 0, stop.end() if stop else len(held)
        while len(held) < begin + size and more():
            pass
        block = bytes(held[begin : begin + size])
        yield {"record_id": value_of(headers, "WARC-Record-ID"), "warc_type": value_of(headers, "WARC-Type"), "headers": headers, "block": block, "cut_off": not stop or len(block) < size}
        del held[: begin + size]


def value_of(headers: Iterable[dict], name: str) -> str | None:
    return next((h["value"] for h in headers or () if h["name"].lower() == name.lower()), None)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as bytes."""
    lines = [re.sub(r"[\r\n]+", " ", f"{k}: {v}") for k, v in [*headers, ("Content-Length", len(block))] if k.lower() != "content-length" or v == len(block)]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path. A file is one row of Spark's reader, and so at most 2 GB as it is stored;
    its gzip members are inflated one after another, never as a whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for one in parse(content.as_py()):
                    held.append(one)
                    size += len(one["block"])
                    if size > PIECE or len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=to_arrow_schema(RECORD))
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=to_arrow_schema(RECORD))

    return files.mapInArrow(run, RECORD)


def serialised(derived: DataFrame) -> DataFrame:
    """One column, the bytes of each derived record; written in order they are a WARC file."""

    def make(columns: dict) -> list[bytes]:
        out = []
        for kind, name, to, uri, date, content, mark, block in zip(*(columns[c] for c in _HEAD), strict=True):
            out.append(record([("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", to), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", content), ("WARC-Block-Digest", mark)], block))
        return out

    from .common import add_column

    return add_column(derived.select(*_HEAD), "bytes", T.BinaryType(), make, list(_HEAD)).select("bytes")


_HEAD = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "block")


# derivatives


def http_parts(block: bytes) -> tuple[str, list[str], bytes]:
    """Status line, header lines and body of an HTTP response; without a head all is body."""
    stop = re.search(rb"\r?\n\r?\n", block)
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, body = (block[: stop.start()], block[stop.end() :]) if stop else (block, b"")
    lines = head.decode("iso-8859-1").splitlines()
    return lines[0], lines[1:], body


def page_of(headers: list[str], body: bytes) -> str:
    kind = next((h for h in headers if h.lower().startswith("content-type:")), "")
    m = re.search(r"charset=[\"']?([-\w]+)", kind)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive_one(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    headers, block = response["headers"] or [], response["block"] or b""
    source = response["record_id"] or ""
    status, http, body = http_parts(block)
    page = page_of(http, body)
    marks = {"source_block_digest": value_of(headers, "WARC-Block-Digest") or digest(block), "source_payload_digest": value_of(headers, "WARC-Payload-Digest") or digest(body)}
    conversion, metadata = name_of(source, "conversion"), name_of(source, "metadata")
    m = re.search(r"<html\b[^>]*\blang=[\"']?([-\w]+)", page, re.I)
    fields = [("source-record", source), ("source-status", status), *(("source-http-header", h) for h in http), ("source-block-digest", marks["source_block_digest"]), ("source-payload-digest", marks["source_payload_digest"])]
    fields += [("source-header", f"{h['name']}: {h['value']}") for h in headers]
    fields += [("conversion", conversion), ("title", title(page)), *([("language", m[1])] if m else []), *(("outlink", x) for x in links(page))]
    note = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    text = "\n".join(b.text for b in blocks(page)).encode("utf-8", "surrogatepass")
    common = {"refers_to": source, "target_uri": value_of(headers, "WARC-Target-URI") or "", "warc_date": value_of(headers, "WARC-Date") or "", **marks}
    made = [("metadata", metadata, "application/warc-fields", note), ("conversion", conversion, "text/plain; charset=utf-8", text)]
    return [common | {"record_id": name, "warc_type": kind, "content_type": content, "content_length": len(b), "block_digest": digest(b), "block": b} for kind, name, content, b in made]


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response of records (headers, block, record_id, warc_type); keep: columns to pass on."""
    fields = [records.schema[c] for c in keep]
    schema = T.StructType([*fields, *DERIVED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = [{c: r[c] for c in keep} | d for r in batch.slice(at, 200).to_pylist() for d in derive_one(r)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return records.where(F.col("warc_type") == "response").select(*keep, "record_id", "headers", "block").mapInArrow(run, schema)


def responses(pages: DataFrame, date: str, page: str = "html", url: str = "url", row_id: str = "page_id") -> DataFrame:
    """Pages as response records; the id stays as a column."""
    from .common import add_column

    kind = T.StructType([f for f in RECORD.fields if f.name != "cut_off"])

    def make(columns: dict) -> list[dict]:
        out = []
        for k, target, text in zip(columns[row_id], columns[url], columns[page], strict=True):
            body = (text or "").encode("utf-8", "surrogatepass")
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
            head = {"WARC-Type": "response", "WARC-Record-ID": name_of(k, target), "WARC-Target-URI": target or "", "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block)}
            out.append({"record_id": head["WARC-Record-ID"], "warc_type": "response", "headers": [{"name": a, "value": b} for a, b in head.items()], "block": block})
        return out

    made = add_column(pages.select(row_id, url, page), "w", kind, make, [row_id, url, page], (url, page))
    return made.select(row_id, "w.*")
