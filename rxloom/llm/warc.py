"""WARC archives written and read as chunk tables.

A record is a run of rows (record, chunk number). A payload longer than a chunk becomes the segments of the
WARC standard: a first record, then `continuation` records, each with its own header, so neither writing nor
reading ever holds more of a payload than a chunk beyond the table's own cell. Digests go along: every chunk row carries
the SHA-1 of the payload up to its end, and the last one's is the record's. Archives are text files
of Spark's own writer, whose line separator ends the last line of a record; compressed files are read by
one task each, in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import query, table
from rxloom.session import new_path

CHUNK_BYTES = 1 << 18
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\n"
#: The record id of a row without a key; no escaped key reads so.
NO_KEY = "\\0"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def escaped(value: str | None) -> str:
    """A header value on one line: backslash, CR and LF are escaped; null is empty."""
    return (value or "").replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def unescaped(value: str) -> str:
    out, parts = [], iter(value.split("\\\\"))
    for part in parts:
        out.append(part.replace("\\r", "\r").replace("\\n", "\n"))
    return "\\".join(out)


def plan_records(df: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """All rows of `df` with `digest` (SHA-1), `size` and `refers`: the smallest key with an equal payload, null for responses.

    The pairs (digest, size) are reduced to one row each before they are joined back, so a payload that a third of
    the rows share is joined to one row; AQE splits its side. Null payloads are empty; payloads under `min_bytes`
    are all responses; of rows that repeat the smallest key each is a response.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    keyed = df.withColumn("digest", F.unhex(F.sha1(body))).withColumn("size", F.octet_length(body).cast("long"))
    first = keyed.groupBy("digest", "size").agg(F.min(key).alias("first"))
    refers = F.when((F.col("size") >= min_bytes) & ~F.col("first").eqNullSafe(F.col(key)), F.col("first"))
    return keyed.join(first, ["digest", "size"]).withColumn("refers", refers).drop("first")


def chunk_rows(planned: DataFrame, key: str, uri: str, payload: str, chunk_bytes: int = CHUNK_BYTES,
               date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record, chunk, data): every record as its segments in order, each with the header that makes it a WARC record."""
    rows = planned.select(F.col(key).cast("string"), F.col(uri).cast("string"), F.col(payload).cast("binary"), "digest", "size",
                          F.col("refers").cast("string"))

    def head(kind: str, ident: str, fields: list[tuple[str, object]], length: int) -> bytes:
        lines = [f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:record:{ident}>", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {length}"]
        return b"\r\n".join([VERSION, *[x.encode() for x in lines]]) + b"\r\n\r\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str | None, int, bytes]] = []
            held = 0
            bodies = b.column(2)
            for i, (name, url, digest, size, refers) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True)):
                ident = NO_KEY if name is None else escaped(name)
                about = [("WARC-Target-URI", escaped(url)), ("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("X-Payload-Length", size)]
                if refers is not None:
                    fields = [*about, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:record:{escaped(refers)}>")]
                    out.append((name, 0, head("revisit", ident, fields, 0)))
                    continue
                body = memoryview(bodies[i].as_buffer() if bodies[i].is_valid else b"")
                sent = hashlib.sha1()
                for chunk, at in enumerate(range(0, max(len(body), 1), chunk_bytes)):
                    data = bytes(body[at:at + chunk_bytes])
                    sent.update(data)
                    fields = [("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(data).digest())}"), ("X-Running-Digest", f"sha1:{base32(sent.digest())}")]
                    if size > chunk_bytes:
                        fields += [("WARC-Segment-Number", chunk + 1)] + [("WARC-Segment-Origin-ID", f"<urn:record:{ident}>")] * (chunk > 0)
                        fields += [("WARC-Segment-Total-Length", size)] * (at + chunk_bytes >= size)
                    kind = "continuation" if chunk else "response"
                    out.append((name, chunk, head(kind, f"{ident};{chunk}" if chunk else ident, fields if chunk else about + fields, len(data)) + data))
                    held += len(data)
                    if held >= 16 * chunk_bytes:
                        yield batch(out)
                        out, held = [], 0
            if out:
                yield batch(out)

    def batch(rows_: list[tuple[str | None, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.string()), pa.array([r[1] for r in rows_], pa.int64()),
                                           pa.array([r[2] for r in rows_], pa.binary())], ["record", "chunk", "data"])

    return rows.mapInArrow(run, "record string, chunk long, data binary")


def write_archives(chunks: DataFrame, path: str, compression: str = "gzip") -> None:
    """One archive per task, its chunk rows in their order."""
    # A record ends with two line ends; the second one's LF is the writer's separator.
    value: Column = F.concat(F.col("data"), F.lit(b"\r\n\r")).cast("string")
    chunks.select(value.alias("value")).write.option("lineSep", LINE).option("compression", compression).text(path)


class Reader:
    """Takes an archive's lines one by one and gives its records chunk by chunk."""

    def __init__(self, keep_data: bool):
        self.keep_data = keep_data
        self.fields: dict[str, str] | None = None  # of the record being read
        self.left = -1  # payload bytes still to come; -1 while in a header or between records
        self.blank = 0  # lines that close the record
        self.total = hashlib.sha1()
        self.size = 0
        self.data: list[bytes] = []
        self.out: list[tuple] = []

    def line(self, line: bytes) -> None:
        """One line without its LF."""
        if self.left >= 0:
            body = line[:self.left]
            self._take(body)
            if self.left > 0:  # the LF was part of the payload
                self._take(b"\n")
                if self.left == 0:
                    self._close()
                return
            self._close()
            rest = line[len(body):]
            if rest != b"\r":
                raise ValueError("a record is longer than its Content-Length")
            self.blank = 1
        elif self.blank:
            if line != b"\r":
                raise ValueError("a record does not end with two line ends")
            self.blank -= 1
        elif self.fields is None:
            if line != VERSION + b"\r":
                raise ValueError("no WARC record starts here")
            self.fields = {}
        elif line == b"\r":
            self.left = int(self.fields["Content-Length"])
        else:
            name, _, value = line.rstrip(b"\r").decode("utf-8").partition(": ")
            self.fields[name] = value

    def _take(self, piece: bytes) -> None:
        if self.fields.get("WARC-Type") != "continuation" and not self.data and "_begun" not in self.fields:
            self.total, self.size = hashlib.sha1(), 0
        self.fields["_begun"] = ""
        self.total.update(piece)
        self.size += len(piece)
        self.left -= len(piece)
        if self.keep_data:
            self.data.append(piece)

    def _close(self) -> None:
        f = self.fields
        self.out.append((f, self.size, base32(self.total.digest()), b"".join(self.data) if self.keep_data else None))
        self.fields, self.left, self.data, self.blank = None, -1, [], 2


def identifier(field: str | None) -> str | None:
    if field is None:
        return None
    name = field.removeprefix("<urn:record:").removesuffix(">")
    return None if name == NO_KEY else unescaped(name)


def read_archives(spark: SparkSession, path: str, keep_data: bool = True) -> DataFrame:
    """Chunk rows of all archives under `path`.

    record, chunk, record_type, uri, refers_to, length so far, digest so far, whether it is the last, and the data
    if asked for. For revisits length and digest are those the header states for the full payload.
    """
    lines = spark.read.option("lineSep", LINE).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))
    names = ["record", "chunk", "record_type", "uri", "refers_to", "length", "digest", "last", "data"]
    kinds = [T.StringType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), T.StringType(), T.BooleanType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    arrow = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file = Reader(keep_data), None
        for b in batches:
            values = b.column(1)
            runs = pc_runs(b.column(0))
            for start, stop, name in runs:
                if name != file:
                    reader, file = Reader(keep_data), name
                for value in values.slice(start, stop - start).to_pylist():
                    reader.line(value)
                    if len(reader.out) >= 2000 or (keep_data and reader.out):
                        yield rows(reader)
                if reader.out:
                    yield rows(reader)

    def rows(reader: Reader) -> pa.RecordBatch:
        out = []
        for f, size, digest, data in reader.out:
            kind = f["WARC-Type"]
            number = int(f.get("WARC-Segment-Number", "1")) - 1
            last = "WARC-Segment-Number" not in f or "WARC-Segment-Total-Length" in f
            if kind == "revisit":
                size, digest = int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")
            elif f["X-Running-Digest"] != f"sha1:{digest}":
                raise ValueError(f"digest mismatch in {f['WARC-Record-ID']}")
            origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
            out.append((identifier(origin), number, "response" if kind == "continuation" else kind, f.get("WARC-Target-URI") and unescaped(f["WARC-Target-URI"]),
                        identifier(f.get("WARC-Refers-To")), size, digest, last, data))
        reader.out = []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], a) for i, a in enumerate(arrow)], names)

    return lines.mapInArrow(run, schema)


def pc_runs(column: pa.Array) -> list[tuple[int, int, str]]:
    """(start, stop, value) of each run of equal values."""
    if not len(column):
        return []
    coded = column.dictionary_encode()
    codes = np.asarray(coded.indices)
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    return [(a, b, column[a].as_py()) for a, b in zip(cuts, cuts[1:], strict=False)]


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: its last chunk's length and digest are those of the full payload."""
    return chunks.where("last").select("record", "record_type", "uri", "refers_to", "length", "digest")


@query("op4_warc_chunks", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY hex, html) AS first,
             array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', substr(hex, i::INT, 1)) - 1), 4)), '') AS bits FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0b' || substr(bits, (i * 5 + 1)::INT, 5))::INT + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b""")
def op4_warc_chunks(spark, sf_dir):
    path = new_path(spark, "warc")
    planned = plan_records(table(spark, sf_dir, "pages"), "page_id", "html")
    write_archives(chunk_rows(planned, "page_id", "url", "html"), path)
    return records(read_archives(spark, path, keep_data=False)).select(
        F.col("record").cast("long").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"))
