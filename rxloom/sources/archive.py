"""Raw files kept as rows of bounded size and given back byte for byte."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxloom.session import materialise

CHUNK_BYTES = 1 << 20
BOM = b"\xef\xbb\xbf"  # left out by the reader
CHUNK_DDL = "file string, file_bytes long, block long, chunk int, content binary, inner long, n_bytes long"


def chunk_lines(size: int):
    """A function for mapInArrow: lines of each byte range -> chunks of whole lines, of at most `size` bytes or one line."""
    schema = pa.schema([("file", pa.string()), ("file_bytes", pa.int64()), ("block", pa.int64()), ("chunk", pa.int32()),
                        ("content", pa.binary()), ("inner", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        lines: list[bytes] = []
        held = chunk = inner = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, chunk, inner
            if lines:
                row = (*here, chunk, b"".join(lines), inner, held)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
                lines.clear()
                held, chunk, inner = 0, chunk + 1, inner + held

        for b in batches:
            for file, file_bytes, block, line in zip(*(b.column(c).to_pylist() for c in ("file", "file_bytes", "block", "value")), strict=True):
                if (file, file_bytes, block) != here:
                    yield from close()
                    here, chunk, inner = (file, file_bytes, block), 0, 0
                elif held + len(line) >= size:
                    yield from close()
                lines += (line, b"\n")
                held += len(line) + 1
        yield from close()

    return run


def read_chunks(spark: SparkSession, path: str, batch_id: Column, source: str, now: Column, size: int = CHUNK_BYTES) -> DataFrame:
    """The bytes of all files under `path` as rows (batch_id, file, file_bytes, offset, content, digest, source_ip, created_at).

    A large file is read by many tasks. `offset` is the place of a chunk's bytes in its file, `digest` their SHA-256. A chunk
    holds whole lines; a line longer than `size` is one chunk. An empty file, which Spark doesn't
    read, leaves none.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    chunks = materialise(lines.mapInArrow(chunk_lines(size), CHUNK_DDL), "raw-chunks")
    # A line break too many was added if the file does not end in one; a byte-order mark is missing from the first chunk.
    # Places are settled per byte range and stored, so that the join's choice goes by their true size.
    file, order = Window.partitionBy("file"), Window.partitionBy("file").orderBy("block")
    ranges = chunks.groupBy("file", "block").agg(F.sum("n_bytes").alias("n"), F.max("chunk").alias("top"), F.max("file_bytes").alias("size"))
    places = materialise(ranges.withColumn("off", F.col("size") - F.sum("n").over(file)).select(
        "file", "block", "top", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        (F.col("off") >= 2).alias("marked"), F.col("off").isin(-1, 2).alias("added"),
        (F.col("block") == F.min("block").over(file)).alias("first"), (F.col("block") == F.max("block").over(file)).alias("last")), "chunk-places")
    head = F.col("first") & (F.col("chunk") == 0)
    content = F.when(F.col("added") & F.col("last") & (F.col("chunk") == F.col("top")), F.expr("substring(content, 1, octet_length(content) - 1)"))
    content = F.coalesce(content, F.col("content"))
    content = F.when(F.col("marked") & head, F.concat(F.lit(BOM), content)).otherwise(content)
    offset = F.col("start") + F.col("inner") + F.when(F.col("marked") & ~head, len(BOM)).otherwise(0)
    whole = chunks.join(places, ["file", "block"]).select("file", "file_bytes", offset.alias("offset"), content.alias("content"))
    return whole.select(
        batch_id.alias("batch_id"), "file", "file_bytes", "offset", "content", F.sha2("content", 256).alias("digest"),
        F.lit(source).alias("source_ip"), now.alias("created_at"))


def damaged_files(archive: DataFrame) -> DataFrame:
    """Archived files (batch_id, file) whose chunks have another digest than stored, overlap, or leave bytes out."""
    end = F.col("offset") + F.octet_length("content")
    before = Window.partitionBy("batch_id", "file").orderBy("offset", "end")
    facts = archive.select("batch_id", "file", "file_bytes", "offset", end.alias("end"), (F.sha2("content", 256) == F.col("digest")).alias("right"))
    checked = facts.withColumn("joins", F.col("offset") == F.coalesce(F.lag("end").over(before), F.lit(0)))
    bad = ~F.min(F.col("right") & F.col("joins")) | (F.max("end") != F.max("file_bytes"))
    return checked.groupBy("batch_id", "file").agg(bad.alias("bad")).where("bad").drop("bad")


def archived_lines(archive: DataFrame) -> DataFrame:
    """The lines of archived files: file, offset of the chunk, line. No chunk cuts a line."""
    body = F.regexp_replace(F.col("content").cast("string"), "\n\\z", "")
    return archive.select("batch_id", "file", "offset", F.posexplode(F.split(body, "\n")).alias("pos", "line"))
