"""Quoted CSV files read by many tasks, line breaks inside quotes included.

Whether a line break ends a record depends on all text before it. A file's byte ranges are therefore marked under both
assumptions, starting outside and inside quotes. Most ranges lead to the same state either way after their first
quoted field. What each range does to the state is one row, a window over a file's ranges settles how each begins, and
only lines whose record is spread over rows are brought together.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxloom.session import materialise

BOM = "﻿"
BATCH_ROWS = 4096
MARKS_DDL = "file string, block long, row long, value string, in0 int, out0 int, in1 int, out1 int"
_TO_QUOTE = re.compile(r'[^"]*(?:""[^"]*)*')


def ends_inside(line: str, inside: int, sep: str = ",") -> int:
    """Whether a line ends inside quotes, given how it begins. A quote opens at the start of a field only."""
    at = 0
    while True:
        if inside:
            at = _TO_QUOTE.match(line, at).end()
            if at == len(line):
                return 1
            at = line.find(sep, at + 1)
            if at < 0:
                return 0
            at += 1
        inside = 1
        if line.startswith('"', at):
            at += 1
            continue
        at = line.find(sep + '"', at)
        if at < 0:
            return 0
        at += 2


def mark_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the states before and after them under both assumptions; whole records once both agree."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("value", pa.string())]
                       + [(c, pa.int32()) for c in ("in0", "out0", "in1", "out1")])
    out: list[tuple] = []
    held: list[str] = []  # lines of a record that began where both assumptions agree
    here = None
    state0, state1, row = 0, 1, 0

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()

    def release() -> None:
        """A record still open at the end of its range."""
        nonlocal row
        if held:
            out.append((*here, row, "\n".join(held), 0, 1, 0, 1))
            held.clear()
            row += 1

    for batch in batches:
        for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if (file, block) != here:
                release()
                here, state0, state1, row = (file, block), 0, 1, 0
            if '"' in line:
                next0 = ends_inside(line, state0)
                next1 = next0 if state0 == state1 else ends_inside(line, state1)
            else:
                next0, next1 = state0, state1
            if held:
                held.append(line)
                if not next0:
                    out.append((*here, row, "\n".join(held), 0, 0, 0, 0))
                    held.clear()
                    row += 1
            elif state0 == state1 == 0 and next0:
                held.append(line)
            else:
                out.append((*here, row, line, state0, next0, state1, next1))
                row += 1
            state0, state1 = next0, next1
            if len(out) >= BATCH_ROWS:
                yield from flush()
        yield from flush()
    release()
    yield from flush()


def range_starts(marks: DataFrame) -> DataFrame:
    """Ranges (file, block) that begin inside quotes.

    A range keeps the state, turns it over, or leads to one state from both; so the state before a range is the last
    forced one, turned over as often as ranges since then do.
    """
    ends = marks.groupBy("file", "block").agg(F.max_by(F.struct("out0", "out1"), "row").alias("e")).select("file", "block", "e.*")
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    forced = F.col("out0") == F.col("out1")
    turns = ends.withColumn("turned", F.sum(((F.col("out0") == 1) & (F.col("out1") == 0)).cast("int")).over(in_order))
    zero = lambda c: F.coalesce(c, F.lit(0))
    state = (zero(F.last(F.when(forced, F.col("out0")), True).over(before)) + zero(F.last("turned").over(before))
             - zero(F.last(F.when(forced, F.col("turned")), True).over(before)))
    return turns.withColumn("inside", state % 2).where("inside = 1").select("file", "block", "inside")


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a record put together in order, at the place of the first."""
    part = F.struct("block", "row", "value", "before", "after")
    parts = F.array_sort(F.collect_list(part))
    return rows.groupBy("file", *keys).agg(parts.alias("p")).select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["row"].alias("row"), F.array_join(F.col("p.value"), "\n").alias("value"),
        F.col("p")[0]["before"].alias("before"), F.element_at("p", -1)["after"].alias("after"))


def read_csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of all CSV files: file, block and row (their place), value (the record's text).

    Quotes are `"`, doubled inside a field; a record ends at \\n or \\r\\n outside quotes, and \\r\\n inside becomes \\n. Empty lines between records are no
    records. A quote that never closes makes one record of the rest of its file. The marked lines are stored, as a second
    read of the files could be cut into other ranges.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    marks = materialise(lines.mapInArrow(mark_lines, MARKS_DDL), "csv-marks")
    state = lambda c: F.when(F.col("inside") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    rows = marks.join(range_starts(marks), ["file", "block"], "left").select(
        "file", "block", "row", "value", state("in").alias("before"), state("out").alias("after"))
    whole = (F.col("before") == 0) & (F.col("after") == 0)
    # First inside each range, then the one or two rows a range has left over a file's ranges.
    starts = F.sum((F.col("before") == 0).cast("int"))
    near = rows.where(~whole).withColumn("g", starts.over(Window.partitionBy("file", "block").orderBy("row")))
    near = _joined(near, "block", "g")
    far = near.where(~whole).withColumn("g", starts.over(Window.partitionBy("file").orderBy("block", "row")))
    records = rows.where(whole).unionByName(near.where(whole)).unionByName(_joined(far, "g"))
    return records.select("file", "block", "row", F.regexp_replace("value", r"\r(?=\n|\z)", "").alias("value")).where("value != ''")


def place(file: str = "file") -> Column:
    """Order of records within and across files, as text."""
    return F.concat_ws("#", F.col(file), F.lpad(F.col("block").cast("string"), 20, "0"), F.lpad(F.col("row").cast("string"), 12, "0"))


def parsed(records: DataFrame, fields: int, corrupt: bool = False) -> DataFrame:
    """Records as string columns c0, c1, ... after `file` and `pos`; with `corrupt`, `_raw` is the text of a record of another length."""
    schema = ", ".join([f"c{i} string" for i in range(fields)] + ["_raw string"] * corrupt)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    if corrupt:
        options["columnNameOfCorruptRecord"] = "_raw"
    return records.select("file", place().alias("pos"), F.from_csv("value", schema, options).alias("_row")).select("file", "pos", "_row.*")


def read_by_header(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], DataFrame]]:
    """The column names of each form of header among the files, with the records below it (file, block, row, value).

    The driver gets the distinct headers, not the files.
    """
    records = read_csv_records(spark, path)
    first = records.where("block = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"), F.min("row").alias("top"))
    heads = materialise(first, "csv-headers")
    below = records.join(heads, "file").where("block > 0 OR row > top")
    forms = sorted(r["header"] for r in heads.select("header").distinct().collect())
    return [([c.lstrip(BOM) for c in next(csv.reader([h]))], below.where(F.col("header") == h).drop("header", "top")) for h in forms]
