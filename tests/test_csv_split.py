"""Quoted CSV cut into small ranges against Spark's own reader of whole files."""

import random

import pytest

from rxloom.sources import csv_split, files
from rxloom.sources.csv_split import ends_inside, parsed, read_by_header


@pytest.fixture(autouse=True)
def ranges(spark, monkeypatch):
    """Files, but not the stored tables, are read in byte ranges of 150 bytes."""
    conf = "spark.sql.files.maxPartitionBytes"
    before, plain = spark.conf.get(conf), csv_split.read_csv_records

    def read(session, path):
        spark.conf.set(conf, "150")
        try:
            return plain(session, path)
        finally:
            spark.conf.set(conf, before)

    for module in (csv_split, files):
        monkeypatch.setattr(module, "read_csv_records", read)


def whole_files(spark, path, fields):
    schema = ", ".join(f"c{i} string" for i in range(fields))
    return spark.read.schema(schema).options(multiLine="true", quote='"', escape='"').csv(path)


def test_states():
    assert ends_inside('a,"b', 0) == 1 and ends_inside('a,"b""', 0) == 1 and ends_inside('a,"b"""', 0) == 0
    assert ends_inside('a"b,c', 0) == 0  # a quote inside a plain field opens nothing
    assert ends_inside('x","y', 1) == 1 and ends_inside("x", 1) == 1 and ends_inside('x",y', 1) == 0 and ends_inside("", 0) == 0


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_against_whole_files(spark, tmp_path, end):
    rng = random.Random(7)
    made = ["plain", "", "5 mg", '"one\ntwo"', '"a ""b"" c"', '","', '"x\n\n,y"', "đau", 'in"side', '"' + "long\n" * 40 + '"', '"\n"']
    made = [m.replace("\n", end) for m in made]  # Spark takes the first line break of a file for all, also one inside quotes
    for f in range(2):
        lines = [",".join(rng.choice(made) for _ in range(3)) for _ in range(60)]
        (tmp_path / f"{f}.csv").write_bytes((end.join(lines) + end).encode())
    want = sorted(map(tuple, whole_files(spark, str(tmp_path), 3).collect()), key=repr)
    records = csv_split.read_csv_records(spark, str(tmp_path))
    got = parsed(records, 3)
    assert sorted((tuple(r)[2:] for r in got.collect()), key=repr) == want
    assert records.select("file", "block").distinct().count() > 10  # many ranges gave records
    # Places follow the order of the files.
    first = [r for r in got.orderBy("pos").collect() if r["file"].endswith("0.csv")]
    assert [tuple(r)[2:] for r in first] == [tuple(r) for r in whole_files(spark, str(tmp_path / "0.csv"), 3).collect()]


def test_no_quotes_and_one_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h,k\n" + "".join(f"{i},v\n" for i in range(50)) + '"open,' + "x\n" * 60, encoding="utf-8")
    [(names, below)] = read_by_header(spark, str(tmp_path))
    rows = parsed(below, 2).orderBy("pos").collect()
    assert names == ["h", "k"] and [r.c0 for r in rows[:50]] == [str(i) for i in range(50)] and len(rows) == 51


def test_headers_and_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert files.read_catalogue(spark, str(tmp_path / "in")).columns == ["pos"]
    assert files.read_prescription_log(spark, str(tmp_path / "in")).count() == 0
    (tmp_path / "in" / "a.csv").write_text('"so\nso",ten_thuoc\n1,"x\ny"\n', encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text("﻿so_dang_ky,ten_thuoc\r\n2,z\r\n", encoding="utf-8")
    rows = files.read_catalogue(spark, str(tmp_path / "in")).collect()
    assert {(r.so_dang_ky, r.ten_thuoc) for r in rows} == {(None, "x\ny"), ("2", "z")}
