"""Chunked archive: files come back byte for byte."""

from pyspark.sql import functions as F

from rxloom.sources import archive


def test_files_come_back(spark, tmp_path):
    made = {
        "a": "đau\r\n\n".encode() * 400 + b"no end", "b": b"\xef\xbb\xbfx,y\n" + b"1,2\n" * 50, "c": b"\xef\xbb\xbfx", "d": b"", "e": b"\n", "f": b"l" * 3000 + b"\nz",
    }
    (tmp_path / "in").mkdir()
    for name, content in made.items():
        (tmp_path / "in" / name).write_bytes(content)
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "700")  # a file is read in several ranges
    try:
        rows = archive.read_chunks(spark, str(tmp_path / "in"), F.lit("b1"), "test", F.current_timestamp(), size=200)
    finally:
        spark.conf.set(conf, before)
    rows.write.parquet(str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    got = {}
    for r in stored.orderBy("file", "offset").collect():
        assert len(got.get(r.file[-1], b"")) == r.offset
        got[r.file[-1]] = got.get(r.file[-1], b"") + bytes(r.content)
    assert got == {name: content for name, content in made.items() if content}
    assert max(len(r.content) for r in stored.where("file NOT LIKE '%/f'").collect()) <= 203 and stored.count() > 20
    assert archive.damaged_files(stored).count() == 0
    lines = [r.line for r in archive.archived_lines(stored.where("file LIKE '%/a'")).orderBy("offset", "pos").collect()]
    assert lines == made["a"].decode().split("\n")
    # A lost chunk and a changed one.
    lost = stored.where("NOT (file LIKE '%/f' AND offset = 0)")
    changed = stored.withColumn("content", F.when(F.col("file").endswith("/e"), F.lit(b"?")).otherwise(F.col("content")))
    assert [r.file[-1] for r in archive.damaged_files(lost).collect()] == ["f"]
    assert [r.file[-1] for r in archive.damaged_files(changed).collect()] == ["e"]
