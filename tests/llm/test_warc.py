import base64
import hashlib
import random

from pyspark.sql import functions as F

from rxloom.llm import warc


def round_trip(spark, path, rows, chunk_bytes):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(warc.chunk_rows(warc.plan_records(df, "page_id", "html"), "page_id", "url", "html", chunk_bytes), path)
    return warc.read_archives(spark, path)


def test_payloads_survive_whatever_they_hold(spark, tmp_path):
    random.seed(7)
    pieces = ["\r", "\n", "\r\n\r\n", "WARC/1.1\r\n", "é", "x", "\0", "😀" * 5]
    rows = [(i, f"http://a/{i}", "".join(random.choices(pieces, k=random.randint(0, 40)))) for i in range(150)]
    rows += [(200, None, None), (201, "u\r\nv\\n", ""), (None, "n", "only here"), (203, "", rows[0][2]), (204, "c", rows[0][2])]
    chunks = round_trip(spark, str(tmp_path / "w"), rows, 7)
    got = {}
    for r in chunks.collect():
        got.setdefault(r["record"], {})[r["chunk"]] = r
    assert len(got) == len(rows)
    first = {}
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", key)
    for key, url, html in rows:
        body = (html or "").encode()
        chunk = got[None if key is None else str(key)]
        last = chunk[max(chunk)]
        assert last["last"] and last["length"] == len(body)
        assert last["digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert chunk[0]["uri"] == (url or "")or chunk[0]["uri"] == url
        if first[html or ""] == key:
            assert chunk[0]["record_type"] == "response" and chunk[0]["refers_to"] is None
            assert b"".join(chunk[i]["data"] for i in range(len(chunk))) == body
            assert all(len(c["data"]) <= 7 for c in chunk.values())
        else:
            assert chunk[0]["record_type"] == "revisit" and chunk[0]["refers_to"] == str(first[html or ""])


def test_running_digests_follow_the_chunks(spark, tmp_path):
    chunks = round_trip(spark, str(tmp_path / "w"), [(1, "u", "abcdefghij")], 4).orderBy("chunk").collect()
    assert [c["data"] for c in chunks] == [b"abcd", b"efgh", b"ij"]
    for c, upto in zip(chunks, (b"abcd", b"abcdefgh", b"abcdefghij"), strict=True):
        assert c["digest"] == base64.b32encode(hashlib.sha1(upto).digest()).decode() and c["length"] == len(upto)


def test_small_payloads_stay_responses_and_extra_columns_pass(spark):
    rows = [(1, "u", "a", 5), (2, "u", "a", 6), (3, "u", "aaaa", 7), (4, "u", "aaaa", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first_ long")
    planned = warc.plan_records(df, "page_id", "html", min_bytes=2)
    assert {r["page_id"]: r["refers"] for r in planned.collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, str(tmp_path / "w"), [], 7).where(F.lit(True)).count() == 0
