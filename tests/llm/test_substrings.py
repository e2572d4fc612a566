import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxloom.llm import substrings as s


def naive(rows, length):
    seen = {}
    for _, body in rows:
        for p in range(len(body) - length + 1):
            seen[body[p:p + length]] = seen.get(body[p:p + length], 0) + 1
    out = []
    for key, body in rows:
        mark = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if seen[body[p:p + length]] > 1:
                mark[p:p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(body, mark, strict=True) if not m)
        spans = sum(1 for j in range(len(body)) if mark[j] and (j == 0 or not mark[j - 1]))
        out.append((key, len(body), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, length, gram):
    cut = s.remove_repeats(df, "doc_id", "text", length, gram)
    return sorted(map(tuple, cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize(("length", "gram", "letters", "segment"), [
    (20, 6, "ab", 1 << 20), (20, 6, "abcé", 1 << 20), (40, 12, "abcdefgh", 97), (24, 3, "ab\0", 50)])
def test_against_brute_force(spark, monkeypatch, length, gram, letters, segment):
    monkeypatch.setattr(s, "SEGMENT", segment)
    monkeypatch.setattr(s, "HELD_ANCHORS", 100)
    monkeypatch.setattr(s, "CONTEXTS", 50)
    monkeypatch.setattr(s, "CHUNK", 4 if segment < 1 << 20 else 4096)
    rng = random.Random(length + len(letters))
    pool = ["".join(rng.choices(letters, k=rng.randint(10, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(rng.randint(0, 8))))
            for i in range(60)]
    rows += [(100, "a" * 200), (101, None), (102, ""), (103, rows[3][1]), (103, rows[3][1]), (None, rows[4][1] + "x"), (104, "ab" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, length, gram) == naive([(k, (t or "").encode()) for k, t in rows], length)


def test_production_length_on_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    assert run(df.select("doc_id", "text"), s.LENGTH, s.GRAM) == naive(rows, s.LENGTH)


def test_interval_expansion_alone():
    rng = random.Random(1)
    length, gram = 12, 4
    for _ in range(60):
        n = rng.randint(2, 12)
        group = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        core = {g: bytes(rng.choices(b"ab", k=gram)) for g in range(3)}
        left = [bytes(rng.choices(b"ab", k=rng.randint(0, length - gram))) for _ in range(n)]
        right = [core[g] + bytes(rng.choices(b"ab", k=rng.randint(0, length - gram))) for g in group]
        near, far = s.expand(group, left, right, length, gram)
        for i in range(n):
            hits = []
            for step in range(length - gram + 1):
                def window(k, step=step):
                    body = left[k] + right[k]
                    at = len(left[k]) - step
                    return body[at:at + length] if at >= 0 and at + length <= len(body) else None
                if window(i) is not None and any(k != i and group[k] == group[i] and window(k) == window(i) for k in range(n)):
                    hits.append(step)
            assert (near[i], far[i]) == ((hits[0], hits[-1]) if hits else (-1, -1))


def test_text_form_other_columns_and_empty_table(spark):
    shared = "x" * 150 + "é" * 50
    rows = [(1, shared[:-1] + "1st", 7), (2, "a" + shared[:-1] + "2nd", 8), (3, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long")
    out = {r["doc_id"]: r for r in s.remove_repeats(df, "doc_id", "text", 200, as_text=True).collect()}
    assert (out[1]["kept"], out[2]["kept"], out[3]["kept"]) == ("1st", "a2nd", "") and out[1]["key"] == 7
    assert s.remove_repeats(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError, match="kept"):
        s.remove_repeats(df.withColumnRenamed("key", "KEPT"), "doc_id", "text")
