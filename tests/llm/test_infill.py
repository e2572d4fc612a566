import hashlib
import random
import re

import numpy as np
import pytest

from rxloom.llm import infill as f

SF = "/root/testdata/sf0.001"


def naive(doc_id, text, fim=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, z = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    return (n, "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}") if h4 % 100 < spm else (n, "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}")


def bodies(rng, count):
    kinds = [b"", b"\n", b"\n\n", b"a", b"a\r\nb\r\n"]
    for _ in range(count):
        yield rng.choice([*kinds, ("é日" * rng.randint(0, 900)).encode(), b"\n".join(b"x" * rng.choice([0, 3, 250, 250, 250, 3000]) for _ in range(rng.randint(0, 400)))])


@pytest.mark.parametrize("epsilon", [1, 50, 4096, 40_000])
def test_index_gives_every_boundary_exactly(epsilon):
    texts = list(bodies(random.Random(epsilon), 120))
    want, at = [], 0
    for body in texts:
        want.append(at)
        for line in re.findall(rb"[^\n]*\n|[^\n]+", body):
            at += len(line)
            want.append(at)
    offsets, lines = f.boundaries(texts)
    assert offsets.tolist() == want
    assert lines.tolist() == [len(re.findall(rb"[^\n]*\n|[^\n]+", x)) for x in texts]
    index = f.fit(offsets, epsilon)
    ranks = np.arange(len(want))
    assert np.array_equal(f.offsets_at(index, ranks), offsets)
    assert np.abs(offsets - f.predicted(index, ranks)).max() <= epsilon
    assert len(f.fit(np.arange(5000) * 80, epsilon).starts) == 1  # lines of one length are one line
    assert len(f.fit(np.zeros(0, np.int64)).starts) == 0


def test_transform_against_brute_force(spark):
    rows = [(None, "x\ny"), (1, None), (1, ""), (2, "no <P> here\n"), (3, "<\nS>\n<S\n>M>\n<"), (4, "\n\n\n"), (5, "é日😀\n" * 300), (5, "é日😀\n" * 300), (6, "a" * 200_000)]
    rows += [(10 + i, body.decode()) for i, body in enumerate(bodies(random.Random(5), 30))]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, key string, n int")
    for fim, spm in ((100, 50), (60, 0)):
        out = f.transform(df, "doc_id", "text", fim_percent=fim, spm_percent=spm)
        got = out.withColumn("back", f.restored(out.output, out.form)).collect()
        want = sorted(((k, *naive(k, t, fim, spm), t or "") for k, t in rows), key=repr)
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert f.transform(df.limit(0), "doc_id", "text").count() == 0


def test_query_against_brute_force(spark):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, form, a, b, output = naive(r["doc_id"], r["text"])
        want[r["doc_id"]] = (r["doc_id"], n, form, a, b, sha(output), sha(r["text"] or ""))
    got = f.op13_infill_lines(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want.values())
    assert {x[2] for x in want.values()} >= {"spm", "psm"}
