import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import test_decontaminate
import test_near_text
import test_simhash

import corpus_pipeline as c
from rxloom.llm import packing

SF = "/root/testdata/sf0.001"


def removed(texts, length=200):
    seen = {}
    for body in texts:
        for p in range(len(body) - length + 1):
            seen[body[p:p + length]] = seen.get(body[p:p + length], 0) + 1
    out = []
    for body in texts:
        mark = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if seen[body[p:p + length]] > 1:
                mark[p:p + length] = b"\1" * length
        out.append(bytes(x for x, m in zip(body, mark, strict=True) if not m).decode("utf-8", "ignore"))
    return out


def test_stages_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(k, t) for k, t in docs if t and any(x.isalpha() for x in t)]
    sets = [test_near_text.shingle_set(t) for _, t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if test_near_text.jaccard(sets[i], sets[j]) >= 0.8]
    docs = [d for i, (d, r) in enumerate(zip(docs, test_simhash.roots(len(docs), near), strict=True)) if r == i]
    docs = list(zip([k for k, _ in docs], removed([t.encode() for _, t in docs]), strict=True))
    grams = {tuple(w[i:i + 10]) for w in (test_decontaminate.ws(t) for _, t in items) for i in range(max(1, len(w) - 9))}
    assert all(len(g) == 10 for g in grams)
    want = {}
    for k, t in docs:
        w = test_decontaminate.ws(t)
        if not any(tuple(w[i:i + 10]) in grams for i in range(len(w) - 9)):
            want[k] = packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.json")).encode(t) + b"\1\0\0\0"
    got = {}
    for r in c.run(spark, SF).orderBy("doc_id", "start").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    assert got == want


def test_stages_keep_the_columns_of_documents_and_take_odd_rows(spark):
    good = [" ".join(f"{a}{i}" for i in range(60)) for a in ("alpha", "beta", "gamma")]
    rows = [(1, good[0], "en", "s", 9, 1), (2, good[0], "en", "s", 9, 2), (2, good[0], "en", "s", 9, 3), (3, None, None, None, None, 4), (4, "", "en", "s", 0, 5),
            (5, "12 34", "en", "s", 5, 6), (None, good[1], "en", None, 9, 7), (6, good[2], "fr", "s", 9, 8), (6, good[2], "fr", "s", 9, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = c.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 5, 6]
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert {r["doc_id"] for r in c.language_stage(spark, docs, SF).collect()} <= {1, 2, None, 6}
    assert c.packing_stage(spark, docs, SF).count() >= 1
