import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import test_simhash

import corpus_pipeline as c
from rxloom.llm import near_text as n

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    ws = test_simhash.re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def similar_texts():
    """Texts around a common passage with copies on both sides of 0.8, and chains of copies."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=40)
    out = ["", " \n", "one two", "ONE  two", "one two three"]
    for i in range(60):
        base = (passage if i % 3 == 0 else []) + rng.choices(words, k=rng.choice([6, 30, 120]))
        out.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy[:rng.choice([len(copy), len(copy) - 3])]))
    return out


@pytest.mark.parametrize(("chunk", "radius", "few"), [(4096, n.RADIUS, 32), (8, n.RADIUS, 2), (4096, -1, 32)])
def test_groups_against_brute_force(spark, monkeypatch, chunk, radius, few):
    monkeypatch.setattr(n, "CHUNK", chunk)  # 8: buckets are cut into pairs of chunks
    monkeypatch.setattr(n, "FEW", few)
    texts = similar_texts()
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    roots = test_simhash.roots(len(texts), pairs)
    assert sum(3 < (n.majority(n.shingles(texts[i].encode())) ^ n.majority(n.shingles(texts[j].encode()))).bit_count() for i, j in pairs) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["key"] for r in n.group_firsts(df, "doc_id", "text", radius).collect()) == sorted(set(roots))
    assert n.group_firsts(df.limit(0), "doc_id", "text").count() == 0


def test_the_stage_takes_near_copies_beyond_op3s_radius_and_leaves_other_texts(spark):
    rng = random.Random(1)
    base = [f"a{i}" for i in range(104)]
    near, far = list(base), list(base)
    near[30], near[60] = "a", "b"  # 90 of 110 shingles
    for at in (30, 45, 60, 75):
        far[at] = f"c{rng.random()}"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert (test_simhash.naive_fingerprint(rows[0][1]) ^ test_simhash.naive_fingerprint(rows[1][1])).bit_count() > 3
    assert jaccard(*map(shingle_set, (rows[0][1], rows[1][1]))) >= 0.8 > jaccard(*map(shingle_set, (rows[0][1], rows[2][1])))
    assert sorted(r["doc_id"] for r in c.near_duplicate_stage(spark, docs, "").collect()) == [1, 3]


def test_rows_without_an_id_or_with_one_id_are_decided_by_their_own_text(spark):
    rng = random.Random(2)
    clean = [" ".join(f"y{k}_{rng.random()}" for _ in range(60)) for k in range(4)]
    near = [t + " end" for t in clean]
    docs = spark.createDataFrame([(None, clean[0]), (None, clean[1]), (None, near[0]), (7, clean[2]), (7, clean[3]), (7, near[2]), (7, clean[3])], "doc_id long, text string")
    kept = sorted(r["text"] for r in c.near_duplicate_stage(spark, docs, SF).collect())
    assert len(kept) == 4 and [sum(t in (a, b) for t in kept) for a, b in zip(clean, near, strict=True)] == [1] * 4
    leak = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"].split()) > 12)
    docs = spark.createDataFrame([(None, clean[0]), (None, leak), (7, clean[1]), (7, f"{clean[2]} {leak}"), (8, None)], "doc_id long, text string")
    out = c.decontamination_stage(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(0, clean[0]), (7, clean[1]), (8, "")])
    assert out.columns == docs.columns


def test_sketches_lose_no_pair():
    rng = random.Random(9)
    for size in (1, 3, 20, 200, 3000):
        base = np.array(sorted({rng.getrandbits(64) for _ in range(size)}), np.uint64)
        for share in (0.0, 0.05, 0.11, 0.3):
            other = np.unique(np.where(np.array([rng.random() < share for _ in base]), np.array([rng.getrandbits(64) for _ in base], np.uint64), base))
            other = other[:max(1, len(other) - rng.randint(0, 1 + size // 9))]
            pair = sorted((base, other), key=len)
            rows = pa.table({"side": [0, 0], "node": [1, 2], "size": [len(x) for x in pair], "sketch": [n.parity(x).tobytes() for x in pair]})
            similar = len(np.intersect1d(*pair)) / len(np.union1d(*pair))
            found = len(n.Cell(rows).possible(1, np.arange(2)))
            assert found or similar < 0.8
            assert not found or similar > 0.6


def test_a_template_of_many_texts_just_below_the_limit_gives_few_links(spark):
    common = [f"w{i}" for i in range(88)]
    texts = [" ".join([*common, *(f"t{k}_{i}" for i in range(12))]) for k in range(600)] + [" ".join([*common, *(f"t0_{i}" for i in range(11))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 0.75 < jaccard(shingle_set(texts[0]), shingle_set(texts[1])) < 0.8
    assert sorted(r["key"] for r in n.group_firsts(df, "doc_id", "text").collect()) == list(range(600))  # the last one is a copy of the first
    rows = df.select(n.F.col("doc_id").alias("key"), n.F.xxhash64("text").alias("th"), "text")
    nodes = n.read_texts(rows, df.schema[0].dataType, n.frequent_shingles(rows))
    members = n.members_of(n.shared_postings(nodes, n.frequent_shingles(rows))).join(nodes.select("node", "size", "fp", "sketch"), "node")
    assert members.groupBy("h").count().count() <= 60
    per_cell = n.by_cell(n.cells_of(members), lambda t: n.candidates(t, n.RADIUS), "a long, b long")
    assert per_cell.count() <= members.count()
