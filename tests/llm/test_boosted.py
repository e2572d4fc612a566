import zlib

import numpy as np

from rxloom.llm import boosted as b

SF = "/root/testdata/sf0.01"


def naive_walk(forest, row):
    """The sum over trees of the leaf a row comes to, node by node."""
    total = forest.base
    for at in forest.roots.tolist():
        while forest.left[at] != at:
            at = int(forest.left[at] if row[forest.feature[at]] <= forest.limit[at] else forest.right[at])
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def test_traversal_and_splits_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    x[:, 3] = rng.integers(0, 3, 400)  # ties
    x[:, 4] = 1.0  # a constant
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 1)).astype(int)
    forest = b.fit(x, y, trees=12, depth=3, bins=16)
    assert np.allclose(b.walk(forest, x), [naive_walk(forest, r) for r in x])
    assert ((b.walk(forest, x) >= 0.5) == y).mean() > 0.95
    order = rng.permutation(400)
    again = b.fit(x[order], y[order], trees=12, depth=3, bins=16)
    assert all(np.array_equal(p, q) for p, q in zip(forest[:6], again[:6], strict=True))
    codes = rng.integers(0, 6, (60, 3))
    node, g, h = rng.integers(0, 2, 60), rng.normal(size=60), rng.uniform(0.1, 0.3, 60)
    f, cut, gain = b.best_splits(codes, node, 2, g, h, 6, 1.0, 0.5)
    for k in range(2):
        def value(rows, k=k):
            return g[rows].sum() ** 2 / (h[rows].sum() + 1.0)

        best = 0.0
        for c in range(3):
            for t in range(5):
                left, right = (node == k) & (codes[:, c] <= t), (node == k) & (codes[:, c] > t)
                if min(h[left].sum(), h[right].sum()) >= 0.5:
                    best = max(best, value(left) + value(right) - value(node == k))
        assert np.isclose(gain[k], best)
        left, right = (node == k) & (codes[:, f[k]] <= cut[k]), (node == k) & (codes[:, f[k]] > cut[k])
        assert best == 0 or np.isclose(value(left) + value(right) - value(node == k), best)


def test_statistics_take_any_text():
    for body in (b"", b" \n\t ", b"\n", b"a", "é日😀".encode(), b"| | |", b"x" * 100_000, b"A!! B!!\n" * 50, b"\xff\xfe"):
        found = b.statistics(body)
        assert len(found) == len(b.STATISTICS) and np.isfinite(found).all()


def test_query_against_brute_force_and_held_out_labels(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 3 for k in docs}
    taught = [k for k in labels if fold[k] != 1]
    stats = {k: np.array(b.statistics(t.encode()), np.float32) for k, t in docs.items()}
    forest = b.fit(np.array([stats[k] for k in taught]), np.array([labels[k] for k in taught]))
    got = {r["doc_id"]: r for r in b.op12_boosted_quality(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        assert r["held_out"] == (fold[k] == 1) and np.isclose(r["score"], naive_walk(forest, stats[k])) and r["predicted"] == (r["score"] >= 0.5)
    held = [k for k in labels if fold[k] == 1]
    assert np.mean([got[k]["predicted"] == labels[k] for k in held]) >= 0.97


def test_odd_rows_and_labels(spark):
    good, bad = "A line of plain words, and more of them.\n" * 4, "WORD!! ## | | %%%\n" * 4
    rows = [(i, good if i % 2 else bad, 1) for i in range(120)] + [(None, good, 1), (None, None, 1), (500, "", 1), (501, bad, 1), (501, bad, 1), (502, "x" * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 5.0) for i in range(120)] + [(None, 1, 1.0), (3, None, 1.0), (4, 7, 1.0)], "doc_id long, quality int, stats double")
    got = b.classify(docs, "doc_id", "text", labels, "quality").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.5) == (r["key"] % 2 == 1) for r in got if r["key"] is not None and r["key"] < 120)
    assert len({r["score"] for r in got if r["key"] == 501}) == 1
    assert len(b.classify(docs, "doc_id", "text", labels, "quality", rows=20).collect()) == len(rows)  # a bounded sample
    none = b.classify(docs, "doc_id", "text", labels.limit(0), "quality").collect()
    assert {r["score"] for r in none} == {0.5}
    assert b.classify(docs.limit(0), "doc_id", "text", labels, "quality").count() == 0
