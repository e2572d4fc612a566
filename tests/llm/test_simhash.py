import random
import re

import numpy as np
import pytest
import xxhash

from rxloom.llm import simhash as s
from rxloom.llm.graph import components


def naive_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64)) if hashes else 0


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("m", "radius"), [(300, 3), (5, 3), (200, 2), (100, 5), (70, 1)])
def test_bit_sliced_links_join_what_brute_force_joins(m, radius):
    rng = random.Random(m)
    base = [rng.getrandbits(64) for _ in range(m // 5)]
    values = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, radius + 2))) for b in base for _ in range(5)})
    at = {v: i for i, v in enumerate(values)}
    for side in (None, np.array([rng.randint(0, 1) for _ in values])):
        got = s.joining_links(np.array(values, np.uint64), radius, side)
        assert all((a ^ b).bit_count() <= radius for a, b in got) and len(got) < len(values)
        want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius and (side is None or side[i] != side[j])]
        assert roots(len(values), [(at[a], at[b]) for a, b in got]) == roots(len(values), want)


def test_every_near_pair_shares_a_bucket():
    masks = s.bucket_masks(3)
    rng = random.Random(1)
    for _ in range(2000):
        d = sum(1 << k for k in rng.sample(range(64), 3))
        assert any(not d & m for m in masks)


@pytest.mark.parametrize("chunk", [4096, 16])
def test_groups_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(s, "CHUNK", chunk)  # 16: a hot bucket is cut into pairs of chunks
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 60]))) for _ in range(80)]
    base = rng.choices(words, k=400)
    for _ in range(80):  # many near copies of one text
        t = list(base)
        t[rng.randrange(400)] = "changed"
        texts.append(" ".join(t).upper())
    texts += [None, "", " \n", texts[5], texts[5]]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "alone in its group it is", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = s.near_groups(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    prints = [naive_fingerprint(t) for t in texts]
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fp"] % (1 << 64), r["group"]) == (prints[r["doc_id"]], want[r["doc_id"]])
    assert s.near_groups(df.limit(0), "doc_id", "text").count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 400)] + [(5, 5), (400, 401), (401, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(300, 400)]} | {400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
