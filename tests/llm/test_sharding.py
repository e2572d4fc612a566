import zlib

import pytest
from pyspark.sql import functions as F

from rxloom.llm.common import QUERIES
from rxloom.llm.sharding import hilbert_index, hilbert_shards, string_bounds

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, dims, bits):
    cells = [F.shiftright("id", bits * j).bitwiseAND((1 << bits) - 1) for j in range(dims)]
    rows = (spark.range(1 << (dims * bits)).select(hilbert_index(cells, bits).alias("h"), *[c.alias(f"c{j}") for j, c in enumerate(cells)])
            .orderBy("h").collect())
    assert [r["h"] for r in rows] == list(range(1 << (dims * bits)))
    assert all(sum(abs(a[j] - b[j]) for j in range(1, dims + 1)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_whole_table_by_the_rows_law(spark):
    rows = QUERIES["op5_hilbert_shards"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = {}
    for r in rows:
        body = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "rows", None)
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_runs_prune_better_than_arrival_order(spark):
    df = spark.range(4096).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    spans = (hilbert_shards(df, ["x", "y"], "id", 16).groupBy("shard").agg((F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
             .agg(F.avg("dx"), F.avg("dy")).first())
    assert spans[0] < 0.5 and spans[1] < 0.5


def plain_curve(x, bits):
    """Position on the Hilbert curve by the transpose method: undo excess work per bit, then Gray-decode."""
    x, n = list(x), len(x)
    m = q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        t ^= (q - 1) if x[n - 1] & q else 0
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def test_shards_are_the_runs_of_the_curve(spark):
    rows = QUERIES["op5_hilbert_shards"](spark, SF).orderBy("shard", "slot").collect()
    assert [r["curve"] for r in rows] == sorted(r["curve"] for r in rows)
    assert all(a["curve"] < b["curve"] or a["doc_id"] <= b["doc_id"] for a, b in zip(rows, rows[1:], strict=False))


def test_curve_by_a_second_implementation(spark):
    """Both are Hilbert curves: unit steps through all cells, and within every aligned block before any other."""
    for dims, bits in ((2, 3), (3, 2)):
        cells = [F.shiftright("id", bits * j).bitwiseAND((1 << bits) - 1) for j in range(dims)]
        rows = spark.range(1 << (dims * bits)).select(hilbert_index(cells, bits).alias("h"), *[c.alias(f"c{j}") for j, c in enumerate(cells)]).collect()
        ours = {tuple(r[1:]): r["h"] for r in rows}
        other = {c: plain_curve(c, bits) for c in ours}
        for level in range(1, bits + 1):
            for index in (ours, other):
                blocks = {}
                for c, h in index.items():
                    blocks.setdefault(tuple(v >> level for v in c), []).append(h)
                assert all(max(v) - min(v) == len(v) - 1 for v in blocks.values())


def test_strings_are_compared_whole(spark):
    sources = [f"https://{chr(97 + k)}.org" for k in range(26)]
    df = spark.createDataFrame([(i, sources[i % 26]) for i in range(26 * 20)], "id long, source string")
    out = hilbert_shards(df, ["source"], "id", 13).groupBy("shard").agg(F.collect_set("source").alias("s")).collect()
    assert len(out) == 13 and all(len(r["s"]) == 2 for r in out)
    assert string_bounds(df, ["source"], 6) == {"source": sources}
    long = spark.createDataFrame([(i, "x" * 500 + str(i % 4), -1.0 * i) for i in range(400)], "id long, name string, v double")
    assert string_bounds(long, ["name"], 2)["name"] == ["x" * 500 + str(k) for k in range(4)]


def test_odd_inputs(spark):
    rows = [(1, "a", None, 5), (1, "a", None, 5), (None, None, None, 6), (2, "b", 3.0, 7)]
    df = spark.createDataFrame(rows, "id long, name string, x double, part long")
    out = hilbert_shards(df, ["name", "x"], "id", 3).collect()
    assert len(out) == 4 and sorted(r["part"] for r in out) == [5, 5, 6, 7]
    assert hilbert_shards(df.limit(0), ["name", "x"], "id", 3).count() == 0
    with pytest.raises(ValueError, match="slot"):
        hilbert_shards(df.withColumnRenamed("part", "Slot"), ["x"], "id", 3)
