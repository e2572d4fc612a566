import random
import zlib
from array import array

import pytest

from rxloom.llm import packing as p

VOCABULARY = p.public_tokenizers.path("byte_bpe_50k.json")


def best_sum(counts, capacity):
    longest = max(counts)
    sums = {longest}
    for k, n in counts.items():
        for _ in range(n - (k == longest)):
            sums |= {s + k for s in sums if s + k <= capacity}
    return max(sums)


def test_a_window_is_filled_as_closely_as_can_be():
    random.seed(2)
    for _ in range(200):
        capacity = random.randint(5, 60)
        counts = {random.randint(1, capacity - 1): random.randint(1, 4) for _ in range(random.randint(1, 6))}
        taken, total = p.fill(counts, capacity)
        assert total == best_sum(counts, capacity) == sum(k * n for k, n in taken.items())
        assert all(0 < n <= counts[k] for k, n in taken.items())


def test_encoder_equals_the_tokenizer():
    e = p.encoder(VOCABULARY)
    random.seed(3)
    pieces = ["a", "bc", " ", "  ", "\n", " \n", "\t", " ", "é", "日本", "1", "'s", "!", "_", "²", "<|endoftext|>", "\x1c", "😀", "'ll"]
    for _ in range(3000):
        t = "".join(random.choices(pieces, k=random.randint(0, 14)))
        ids = array("I")
        ids.frombytes(e.encode(t))
        assert list(ids) == e.whole.encode(t, add_special_tokens=False).ids


def check(pieces, texts, capacity, end_id=1):
    """Every id in one piece, sequences gapless, all full but the last of each task."""
    e = p.encoder(VOCABULARY)
    docs, sequences = {}, {}
    for r in pieces:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(texts)
    for d, rows in docs.items():
        ids = e.encode(texts[d] or "") + array("I", [end_id]).tobytes()
        rows.sort(key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in rows) == ids
        assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        assert all(r["doc_tokens"] == len(ids) // 4 and r["length"] == len(r["ids"]) // 4 for r in rows)
    short = {}
    for s, rows in sequences.items():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        total = sum(r["length"] for r in rows)
        assert total <= capacity
        short[s >> 33] = short.get(s >> 33, 0) + (total < capacity)
    assert all(n <= 1 for n in short.values())


@pytest.mark.parametrize("block", [50, 4_000_000])
def test_round_trip(spark, block):
    random.seed(4)
    texts = {i: " ".join(random.choices(["alpha", "be", "c", "éé"], k=random.choice([0, 1, 5, 30, 200]))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "same same", 503: "same same", 504: "long " * 3000}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, length long").repartition(3)
    check(p.pack(df, "doc_id", "text", capacity=64, block_tokens=block).collect(), texts, 64)


def test_digests_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x")], "doc_id long, text string").coalesce(1)
    rows = p.digests(p.pack(df, "doc_id", "text"), "doc_id").collect()
    ids = p.encoder(VOCABULARY).encode("a b") + array("I", [1]).tobytes()
    assert sorted(r["ids_crc32"] for r in rows if r["doc_id"] == 1) == [zlib.crc32(ids)] * 2
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1
    assert p.pack(df.limit(0), "doc_id", "text").count() == 0
