"""SimHash near-duplicates with bit-sliced comparison.

Distinct fingerprints meet in buckets: the 64 bits are cut into radius + 3 blocks, and for every choice of three
blocks the fingerprints that agree on them form a bucket, so a pair within the radius shares at least one. Inside
a bucket fingerprints are stored as 64 vertical bit planes. Each plane is added to all distances at once with
carry-save counters that saturate above the radius, and comparison stops for queries whose distances have
all passed it. A bucket gives only links that join something new, at most one fewer than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import query, table, texts
from rxloom.llm.graph import components
from rxloom.session import materialise

SEED = 42
RADIUS = 3
#: Fingerprints compared with each other in one piece of work; larger buckets are cut into pairs of chunks.
CHUNK = 4096
#: Planes added between two looks for queries that can be abandoned.
PLANES = 8
#: Queries compared at once.
QUERIES_AT_ONCE = 128
#: Up to here a bucket is compared number by number.
FEW = 8


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of the shingles' XXH64 bits; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    slices = [joined[a:b - 1] for a, b in zip(starts[:n], ends[min(width, len(words)) - 1:], strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(key, text)
    schema = T.StructType([T.StructField(key, rows.schema[0].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return rows.mapInArrow(run, schema)


def bucket_masks(radius: int) -> list[int]:
    """Bit masks of every choice of three out of radius + 3 blocks."""
    blocks = radius + 3
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [a | b | c for a, b, c in combinations(masks, 3)]


def signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit planes of the fingerprints, each as 64-bit words with one lane per fingerprint."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((-(-len(values) // 64) * 64, 64), np.uint8)
    lanes[:len(values)] = bits
    return np.ascontiguousarray(np.packbits(lanes.T, axis=1, bitorder="little")).view("<u8")


def lanes_within(planes: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries that were not abandoned, and for each a lane mask of fingerprints within the radius."""
    alive = np.arange(len(queries))
    digits = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros((len(queries), planes.shape[1]), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(64):
        bit = (queries[alive] >> np.uint64(p)) & np.uint64(1)
        carry = planes[p][None, :] ^ np.where(bit == 1, full, np.uint64(0))[:, None]
        for d in digits:
            d ^= carry
            carry &= ~d
        over |= carry
        if p % PLANES == PLANES - 1:
            keep = (over != full).any(1)
            if not keep.all():
                alive, over, digits = alive[keep], over[keep], [d[keep] for d in digits]
                if not len(alive):
                    break
    if radius + 1 < 1 << radius.bit_length():  # counters run to a power of two; compare the rest exactly
        excess = np.zeros_like(over)
        for value in range(radius + 1, 1 << radius.bit_length()):
            same = np.full_like(over, full)
            for i, d in enumerate(digits):
                same &= d if value >> i & 1 else ~d
            excess |= same
        over |= excess
    return alive, ~over


def joining_links(values: np.ndarray, radius: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links within the radius that connect all the groups the fingerprints fall into, and no more than that.

    With `side`, only pairs from different sides are compared.
    """
    m = len(values)
    label = np.arange(m)
    links: list[tuple[int, int]] = []

    def join(i: int, js: np.ndarray) -> None:
        other = label[js]
        new, first = np.unique(other, return_index=True)
        for lab, k in zip(new.tolist(), first.tolist(), strict=True):
            if lab != label[i]:
                links.append((int(values[i]), int(values[js[k]])))
                label[label == lab] = label[i]

    if m <= FEW:
        plain = values.tolist()
        for i in range(m):
            near = [j for j in range(i) if (plain[i] ^ plain[j]).bit_count() <= radius and (side is None or side[i] != side[j])]
            if near:
                join(i, np.array(near))
        return links
    asks = np.arange(m) if side is None else np.flatnonzero(side == 0)
    lanes = np.arange(m) if side is None else np.flatnonzero(side == 1)
    planes = planes_of(values[lanes])
    for at in range(0, len(asks), QUERIES_AT_ONCE):
        block = asks[at:at + QUERIES_AT_ONCE]
        alive, within = lanes_within(planes, values[block], radius)
        hits = np.unpackbits(np.ascontiguousarray(within).view(np.uint8), axis=1, bitorder="little")[:, :len(lanes)]
        for row, i in zip(hits, block[alive].tolist(), strict=True):
            join(i, lanes[np.flatnonzero(row)])
    return links


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all fingerprints of `nodes` (fp, distinct) within the radius of each other."""
    masks = bucket_masks(radius)
    rows = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(m)) for m in masks])).alias("t", "part"))
    counts = rows.groupBy("t", "part").agg(F.count("*").alias("n")).where("n > 1")
    full = rows.join(counts, ["t", "part"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # A bucket of c chunks is c * (c + 1) / 2 cells; a fingerprint goes to the c cells that hold its chunk.
    cells = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("t", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                         (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    ordered = cells.repartition("t", "part", "x", "y").sortWithinPartitions("t", "part", "x", "y", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            now = np.stack([np.asarray(c).astype(np.int64) for c in b.columns], axis=1)
            if held:
                now = np.concatenate([held.pop(), now])
            cuts = np.flatnonzero((now[1:, :4] != now[:-1, :4]).any(1)) + 1
            if len(cuts):
                yield linked(now[:cuts[-1]], cuts)
                now = now[cuts[-1]:]
            held.append(now)
        if held:
            yield linked(held[0], np.array([len(held[0])]))

    def linked(block: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            if z - a > 1:
                run_ = block[a:z]
                out += joining_links(run_[:, 5].view(np.uint64), radius, None if run_[0, 2] == run_[0, 3] else run_[:, 4])
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def near_groups(df: DataFrame, key: str, text: str, radius: int = RADIUS) -> DataFrame:
    """key, fp and the smallest key reachable over links, for every row.

    Null and empty texts have fingerprint zero and link like others. Rows without a key get their group's smallest
    key; repeated rows stay. An empty table gives no rows.
    """
    docs = materialise(fingerprints(df, key, text), "fingerprints")
    nodes = materialise(docs.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    roots = components(materialise(near_links(nodes, radius), "near"))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("group"))
    return docs.join(rooted.join(firsts, "root").select("fp", "group"), "fp")


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    groups = near_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("group").alias("component_id"))
