"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

No fingerprint radius holds all such pairs in buckets of agreeing bits, so candidates meet by shingle instead. Texts at
0.8 share one of the first n - ceil(0.8 n) + 1 shingles of each, in any order all texts follow; here shingles that are frequent
in a sample come last and the others are in hash order, so a common passage makes no large bucket. The sample only sets the order.

A node is a distinct set. Postings (shingle, node) are exchanged once; buckets with the same members are one bucket, and
large ones are cut into pairs of chunks, the cells. Inside a cell

1. the SimHash fingerprints (64 bits, of the same shingles) are compared bit-sliced within RADIUS, survivors by their parity
   sketches, and one candidate is given for every two groups that survivors join. Candidates are confirmed on the whole sets;
2. where nodes of a cell have different roots by then, the sketches alone, which lose no pair, say which of them might still be
   linked; their sets are brought to the cell and compared there, and links that join something new are given.

No step gives more links than a cell has nodes. A parity sketch has a bit per hash slot, set if an odd number of shingles falls in
it. Sketches differ in at most as many bits as the sets in shingles, and at 0.8 that is a ninth of both sizes at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import mix64, texts
from rxloom.llm.graph import components
from rxloom.llm.simhash import lanes_within, planes_of
from rxloom.session import materialise

WIDTH = 5
#: Of the first step only. At 0.8 a bit differs with probability arccos(8/9) / pi = 0.15, 9.7 of 64 bits; over 24 differ in 3 of a million pairs.
RADIUS = 24
#: Distinct texts whose shingles are counted for the order, and how many of them have a frequent shingle.
SAMPLE_TEXTS = 4_000
FREQUENT = 3
#: Parts into which the postings of a frequent shingle are dealt.
SALTS = 64
#: Nodes and shingles of a chunk.
CHUNK = 4096
CHUNK_SHINGLES = 4_000_000
#: Slots of a sketch: a power of two, at least four for each shingle, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 64, 1 << 14
#: Texts read at once.
BLOCK = 200
#: Up to here fingerprints are compared number by number; beyond bit-sliced, so many queries at once.
FEW = 32
QUERIES_AT_ONCE = 128

CELL = ["h", "p", "q"]


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Ordered distinct XXH64 of the runs of `width` words; a text of fewer words, or none, is one run."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words)) or [1]
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    slices = [joined[a:b - 1] for a, b in zip(starts[:n], ends[min(width, len(ends)) - 1:], strict=True)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(0)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def slots_of(size: int) -> int:
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (4 * size - 1).bit_length()))


def parity(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch as 64-bit words. The lower half of a sketch xor its upper half is the sketch of half as many slots."""
    slots = slots_of(len(hashes))
    counts = np.bincount((mix64(hashes) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8")


def prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which a text at 0.8 must share one: the first in the common order."""
    n = len(hashes)
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[:n - (4 * n + 4) // 5 + 1]


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """Shingles of several texts in a sample of distinct texts, ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in texts(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(body).view(np.int64))], ["s"])

    share = max(1, rows.agg(F.approx_count_distinct("th")).first()[0] // SAMPLE_TEXTS)
    sample = rows.where(F.pmod("th", F.lit(share)) == 0).groupBy("th").agg(F.first("text").alias("text")).select("text")
    found = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("s").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def read_texts(rows: DataFrame, kind: T.DataType, frequent: np.ndarray) -> DataFrame:
    """Per row its key, th, node (the hash of the set), size, fingerprint, sketch and prefix, a few texts at a time."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)
    names = ["key", "th", "node", "size", "fp"]
    schema = T.StructType([*[T.StructField(c, kind if c == "key" else T.LongType()) for c in names], *[T.StructField(c, T.BinaryType()) for c in ("sketch", "prefix")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                found = []
                for body in texts(b.column(2)):
                    hashes = shingles(body)
                    node = xxhash.xxh64_intdigest(hashes.tobytes())
                    found.append((node - (node >> 63 << 64), len(hashes), majority(hashes), parity(hashes).tobytes(), prefix(hashes, sent.value).tobytes()))
                columns = zip(zip(*found, strict=True), (*[pa.int64()] * 3, *[pa.binary()] * 2), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in columns]], schema.names)

    return rows.select("key", "th", "text").mapInArrow(run, schema)


def shared_postings(nodes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Postings (h, node, size) of shingles that several nodes have in their prefix.

    Postings are dealt by shingle, those of frequent ones also by a salt: they count as shared in any case. What the
    sample did not show as frequent is no large part of any task.
    """
    sent = nodes.sparkSession.sparkContext.broadcast(frequent)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                found = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
                h = np.concatenate(found)
                node, size = (np.repeat(b.column(k).to_numpy(), [len(x) for x in found]) for k in (0, 1))
                salt = np.where(np.isin(h, sent.value), mix64(node.view(np.uint64)) % np.uint64(SALTS) + np.uint64(1), np.uint64(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(node), pa.array(size.astype(np.int32))], ["h", "salt", "node", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None
        after_equal = False  # whether the row in `last` follows one of the same shingle
        for b in batches:
            now = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)
            now = now if last is None else np.concatenate([last, now])
            same = now[1:, 0] == now[:-1, 0]
            before = np.r_[after_equal, same]
            keep = (now[:, 1] > 0) | before | np.r_[same, False]
            last, after_equal = now[-1:], bool(before[-1])
            yield rows_of(now[:-1][keep[:-1]])
        if last is not None and (after_equal or last[0, 1] > 0):
            yield rows_of(last)

    def rows_of(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 2]), pa.array(x[:, 3])], ["h", "node", "size"])

    spread_out = nodes.select("node", "size", "prefix").mapInArrow(spread, "h long, salt int, node long, size int")
    return spread_out.repartition("h", "salt").sortWithinPartitions("h").mapInArrow(run, "h long, node long, size long")


def members_of(shared: DataFrame) -> DataFrame:
    """(h, chunks, node) of buckets of several nodes; of those with the same members (by number and two hash sums) one."""
    marks = [F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    buckets = shared.groupBy("h").agg(*marks).where("n > 1").groupBy("n", "x", "y").agg(F.min("h").alias("h"), F.max("total").alias("total"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int")
    return shared.select("h", "node").join(buckets.select("h", chunks.alias("chunks")), "h")


def cells_of(members: DataFrame) -> DataFrame:
    """Rows with their cell (h, p, q), dealt and sorted by it, then by size. A bucket of c chunks is c * (c + 1) / 2 cells."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = [c for c in members.columns if c not in ("h", "chunks")]
    cells = spread.select("h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), *rest)
    return sorted_cells(cells)


def sorted_cells(cells: DataFrame) -> DataFrame:
    return cells.repartition(*CELL).sortWithinPartitions(*CELL, "size", "node")


def by_cell(cells: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """`work` on every cell of `cells_of`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1).tolist(), b.num_rows]
            if held and [held[0].column(k)[0].as_py() for k in range(3)] != codes[0].tolist():
                yield from done(held)
                held = []
            for x, z in zip(cuts, cuts[1:-1], strict=False):
                yield from done([*held, b.slice(x, z - x)])
                held = []
            held.append(b.slice(cuts[-2]))
        if held:
            yield from done(held)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        if whole.num_rows > 1:
            yield from work(whole).to_batches()

    return cells.mapInArrow(run, schema)


class Cell:
    """Nodes of a cell in order of size, with what their sketches say about pairs."""

    def __init__(self, rows: pa.Table):
        self.side, self.node, self.size = (rows.column(c).to_numpy().astype(np.int64) for c in ("side", "node", "size"))
        self.split = bool(self.side.any())
        words = [np.frombuffer(x, "<u8") for x in rows.column("sketch").to_pylist()]
        length = np.fromiter(map(len, words), np.int64, len(words))
        cuts = [0, *(np.flatnonzero(length[1:] != length[:-1]) + 1).tolist(), len(words)]
        self.levels = [(a, z, np.stack(words[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)]

    def possible(self, i: int, label: np.ndarray) -> np.ndarray:
        """Nodes before i, of another label, that may be at 0.8 by size and sketch; none that is at 0.8 is left out."""
        low = int(np.searchsorted(5 * self.size[:i], 4 * self.size[i], side="left"))
        open_ = label[low:i] != label[i]
        if self.split:
            open_ &= self.side[low:i] != self.side[i]
        lanes = low + np.flatnonzero(open_)
        if not len(lanes):
            return lanes
        word = next(m[i - a] for a, z, m in self.levels if a <= i < z)
        out = []
        for a, z, m in self.levels:
            part = lanes[np.searchsorted(lanes, a):np.searchsorted(lanes, z)]
            if len(part):
                folded = word
                while len(folded) > m.shape[1]:
                    folded = folded[:len(folded) // 2] ^ folded[len(folded) // 2:]
                apart = np.bitwise_count(m[part - a] ^ folded).sum(1, dtype=np.int64)
                out.append(part[9 * apart <= self.size[part] + self.size[i]])
        return np.concatenate(out) if out else lanes[:0]


def join(label: np.ndarray, i: int, j: int) -> None:
    label[label == label[j]] = label[i]


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.Table:
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": found.min(1), "b": found.max(1)})


def candidates(rows: pa.Table, radius: int) -> pa.Table:
    """Pairs (a, b) that join the groups into which pairs within the radius, and possible by their sketches, put the nodes."""
    cell, fp = Cell(rows), rows.column("fp").to_numpy().view(np.uint64)
    m = len(fp)
    label, found = np.arange(m), []
    planes = planes_of(fp) if m > FEW else None
    for at in range(0, m, QUERIES_AT_ONCE):
        block = np.arange(at, min(m, at + QUERIES_AT_ONCE))
        if planes is None:
            near = np.bitwise_count(fp[block][:, None] ^ fp[None, :]) <= radius
        else:
            alive, within = lanes_within(planes, fp[block], radius)
            near = np.zeros((len(block), m), bool)
            near[alive] = np.unpackbits(np.ascontiguousarray(within).view(np.uint8), axis=1, bitorder="little")[:, :m]
        for i, row in zip(block.tolist(), near, strict=True):
            if row[:i].any():
                masked = np.where(row, label, label[i])
                for j in cell.possible(i, masked).tolist():
                    if label[j] != label[i]:
                        found.append((int(cell.node[i]), int(cell.node[j])))
                        join(label, i, j)
    return pairs_batch(found)


def open_nodes(rows: pa.Table) -> pa.Table:
    """The rows of nodes that may be linked to one of another root."""
    cell, root = Cell(rows), rows.column("root").to_numpy()
    marked = np.zeros(len(root), bool)
    for i in range(len(root)):
        found = cell.possible(i, root)
        marked[found] = True
        marked[i] |= len(found) > 0
    return rows.filter(pa.array(marked))


def exact_links(rows: pa.Table) -> pa.Table:
    """Links at 0.8 that join nodes of different roots, compared on their sets."""
    cell, label = Cell(rows), rows.column("root").to_numpy().copy()
    s = rows.column("s").combine_chunks()
    sets = [np.frombuffer(x, np.int64) for x in s.to_pylist()]
    found = []
    for i in range(len(label)):
        for j in cell.possible(i, label).tolist():
            if label[j] != label[i] and 9 * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= 4 * (len(sets[i]) + len(sets[j])):
                found.append((int(cell.node[i]), int(cell.node[j])))
                join(label, i, j)
    return pairs_batch(found)


class Corpus(NamedTuple):
    """rows: key, th, text; firsts: node and the key and th of one of its rows."""

    rows: DataFrame
    firsts: DataFrame

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node and s (its shingles) of the wanted nodes, read again from one text each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(at, BLOCK)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x).tobytes() for x in texts(b.column(1))], pa.binary())], ["node", "s"])

        firsts = self.firsts.select("node", F.col("first.key").alias("w_key"), F.col("first.th").alias("w_th"))
        named = materialise(wanted.select("node").distinct().join(firsts, "node"), "wanted")
        found = self.rows.join(named, (F.col("th") == F.col("w_th")) & F.col("key").eqNullSafe(F.col("w_key"))).select("node", "text")
        return materialise(found.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "node long, s binary"), "sets")


def confirmed(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """The pairs (a, b) at 0.8 or more, on the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [9 * len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) >= (len(x) + len(y)) // 2
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = corpus.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def group_firsts(df: DataFrame, key: str, text: str, radius: int = RADIUS) -> DataFrame:
    """key and th (XXH64 of the text, null as empty) of one row per group: the smallest key, null last, then the smallest th.

    Rows are told apart by both, so null and repeated keys with different texts stay apart. Texts without words are
    one group. An empty table gives no rows. `radius` changes the work of the two steps, not the groups; below 0 the
    first step finds nothing and the second does everything.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
    frequent = frequent_shingles(rows)
    read = read_texts(rows, df.schema[key].dataType, frequent)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th")).alias("first")
    nodes = materialise(read.groupBy("node").agg(first, *[F.first(c).alias(c) for c in ("size", "fp", "sketch", "prefix")]), "nodes")
    corpus = Corpus(rows, nodes.select("node", "first"))
    members = materialise(members_of(materialise(shared_postings(nodes, frequent), "shared")), "members")
    near = by_cell(cells_of(members.join(nodes.select("node", "size", "fp", "sketch"), "node")), lambda t: candidates(t, radius), "a long, b long")
    links = materialise(confirmed(materialise(near.distinct(), "candidates"), corpus), "links")
    roots = materialise(components(links), "roots")
    rooted = materialise(members.join(roots, "node", "left").select("h", "chunks", "node", F.coalesce("root", "node").alias("root")), "rooted")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    cells = cells_of(rooted.join(mixed, "h").join(nodes.select("node", "size", "sketch"), "node"))
    kind = cells.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    waiting = materialise(by_cell(cells, open_nodes, kind), "open")
    sets = corpus.sets(waiting)
    more = by_cell(sorted_cells(waiting.join(sets, "node").select(*waiting.columns, "s")), exact_links, "a long, b long")
    roots = components(links.union(more))
    rooted = nodes.select("node", "first").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.key", "first.th")
