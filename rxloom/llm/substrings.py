"""Removal of repeated substrings by interval expansion on a Burrows-Wheeler order.

Every byte covered by a string of `length` bytes that also starts elsewhere is removed. Two occurrences of such a
string select the same anchor inside it: the `gram` with the smallest hash (rightmost on ties) of the window.
So occurrences meet by anchor, and documents never have to be compared as wholes:

1. Anchors of all documents, each with a hash of its context, the bytes of all windows that hold it.
2. Per anchor: a context seen twice is repeated as a whole. Contexts seen once at an anchor that has others
   are fetched from their documents.
3. The contexts of an anchor, aligned at it, are put in suffix order. From there the order is extended backwards,
   one column a step, for all anchors at once: the column before the suffixes is the BWT column, a stable
   counting sort by it is the LF mapping, each interval splits into one per preceding byte, and the
   common prefixes of neighbours follow from range minima of the previous ones. Strings grow by one byte a step
   until the minimum length is passed in every window; intervals of one suffix are dropped.
4. The spans of a document are merged and cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import mix64, query, table, texts
from rxloom.session import materialise

LENGTH = 200
GRAM = 48
#: Bytes hashed in one go; longer documents are worked through in overlapping segments.
SEGMENT = 1 << 20
#: Anchors held by a task before copies among them are combined and passed on.
HELD_ANCHORS = 300_000
#: Contexts put in order in one go.
CONTEXTS = 20_000
#: Contexts of an anchor that stay together; with more, every two chunks of them meet in a cell of their own.
CHUNK = 4096
#: Up to so many anchors with more contexts are broadcast (16 bytes each).
HOT_ANCHORS = 1_000_000

BASE = 0x9E3779B97F4A7C15
TIE = np.uint64((1 << 24) - 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by prefix and suffix minima of blocks."""
    blocks = -(-len(x) // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    square = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(square, 1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def segments(text: bytes, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset of the bytes, first and last owned position, bytes with a margin on both sides)."""
    margin = 2 * length
    for at in range(0, len(text), SEGMENT):
        end = min(at + SEGMENT, len(text))
        low = max(0, at - margin)
        yield low, at, end, text[low:end + margin]
        if end == len(text):
            break


def anchors_of(parts: list[tuple[int, int, int, int, bytes]], length: int, gram: int) -> np.ndarray | None:
    """Anchors of the windows in some segments (document, offset, first, last, bytes).

    Columns: anchor hash, context hash, document, position, bytes of context before and from the anchor.
    """
    sizes = np.array([len(p[4]) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    buffer = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
    n = len(buffer)
    if n < length:
        return None
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mix64((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    ties = TIE - (np.arange(len(grams), dtype=np.uint64) & TIE)
    low = sliding_min((grams & ~TIE) | ties, length - gram + 1)
    inside = np.zeros(n + 1, np.int32)
    fits = sizes >= length
    np.add.at(inside, starts[:-1][fits], 1)
    np.add.at(inside, starts[1:][fits] - length + 1, -1)
    valid = np.cumsum(inside)[:len(low)] > 0
    at = (TIE - (low[valid] & TIE)).astype(np.int64)
    if not len(at):
        return None
    at = np.unique(at)
    part = np.searchsorted(starts, at, "right") - 1
    offset, first, last, doc = (np.array([p[i] for p in parts])[part] for i in (1, 2, 3, 0))
    position = at - starts[part] + offset
    own = (position >= first) & (position < last)
    at, part, position, doc = at[own], part[own], position[own], doc[own]
    left = np.minimum(length - gram, at - starts[part])
    right = np.minimum(length, starts[part + 1] - at)
    context = mix64((sums[at + right] - sums[at - left]) * down[at - left] + (left * 1024 + right).astype(np.uint64))
    return np.stack([grams[at].view(np.int64), context.view(np.int64), doc, position, left, right], axis=1)


def find_anchors(docs: DataFrame, kind: T.DataType, length: int, gram: int) -> DataFrame:
    """One row per anchor of `docs` (key, th, text); copies within a task are combined to one row with n = 2.

    What was combined keeps its own row with n = 0, already known to be repeated, and a deal of its own, so that a
    context that a third of all documents share does not send them all to one task.
    """
    names = ["deal", "h", "ctx", "key", "th", "pos", "left", "right", "n"]
    schema = T.StructType([T.StructField(c, kind if c == "key" else T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        keys: list[pa.Array] = []
        hashes: list[np.ndarray] = []
        docs_held = count = 0

        def combined() -> Iterator[pa.RecordBatch]:
            if not count:
                return
            rows = np.concatenate(found)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            n = np.where(many, 0, 1)
            deal = np.where(many, mix64((rows[:, 2] * 1_000_003 + rows[:, 3]).astype(np.uint64)).view(np.int64), rows[:, 0])
            sent = np.flatnonzero(new & many)  # one more row for each combined context
            rows = np.concatenate([rows, rows[sent]])
            n = np.concatenate([n, np.full(len(sent), 2)])
            deal = np.concatenate([deal, rows[len(deal):, 0]])
            names_of, th_of = pa.concat_arrays(keys), np.concatenate(hashes)
            for at in range(0, len(rows), 50_000):
                r = rows[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(deal[at:at + 50_000]), pa.array(r[:, 0]), pa.array(r[:, 1]), names_of.take(pa.array(r[:, 2])),
                     pa.array(th_of[r[:, 2]]), pa.array(r[:, 3]), pa.array(r[:, 4]), pa.array(r[:, 5]), pa.array(n[at:at + 50_000])], names)

        for b in batches:
            keys.append(b.column(0))
            hashes.append(np.asarray(b.column(1)))
            parts: list[tuple[int, int, int, int, bytes]] = []
            size = 0
            for i, text in enumerate(texts(b.column(2))):
                for offset, first, last, body in segments(text, length):
                    parts.append((docs_held + i, offset, first, last, body))
                    size += len(body)
                    if size >= SEGMENT:
                        got = anchors_of(parts, length, gram)
                        parts, size = [], 0
                        if got is not None:
                            found.append(got)
                            count += len(got)
            if parts and (got := anchors_of(parts, length, gram)) is not None:
                found.append(got)
                count += len(got)
            docs_held += len(b)
            if count >= HELD_ANCHORS:
                yield from combined()
                found, keys, hashes, docs_held, count = [], [], [], 0, 0
        yield from combined()

    return docs.select("key", "th", "text").mapInArrow(run, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], column: str, least: int = 1) -> Iterator[pa.Table]:
    """Tables of at least `least` rows in which every value of the (ordered) column is complete."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        values = np.asarray(b.column(column))
        change = np.flatnonzero(values[1:] != values[:-1])
        cut = int(change[-1]) + 1 if len(change) else 0
        if not cut and len(held) > 1 and held[-2].column(column)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held[:-1])
            held, rows = [b], len(b)
        elif cut and rows >= least:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held, rows = [b.slice(cut)], len(b) - cut
    if held:
        yield pa.Table.from_batches(held)


def sort_by_anchor(anchors: DataFrame, kind: T.DataType) -> DataFrame:
    """Spans that are repeated for certain (h null), and contexts that have to be looked at (h set, n as before)."""
    names = ["key", "th", "start", "stop", "pos", "h", "n"]
    schema = T.StructType([T.StructField(c, kind if c == "key" else T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "deal"):
            h, ctx, n, pos, left, right = (t.column(c).to_numpy() for c in ("h", "ctx", "n", "pos", "left", "right"))
            known = n == 0
            live = ~known
            same_h = np.zeros(len(h), bool)
            same_h[1:] = live[1:] & live[:-1] & (h[1:] == h[:-1])
            same_ctx = same_h.copy()
            same_ctx[1:] &= ctx[1:] == ctx[:-1]
            group, context = np.cumsum(~same_h) - 1, np.cumsum(~same_ctx) - 1
            seen = np.bincount(context, weights=n)[context]
            kinds = np.bincount(group, weights=~same_ctx)[group]
            single = np.bincount(group, weights=(seen == 1))[group]
            repeated = known | (live & (seen > 1) & (n == 1))
            # Contexts to look at: those seen once, and one of each seen more often as their partner.
            look = live & (kinds > 1) & (single > 0) & ((seen == 1) | ~same_ctx)
            for mask, mark in ((repeated, False), (look, True)):
                at = np.flatnonzero(mask)
                if not len(at):
                    continue
                some = t.select(["key", "th"]).take(pa.array(at)).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).combine_chunks(), some.column(1).combine_chunks(), pa.array((pos - left)[at]), pa.array((pos + right)[at]),
                     pa.array(pos[at]), pa.array(h[at], pa.int64(), mask=None if mark else np.ones(len(at), bool)),
                     pa.array(np.where(seen[at] > 1, 2, 1))], names)

    ordered = anchors.repartition("deal").sortWithinPartitions("deal", "n", "h", "ctx")
    return ordered.mapInArrow(run, schema)


def expand(group: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of ordered groups, the first and last repeated window as bytes before the anchor; -1 if none.

    `right` are the bytes from the anchor on, `left` those before it; all contexts of a group share the gram.
    """
    n, reach = len(group), length - gram
    lengths_left = np.array([len(x) for x in left])
    lengths_right = np.array([len(x) for x in right])
    after = np.frombuffer(b"".join(x[gram:].ljust(length - gram, b"\xff") for x in right), np.uint8).reshape(n, -1) + np.uint8(1)
    before = np.frombuffer(b"".join(x.rjust(reach, b"\0") for x in left), np.uint8).reshape(n, -1)
    keyed = np.concatenate([group.astype(">i8").view(np.uint8).reshape(n, 8), after], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    klass = group[order]
    differ = after[order[1:]] != after[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), after.shape[1]) + gram
    common = np.minimum(common, np.minimum(lengths_right[order[1:]], lengths_right[order[:-1]]))
    # prefix[j]: column where suffixes j - 1 and j of the order first differ; -1 between intervals.
    prefix = np.full(n + 1, -1, np.int64)
    prefix[1:n] = np.where(klass[1:] == klass[:-1], common, -1)
    nearest, farthest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)

    def mark(step: int) -> None:
        hit = order[np.maximum(prefix[:-1], prefix[1:]) >= length - step]
        nearest[hit] = np.where(nearest[hit] < 0, step, nearest[hit])
        farthest[hit] = step

    mark(0)
    for step in range(1, reach + 1):
        symbol = before[order, reach - step].astype(np.int64)
        alive = lengths_left[order] >= step
        target = klass * 256 + symbol
        moved = np.flatnonzero(alive)
        moved = moved[np.argsort(target[moved], kind="stable")]
        target = target[moved]
        same = np.zeros(len(moved) + 1, bool)
        same[1:-1] = target[1:] == target[:-1]
        keep = same[:-1] | same[1:]  # in an interval of two suffixes at least
        if not keep.any():
            break
        low = np.full(len(moved) + 1, -1, np.int64)
        j = np.flatnonzero(same[:-1])
        first, last = moved[j - 1] + 1, moved[j] + 1
        value = prefix[moved[j]]
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            value[wide] = np.minimum.reduceat(prefix, np.stack([first[wide], last[wide]], axis=1).ravel())[::2]
        low[j] = value
        kept = np.flatnonzero(keep)
        order = order[moved[kept]]
        klass = np.cumsum(~same[:-1][kept]) - 1
        prefix = np.append(low[kept], -1)
        mark(step)
    return nearest, farthest


def deal_cells(wanted: DataFrame) -> DataFrame:
    """Contexts with the cells they are compared in: one for most anchors; of an anchor in c chunks, the c that hold its chunk."""
    sizes = materialise(wanted.groupBy("h").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1"), "sizes")
    # Few anchors are hot; sent to all tasks, they do not bring the rows of one together. Past the bound they are joined.
    sizes = F.broadcast(sizes) if sizes.count() <= HOT_ANCHORS else sizes
    dealt = wanted.join(sizes, "h", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own, other = F.pmod(F.xxhash64("th", "pos"), F.col("chunks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    return dealt.withColumn("own", own).withColumn("other", other).withColumn(
        "cell", F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")))


def fetch_contexts(docs: DataFrame, wanted: DataFrame, kind: T.DataType, length: int, gram: int) -> DataFrame:
    """The bytes around each wanted anchor, read from its document once for all its anchors."""
    lists = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("cell", "h", "pos", "n")).alias("wanted"))
    a, b = docs.alias("a"), lists.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.th") == F.col("b.th"))).select("a.key", "a.th", "a.text", "b.wanted")
    names = ["cell", "h", "n", "key", "th", "pos", "before", "after"]
    kinds = {"key": kind, "before": T.BinaryType(), "after": T.BinaryType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists_ = b.column(3)
            ends = np.asarray(lists_.offsets) - lists_.offsets[0].as_py()
            flat = lists_.flatten()
            cell, h, pos, n = (flat.field(i).to_numpy() for i in range(4))
            bodies = texts(b.column(2))
            for at in range(0, len(bodies), 500):
                stop = min(at + 500, len(bodies))
                owner = np.repeat(np.arange(at, stop), np.diff(ends[at:stop + 1]))
                some = slice(ends[at], ends[stop])
                cut = [(bodies[i][max(0, p - length + gram):p], bodies[i][p:p + length]) for i, p in zip(owner.tolist(), pos[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[some]), pa.array(h[some]), pa.array(n[some]), b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)),
                     pa.array(pos[some]), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], names)

    return joined.mapInArrow(run, schema)


def expand_contexts(contexts: DataFrame, kind: T.DataType, length: int, gram: int) -> DataFrame:
    """Repeated spans (key, th, start, stop) of contexts that were seen once."""
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(c, T.LongType()) for c in ("th", "start", "stop")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "cell", CONTEXTS):
            cell, h, n, pos = (t.column(c).to_numpy() for c in ("cell", "h", "n", "pos"))
            group = np.cumsum(np.concatenate([[False], (cell[1:] != cell[:-1]) | (h[1:] != h[:-1])]))
            nearest, farthest = expand(group, t.column("before").to_pylist(), t.column("after").to_pylist(), length, gram)
            at = np.flatnonzero((nearest >= 0) & (n == 1))
            some = t.select(["key", "th"]).take(pa.array(at)).combine_chunks()
            for r in pa.table([some.column(0), some.column(1), pa.array((pos - farthest)[at]), pa.array((pos - nearest + length)[at])],
                              names=["key", "th", "start", "stop"]).to_batches():
                yield r

    return contexts.repartition("cell").sortWithinPartitions("cell", "h").mapInArrow(run, schema)


def repeated_spans(df: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document with repeats: key, th (hash of the text) and its spans, not yet merged."""
    if not 0 < gram < length:
        raise ValueError("the gram must be shorter than the string")
    kind = df.select(key).schema[0].dataType
    docs = keyed(df, key, text)
    sorted_ = materialise(sort_by_anchor(find_anchors(docs, kind, length, gram), kind), "anchors")
    contexts = fetch_contexts(docs, deal_cells(sorted_.where("h IS NOT NULL")), kind, length, gram)
    spans = sorted_.where("h IS NULL").select("key", "th", "start", "stop").union(expand_contexts(contexts, kind, length, gram))
    return spans.groupBy("key", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    body: Column = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of the spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def remove_repeats(df: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """All rows of `df`, the text replaced by `kept` (remaining bytes), with `n_bytes`, `n_removed` and `n_spans`.

    With `as_text`, `kept` is a string without the characters that a cut went through. Null texts are empty. Repeated rows are occurrences of their own, so their texts are repeated strings. An
    empty table gives no rows. Names that clash with the new columns are an error.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    others = [c for c in df.columns if c != text]
    taken = set(new) & {c.lower() for c in others}
    if taken:
        raise ValueError(f"columns already present: {sorted(taken)}")
    spans = repeated_spans(df, key, text, length, gram).select(F.col("key").alias("b_key"), F.col("th").alias("b_th"), "spans")
    rows = df.select(F.struct(*others).alias("row"), F.col(key).alias("a_key"), F.coalesce(F.col(text), F.lit("")).alias("a_text"))
    rows = rows.withColumn("a_th", F.xxhash64("a_text"))
    joined = rows.join(spans, F.col("a_key").eqNullSafe(F.col("b_key")) & (F.col("a_th") == F.col("b_th")), "left").select("row", "a_text", "spans")
    schema = T.StructType([joined.schema[0], T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *[T.StructField(c, T.LongType()) for c in new[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, counts = [], []
            for body, found in zip(texts(b.column(1)), b.column(2), strict=True):
                cuts = merged([(s["start"], s["stop"]) for s in found.as_py()]) if found.is_valid else []
                left, at = [], 0
                for start, stop in cuts:
                    left.append(body[at:start])
                    at = stop
                left.append(body[at:])
                kept = b"".join(left)
                bodies.append(kept.decode("utf-8", "ignore") if as_text else kept)
                counts.append((len(body), len(body) - len(kept), len(cuts)))
            numbers = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.string() if as_text else pa.binary()), *[pa.array(numbers[:, i]) for i in range(3)]],
                                             ["row", *new])

    return joined.mapInArrow(run, schema).select("row.*", *new)


@query("op9_repeated_substrings")
def op9_repeated_substrings(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
