"""Benchmark decontamination with a positional inverted index.

Index: documents in segments. A segment is one stored row: for every benchmark term its postings in some hundred
documents, (term, document, position) in order. It is written by the task that read the documents, so postings
are never shuffled, and corpus counts per term are sums over segments.

Search: every window of a benchmark item starts from its rarest term. The term's positions minus its offset in
the window are candidate starts; the lists of the other terms, from the second rarest on and shifted in the same
way, are intersected with them. A slop above zero also lets terms lie that far from their place (proximity);
drift 0 is the exact phrase. Queries go to all segments, in parts of bounded size if the benchmark is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rxloom.llm.common import query, table, texts
from rxloom.session import materialise

WIDTH = 10
#: Benchmark windows searched in one pass over the documents; a larger benchmark takes more passes.
WINDOWS_AT_ONCE = 100_000
#: Documents and words after which a segment is closed.
SEGMENT_DOCS = 500
SEGMENT_WORDS = 2_000_000

#: Letters A-Z to lower case; every other ASCII byte that is no letter or digit to a blank.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def benchmark_windows(items: DataFrame, item: str, text: str, width: int = WIDTH) -> DataFrame:
    """(window, item, terms): every run of `width` words of every item; an item of fewer words, but not none, is one window."""
    rows = items.select(item, text)
    schema = T.StructType([T.StructField("window", T.LongType()), T.StructField("item", rows.schema[0].dataType),
                           T.StructField("terms", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        for b in batches:
            which, found = [], []
            for i, body in enumerate(texts(b.column(1))):
                ws = [w.decode("utf-8", "replace") for w in words(body)]
                size = min(width, len(ws))
                found += [ws[s:s + size] for s in range(len(ws) - size + 1 if ws else 0)]
                which += [i] * (len(found) - len(which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(serial, serial + len(found)), pa.int64()), b.column(0).take(pa.array(which, pa.int64())),
                 pa.array(found, pa.list_(pa.string()))], [f.name for f in schema])
            serial += len(found)

    return rows.mapInArrow(run, schema)


class Queries:
    """Windows as rows of term numbers, their terms in some order, with the offset of each."""

    def __init__(self, rows: list):
        self.vocabulary = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.ids = np.array([r["window"] for r in rows], np.int64)
        self.items = [r["item"] for r in rows]
        self.sizes = np.array([len(r["terms"]) for r in rows], np.int64)
        width = max(map(len, (r["terms"] for r in rows)), default=1)
        self.terms = np.array([[number[t] for t in r["terms"]] + [-1] * (width - len(r["terms"])) for r in rows], np.int64).reshape(-1, width)
        self.offsets = np.tile(np.arange(width), (len(rows), 1))

    def order_by(self, counts: np.ndarray) -> None:
        """Rarest term first; windows with a term that no document has are dropped."""
        if not len(self.terms):
            return
        n = np.where(self.terms >= 0, counts[self.terms], np.iinfo(np.int64).max)
        order = np.argsort(n, axis=1, kind="stable")
        possible = n.min(1) > 0
        self.terms = np.take_along_axis(self.terms, order, 1)[possible]
        self.offsets = np.take_along_axis(self.offsets, order, 1)[possible]
        self.items = [x for x, p in zip(self.items, possible, strict=True) if p]
        self.ids, self.sizes = self.ids[possible], self.sizes[possible]


def build_index(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """The stored index: per document a row (doc, key, n_words), per segment a row with its postings.

    `doc` numbers the rows, so repeated keys stay apart; null and empty texts have no words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select(key, text)
    binary = ["terms", "docs", "positions"]
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("key", rows.schema[0].dataType), T.StructField("n_words", T.LongType()),
                           *[T.StructField(c, T.BinaryType()) for c in binary]])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i for i, w in enumerate(sent.value)}
        serial = TaskContext.get().partitionId() << 33
        for b in batches:
            codes: list[np.ndarray] = []
            first = held = 0
            for i, body in enumerate(texts(b.column(1))):
                ws = words(body)
                codes.append(np.fromiter(map(number.get, ws, repeat(-1)), np.int32, len(ws)))
                held += len(ws)
                if len(codes) >= SEGMENT_DOCS or held >= SEGMENT_WORDS or i == len(b) - 1:
                    yield segment(codes, b.column(0).slice(first, len(codes)), serial)
                    serial += len(codes)
                    first, codes, held = i + 1, [], 0

    def segment(codes: list[np.ndarray], keys: pa.Array, serial: int) -> pa.RecordBatch:
        sizes = np.array([len(c) for c in codes], np.int64)
        code = np.concatenate(codes)
        doc = np.repeat(np.arange(len(codes), dtype=np.int32), sizes)
        place = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        hit = np.flatnonzero(code >= 0)
        hit = hit[np.argsort(code[hit], kind="stable")]
        none = [None] * len(codes)
        return pa.RecordBatch.from_arrays(
            [pa.array([*range(serial, serial + len(codes)), serial]), pa.concat_arrays([keys, pa.nulls(1, keys.type)]), pa.array([*sizes.tolist(), None], pa.int64()),
             *[pa.array([*none, x[hit].tobytes()], pa.binary()) for x in (code, doc, place)]], names)

    return materialise(rows.mapInArrow(run, schema), "postings")


def term_counts(index: DataFrame, terms: int) -> np.ndarray:
    """Postings per term over all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for b in batches:
            for body in b.column(0):
                total += np.bincount(np.frombuffer(body.as_buffer(), np.int32), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(terms, np.int64)
    sums = index.where("n_words IS NULL").select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():
        out[r["term"]] = r["n"]
    return out


#: Bits of a position in a posting's joint number, above it the document, above that the term.
PLACE_BITS = 31


def intersect(q: Queries, terms: np.ndarray, docs: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """(window row, document, start, drift) of all matches in a segment's ordered postings."""
    n_docs = int(docs.max()) + 1 if len(docs) else 1
    joint = ((terms.astype(np.int64) * n_docs + docs) << PLACE_BITS) + places
    low, high = np.searchsorted(terms, q.terms[:, 0]), np.searchsorted(terms, q.terms[:, 0], "right")
    count = high - low
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
    doc, start = docs[at].astype(np.int64), places[at].astype(np.int64) - q.offsets[row, 0]
    inside = start >= 0
    row, doc, start = row[inside], doc[inside], start[inside]
    drift = np.zeros(len(row), np.int64)
    for k in range(1, q.terms.shape[1]):
        term = q.terms[row, k]
        wanted = ((term * n_docs + doc) << PLACE_BITS) + start + q.offsets[row, k]
        next_ = np.searchsorted(joint, wanted)
        away = np.minimum(np.abs(joint[np.minimum(next_, len(joint) - 1)] - wanted), np.abs(joint[np.maximum(next_ - 1, 0)] - wanted)) if len(joint) else wanted
        away = np.where(term < 0, 0, away)
        keep = away <= slop
        row, doc, start, drift = row[keep], doc[keep], start[keep], np.maximum(drift, away)[keep]
    return row, doc, start, drift


def find_matches(index: DataFrame, q: Queries, item_type: T.DataType, slop: int = 0) -> DataFrame:
    """(doc, item, window, start, size, drift) of every occurrence of a window, exact phrases having drift 0."""
    sent = index.sparkSession.sparkContext.broadcast(q)
    longs = ["window", "start", "size", "drift"]
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("item", item_type), *[T.StructField(c, T.LongType()) for c in longs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for b in batches:
            for i, serial in enumerate(b.column(0).to_pylist()):
                terms, docs, places = (np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in (1, 2, 3))
                row, doc, start, drift = intersect(asked, terms, docs, places, slop)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc + serial), pa.array([asked.items[r] for r in row.tolist()], item_arrow), pa.array(asked.ids[row]), pa.array(start),
                     pa.array(asked.sizes[row]), pa.array(drift)], [f.name for f in schema])

    item_arrow = to_arrow_type(item_type)
    return index.where("n_words IS NULL").select("doc", "terms", "docs", "positions").mapInArrow(run, schema)


def contamination(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, width: int = WIDTH) -> DataFrame:
    """Per row of `docs`: key, n_words, n_hit, the sorted ids of the items found, n_items, contaminated.

    Null and empty texts have no words and are clean; an item without words has no window; items that share an id
    are one item and items without an id are not listed. Repeated rows get a row each.
    """
    windows = materialise(benchmark_windows(items, item, item_text, width), "benchmark")
    parts = max(1, -(-windows.count() // WINDOWS_AT_ONCE))
    found, index = [], None
    for part in range(parts):
        asked = Queries(windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect())
        index = build_index(docs, key, text, asked.vocabulary)
        asked.order_by(term_counts(index, len(asked.vocabulary)))
        found.append(find_matches(index, asked, windows.schema["item"].dataType))
    matches = materialise(reduce(DataFrame.union, found), "matches")
    hit = (matches.select("doc", "start", "size").distinct()
           .select("doc", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct()
           .groupBy("doc").agg(F.count("*").alias("n_hit")))
    listed = matches.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    per_doc = index.where("n_words IS NOT NULL").select(F.col("key").alias(key), "doc", "n_words")
    none = F.array().cast("array<string>")
    return (per_doc.join(hit, "doc", "left").join(listed, "doc", "left")
            .select(key, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
            .withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0))


@query("op8_positional_index", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM s),
g AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)),
m AS (SELECT doc_id, item_id, k, i FROM g JOIN w USING (k, gram)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)""")
def op8_positional_index(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")
