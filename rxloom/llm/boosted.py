"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

Every whole text is measured once and the statistics are stored. The trees are fitted to a bounded sample of labelled rows: each
statistic is cut into bins at quantiles, and every level of a tree takes the split with the largest gain from sums of gradients and
hessians per bin. All trees together are five arrays (feature, limit, left, right, value); tasks walk a block of documents
through all trees at once with numpy, one gather per level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import query, table, texts
from rxloom.llm.quality import covered_by_repeats
from rxloom.session import materialise

#: Labelled rows the trees are fitted to: at most twice this many, chosen by a hash of the key.
TRAINING_ROWS = 20_000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST_HESSIAN = 80, 4, 0.15, 64, 1.0, 2.0
#: Rows measured or walked through the trees at once.
BLOCK = 500

UPPER = np.arange(65, 91)
LOWER = np.arange(97, 123)
DIGITS = np.arange(48, 58)
STARTS = np.arange(0xC0, 0x100)  # first bytes of characters outside ASCII
BLANKS = np.array([9, 10, 11, 12, 13, 32])
SYMBOLS = np.frombuffer(b"#*$%&|<>@~^_=+{}[]\\/", np.uint8).astype(np.int64)
ODD_RUN = re.compile(rb"[#*$%&|<>@~^_=+{}\[\]\\/!?]{2,}")

STATISTICS = ["log_bytes", "log_words", "log_lines", "upper", "digits", "others", "blanks", "symbols", "pipes", "ends", "bangs", "commas", "byte_entropy",
              "word_length", "word_length_spread", "longest_word", "short_words", "one_letter", "distinct_words", "capital_words", "title_words", "odd_runs",
              "lone_symbols", "repeats", "duplicate_lines", "line_words", "ended_lines", "short_lines", "ending", "sentence_words"]


def statistics(body: bytes) -> list[float]:
    """Statistics of one text, in the order of STATISTICS; shares are of bytes, words or lines. All are 0 for an empty text."""
    if not body:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    size = len(body)
    letters = counts[UPPER].sum() + counts[LOWER].sum() + counts[STARTS].sum()
    ends = counts[33] + counts[46] + counts[63]
    share = counts[counts > 0] / size
    chars = [np.log1p(size), 0.0, 0.0, counts[UPPER].sum() / max(1, letters), counts[DIGITS].sum() / size, counts[STARTS].sum() / max(1, letters), counts[BLANKS].sum() / size,
             counts[SYMBOLS].sum() / size, counts[124] / size, ends / size, counts[33] / size, counts[44] / size, float(-(share * np.log2(share)).sum())]
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    n, m = len(words), len(lines)
    if not n:
        return [float(x) for x in chars] + [0.0] * (len(STATISTICS) - len(chars))
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars[1:3] = np.log1p(n), np.log1p(m)
    firsts = b"".join([w[:1] for w in words])
    tallies = [lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(), (lengths == 1).mean(), len(set(words)) / n,
               sum(len(w) > 1 and w.isupper() for w in words) / n, np.isin(np.frombuffer(firsts, np.uint8), UPPER).mean(), len(ODD_RUN.findall(body)) / n,
               sum(len(w) == 1 and not w.isalnum() for w in words) / n, covered_by_repeats(words) / n, 1 - len(set(lines)) / m, np.log1p(n / m),
               sum(x.rstrip()[-1:] in b".!?" for x in lines) / m, sum(len(x.split(None, 3)) < 4 for x in lines) / m, float(words[-1][-1:] in b".!?"), np.log1p(n / (1 + ends))]
    return [float(x) for x in chars + tallies]


def measured(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and stats (array of float) of every row, null texts as empty."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema[0].dataType), T.StructField("stats", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                found = np.array([statistics(x) for x in texts(part.column(1))], np.float32)
                offsets = pa.array(np.arange(0, found.size + 1, len(STATISTICS), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], schema.names)

    return rows.mapInArrow(run, schema)


class Forest(NamedTuple):
    """All nodes of all trees; a leaf leads to itself. Tree t begins at node roots[t]."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float


def walk(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of statistics."""
    at = np.broadcast_to(forest.roots, (len(x), len(forest.roots))).copy()
    rows = np.arange(len(x))[:, None]
    for _ in range(forest.depth):
        at = np.where(x[rows, forest.feature[at]] <= forest.limit[at], forest.left[at], forest.right[at])
    return 1 / (1 + np.exp(-(forest.base + forest.value[at].sum(1))))


def limits_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per statistic ascending limits, at most bins - 1; bin k holds the values over k of them."""
    return [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower"))[:bins - 1].astype(np.float32) for f in range(x.shape[1])]


def best_splits(codes: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, bins: int, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the statistic and bin of the best split (rows up to the bin go left) and its gain; 0 where none is allowed.

    One histogram per statistic has the sums of gradients and hessians of all nodes of a level.
    """
    best = (np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes))
    for f in range(codes.shape[1]):
        cell = node * bins + codes[:, f]
        sums = [np.bincount(cell, w, nodes * bins).reshape(nodes, bins) for w in (g, h)]
        gl, hl = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
        gt, ht = (s.sum(1)[:, None] for s in sums)
        gain = gl**2 / (hl + ridge) + (gt - gl)**2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        gain[(hl < least) | (ht - hl < least)] = 0
        at = gain.argmax(1)
        top = gain[np.arange(nodes), at]
        better = top > best[2] + 1e-12
        for old, new in zip(best, (np.full(nodes, f), at, top), strict=True):
            old[better] = new[better]
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = RIDGE, least: float = LEAST_HESSIAN) -> Forest:
    """Boosted trees on the logistic loss. Rows may come in any order: they are sorted first."""
    order = np.lexsort((y, *x.T[::-1]))
    x, y = x[order], y[order].astype(np.float64)
    limits = limits_of(x, bins) if len(x) else []
    codes = np.stack([np.searchsorted(v, x[:, f], side="left") for f, v in enumerate(limits)], axis=1) if len(x) else np.zeros((0, 0), np.int64)
    rate_of_one = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    score = np.full(len(y), base)
    feature, limit, left, right, value, roots = ([] for _ in range(6))

    def leaf() -> int:
        at = len(feature)
        for column, v in zip((feature, limit, left, right, value), (0, 0.0, at, at, 0.0), strict=True):
            column.append(v)
        return at

    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        roots.append(leaf())
        open_nodes, node, at = [roots[-1]], np.zeros(len(y), np.int64), np.full(len(y), roots[-1])
        for _ in range(depth):
            rows = node >= 0
            f, cut, gain = best_splits(codes[rows], node[rows], len(open_nodes), g[rows], h[rows], bins, ridge, least)
            follow, named = np.full((len(open_nodes), 2), -1), []
            for k in np.flatnonzero(gain > 0).tolist():
                i = open_nodes[k]
                feature[i], limit[i], left[i], right[i] = int(f[k]), float(limits[f[k]][cut[k]]) if cut[k] < len(limits[f[k]]) else np.inf, leaf(), leaf()
                follow[k] = len(named), len(named) + 1
                named += [left[i], right[i]]
            if not named:
                break
            inner = np.flatnonzero(rows)
            goes = (codes[inner, f[node[inner]]] > cut[node[inner]]).astype(np.int64)
            node[inner] = follow[node[inner], goes]
            moved = node >= 0
            at[moved] = np.array(named)[node[moved]]
            open_nodes = named
        for i in np.unique(at).tolist():
            inside = at == i
            value[i] = float(-rate * g[inside].sum() / (h[inside].sum() + ridge))
        score += np.array(value)[at]
    return Forest(np.array(roots, np.int64), np.array(feature, np.int64), np.array(limit, np.float32), np.array(left, np.int64), np.array(right, np.int64), np.array(value), depth, base)


def train(stats: DataFrame, labels: DataFrame, key: str, label: str, rows: int = TRAINING_ROWS) -> Forest:
    """A forest from the labelled rows (0 or 1; null labels and keys count for nothing) of `stats` (key, stats).

    Of more than `rows` labelled rows every n-th by a hash of the key is taken, fewer than 2 * rows on average. No labels, or one
    label only, give a constant score.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    share = max(1, known.count() // rows)
    sample = materialise(known.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0), "labels")
    found = stats.join(F.broadcast(sample), "key").select("stats", "label").toArrow()  # the sample's size is bounded
    flat = found.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return fit(flat.reshape(-1, len(STATISTICS)), found.column(1).to_numpy())


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """key and score (0 to 1, higher: label 1 likelier) of every row of `stats`."""
    schema = T.StructType([stats.schema["key"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(walk(forest, x))], schema.names)

    return stats.select("key", "stats").mapInArrow(run, schema)


def classify(df: DataFrame, key: str, text: str, labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """key and score of every row of `df`, learned from `labels`, which has the same key column.

    Null and empty texts are scored like others; null keys are scored but teach nothing; repeated rows stay. An empty table gives
    no rows. Only the named columns are read.
    """
    stats = materialise(measured(df, key, text), "stats")
    return score(stats, train(stats, labels, key, label, rows))


@query("op12_boosted_quality")
def op12_boosted_quality(spark, sf_dir):
    def remainder(name: str):
        return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(3))

    taught = table(spark, sf_dir, "labels").where(remainder("doc_id") != 1)
    found = classify(table(spark, sf_dir, "documents"), "doc_id", "text", taught, "quality")
    return found.select(F.col("key").alias("doc_id"), (remainder("key") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
