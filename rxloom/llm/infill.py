r"""Fill-in-middle transformation with a piecewise-linear learned rank index.

A text is cut at unit boundaries (lines here): prefix, middle and suffix, written with sentinels in the order psm or spm. The
boundary offsets of a block of documents are one ascending sequence. The index fits lines to it, each as long as no
offset is farther than EPSILON from its line, and stores the residuals of two bytes each. A cut is found by rank: its line
predicts the offset, its residual corrects it exactly; all cuts of a block are looked up at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import query, table, texts

SENTINELS = ("<P>", "<S>", "<M>")
#: Largest distance of an offset from its line; residuals are stored in 16 bits.
EPSILON = 4096
#: Offsets looked at first for one line; doubled as long as the line holds.
FIRST_LOOK = 64
#: Documents whose boundaries share an index.
BLOCK = 256


class RankIndex(NamedTuple):
    """Line k covers the ranks from starts[k] on: offset = bases[k] + round(slopes[k] * (rank - starts[k])) + residuals[rank]."""

    starts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray


def predicted(index: RankIndex, ranks: np.ndarray) -> np.ndarray:
    k = np.searchsorted(index.starts, ranks, side="right") - 1
    return index.bases[k] + np.floor(index.slopes[k] * (ranks - index.starts[k]) + 0.5).astype(np.int64)


def offsets_at(index: RankIndex, ranks: np.ndarray) -> np.ndarray:
    """The exact offsets of these ranks."""
    return predicted(index, ranks) + index.residuals[ranks]


def fit_line(offsets: np.ndarray, start: int, epsilon: int) -> tuple[int, float]:
    """The end (exclusive) of the longest line from the offset at `start`, and its slope.

    Every further offset narrows the slopes that pass within epsilon of it; the line ends where none is left.
    """
    look, done, low, high = FIRST_LOOK, start + 1, -np.inf, np.inf
    while done < len(offsets):
        rise = offsets[done:done + look] - offsets[start]
        run = np.arange(done - start, done - start + len(rise))
        lows = np.maximum(np.maximum.accumulate((rise - epsilon) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + epsilon) / run), high)
        crossed = np.flatnonzero(lows > highs)
        held = int(crossed[0]) if len(crossed) else len(rise)
        if held:
            low, high = float(lows[held - 1]), float(highs[held - 1])
        done += held
        if len(crossed):
            break
        look *= 2
    return done, (low + high) / 2 if done > start + 1 else 0.0


def fit(offsets: np.ndarray, epsilon: int = EPSILON) -> RankIndex:
    """The index of ascending offsets."""
    starts, slopes, at = [], [], 0
    while at < len(offsets):
        starts.append(at)
        at, slope = fit_line(offsets, at, epsilon)
        slopes.append(slope)
    first = np.array(starts, np.int64)
    index = RankIndex(first, offsets[first].astype(np.int64), np.array(slopes), np.zeros(0, np.int16))
    residuals = offsets - predicted(index, np.arange(len(offsets)))
    return index._replace(residuals=residuals.astype(np.int16 if epsilon < 1 << 15 else np.int64))


def boundaries(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in the joined texts where a line of a text begins or ends, text by text, and the lines per text.

    A text of n lines has n + 1 boundaries: its start, and the end of each line.
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(sizes)
    breaks = np.flatnonzero(np.frombuffer(b"".join(bodies), np.uint8) == 10) + 1
    # A text that does not end in a line break ends its last line itself.
    open_ends = ends[[bool(b) and b[-1] != 10 for b in bodies]]
    lines = np.bincount(np.searchsorted(ends, breaks, side="left"), minlength=len(bodies)) + np.array([bool(b) and b[-1] != 10 for b in bodies], np.int64)
    inner = np.sort(np.concatenate([breaks, open_ends]), kind="stable")
    place = np.cumsum(lines) - lines
    return np.insert(inner, place, ends - sizes), lines


def chars(body: bytes) -> int:
    return len(body.decode("utf-8", "surrogatepass"))


def transform(df: DataFrame, key: str, text: str, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50,
              sentinels: tuple[str, str, str] = SENTINELS, epsilon: int = EPSILON) -> DataFrame:
    """key, n (lines), form, prefix_chars, middle_chars and output of every row.

    The draws are the first four 32-bit groups of the SHA-256 of `seed:key`, a null key being empty: two for the cuts, one for
    `fim_percent`, one for `spm_percent`. A text that is empty or null, or has a sentinel, is plain: output is the text, and the
    char counts are null. Repeated rows give repeated rows; an empty table gives none. Other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), digest.alias("digest")).select("key", "text", *draws)
    schema = T.StructType([T.StructField("key", rows.schema[0].dataType), *T.StructType.fromDDL(
        "n long, form string, prefix_chars long, middle_chars long, output string").fields])
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                yield changed(b.slice(at, BLOCK))

    def changed(b: pa.RecordBatch) -> pa.RecordBatch:
        bodies = texts(b.column(1))
        draw = [c.to_numpy() for c in b.columns[2:]]
        offsets, lines = boundaries(bodies)
        index = fit(offsets, epsilon)
        first = np.cumsum(lines + 1) - (lines + 1)
        cuts = np.stack([draw[0] % (lines + 1), draw[1] % (lines + 1)])
        begins = offsets_at(index, first)
        low, high = (offsets_at(index, first + c) - begins for c in (cuts.min(0), cuts.max(0)))
        forms, sizes, out = [], [], []
        for body, x, y, whole, kind in zip(bodies, low.tolist(), high.tolist(), (draw[2] % 100 >= fim_percent).tolist(), (draw[3] % 100 < spm_percent).tolist(), strict=True):
            if whole or not body or p in body or s in body or m in body:
                forms.append("plain")
                sizes.append((None, None))
                out.append(body)
                continue
            forms.append("spm" if kind else "psm")
            sizes.append((chars(body[:x]), chars(body[x:y])))
            out.append(b"".join((s, body[y:], p, body[:x], m, body[x:y]) if kind else (p, body[:x], s, body[y:], m, body[x:y])))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lines), pa.array(forms, pa.string()), *[pa.array([z[i] for z in sizes], pa.int64()) for i in (0, 1)],
                                           pa.array(out, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, found by its sentinels alone."""
    p, s, m = sentinels

    def between(a: str, b: str | None) -> Column:
        after = F.substr(output, F.instr(output, a) + F.lit(len(a)))
        return after if b is None else F.substr(after, F.lit(1), F.instr(after, b) - F.lit(1))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


@query("op13_infill_lines", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS lo, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, coalesce(array_to_string(ls[1:lo], ''), '') AS a, coalesce(array_to_string(ls[lo + 1:hi], ''), '') AS b,
             coalesce(array_to_string(ls[hi + 1:], ''), '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""")
def op13_infill_lines(spark, sf_dir):
    out = transform(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
