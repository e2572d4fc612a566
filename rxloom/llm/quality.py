"""Host-level quality rules: failure rates per host, shrunk by an empirical beta prior, joined back to documents.

Every document is measured once. Per rule, the hosts' failure rates give a beta prior by the method of
moments; a host whose posterior mean rate passes the limit for any rule is rejected with all its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import query, table, texts
from rxloom.session import materialise

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that start no code point, and white space: deleted, one byte is left per code point of a word.
NOT_COUNTED = bytes(range(0x80, 0xC0)) + SPACES

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def covered_by_repeats(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    base = len(ids)
    grams = codes[:n]
    for k in range(1, width):
        if base ** (k + 1) >= 1 << 62:
            _, grams = np.unique(grams, return_inverse=True)
        grams = grams * base + codes[k:k + n]
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The base measures of one text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), covered_by_repeats(words))


def measure_documents(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    rows = df.select(F.col(key), F.col(host).cast("string").alias("host"), F.col(text))
    schema = T.StructType([T.StructField(key, rows.schema[0].dataType), T.StructField("host", T.StringType())] + [
        T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measure(t) for t in texts(b.column(2))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(found[:, i]) for i in range(len(MEASURES))]],
                                             [key, "host", *MEASURES])

    return rows.mapInArrow(run, schema)


def rules() -> dict[str, Column]:
    """Each rule is true where a document fails it."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": F.col("n_repeat_words") * 100 > n * 50,
        "symbols": F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20),
    }


def host_verdicts(measured: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row per host with n, a shrunk failure rate per rule and `host_ok`.

    The prior of a rule comes from all hosts: mean m over documents, variance v of the hosts' rates; strength
    m(1-m)/v - 1, at least 1. Hosts that never vary give a strong prior, capped at 1000 documents.
    Documents without a host form no host.
    """
    names = list(rules())
    hosts = measured.where("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(f"f_{k}") for k, c in rules().items()])
    prior = hosts.agg(
        *[(F.sum(f"f_{k}") / F.sum("n")).alias(f"m_{k}") for k in names],
        *[F.coalesce(F.var_pop(F.col(f"f_{k}") / F.col("n")), F.lit(0.0)).alias(f"v_{k}") for k in names]).first()

    def shrunk(k: str) -> Column:
        m, v = prior[f"m_{k}"] or 0.0, prior[f"v_{k}"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, 1.0), 1000.0) if v > 0 else 1000.0
        return (F.col(f"f_{k}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))

    rated = hosts.select("host", "n", *[shrunk(k).alias(f"rate_{k}") for k in names])
    return rated.withColumn("host_ok", F.greatest(*[F.col(f"rate_{k}") for k in names]) <= limit)


def judge_documents(df: DataFrame, key: str, text: str, host: str, limit: float = 0.5) -> DataFrame:
    """Measures, `base_failed`, `host_ok` and `kept` for every row.

    Null text has no words and fails; a document without a host is judged by itself; repeated rows count as
    often as they occur; an empty table gives no rows.
    """
    measured = materialise(measure_documents(df, key, text, host), "measures")
    verdicts = host_verdicts(measured, limit).select("host", "host_ok")
    r = rules()
    base = r["short"] | r["repeats"]
    return (measured.join(verdicts, "host", "left")
            .withColumn("base_failed", base).withColumn("host_ok", F.coalesce("host_ok", F.lit(True)))
            .withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
            .select(key, *MEASURES, "base_failed", "kept", "host_ok"))


_RATE = "(f_{0} + m_{0} * s_{0}) / (n + s_{0})"
_STRENGTH = "CASE WHEN v_{0} > 0 THEN least(greatest(m_{0} * (1 - m_{0}) / v_{0} - 1, 1.0), 1000.0) ELSE 1000.0 END AS s_{0}"
_NAMES = ["short", "repeats", "symbols", "word_length"]


@query("op7_host_quality", rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT *, w || ' ' || lead(w) OVER x || ' ' || lead(w, 2) OVER x AS gram FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS rep FROM g),
r AS (SELECT doc_id, rep OR coalesce(lag(rep) OVER x, false) OR coalesce(lag(rep, 2) OVER x, false) AS hit
      FROM c WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT d.doc_id, host, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
               - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN k USING (doc_id)),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE n_words < 50) AS f_short,
             count(*) FILTER (WHERE n_repeat_words * 100 > n_words * 50) AS f_repeats,
             count(*) FILTER (WHERE n_symbols > n_words) AS f_symbols,
             count(*) FILTER (WHERE word_chars < n_words * 2 OR word_chars > n_words * 20) AS f_word_length
      FROM m WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT {', '.join(f'sum(f_{k}) / sum(n) AS m_{k}, var_pop(f_{k} / n) AS v_{k}' for k in _NAMES)} FROM h),
s AS (SELECT *, {', '.join(_STRENGTH.format(k) for k in _NAMES)} FROM p),
o AS (SELECT host, greatest({', '.join(_RATE.format(k) for k in _NAMES)}) <= 0.5 AS host_ok FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
       NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND coalesce(host_ok, true) AS kept,
       coalesce(host_ok, true) AS host_ok
FROM m LEFT JOIN o USING (host)""")
def op7_host_quality(spark, sf_dir):
    return judge_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
