"""URL rules looked up in a sorted digest array.

Rule strings (host + path prefix) are hashed with XXH64 and sorted. The array, the strings and the actions are
written to one file that Spark ships to every executor, where all tasks memory-map the same copy. A URL
probes every (parent host, path prefix) it has with one vectorised binary search per batch, and a hit
counts only if the stored string is equal, so colliding digests cannot give a wrong verdict.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rxloom.llm.common import query, table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: The rules of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:]
    ends = [i for i in map(path.find, "?#") if i >= 0]
    return rest[:cut].translate(UPPER), path[:min(ends, default=len(path))]


class DigestIndex:
    """Sorted 64-bit digests of the rule strings, with strings and actions in the same order."""

    def __init__(self, buffer: np.ndarray):
        n, lengths = (int(x) for x in buffer[:16].view(np.int64))
        at = 16
        self.digests = buffer[at:at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = buffer[at:at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.path_lengths = buffer[at:at + 8 * lengths].view(np.int64).tolist()
        at += 8 * lengths
        self.host_lengths = buffer[at:at + 8 * n].view(np.int64)
        at += 8 * n
        self.allows = buffer[at:at + n]
        self.blob = buffer[at + n:]

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """Serialise (action, host, path) rules; of a repeated host and path the first action holds."""
        seen: dict[tuple[str, str], str] = {}
        for action, host, path in rules:
            seen.setdefault((host.translate(UPPER), path), action)
        rows = sorted((xxhash.xxh64_intdigest(f"{h}\n{p}"), h, p, a) for (h, p), a in seen.items())
        strings = [f"{h}{p}".encode() for _, h, p, _ in rows]
        paths = sorted({len(p) for _, _, p, _ in rows})
        return b"".join([
            np.array([len(rows), len(paths)], np.int64).tobytes(),
            np.array([r[0] for r in rows], np.uint64).tobytes(),
            np.cumsum([0, *map(len, strings)], dtype=np.int64).tobytes(),
            np.array(paths, np.int64).tobytes(),
            np.array([len(h.encode()) for _, h, _, _ in rows], np.int64).tobytes(),
            np.array([a == "allow" for *_, a in rows], np.uint8).tobytes(), *strings])

    @staticmethod
    def open(path: str) -> DigestIndex:
        return DigestIndex(np.memmap(path, np.uint8, "r"))

    def judge(self, urls: list[str | None], default: str) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each URL; the longest fitting rule string wins, then the longer host."""
        parts = [split_url(u) for u in urls]
        owner, hosts, paths, keys = [], [], [], []
        for i, (host, path) in enumerate(parts):
            parents = []
            while host:
                parents.append(host)
                _, dot, host = host.partition(".")
                if not dot:
                    break
            for size in self.path_lengths:
                if size <= len(path):
                    head = path[:size]
                    for parent in parents:
                        owner.append(i)
                        hosts.append(parent)
                        paths.append(head)
                        keys.append(xxhash.xxh64_intdigest(f"{parent}\n{head}"))
        wanted = np.array(keys, np.uint64)
        first = np.searchsorted(self.digests, wanted)
        last = np.searchsorted(self.digests, wanted, "right")
        best: dict[int, tuple[int, int, str, int]] = {}
        for k in np.flatnonzero(last > first).tolist():
            host, path = hosts[k].encode(), paths[k].encode()
            for r in range(int(first[k]), int(last[k])):
                stored = self.blob[self.offsets[r]:self.offsets[r + 1]].tobytes()
                if stored == host + path and self.host_lengths[r] == len(host):
                    rank = (len(hosts[k]) + len(paths[k]), len(hosts[k]), hosts[k] + paths[k], r)
                    best[owner[k]] = max(best.get(owner[k], rank), rank)
        out = []
        for i, (host, path) in enumerate(parts):
            hit = best.get(i)
            out.append((host, path, hit[2] if hit else None, ("allow" if self.allows[hit[3]] else "block") if hit else default))
        return out


def ship(spark: SparkSession, payload: bytes) -> str:
    """Send one file to every executor, those that start later too, and return its name there."""
    name = f"rules-{hashlib.sha1(payload).hexdigest()}.idx"
    path = os.path.join(tempfile.gettempdir(), name)
    if not os.path.exists(path):
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(payload)
        os.replace(f"{path}.{os.getpid()}", path)
    spark.sparkContext.addFile(path)
    return name


def filter_urls(df: DataFrame, key: str, url: str, rules: Iterable[tuple[str, str, str]], default: str = "allow",
                max_index_bytes: int = 4 << 30) -> DataFrame:
    """`key`, host, path, rule and verdict for every row.

    Null URLs and those without `://` have empty host and path and get the default verdict; repeated rows are
    judged alike; other columns are not read. An index over `max_index_bytes` is an error: split the rules
    by host digest and run once per part.
    """
    payload = DigestIndex.build(rules)
    if len(payload) > max_index_bytes:
        raise ValueError(f"the rule index takes {len(payload)} bytes; the bound is {max_index_bytes}")
    name = ship(df.sparkSession, payload)
    rows = df.select(key, url)
    schema = T.StructType([T.StructField(key, rows.schema[0].dataType)] + [
        T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex.open(SparkFiles.get(name))
        for b in batches:
            columns = list(zip(*index.judge(b.column(1).to_pylist(), default), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in columns]],
                                             [key, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judged, schema)


@query("op2_url_filter", """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT p.page_id, p.host, p.path, r.action, r.rhost || r.rpath AS rule,
               row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS k
        FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1""")
def op2_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), "page_id", "url", RULES)
