"""Term indexes of a catalogue, stored by version and kept up by the rows that change.

A version holds the texts (`docs`), how often each distinct text occurs (`folded`), and per kind of token the document frequencies
(`df`). Term counts are kept once per distinct text ever seen, in one part per version (`counts`). A change tokenises
only texts that no earlier version has, and corrects the frequencies by the counts of texts whose number of copies has changed.
Weights depend on all frequencies; they are computed from the counts on a version's first use and stored with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.operators.index import Bm25Index, TfidfIndex, block_postings, bm25_of, space_tokens, tfidf_idf, unit_vectors, word_tokens

#: Kinds of tokens: words, words and word pairs, white-space tokens.
KINDS = ("words", "pairs", "spaces")


def _tokens(kind: str) -> Column:
    return space_tokens("text") if kind == "spaces" else word_tokens("text", 2 if kind == "pairs" else 1)


class CatalogueIndex:
    """Index over `corpus(id, text)` in the folder `path`. Ids are distinct. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS):
        self.spark, self.path, self.kinds = spark, path.rstrip("/"), kinds

    def _exists(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self._read(name)

    def version(self) -> int | None:
        """The newest complete version; `sizes` is written last."""
        n = 0
        while self._exists(f"v{n}/sizes"):
            n += 1
        return n - 1 if n else None

    def _parts(self, name: str, version: int) -> DataFrame:
        """What all versions up to this one have stored under a name."""
        return self.spark.read.parquet(*[f"{self.path}/v{v}/{name}" for v in range(version + 1)])

    def build(self, corpus: DataFrame) -> int:
        """The first version."""
        if self.version() is not None:
            raise ValueError(f"{self.path} has an index already; apply changes to it")
        return self._store(corpus.select("id", "text"), None)

    def apply(self, changes: DataFrame) -> int:
        """A new version after `changes(id, text)`: new or edited rows, and ids without a text that are deleted."""
        before = self.version()
        if before is None:
            return self.build(changes.where("text IS NOT NULL"))
        kept = self._read(f"v{before}/docs").join(changes.select("id"), "id", "left_anti")
        return self._store(kept.unionByName(changes.where("text IS NOT NULL").select("id", "text")), before)

    def _store(self, docs: DataFrame, before: int | None) -> int:
        now = 0 if before is None else before + 1
        docs = self._write(docs, f"v{now}/docs")
        key = F.sha2("text", 256).alias("key")
        folded = docs.groupBy(key).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("text").alias("text"))
        folded = self._write(folded.withColumn("dl", F.size(space_tokens("text"))), f"v{now}/folded")
        old = None if before is None else self._read(f"v{before}/folded")
        changed = folded.select("key", "copies") if old is None else folded.select("key", F.col("copies").alias("new")).join(
            old.select("key", F.col("copies").alias("old")), "key", "full").select("key", (F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("copies")).where("copies <> 0")
        changed = self._write(changed, f"v{now}/changed")
        fresh = folded if before is None else folded.join(self._parts("seen", before), "key", "left_anti")
        self._write(fresh.select("key"), f"v{now}/seen")
        for kind in self.kinds:
            counts = fresh.select("key", F.explode(_tokens(kind)).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
            self._write(counts, f"v{now}/counts-{kind}")
            moved = self._parts(f"counts-{kind}", now).join(changed, "key").groupBy("term").agg(F.sum("copies").alias("df"))
            if before is not None:
                moved = self._read(f"v{before}/df-{kind}").unionByName(moved).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            self._write(moved, f"v{now}/df-{kind}")
        self._write(folded.agg(F.sum("copies").alias("n"), (F.sum(F.col("copies") * F.col("dl")) / F.sum("copies")).alias("avgdl")), f"v{now}/sizes")
        return now

    def _current(self, kind: str, version: int) -> DataFrame:
        folded = self._read(f"v{version}/folded").select("key", "id", "copies", "dl")
        return self._parts(f"counts-{kind}", version).join(folded, "key").select("id", "copies", "dl", "term", "tf")

    def tfidf(self, max_ngram: int = 1) -> TfidfIndex:
        """The TF-IDF index of the newest version; stored on first use, only read afterwards."""
        version, kind = self.version(), "pairs" if max_ngram == 2 else "words"
        name = f"tfidf{max_ngram}"
        if not self._exists(f"v{version}/{name}-vectors"):
            size = self._read(f"v{version}/sizes").select("n").scalar()
            idf = self._write(tfidf_idf(self._read(f"v{version}/df-{kind}"), size), f"v{version}/{name}-idf")
            self._write(unit_vectors(self._current(kind, version), idf, "id"), f"v{version}/{name}-vectors")
        return TfidfIndex(self._read(f"v{version}/{name}-idf"), self._read(f"v{version}/{name}-vectors"), max_ngram)

    def bm25(self) -> Bm25Index:
        """The BM25 index of the newest version; stored on first use, only read afterwards."""
        version = self.version()
        if not self._exists(f"v{version}/bm25-blocks"):
            sizes = self._read(f"v{version}/sizes")
            made = bm25_of(self._current("spaces", version), self._read(f"v{version}/df-spaces"), sizes.select("n").scalar(), sizes.select("avgdl").scalar(), store=False)
            postings = self._write(made.postings, f"v{version}/bm25-postings")
            bounds = self._write(postings.groupBy("term").agg(F.max("gain").alias("bound")), f"v{version}/bm25-terms")
            self._write(block_postings(postings, bounds), f"v{version}/bm25-blocks")
        return Bm25Index(*(self._read(f"v{version}/bm25-{k}") for k in ("terms", "postings", "blocks")))
