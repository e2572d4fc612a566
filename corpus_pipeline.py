"""Corpus preparation from raw documents to packed training sequences, one stored table per stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.llm import decontaminate, langid, near_text, packing, substrings
from rxloom.session import new_path

#: A document whose best language has a lower posterior is rejected, like one without a letter.
LEAST_SCORE = 0.5

#: SQL has neither the language model nor XXH64 and packing; the run is tested against a brute-force version.
ORACLE_SQL = None


def id_key(name: str) -> Column:
    """An id to join on, null ids being equal to each other."""
    return F.coalesce(F.col(name), F.lit(-(1 << 63)))


def text_key(name: str) -> Column:
    """The hash of a text, null being empty."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null texts and texts without a letter go."""
    languages, prob = langid.train(docs, "doc_id", "text", "lang")
    found = langid.predict(docs, "text", languages, prob)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard similarity of 0.8 or more one row, that with the smallest id."""
    kept = near_text.group_firsts(docs, "doc_id", "text").select(id_key("key").alias("k_id"), F.col("th").alias("k_text"))
    # An id alone does not name a row: it may be null or repeated.
    keyed = docs.withColumns({"k_id": id_key("doc_id"), "k_text": text_key("text")})
    return keyed.join(kept, ["k_id", "k_text"], "left_semi").dropDuplicates(["k_id", "k_text"]).select(docs.columns)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated strings; a character cut in two goes, `n_chars` follows the text."""
    out = substrings.remove_repeats(docs, "doc_id", "text", as_text=True).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # The decision depends on the text alone, and an id may be null or repeated.
    found = decontaminate.contamination(docs.select(text_key("text").alias("k_text"), "text"), "k_text", "text", items, "item_id", "text")
    bad = found.where("contaminated").select("k_text").distinct()
    return docs.withColumn("k_text", text_key("text")).join(bad, "k_text", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, with their ids."""
    return packing.pack(docs, "doc_id", "text")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_text", repeated_text_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each one's result is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
