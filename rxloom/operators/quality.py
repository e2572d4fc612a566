"""Catalogue quality: deduplication, profiles, candidate merging, match quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.text import strip
from rxloom.operators.ranking import first_per_key


def dedupe_by_completeness(df: DataFrame, key: str, pos: str, null_key_collapses: bool = False) -> DataFrame:
    """Best-filled row per key; text trimmed. Rows without a key all stay unless told to collapse to one."""
    cols = [c for c in df.columns if c != pos]
    text = {c for c, t in df.dtypes if t == "string"}
    clean = df.select(*[strip(c).alias(c) if c in text else F.col(c) for c in df.columns])

    def filled(c: str) -> Column:
        value = F.col(c).cast("string")
        return (value.isNotNull() & (F.trim(value) != "") & (F.lower(value) != "nan")).cast("int")

    score = reduce(lambda a, b: a + b, [filled(c) for c in cols])
    scored = clean.withColumn("_score", score)
    order = [F.desc("_score"), F.col(pos)]
    if null_key_collapses:
        return first_per_key(scored, [key], order).drop("_score")
    with_key = first_per_key(scored.where(F.col(key).isNotNull()), [key], order)
    return with_key.unionByName(scored.where(F.col(key).isNull())).drop("_score")


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, surplus rows, keys held more than once."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"), F.count_if(F.col("n") > 1).alias("repeated_keys"),
    )


def duplicate_groups(df: DataFrame, key: str, samples: int = 5) -> DataFrame:
    """The largest groups of equal keys."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        .orderBy(F.desc("n"), key).limit(samples)
    )


def _joined(col: str) -> Column:
    """Distinct non-empty values of a group, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(col, F.lit("")))), " | ")


def merge_candidates(candidates: DataFrame, joined: list[str], first: list[str]) -> DataFrame:
    """Merge candidate records (query, pos, so_dang_ky, ...) into one record per query.

    The registration number with most candidates wins (earliest among equals); its
    candidates' distinct values are joined, the first one supplies name and form. Without
    any number the first candidate stands alone.
    """
    has = F.coalesce(F.col("so_dang_ky"), F.lit("")) != ""
    groups = candidates.where(has).groupBy("query", "so_dang_ky").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"),
        *[_joined(c).alias(c) for c in joined], *[F.min_by(c, "pos").alias(c) for c in first],
    )
    fields = ["so_dang_ky", *joined, *first]
    best = groups.groupBy("query").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "first_pos", *fields)).alias("b")
    ).select("query", *[F.col(f"b.{c}").alias(c) for c in fields])
    rest = candidates.join(best.select("query"), "query", "left_anti")
    alone = rest.groupBy("query").agg(F.min_by(F.struct(*joined, *first), "pos").alias("b")).select(
        "query", F.lit("Web Result (No SDK)").alias("so_dang_ky"), *[F.col(f"b.{c}").alias(c) for c in [*joined, *first]])
    return best.unionByName(alone).withColumn("confidence", F.lit(0.8))


def consolidate_sources(results: DataFrame, fields: list[str]) -> DataFrame:
    """First result of a query that has a registration number, else its first result."""
    missing = F.coalesce(F.col("sdk"), F.lit("")).isin("", "Not Found", "Đang cập nhật").cast("int")
    best = results.groupBy("query").agg(F.min_by(F.struct("sdk", *fields), F.struct(missing, "pos")).alias("b"))
    shown = F.when(F.col("b.sdk") == "Not Found", "Đang cập nhật").otherwise(F.col("b.sdk"))
    return best.select("query", shown.alias("sdk"), *[F.col(f"b.{f}").alias(f) for f in fields])


def code_frequency(rows: DataFrame, code: str, top: int = 30) -> DataFrame:
    return rows.where(F.col(code) != "").groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code).limit(top)


def match_quality(predicted: DataFrame, labels: DataFrame, key: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and error rates of predicted(key, hit) against labels(key, truth), both 0/1; a row per `by` of the predictions."""
    j = predicted.join(labels, key)
    hit, truth = F.col("hit") == 1, F.col("truth") == 1
    c = j.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit == truth).alias("right"), F.count_if(hit & ~truth).alias("fp"),
              F.count_if(~hit & truth).alias("fn"), F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))

    def rate(a: str, b: str) -> Column:
        return F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)

    return c.select(*by, "n", rate("right", "n").alias("accuracy"), rate("fp", "neg").alias("false_positive_rate"),
                    rate("fn", "pos").alias("false_negative_rate"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)
