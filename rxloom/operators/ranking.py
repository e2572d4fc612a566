"""First-per-key, top-per-key, ordered distinct and pages.

Top-k filters on row_number() let Spark limit each key before the shuffle
(WindowGroupLimit), so a key that holds a third of the rows never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first `k` rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def ordered_distinct(df: DataFrame, col: str, pos: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(col).agg(F.min(pos).alias(pos))


def mark_duplicates(df: DataFrame, key: str, name: str, pos: str, ignore: list[str]) -> DataFrame:
    """Add is_duplicate and duplicate_of: the first holder of a key wins."""
    usable = F.col(key).isNotNull() & (F.col(key) != "") & ~F.col(key).isin(ignore)
    first = (
        df.where(usable)
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(F.struct(F.col(pos).alias("pos"), F.col(name).alias("name"))).alias("_first"))
    )
    later = F.col("_first").isNotNull() & (F.col(pos) != F.col("_first.pos"))
    return (
        df.join(first, usable & (F.col(key) == F.col("_key")), "left")
        .withColumn("is_duplicate", later)
        .withColumn("duplicate_of", F.when(later, F.col("_first.name")))
        .drop("_key", "_first")
    )


def page_of(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def with_total(page: DataFrame, whole: DataFrame) -> DataFrame:
    """Add the row count of the unpaged listing."""
    return page.withColumn("total", whole.agg(F.count("*")).scalar())


def contains_text(needle: str, *cols: str, like: bool = False) -> Column:
    """Case-blind substring test over several columns; `like` honours % and _ in the needle."""
    low = needle.strip().lower()
    test = F.lit(False)
    for c in cols:
        value = F.lower(F.coalesce(c, F.lit("")))
        test = test | (value.like(f"%{low}%") if like else F.contains(value, F.lit(low)))
    return test


def union_ordered(*frames: DataFrame, value: str, pos: str, cap: int | None = None) -> DataFrame:
    """Ordered distinct union: values in the order of the frames, then of `pos`.

    `cap` keeps the first values only, as a link list of limited length does.
    """
    tagged = [f.select(value, F.struct(F.lit(i).alias("frame"), F.col(pos).alias("pos")).alias("_at")) for i, f in enumerate(frames)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    out = rows.groupBy(value).agg(F.min("_at").alias("_at"))
    if cap is not None:
        out = out.orderBy("_at", value).limit(cap)
    return out.select(value, F.col("_at.frame").alias("frame"), F.col("_at.pos").alias(pos))
