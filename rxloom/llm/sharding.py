"""Hilbert-curve sharding: quantise metadata dimensions, order rows along the curve, cut runs of equal row count.

Rows that are close in every dimension end up in the same shard, so the minimum and maximum of each
dimension per file prune well. Only DataFrame and SQL functions are used; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxloom.llm.common import query, table
from rxloom.session import materialise


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Next state and curve digit for each (state, cell corner), derived from the Gray-code rule of the curve.

    A state is (entry corner e, direction d) as e * dims + d; an entry of the tables is state * 2**dims + corner.
    """
    n, mask = dims, (1 << dims) - 1

    def rotate_right(x: int, k: int) -> int:
        k %= n
        return ((x >> k) | (x << (n - k))) & mask

    def trailing_ones(x: int) -> int:
        return ((x ^ (x + 1)).bit_length() - 1) if x >= 0 else 0

    nxt, digit = [], []
    for e in range(1 << n):
        for d in range(n):
            for corner in range(1 << n):
                t = rotate_right(corner ^ e, d + 1)
                w = t
                for s in range(1, n):
                    w ^= t >> s
                entry = 0 if w == 0 else (2 * ((w - 1) // 2)) ^ (2 * ((w - 1) // 2) >> 1)
                step = 0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % n
                nxt.append((e ^ rotate_right(entry, n - (d + 1) % n)) * n + (d + step + 1) % n)
                digit.append(w)
    return nxt, digit


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell with coordinates of `bits` bits each."""
    n = len(cells)
    nxt, digit = (F.array(*map(F.lit, t)) for t in curve_tables(n))
    levels = F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)])
    step = 1 << n

    def corner(level: Column) -> Column:
        out = F.lit(0)
        for j, c in enumerate(cells):
            out = out + (F.call_function("shiftright", c, level).bitwiseAND(1)) * (1 << j)
        return out

    def walk(acc: Column, level: Column) -> Column:
        at = (acc["s"] * step + corner(level)).cast("int")
        return F.struct(F.get(nxt, at).alias("s"), (acc["h"] * step + F.get(digit, at)).cast("long").alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(levels, start, walk, lambda acc: acc["h"])


def quantise(code: Column, bounds: list, bits: int) -> Column:
    """How many of the sorted bounds are at most the code, by binary search over at most 2**bits bounds; 0 for null."""
    if not bounds:
        return F.lit(0)
    full = F.array(*[F.lit(b) for b in bounds])
    n = len(bounds)
    levels = F.array(*[F.lit(1 << i) for i in range(bits, -1, -1)])
    found = F.aggregate(
        levels, F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.get(full, F.least(at + s, F.lit(n)) - 1) <= code), at + s).otherwise(at))
    return F.coalesce(F.least(found, F.lit((1 << bits) - 1)), F.lit(0))


def number_bounds(df: DataFrame, name: str, bits: int) -> list[float]:
    """Approximate quantiles of a column as numbers, null being -1."""
    cuts = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    return sorted(set(df.agg(F.percentile_approx(numeric(name), cuts, 10_000).alias("q")).first()[0] or []))


def numeric(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(-1.0))


def string_bounds(df: DataFrame, names: list[str], bits: int) -> dict[str, list[str]]:
    """Per column the whole strings at which the rows, in order of the string, pass another 2**-bits of all rows; 2**bits at most.

    Distinct values and their counts are sorted in ranges over all tasks; a value's place is its range's offset plus the sum inside.
    """
    if not names:
        return {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(c).alias("v")) for i, c in enumerate(names)])).alias("x")).select("x.*")
    counts = values.where("v IS NOT NULL").groupBy("d", "v").agg(F.count("*").alias("n"))
    ranged = materialise(counts.repartitionByRange(parts, "d", "v").withColumn("part", F.spark_partition_id()), "values")
    before = Window.partitionBy("d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("d", "part").agg(F.sum("n").alias("s")).select(
        "d", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy("d")).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("d", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("end", inside).join(offsets, ["d", "part"]).withColumn("end", F.col("before") + F.col("end"))
    passed = placed.where(F.expr(f"end * {1 << bits} div total > (end - n) * {1 << bits} div total"))
    found: dict[str, list[str]] = {c: [] for c in names}
    for r in passed.select("d", "v").collect():
        found[names[r["d"]]].append(r["v"])
    return {c: sorted(v, key=str.encode) for c, v in found.items()}


def hilbert_shards(df: DataFrame, dims: list[str], order_by: str, shards: int, bits: int = 6) -> DataFrame:
    """All rows of `df` with `shard`, `slot` and `curve`; shard sizes differ by one row at most.

    Each dimension is cut at its (for numbers approximate) quantiles into 2**bits cells; strings are compared whole. Rows are range-partitioned by
    (curve, order_by); a row's rank is its partition's offset plus its place there, so no task sees all rows
    and only one count per partition is gathered. Nulls form the lowest cell; an empty table gives no rows;
    repeated rows are ordinary rows. Names that clash with the three new columns are an error.
    """
    taken = {"shard", "slot", "curve"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns already present: {sorted(taken)}")
    kinds = dict(df.dtypes)
    text = [kinds[d] == "string" for d in dims]
    strings = string_bounds(df, [d for d, t in zip(dims, text, strict=True) if t], bits)
    bounds = [strings[d] if t else number_bounds(df, d, bits) for d, t in zip(dims, text, strict=True)]
    cells = [quantise(F.col(d) if t else numeric(d), b, bits) for d, t, b in zip(dims, text, bounds, strict=True)]
    keyed = materialise(df.select(F.struct("*").alias("row"), F.col(order_by).alias("key"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
                        .select("row", "key", hilbert_index([F.col(f"c{i}") for i in range(len(cells))], bits).alias("curve")), "curve")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(
        keyed.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key")
        .withColumn("mono", F.monotonically_increasing_id())
        .select("row", "curve", F.shiftright("mono", 33).alias("part"), F.col("mono").bitwiseAND((1 << 33) - 1).alias("place")), "ranged")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(everything).alias("total"))
    rank = F.col("before") + F.col("place")
    shard = F.expr(f"(before + place) * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (ranged.join(offsets, "part").withColumn("shard", shard)
            .select("row.*", F.col("shard").cast("int").alias("shard"), (rank - first).alias("slot"), "curve"))


@query("op5_hilbert_shards")
def op5_hilbert_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source", "n_chars")
    out = hilbert_shards(docs, ["lang", "source", "n_chars"], "doc_id", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")
