"""Candidate generation for string joins. Every filter here is lossless.

Similarity is the normalised insert/delete ratio r = 2*LCS/(m+n) of two strings with
m and n characters. For r >= t:

* n >= m * t/(2-t), and the same with the sides exchanged (length band);
* with d = m+n-2*LCS edits, the aligned characters form at most d+1 runs, so the
  strings share at least LCS - (q-1)(d+1) aligned q-grams. Written in s = m+n that is
  s*(t/2 - (q-1)(1-t)) - (q-1), smallest for the shortest partner;
* an aligned gram at positions i and j leaves room for at most
  min(i,j) + q + min(m-i-q, n-j-q) matched characters, which must reach t*s/2;
* LCS is at most the number of characters the strings have in common, counted with
  multiplicity, so twice that number must reach t*s.

If two strings share at least k aligned grams, then with both gram lists in one fixed
order the rarest of those shared grams survives when each side drops its last k-1 grams
(ties with the last kept gram are kept). So only those prefixes are joined. Bigrams are
used where the bound on them is positive, single characters for shorter strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxloom.functions.similarity import sorted_ratio
from rxloom.session import materialise

FREQUENT_GRAMS = 128
#: Pairs of a block up to which its texts meet by the block alone.
BLOCK_PAIRS = 1024
# Characters counted one by one for the common-character bound; all others count as one.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "
_SLOT = 3  # occurrences per character that a signature tells apart
_EPS = 1e-9
#: Similarity at which best partners are sought first, and candidates of a text that are scored before others are ruled out.
HIGH, FIRST_SCORED = 85.0, 4


def _bigram_min_length(t: float) -> int:
    """Shortest length for which the bound on shared bigrams is positive; 0 if there is none."""
    slope = (1.5 * t - 1.0) * 2.0 / (2.0 - t)
    return math.floor(1.0 / slope) + 1 if slope > 0 else 0


def _grams(text: Column, q: int) -> Column:
    """All q-grams with their start position."""
    count = F.length(text) - q + 1
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(1), count),
            lambda p: F.struct(text.substr(p, F.lit(q)).alias("gram"), (p - 1).alias("pos")),
        ),
    ).otherwise(F.array().cast("array<struct<gram:string,pos:int>>"))


def _shared(m: Column, q: int, t: float) -> Column:
    """Lower bound on aligned q-grams shared with the shortest partner of a string of length m."""
    per_char = (t / 2 - (q - 1) * (1 - t)) * 2.0 / (2.0 - t)
    return F.greatest(F.lit(1), F.ceil(m * per_char - (q - 1) - _EPS).cast("int"))


def _frequent_grams(df: DataFrame, text: str, q: int) -> DataFrame:
    """One string listing the commonest grams, rarest of them first.

    A gram's place in it (0 when absent) orders grams by rarity. Any fixed order keeps the
    join lossless, so listing only the commonest grams costs nothing but selectivity.
    """
    top = (
        df.select(F.explode(_grams(F.col(text), q)).alias("g")).groupBy("g.gram").count()
        .orderBy(F.desc("count"), "gram").limit(FREQUENT_GRAMS)
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("count", "gram"))), lambda g: g["gram"])
    return top.agg(F.array_join(listed, "\x01").alias("often"))


def _signature(text: str) -> dict[str, Column]:
    """Character counts of a column: `_lo` and `_hi` with up to three bits set per character, `_over` what goes beyond.

    Common characters of two strings are at most the bits set in both, plus the smaller `_over`.
    """
    t = f"`{text}`"
    counts = [f"(length({t}) - length(replace({t}, '{c}', '')))" for c in COUNTED] + [f"length(translate({t}, '{COUNTED}', ''))"]
    half = len(counts) // 2

    def packed(part: list[str]) -> str:
        return " + ".join(f"(shiftleft(1L, least({n}, {_SLOT})) - 1) * {1 << (_SLOT * i)}L" for i, n in enumerate(part))

    lo, hi = packed(counts[:half]), packed(counts[half:])
    return {"_lo": F.expr(lo), "_hi": F.expr(hi), "_over": F.expr(f"length({t}) - bit_count({lo}) - bit_count({hi})")}


def _gram_rows(df: DataFrame, keys: list[str], text: str, t: float, frequent: dict[int, DataFrame]) -> DataFrame:
    """One row per prefix gram: the rarest grams of a string, among which a shared one must be."""
    m2 = _bigram_min_length(t)
    m = F.length(text)
    # single characters are needed only by strings that a short partner can reach
    classes = [(1, (m * (t / (2 - t)) < m2) if m2 else F.lit(True))] + ([(2, m >= m2)] if m2 else [])
    # with blocks the same text recurs in many of them; its grams are built once
    rows = df.where(m > 0).select(text).distinct() if keys else df.where(m > 0).select(text)
    rows = rows.withColumns({f"_often{q}": frequent[q].scalar() for q, _ in classes})

    def ranked(q: int) -> Column:
        often = F.coalesce(f"_often{q}", F.lit(""))
        return F.array_sort(F.transform(
            _grams(F.col(text), q),
            lambda g: F.struct(F.instr(often, g["gram"]).alias("n"), g["gram"].alias("gram"), g["pos"].alias("pos"))))

    # separate projections: each array is built once per row, not once per use
    rows = rows.withColumns({f"_g{q}": F.when(used, ranked(q)) for q, used in classes})
    rows = rows.withColumns({f"_last{q}": F.get(f"_g{q}", m - q + 1 - _shared(m, q, t)) for q, _ in classes})

    def prefix(q: int) -> Column:
        last = F.struct(F.col(f"_last{q}.n"), F.col(f"_last{q}.gram"))
        kept = F.filter(f"_g{q}", lambda g: F.struct(g["n"], g["gram"]) <= last)
        return F.coalesce(kept, F.array().cast("array<struct<n:int,gram:string,pos:int>>"))

    kept = [prefix(q) for q, _ in classes]
    signature = _signature(text)
    rows = rows.select(text, F.concat(*kept).alias("_grams"), *[c.alias(name) for name, c in signature.items()])
    if keys:
        rows = df.join(rows, text)
    # explode_outer: explode would infer a size filter that inlines the whole array expression
    return rows.select(*keys, text, *signature, F.explode_outer("_grams").alias("_g")).select(
        *keys, text, *signature, F.col("_g.gram").alias("gram"), F.col("_g.pos").alias("pos")).where("gram IS NOT NULL")


def candidate_pairs(left: DataFrame, right: DataFrame, l_text: str, r_text: str, threshold: float, block: list[str] | None = None) -> DataFrame:
    """Distinct (block, l_text, r_text, bound) that pass every bound: all pairs with similarity >= `threshold`, and few others.

    No pair is more similar than its `bound`, which comes from the characters in common. In blocks of at most BLOCK_PAIRS
    pairs texts meet without grams, and the bound comes from their lengths.
    """
    if not block:
        return _pairs_by_grams(left, right, l_text, r_text, threshold, [])
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = left.select(*block, one.alias("_l"), none.alias("_r")).unionByName(right.select(*block, none.alias("_l"), one.alias("_r")))
    large = materialise(rows.groupBy(*block).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).where(F.col("_l") * F.col("_r") > BLOCK_PAIRS).select(*block), "blocks")
    if large.isEmpty():
        return _pairs_by_block(left, right, l_text, r_text, threshold, block)
    few, many = ([x.join(large, block, how) for x in (left, right)] for how in ("left_anti", "left_semi"))
    return _pairs_by_block(*few, l_text, r_text, threshold, block).unionByName(_pairs_by_grams(*many, l_text, r_text, threshold, block))


def _pairs_by_block(left: DataFrame, right: DataFrame, l_text: str, r_text: str, threshold: float, block: list[str]) -> DataFrame:
    m, n = F.length(l_text), F.length(r_text)
    bound = F.least(m, n) * 200.0 / (m + n)
    return (left.select(*block, l_text).where(m > 0).join(right.select(*block, r_text).where(n > 0), block)
            .select(*block, l_text, r_text, bound.alias("bound")).where(F.col("bound") >= threshold - 1e-6))


def _pairs_by_grams(left: DataFrame, right: DataFrame, l_text: str, r_text: str, threshold: float, block: list[str]) -> DataFrame:
    t = threshold / 100.0
    m2 = _bigram_min_length(t)
    frequent = {q: _frequent_grams(right, r_text, q) for q in (1, 2)}
    own = ["pos", "_lo", "_hi", "_over"]
    lg = _gram_rows(left, block, l_text, t, frequent).withColumnsRenamed({c: f"l{c}" for c in own})
    rg = _gram_rows(right, block, r_text, t, frequent).withColumnsRenamed({c: f"r{c}" for c in own})
    m, n, q = F.length(l_text), F.length(r_text), F.length("gram")
    half = (m + n) * (t / 2) - _EPS
    near = F.least(m, n) >= F.greatest(m, n) * (t / (2 - t)) - _EPS
    by_length = (q == 2) | (F.least(m, n) < m2) if m2 else F.lit(True)
    room = F.least("lpos", "rpos") + q + F.least(m - F.col("lpos") - q, n - F.col("rpos") - q)
    common = (F.bit_count(F.col("l_lo").bitwiseAND(F.col("r_lo"))) + F.bit_count(F.col("l_hi").bitwiseAND(F.col("r_hi"))) + F.least("l_over", "r_over"))
    return (lg.join(rg, [*block, "gram"]).where(near & by_length & (common >= half) & (room >= half))
            .select(*block, l_text, r_text, (common * 200.0 / (m + n)).alias("bound")).distinct())


def fuzzy_pairs(
    left: DataFrame, right: DataFrame, l_text: str, r_text: str, threshold: float, block: list[str] | None = None
) -> DataFrame:
    """All pairs of distinct token-sorted strings with similarity >= `threshold` (0..100).

    `left` and `right` hold one row per (block, text). Returns block, l_text, r_text, score.
    """
    pairs = candidate_pairs(left, right, l_text, r_text, threshold, block)
    return pairs.drop("bound").withColumn("score", sorted_ratio(F.col(l_text), F.col(r_text))).where(F.col("score") >= threshold)


def best_pairs(
    left: DataFrame, right: DataFrame, l_text: str, r_text: str, threshold: float, block: list[str] | None = None
) -> DataFrame:
    """Of `fuzzy_pairs` each left text's most similar partners (all that are equally similar), without scoring all pairs.

    First partners are sought at HIGH, where few pairs are candidates: a text that has one there needs no other. For the rest
    the FIRST_SCORED candidates with the largest bounds are scored; others only if their bound reaches the best score found.
    """
    key = [*(block or []), l_text]
    if threshold + 5 >= HIGH:
        return _best_at(left, right, l_text, r_text, threshold, block or [])
    close = materialise(_best_at(left, right, l_text, r_text, HIGH, block or []), "best")
    rest = left.join(close.select(*key).distinct(), key, "left_anti")
    return close.unionByName(_best_at(rest, right, l_text, r_text, threshold, block or []))


def _best_at(left: DataFrame, right: DataFrame, l_text: str, r_text: str, threshold: float, block: list[str]) -> DataFrame:
    key = [*block, l_text]
    pairs = materialise(candidate_pairs(left, right, l_text, r_text, threshold, block), "candidates")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("bound"), r_text))
    first = pairs.withColumn("place", place).where(F.col("place") <= FIRST_SCORED).drop("place")
    score = sorted_ratio(F.col(l_text), F.col(r_text)).alias("score")
    seen = materialise(first.select(*key, r_text, score), "scored")
    low = seen.groupBy(*key).agg(F.max("score").alias("low"))
    rest = pairs.join(low, key).where(F.col("bound") >= F.greatest("low", F.lit(threshold)) - 1e-6).join(seen.select(*key, r_text), [*key, r_text], "left_anti")
    scored = seen.unionByName(rest.select(*key, r_text, score)).where(F.col("score") >= threshold)
    return scored.withColumn("place", F.rank().over(Window.partitionBy(*key).orderBy(F.desc("score")))).where("place = 1").drop("place")


def substring_first(queries: DataFrame, names: DataFrame) -> DataFrame:
    """For each `needle`, the smallest `id` among `names(name, id)` whose name contains it.

    Needles of up to three characters read the answer from a (gram -> smallest id)
    aggregate. Longer ones meet the postings of their rarest trigram and are verified.
    """
    ids = names.groupBy("name").agg(F.min("id").alias("id"))

    def distinct_grams(col: str, q: int) -> Column:
        return F.array_distinct(F.transform(_grams(F.col(col), q), lambda g: g["gram"]))

    short = queries.where(F.length("needle").between(1, 3)).select("needle").distinct()
    short_hits = (
        ids.select(
            "id", F.explode(F.concat(*[distinct_grams("name", q) for q in (1, 2, 3)])).alias("needle")
        )
        .groupBy("needle")
        .agg(F.min("id").alias("id"))
        .join(short, "needle")
    )
    postings = ids.select("id", "name", F.explode(distinct_grams("name", 3)).alias("gram"))
    sizes = postings.groupBy("gram").agg(F.count("*").alias("n"))
    long = queries.where(F.length("needle") > 3).select("needle").distinct()
    rarest = (
        long.select("needle", F.explode(distinct_grams("needle", 3)).alias("gram"))
        .join(sizes, "gram", "left")
        .groupBy("needle")
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("absent"))
        .where("absent = 0")
    )
    long_hits = (
        rarest.join(postings, "gram")
        .where(F.contains("name", "needle"))
        .groupBy("needle")
        .agg(F.min("id").alias("id"))
    )
    return short_hits.select("needle", "id").unionByName(long_hits.select("needle", "id"))


def like_first(queries: DataFrame, names: DataFrame) -> DataFrame:
    """For each pattern `needle`, the smallest `id` among `names(name, id)` that have it somewhere, % and _ being wildcards.

    A pattern's literal pieces must all occur, so it meets the postings of the rarest gram of its pieces: of three
    characters, or of as many as its longest piece has. The pattern is checked on those names only. Patterns of wildcards
    alone ask for a least length, which a table of the smallest id by length answers. A backslash makes the next
    character literal.
    """
    ids = names.groupBy("name").agg(F.min("id").alias("id"))

    def grams_of(text: Column, q: Column | int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda p: text.substr(p, F.lit(q) if isinstance(q, int) else q))

    patterns = queries.select("needle").distinct()
    pieces = F.filter(F.split("needle", r"[%_\\]"), lambda x: x != "")
    cut = patterns.withColumn("pieces", pieces).withColumn(
        "q", F.least(F.lit(3), F.coalesce(F.array_max(F.transform("pieces", F.length)), F.lit(0))))
    literal = cut.where("q > 0")
    long_enough = F.filter("pieces", lambda x: F.length(x) >= F.col("q"))
    grams = literal.select("needle", F.explode(F.array_distinct(F.flatten(F.transform(long_enough, lambda x: grams_of(x, F.col("q")))))).alias("gram"))
    of_name = [F.when(F.length("name") >= q, grams_of(F.col("name"), q)).otherwise(F.array().cast("array<string>")) for q in (1, 2, 3)]
    postings = ids.select("id", "name", F.explode(F.array_distinct(F.concat(*of_name))).alias("gram"))
    sizes = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(sizes, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("absent")).where("absent = 0")
    hits = rarest.join(postings, "gram").where(F.like("name", F.concat(F.lit("%"), F.col("needle"), F.lit("%"))))
    found = hits.groupBy("needle").agg(F.min("id").alias("id"))
    lengths = ids.groupBy(F.length("name").alias("chars")).agg(F.min("id").alias("id"))
    least = lengths.select("id", F.explode(F.sequence(F.lit(0), F.col("chars"))).alias("chars")).groupBy("chars").agg(F.min("id").alias("id"))
    bare = cut.where("q = 0").select("needle", F.length(F.regexp_replace("needle", "%", "")).alias("chars"))
    return found.unionByName(bare.join(least, "chars").select("needle", "id"))
