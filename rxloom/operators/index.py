"""Term indexes as DataFrames: TF-IDF cosine, BM25 and fielded AND search.

Both rankers prune exactly. Cosine >= t needs a shared term inside the rarest-first
prefix whose remaining norm still reaches t, on both sides. A BM25 score above t needs
a term outside the set whose summed upper bounds stay at or below t. Equal corpus
texts are folded to one row with a count before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxloom.session import materialise

BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
#: Postings in a block, levels per factor of two in gain, the last level; blocks read and documents scored for the lower bound.
BLOCK, LEVELS_PER_HALVING, LEAST_LEVEL, FIRST_BLOCKS, FIRST = 128, 4, 31, 8, 4
#: Tasks that the rows of a cosine join are dealt to, at most as many as shuffles have.
TASKS_PER_CORE = 4
FIELD_WEIGHTS = {"a": 1.0, "b": 0.4, "c": 0.2, "d": 0.1}
_EPS = 1e-9


def word_tokens(col: Column | str, max_ngram: int = 1) -> Column:
    """Lower-cased word runs, with space-joined word pairs when `max_ngram` is 2."""
    words = F.regexp_extract_all(F.lower(col), F.lit(r"(?U)\w+"), F.lit(0))
    if max_ngram == 1:
        return words
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def space_tokens(col: Column | str) -> Column:
    return F.filter(F.split(F.lower(col), r"(?U)\s+"), lambda w: w != "")


def fold_corpus(corpus: DataFrame) -> DataFrame:
    """One row per distinct text: smallest id and number of copies."""
    return corpus.groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def _term_counts(docs: DataFrame, key: list[str], tokens: Column) -> DataFrame:
    return docs.select(*key, F.explode(tokens).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


@dataclass
class TfidfIndex:
    """`idf(term, df, idf)` and unit vectors `vectors(id, term, w, rest)`.

    `rest` is the norm of the vector from this term to its most frequent one.
    """

    idf: DataFrame
    vectors: DataFrame
    max_ngram: int


def unit_vectors(terms: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    weighted = terms.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    whole = Window.partitionBy(key)
    upward = whole.orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    squared = F.col("raw") * F.col("raw")
    return weighted.select(
        key,
        "term",
        (F.col("raw") / F.sqrt(F.sum(squared).over(whole))).alias("w"),
        F.sqrt(F.sum(squared).over(upward) / F.sum(squared).over(whole)).alias("rest"),
    )


def tfidf_idf(df: DataFrame, size: Column) -> DataFrame:
    return df.withColumn("idf", F.log((F.lit(1) + size) / (F.lit(1) + F.col("df"))) + 1.0)


def tfidf_of(terms: DataFrame, df: DataFrame, size: Column, max_ngram: int, store: bool = True) -> TfidfIndex:
    """Index from `terms(id, term, tf)` of distinct texts, `df(term, df)` and the number of texts: smoothed idf, raw tf, L2 norm."""
    idf = tfidf_idf(df, size)
    if store:
        idf = materialise(idf, "idf")
    vectors = unit_vectors(terms, idf, "id")
    if store:
        vectors = materialise(vectors, "tfidf")
    return TfidfIndex(idf, vectors, max_ngram)


def build_tfidf(corpus: DataFrame, max_ngram: int = 1, store: bool = True) -> TfidfIndex:
    """Index `corpus(id, text)`: smoothed idf ln((1+n)/(1+df))+1, raw tf, L2 norm."""
    docs = fold_corpus(corpus)
    terms = _term_counts(docs, ["id", "copies"], word_tokens("text", max_ngram))
    df = terms.groupBy("term").agg(F.sum("copies").alias("df"))
    return tfidf_of(terms, df, docs.agg(F.sum("copies")).scalar(), max_ngram, store)


def _vector_rows(vectors: DataFrame, key: str, low: float, parts: int) -> DataFrame:
    """One row per `key` and `term` of its vector that may be a pair's rarest shared one, with the `rest` there.

    `before` holds the rarer terms, `entries` this one and the more frequent ones as (rest, term, w).
    """
    whole = vectors.where(F.col(key).isNotNull()).repartition(parts, key).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rest", "term", "w")), asc=False).alias("all"))
    rows = whole.select(key, "all", F.posexplode(F.filter("all", lambda e: e["rest"] >= low)).alias("pos", "e"))
    return rows.select(key, F.col("e.term").alias("term"), F.col("e.rest").alias("rest"), F.slice("all.term", 1, F.col("pos")).alias("before"),
                       F.slice("all", F.col("pos") + 1, F.size("all")).alias("entries"))


def cosine_pairs(queries: DataFrame, index: TfidfIndex, threshold: float) -> DataFrame:
    """(query, id, score) for all pairs with cosine >= `threshold`; `queries(query, text)`.

    A pair is settled in the row where its rarest shared term meets, from both vectors, so no pair is exchanged or held. Where that
    term cannot reach the threshold, no other can. Few narrow rows meet many, which their size does not tell: they are dealt to a few
    tasks per core.
    """
    spark = queries.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    terms = _term_counts(queries, ["query"], word_tokens("text", index.max_ngram))
    low = threshold - _EPS
    q = _vector_rows(unit_vectors(terms, index.idf, "query"), "query", low, parts).repartition(parts, "query", "term")
    weights = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["term"], e["w"])))
    q = q.select("query", "term", F.col("rest").alias("q_rest"), F.array_append("before", F.col("term")).alias("q_upto"), weights.alias("q_weights"))
    d = _vector_rows(index.vectors, "id", low, parts).withColumnsRenamed({"rest": "d_rest", "before": "d_before", "entries": "d_entries"})
    met = q.join(d, "term").where((F.col("q_rest") * F.col("d_rest") >= low) & ~F.arrays_overlap("q_upto", "d_before"))
    score = F.aggregate("d_entries", F.lit(0.0), lambda total, e: total + F.coalesce(F.col("q_weights")[e["term"]], F.lit(0.0)) * e["w"])
    return met.select("query", "id", F.round(score, 9).alias("score")).where(F.col("score") >= threshold)


@dataclass
class Bm25Index:
    """`terms(term, bound)`, `postings(term, id, gain)` and `blocks(term, level, top, entries)`.

    Gain is the score of one query occurrence. A block holds about BLOCK postings of a term with gains of one level (a level is a
    factor of 2 ** (1 / LEVELS_PER_HALVING) below the term's largest gain), `top` its largest gain.
    """

    terms: DataFrame
    postings: DataFrame
    blocks: DataFrame


def bm25_of(counts: DataFrame, df: DataFrame, n: Column, avgdl: Column, store: bool = True) -> Bm25Index:
    """Index from `counts(id, dl, term, tf)` of distinct texts, `df(term, df)`, the number of texts and their mean length."""
    raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    idf = raw.select("term", F.when(F.col("raw") < 0, mean * BM25_EPSILON).otherwise(F.col("raw")).alias("idf"))
    length = BM25_K1 * ((1 - BM25_B) + BM25_B * F.col("dl") / avgdl)
    gain = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + length)
    postings = counts.join(idf, "term").select("term", "id", gain.alias("gain"))
    if store:
        postings = materialise(postings, "bm25")
    bounds = postings.groupBy("term").agg(F.max("gain").alias("bound"))
    blocks = block_postings(postings, bounds)
    return Bm25Index(bounds, postings, materialise(blocks, "blocks") if store else blocks)


def build_bm25(corpus: DataFrame, store: bool = True) -> Bm25Index:
    """Okapi BM25 over white-space tokens; negative idf becomes 0.25 times the mean idf."""
    docs = fold_corpus(corpus).withColumn("dl", F.size(space_tokens("text")))
    stats = docs.agg(F.sum("copies").alias("n"), (F.sum(F.col("copies") * F.col("dl")) / F.sum("copies")).alias("avgdl"))
    counts = _term_counts(docs, ["id", "copies", "dl"], space_tokens("text"))
    df = counts.groupBy("term").agg(F.sum("copies").alias("df"))
    return bm25_of(counts, df, stats.select("n").scalar(), stats.select("avgdl").scalar(), store)


def block_postings(postings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Postings by (term, level, part): hashed parts instead of a sort, so a term of all documents is no single task's work."""
    falls = F.when(F.col("gain") > 0, F.floor(F.log2(F.col("bound") / F.col("gain")) * LEVELS_PER_HALVING)).otherwise(LEAST_LEVEL)
    levelled = postings.join(bounds, "term").select("term", "id", "gain", F.least(falls, F.lit(LEAST_LEVEL)).cast("int").alias("level"))
    sizes = levelled.groupBy("term", "level").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = levelled.join(sizes, ["term", "level"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    return dealt.groupBy("term", "level", "part").agg(F.max("gain").alias("top"), F.collect_list(F.struct("gain", "id")).alias("entries"))


def bm25_pairs(queries: DataFrame, index: Bm25Index, threshold: float) -> DataFrame:
    """(query, id, score) for all pairs scoring above `threshold`; `queries(query, text)`."""
    terms = _term_counts(queries, ["query"], space_tokens("text")).join(index.terms, "term")
    upward = Window.partitionBy("query").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.sum(F.col("tf") * F.greatest(F.col("bound"), F.lit(0.0))).over(upward)
    q = terms.select("query", "term", "tf", reach.alias("reach"))
    candidates = (
        q.where(F.col("reach") > threshold - _EPS).join(index.postings, "term").select("query", "id").distinct()
    )
    return (
        candidates.join(q.select("query", "term", "tf"), "query")
        .join(index.postings, ["id", "term"])
        .groupBy("query", "id")
        .agg(F.round(F.sum(F.col("tf") * F.col("gain")), 9).alias("score"))
        .where(F.col("score") > threshold)
    )


def bm25_scores(candidates: DataFrame, terms: DataFrame, index: Bm25Index) -> DataFrame:
    """(query, id, score) of `candidates(query, id)`; `terms(query, term, tf)`."""
    return (
        candidates.join(terms.select("query", "term", "tf"), "query").join(index.postings, ["id", "term"])
        .groupBy("query", "id").agg(F.round(F.sum(F.col("tf") * F.col("gain")), 9).alias("score"))
    )


def bm25_candidates(terms: DataFrame, index: Bm25Index, threshold: float) -> DataFrame:
    """(query, id) of every document that may be a query's best one above `threshold`, by two passes over block maxima.

    terms(query, term, tf, gain_most, reach, rest, place): the most that a term adds, summed up to it in rising order, over all
    others, and its place in falling order. The first pass adds up the best blocks of each query's two strongest terms and
    scores the FIRST best sums, which gives a lower bound. A term that adds more than the total may fall short of the bound must be in the document: if there are any, the
    two strongest are looked up and intersected. Else all terms are that reach the bound with the weaker ones. Of either, only
    blocks are read, and in them only entries, that reach the bound together with all that the other terms could add.
    """
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("top"), "level", "part"))
    best_blocks = index.blocks.withColumn("rank", rank).where(F.col("rank") <= FIRST_BLOCKS).select("term", "entries")
    read = terms.where("place <= 2").join(best_blocks, "term").select("query", "tf", F.explode("entries").alias("e"))
    sums = read.groupBy("query", "e.id").agg(F.sum(F.col("tf") * F.col("e.gain")).alias("part"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("part"), "id"))
    first = sums.withColumn("order", order).where(F.col("order") <= FIRST).select("query", "id")
    lower = bm25_scores(first, terms, index).groupBy("query").agg(F.max("score").alias("low"))
    low = F.greatest(F.coalesce("low", F.lit(threshold)), F.lit(threshold)) - 2 * _EPS
    must = F.col("gain_most") > F.col("gain_most") + F.col("rest") - F.col("low")
    looked = terms.join(lower, "query", "left").withColumn("low", low).withColumn("must", must)
    looked = looked.withColumn("need", F.least(F.count_if("must").over(Window.partitionBy("query")), F.lit(2)))
    looked = looked.where(F.when(F.col("need") > 0, F.col("must") & (F.col("place") <= 2)).otherwise(F.col("reach") >= F.col("low")))
    bounded = materialise(looked, "bounded")
    blocks = bounded.join(index.blocks, "term").where(F.col("tf") * F.greatest("top", F.lit(0.0)) + F.col("rest") >= F.col("low"))
    entries = blocks.select("query", "tf", "rest", "low", "need", F.explode("entries").alias("e"))
    entries = entries.where(F.col("tf") * F.greatest("e.gain", F.lit(0.0)) + F.col("rest") >= F.col("low"))
    found = entries.groupBy("query", "e.id").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return found.where(F.col("n") >= F.col("need")).select("query", "id")


def bm25_terms(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """The `terms` of bm25_candidates for `queries(query, text)`; tokens the index does not have count for nothing."""
    counted = _term_counts(queries, ["query"], space_tokens("text")).join(index.terms, "term")
    counted = counted.withColumn("gain_most", F.col("tf") * F.greatest("bound", F.lit(0.0)))
    whole = Window.partitionBy("query")
    upward = whole.orderBy("gain_most", "term").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select("query", "term", "tf", "gain_most", F.sum("gain_most").over(upward).alias("reach"),
                          (F.sum("gain_most").over(whole) - F.col("gain_most")).alias("rest"),
                          F.row_number().over(whole.orderBy(F.desc("gain_most"), F.desc("term"))).alias("place"))


def bm25_best(queries: DataFrame, index: Bm25Index, threshold: float) -> DataFrame:
    """(query, id, score): the best document above `threshold` of each query, the smallest id among equals."""
    terms = materialise(bm25_terms(queries, index), "terms")
    scores = bm25_scores(bm25_candidates(terms, index, threshold), terms, index)
    return best_per_query(scores.where(F.col("score") > threshold))


def best_per_query(pairs: DataFrame) -> DataFrame:
    """Highest score per query, smallest id among equals. Partial aggregation keeps hot queries cheap."""
    top = F.min(F.struct((-F.col("score")).alias("cost"), F.col("id").alias("id")))
    return pairs.groupBy("query").agg(top.alias("t")).select(
        "query", F.col("t.id").alias("id"), (-F.col("t.cost")).alias("score")
    )


def field_postings(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(term, id, weight) of `docs(id, ...)`; `fields` maps a weight class a..d to a text column."""

    def entries_of(weight: float, col: Column) -> Column:
        terms = F.array_distinct(word_tokens(F.coalesce(col, F.lit(""))))
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    entries = F.concat(*[entries_of(FIELD_WEIGHTS[k], col) for k, col in fields.items()])
    rows = docs.select("id", F.explode(entries).alias("e"))
    return rows.groupBy("id", F.col("e.term").alias("term")).agg(F.sum("e.w").alias("weight"))


@dataclass
class FieldIndex:
    """`terms(term, df, idf)` and `vectors(id, entries)`, entries being (term, weight, idf) of one document."""

    terms: DataFrame
    vectors: DataFrame


def build_fields(docs: DataFrame, fields: dict[str, Column]) -> FieldIndex:
    """Index of `docs(id, ...)`: its dictionary, sorted in ranges of terms, and each document's own terms."""
    rows = materialise(field_postings(docs, fields), "fields")
    n = docs.agg(F.count("*")).scalar()
    counted = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = materialise(counted.withColumn("idf", idf).sort("term"), "terms")
    vectors = rows.join(terms, "term").groupBy("id").agg(F.collect_list(F.struct("term", "weight", "idf")).alias("entries"))
    return FieldIndex(terms, materialise(vectors, "vectors"))


def expand_prefixes(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, term, df) of the dictionary terms that begin with a token; only prefixes of lengths that tokens have are formed."""
    wanted = tokens.select("token").distinct()
    lengths = wanted.agg(F.coalesce(F.collect_set(F.length("token")), F.array().cast("array<int>"))).scalar()
    cut = F.transform(F.filter("lengths", lambda n: n <= F.length("term")), lambda n: F.col("term").substr(F.lit(1), n))
    return terms.select("term", "df").withColumn("lengths", lengths).select("term", "df", F.explode(cut).alias("token")).join(wanted, "token")


def search_all_terms(queries: DataFrame, index: FieldIndex, prefix: bool = True, ranked: bool = False) -> DataFrame:
    """(query, id, score) of documents holding every token of `queries(query, text)`.

    Tokens match as prefixes (default) or whole terms. A document meets the queries whose least frequent token one of its terms
    matches, and each is checked once, inside the document's row, against its own terms; so no pair is exchanged. The score sums the field weights of the terms that
    tokens match; `ranked` multiplies each by the term's idf.
    """
    tokens = queries.select("query", F.explode(F.array_distinct(space_tokens("text"))).alias("token"))
    tokens = tokens.where(F.col("token").rlike("^[a-zA-Z0-9]"))
    expanded = expand_prefixes(tokens, index.terms) if prefix else index.terms.withColumn("token", F.col("term")).join(tokens.select("token").distinct(), "token")
    spread = expanded.groupBy("token").agg(F.sum("df").alias("df"))
    rare = tokens.join(spread, "token", "left").groupBy("query").agg(
        F.min_by("token", F.struct("df", "token")).alias("token"), F.count_if(F.col("df").isNull()).alias("absent"), F.collect_set("token").alias("tokens"))
    rare = rare.where("absent = 0").select("query", "token", "tokens")
    wanted = rare.join(expanded.select("token", "term"), "token")
    documents = index.vectors.where("id IS NOT NULL").select("id", "entries", F.explode("entries.term").alias("term"))

    def fits(entry: Column, token: Column) -> Column:
        return F.startswith(entry["term"], token) if prefix else entry["term"] == token

    def gain(token: Column) -> Column:
        own = F.filter("entries", lambda e: fits(e, token))
        return F.aggregate(own, F.lit(0.0), lambda total, e: total + (e["weight"] * e["idf"] if ranked else e["weight"]))

    met = documents.join(wanted, "term")
    if prefix:  # several terms of a document may begin with the token
        met = met.where(F.col("term") == F.array_min(F.filter("entries.term", lambda t: F.startswith(t, F.col("token")))))
    found = met.where(F.forall("tokens", lambda t: F.exists("entries", lambda e: fits(e, t))))
    score = F.aggregate("tokens", F.lit(0.0), lambda total, t: total + gain(t))
    return found.select("query", "id", F.round(score, 9).alias("score"))
