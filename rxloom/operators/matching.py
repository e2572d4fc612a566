"""Name matching cascades: exact, substring, fuzzy, cosine, BM25.

Each stage sees only the distinct names that earlier stages left over. Stage results
are written to the shared folder, so no stage is computed twice and a lost executor
costs one stage at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.similarity import token_sort
from rxloom.functions.text import normalize_for_matching, query_variants
from rxloom.operators.candidates import best_pairs, like_first, substring_first
from rxloom.operators.index import best_per_query, bm25_best, build_bm25, build_tfidf, cosine_pairs
from rxloom.operators.stored_index import CatalogueIndex
from rxloom.session import materialise

SENTINEL = "_icd_list_"


@dataclass(frozen=True)
class MatchRules:
    """Thresholds (score needed) and confidences (score reported) of the cascade."""

    partial_confidence: float = 0.95
    fuzzy_min: float = 85.0
    fuzzy_confidence: float | None = 0.88  # None: the score itself
    cosine_min: float = 0.75
    cosine_strict: bool = True  # score must exceed cosine_min
    cosine_confidence: float | None = 0.90
    max_ngram: int = 1
    bm25_min: float | None = 5.0
    bm25_confidence: float = 0.85


CLAIM_RULES = MatchRules()
SEARCH_RULES = MatchRules(bm25_min=None)
KB_RULES = MatchRules(
    fuzzy_min=70.0, fuzzy_confidence=None, cosine_min=0.5, cosine_strict=False, cosine_confidence=None,
    max_ngram=2, bm25_min=None,
)


def verified(drugs: DataFrame, indexed: bool = False) -> DataFrame:
    """Verified drugs that carry a registration number; the search index also needs it non-empty."""
    kept = drugs.where((F.col("is_verified") == 1) & F.col("so_dang_ky").isNotNull())
    return kept.where(F.col("so_dang_ky") != "") if indexed else kept


def distinct_queries(names: DataFrame, col: str, variant: str = "claims") -> DataFrame:
    """query (the name as given), raw (trimmed) and norm (matching key), one row per name."""
    base = names.select(F.col(col).alias("query")).where(F.trim(F.col(col)) != "").distinct()
    return base.select("query", F.trim("query").alias("raw"), normalize_for_matching(F.col("query"), variant).alias("norm"))


def exact_hits(queries: DataFrame, names: DataFrame, probe: str) -> DataFrame:
    """Equal name; smallest id among equal names."""
    ids = names.groupBy("name").agg(F.min("id").alias("id"))
    return queries.join(ids, F.col(probe) == F.col("name")).select("query", "id")


def partial_hits(queries: DataFrame, names: DataFrame, probe: str, like: bool = False) -> DataFrame:
    """Name contains the probe, ASCII case ignored; smallest id. Empty probes match nothing.

    `like` honours % and _ in the probe as wildcards.
    """
    low = names.select(F.lower("name").alias("name"), "id")
    keyed = queries.withColumn("needle", F.lower(probe)).where("needle != ''")
    hits = like_first(keyed, low) if like else substring_first(keyed, low)
    return keyed.join(hits, "needle").select("query", "id")


def fuzzy_hits(queries: DataFrame, names: DataFrame, probe: str, minimum: float) -> DataFrame:
    """Best token-sort similarity >= minimum; first id among equals."""
    left = queries.select("query", token_sort(probe).alias("q_sorted"))
    right = names.select("id", token_sort("name").alias("n_sorted")).groupBy("n_sorted").agg(F.min("id").alias("id"))
    pairs = best_pairs(left.select("q_sorted").distinct(), right.select("n_sorted"), "q_sorted", "n_sorted", minimum)
    scored = pairs.join(right, "n_sorted").select(F.col("q_sorted").alias("query"), "id", "score")
    best = best_per_query(scored).withColumnRenamed("query", "q_sorted")
    return left.join(best, "q_sorted").select("query", "id", "score")


def cosine_hits(queries: DataFrame, corpus: DataFrame, probe: str, rules: MatchRules, stored: CatalogueIndex | None = None) -> DataFrame:
    index = stored.tfidf(rules.max_ngram) if stored else build_tfidf(corpus, rules.max_ngram)
    pairs = cosine_pairs(queries.select("query", F.col(probe).alias("text")), index, rules.cosine_min)
    if rules.cosine_strict:
        pairs = pairs.where(F.col("score") > rules.cosine_min)
    return best_per_query(pairs)


def bm25_hits(queries: DataFrame, corpus: DataFrame, probe: str, minimum: float, stored: CatalogueIndex | None = None) -> DataFrame:
    return bm25_best(queries.select("query", F.col(probe).alias("text")), stored.bm25() if stored else build_bm25(corpus), minimum)


def _tag(hits: DataFrame, stage: int, method: str, confidence: Column) -> DataFrame:
    score = F.col("score") if "score" in hits.columns else F.lit(None).cast("double")
    return hits.select(
        "query", "id", confidence.cast("double").alias("confidence"), F.lit(method).alias("method"),
        score.alias("score"), F.lit(stage).alias("stage"),
    )


class _Cascade:
    """Collects stage results and the names still without a hit."""

    def __init__(self, queries: DataFrame):
        self.pending = queries
        self.hits: list[DataFrame] = []

    def add(self, stage_hits: DataFrame) -> None:
        stored = materialise(stage_hits, "stage")
        self.hits.append(stored)
        self.pending = self.pending.join(stored.select("query"), "query", "left_anti")

    def done(self) -> bool:
        return self.pending.isEmpty()

    def result(self) -> DataFrame:
        out = self.hits[0]
        for h in self.hits[1:]:
            out = out.unionByName(h)
        return out


def _late_stages(run: _Cascade, names: DataFrame, corpus: DataFrame, rules: MatchRules,
                 fuzzy_probe: str, labels: tuple[str, str, str], stored: CatalogueIndex | None = None) -> None:
    if not run.done():
        hits = fuzzy_hits(run.pending, names, fuzzy_probe, rules.fuzzy_min)
        conf = F.col("score") / 100.0 if rules.fuzzy_confidence is None else F.lit(rules.fuzzy_confidence)
        run.add(_tag(hits, 3, labels[0], conf))
    if not run.done():
        hits = cosine_hits(run.pending, corpus, "norm", rules, stored)
        conf = F.col("score") if rules.cosine_confidence is None else F.lit(rules.cosine_confidence)
        run.add(_tag(hits, 4, labels[1], conf))
    if rules.bm25_min is not None and not run.done():
        hits = bm25_hits(run.pending, corpus, "norm", rules.bm25_min, stored)
        run.add(_tag(hits, 5, labels[2], F.lit(rules.bm25_confidence)))


def catalogue_corpus(drugs: DataFrame) -> DataFrame:
    """(id, text) of what the cascade's TF-IDF and BM25 stages search; build or change a CatalogueIndex with it."""
    return verified(drugs, indexed=True).select("id", F.coalesce(F.nullif("search_text", F.lit("")), F.col("ten_thuoc")).alias("text"))


def match_catalogue(names: DataFrame, col: str, drugs: DataFrame, rules: MatchRules = CLAIM_RULES, stored: CatalogueIndex | None = None) -> DataFrame:
    """Match every distinct name of `names[col]` against the drug catalogue.

    A `stored` index over `catalogue_corpus(drugs)` is read instead of building one for this call.

    Returns one row per name: query, status, id, confidence, method, score. Stage order
    decides, not confidence. `score` is the stage's own measure (ratio, cosine, BM25).
    """
    usable = verified(drugs).select("id", F.col("ten_thuoc").alias("name"))
    indexed = verified(drugs, indexed=True)
    index_names = indexed.select("id", F.col("ten_thuoc").alias("name"))
    corpus = catalogue_corpus(drugs)
    queries = materialise(distinct_queries(names, col), "names")
    run = _Cascade(queries)
    raw = exact_hits(queries, usable, "raw").withColumn("stage", F.lit(0))
    norm = exact_hits(queries.where(F.col("norm") != F.lower("raw")), usable, "norm").withColumn("stage", F.lit(1))
    first = raw.unionByName(norm).groupBy("query").agg(F.min(F.struct("stage", "id")).alias("m"))
    label = F.when(F.col("m.stage") == 0, "EXACT_MATCH").otherwise("EXACT_MATCH (normalized)")
    run.add(first.select(
        "query", F.col("m.id").alias("id"), F.lit(1.0).alias("confidence"), label.alias("method"),
        F.lit(None).cast("double").alias("score"), F.col("m.stage").alias("stage"),
    ))
    if not run.done():
        run.add(_tag(partial_hits(run.pending, usable, "norm"), 2, "PARTIAL_MATCH", F.lit(rules.partial_confidence)))
    _late_stages(run, index_names, corpus, rules, "raw", ("FUZZY_MATCH", "VECTOR_MATCH", "BM25_MATCH"), stored)
    return _complete(queries, run.result())


def _complete(queries: DataFrame, hits: DataFrame) -> DataFrame:
    joined = queries.select("query").join(hits, "query", "left")
    return joined.select(
        "query",
        F.when(F.col("id").isNotNull(), "FOUND").otherwise("NOT_FOUND").alias("status"),
        "id",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("method", F.lit("NO_MATCH")).alias("method"),
        "score",
    )


def search_catalogue(names: DataFrame, col: str, drugs: DataFrame, rules: MatchRules = SEARCH_RULES) -> DataFrame:
    """Catalogue search over the query variants of each name; the first variant with a hit wins.

    Returns query, id, confidence, source, score for the names found.
    """
    usable = verified(drugs).select("id", F.col("ten_thuoc").alias("name"))
    corpus = verified(drugs).select("id", F.coalesce(F.nullif("search_text", F.lit("")), F.col("ten_thuoc")).alias("text"))
    queries = materialise(distinct_queries(names, col, "kb"), "names")
    variants = queries.select("query", "raw", F.posexplode(query_variants(F.col("query"))).alias("rank", "variant"))
    probes = variants.select(F.col("variant").alias("query"), "variant").distinct()
    exact = exact_hits(probes, usable, "variant").withColumn("kind", F.lit(0))
    partial = partial_hits(probes, usable, "variant").withColumn("kind", F.lit(1))
    found = exact.unionByName(partial).withColumnRenamed("query", "variant")
    best = variants.join(found, "variant").groupBy("query").agg(
        F.min(F.struct("rank", "kind", "id", (F.col("variant") != F.col("raw")).alias("fallback"))).alias("m")
    )
    kind = F.when(F.col("m.kind") == 0, "Exact").otherwise("Partial")
    run = _Cascade(queries)
    run.add(best.select(
        "query", F.col("m.id").alias("id"),
        F.when(F.col("m.kind") == 0, 1.0).otherwise(rules.partial_confidence).alias("confidence"),
        F.concat(F.lit("Database ("), kind, F.when(F.col("m.fallback"), " Fallback").otherwise(""), F.lit(")")).alias("method"),
        F.lit(None).cast("double").alias("score"), F.lit(0).alias("stage"),
    ))
    _late_stages(run, usable, corpus, rules, "raw", ("Database (Fuzzy)", "Database (Vector)", ""))
    return run.result().select("query", "id", "confidence", F.col("method").alias("source"), "score")


def kb_names(kb: DataFrame) -> DataFrame:
    """Distinct usable names of the knowledge base."""
    return (
        kb.where(F.col("drug_name_norm").isNotNull() & (F.trim("drug_name_norm") != "") & (F.col("drug_name_norm") != SENTINEL))
        .select(F.col("drug_name_norm").alias("name"))
        .distinct()
    )


def match_kb_names(names: DataFrame, col: str, kb: DataFrame, rules: MatchRules = KB_RULES) -> DataFrame:
    """Best knowledge-base name per distinct input name: query, drug_name_norm, match_score, match_method.

    Equal scores resolve to the alphabetically first name.
    """
    named = materialise(kb_names(kb).select("name", F.col("name").alias("id")), "kbnames")
    queries = materialise(distinct_queries(names, col, "claims").where("norm != ''"), "names")
    run = _Cascade(queries)
    run.add(_tag(exact_hits(queries, named, "norm"), 0, "exact", F.lit(1.0)))
    if not run.done():
        run.add(_tag(partial_hits(run.pending, named, "norm"), 2, "partial", F.lit(rules.partial_confidence)))
    corpus = named.select("id", F.col("name").alias("text"))
    _late_stages(run, named, corpus, rules, "norm", ("fuzzy", "tfidf", ""))
    return run.result().select(
        "query", F.col("id").alias("drug_name_norm"), F.col("confidence").alias("match_score"),
        F.col("method").alias("match_method"),
    )
