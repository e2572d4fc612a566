"""Name matching, search and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxloom.functions.text import normalize_text
from rxloom.operators import consult, index, lookup, matching, quality, ranking
from rxloom.plans import domain as d
from rxloom.plans.q_functions import sql_compound, sql_mapping, sql_role, sql_valid_role
from rxloom.plans.registry import query
from rxloom.session import materialise

QUERIES = f"""q AS (SELECT query, trim(query) AS raw, {d.sql_norm('query', 'claims')} AS norm
  FROM (SELECT DISTINCT name AS query FROM messy_names WHERE trim(name) <> ''))"""
EXACT = """e AS (SELECT query, min(id) AS id FROM q JOIN verified ON ten_thuoc = raw GROUP BY 1),
en AS (SELECT query, min(id) AS id FROM q JOIN verified ON ten_thuoc = norm WHERE norm <> lower(raw) GROUP BY 1)"""
PARTIAL = """pt AS (SELECT query, min(id) AS id FROM q JOIN verified ON contains(lower(ten_thuoc), norm) WHERE norm <> '' GROUP BY 1)"""
INDEXED = "indexed AS (SELECT id, ten_thuoc AS name, coalesce(nullif(search_text, ''), ten_thuoc) AS text FROM verified WHERE so_dang_ky <> '')"


def sql_fuzzy(source: str, probe: str, minimum: float, names: str = "indexed") -> str:
    """Brute-force fuzzy top-1 of `source(query, probe)` over `names(id, name)`; CTE fz(query, id, score)."""
    return f"""fq AS (SELECT DISTINCT {d.sql_token_sort(probe)} AS a FROM {source}),
fn AS (SELECT {d.sql_token_sort('name')} AS b, min(id) AS id FROM {names} GROUP BY 1),
fs AS (SELECT a, id, {d.sql_ratio('a', 'b')} AS score FROM fq CROSS JOIN fn),
fb AS (SELECT a, id, score FROM fs WHERE score >= {minimum} QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) = 1),
fz AS (SELECT s.query, fb.id, fb.score FROM {source} s JOIN fb ON fb.a = {d.sql_token_sort('s.' + probe)})"""


def sql_words(expr: str, ngram: int) -> str:
    words = rf"regexp_extract_all(lower({expr}), '\w+')"
    if ngram == 1:
        return words
    return (f"list_transform([{words}], lambda w: w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))[1]")


def sql_cosine(source: str, probe: str, op: str, minimum: float, ngram: int = 1, corpus: str = "indexed") -> str:
    """Brute-force TF-IDF cosine top-1 of `source(query, probe)` over `corpus(id, text)`; CTE cz."""
    return f"""ct AS (SELECT id, unnest({sql_words('text', ngram)}) AS term FROM {corpus}),
ctf AS (SELECT id, term, count(*) AS tf FROM ct GROUP BY 1, 2),
cidf AS (SELECT term, ln((1 + (SELECT count(*) FROM {corpus})) / (1 + count(*))::DOUBLE) + 1 AS idf FROM ctf GROUP BY 1),
cw AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM ctf JOIN cidf USING (term)),
cq AS (SELECT query, unnest({sql_words(probe, ngram)}) AS term FROM {source}),
cqf AS (SELECT query, term, count(*) AS tf FROM cq GROUP BY 1, 2),
cqw AS (SELECT query, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query)) AS w FROM cqf JOIN cidf USING (term)),
cs AS (SELECT query, id, round(sum(cqw.w * cw.w), 9) AS score FROM cqw JOIN cw USING (term) GROUP BY 1, 2),
cz AS (SELECT query, id, score FROM cs WHERE score {op} {minimum} QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1)"""


def sql_bm25(source: str, probe: str, minimum: float, corpus: str = "indexed") -> str:
    """Brute-force Okapi BM25 top-1; CTE bz."""
    toks = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> '')"
    return f"""bd AS (SELECT id, {toks.format('text')} AS ws FROM {corpus}),
bt AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, unnest(ws) AS term, len(ws) AS dl FROM bd) GROUP BY 1, 2),
bst AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS avgdl FROM bd),
braw AS (SELECT term, ln((SELECT n FROM bst) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM bt GROUP BY 1),
bidf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM braw) ELSE raw END AS idf FROM braw),
bq AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({toks.format(probe)}) AS term FROM {source}) GROUP BY 1, 2),
bs AS (SELECT query, id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM bst)))), 9) AS score
  FROM bq JOIN bt USING (term) JOIN bidf USING (term) GROUP BY 1, 2),
bz AS (SELECT query, id, score FROM bs WHERE score > {minimum} QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1)"""


BASE = (d.DRUGS, d.VERIFIED, d.MESSY_NAMES, QUERIES)


def _queries(spark, sf):
    return matching.distinct_queries(d.messy_names(spark, sf), "name")


def _usable(spark, sf, indexed: bool = False):
    return matching.verified(d.drugs(spark, sf), indexed).select("id", F.col("ten_thuoc").alias("name"), F.col("search_text").alias("text"))


@query("exact_match", "J1 P1 W2", d.ctes(*BASE, EXACT) + " SELECT query, id, 0 AS stage FROM e UNION ALL SELECT query, id, 1 FROM en")
def exact_match(spark, sf):
    q, names = _queries(spark, sf), _usable(spark, sf)
    raw = matching.exact_hits(q, names, "raw").withColumn("stage", F.lit(0))
    return raw.unionByName(matching.exact_hits(q.where(F.col("norm") != F.lower("raw")), names, "norm").withColumn("stage", F.lit(1)))


@query("substring_match", "J2 W2", d.ctes(*BASE, PARTIAL, """
short AS (SELECT DISTINCT substring(p_name, 2, 2) AS query FROM part UNION SELECT DISTINCT substring(p_name, 3, 3) FROM part),
s AS (SELECT query, min(id) AS id FROM short JOIN verified ON contains(lower(ten_thuoc), query) GROUP BY 1)""")
       + " SELECT query, id FROM pt UNION ALL SELECT query, id FROM s")
def substring_match(spark, sf):
    p = d.table(spark, sf, "part")
    short = p.select(F.substring("p_name", 2, 2).alias("query")).union(p.select(F.substring("p_name", 3, 3))).distinct()
    names = _usable(spark, sf)
    return matching.partial_hits(_queries(spark, sf), names, "norm").unionByName(
        matching.partial_hits(short, names, "query"))


@query("like_match", "J2", d.ctes(*BASE, """
pats AS (SELECT DISTINCT substring(p_name, 1, 3) || '%' || right(p_name, 3) AS query FROM part
  UNION SELECT DISTINCT substring(p_name, 2, 2) || '_' || substring(p_name, 5, 2) || '%' || substring(p_brand, 1, 1) FROM part
  UNION SELECT DISTINCT substring(p_name, 2, 3) || '_' || substring(p_name, 6, 2) FROM part)""") + """
SELECT query, min(id) AS id FROM pats JOIN verified ON lower(ten_thuoc) LIKE '%' || lower(query) || '%' GROUP BY 1""")
def like_match(spark, sf):
    p = d.table(spark, sf, "part")
    sub = lambda c, a, n: F.substring(c, a, n)
    patterns = p.select(F.concat(sub("p_name", 1, 3), F.lit("%"), F.expr("right(p_name, 3)")).alias("query")).union(
        p.select(F.concat(sub("p_name", 2, 2), F.lit("_"), sub("p_name", 5, 2), F.lit("%"), sub("p_brand", 1, 1)))).union(
        p.select(F.concat(sub("p_name", 2, 3), F.lit("_"), sub("p_name", 6, 2)))).distinct()
    return matching.partial_hits(patterns, _usable(spark, sf), "query", like=True)


@query("fuzzy_match", "J3 F31", d.ctes(*BASE, INDEXED, sql_fuzzy("q", "raw", 85)) + " SELECT query, id, round(score, 6) AS score FROM fz")
def fuzzy_match(spark, sf):
    hits = matching.fuzzy_hits(_queries(spark, sf), _usable(spark, sf, True), "raw", 85.0)
    return hits.select("query", "id", F.round("score", 6).alias("score"))


@query("fuzzy_match_loose", "J3 F31", d.ctes(*BASE, INDEXED, sql_fuzzy("q", "norm", 70)) + " SELECT query, id, round(score, 6) AS score FROM fz")
def fuzzy_match_loose(spark, sf):
    hits = matching.fuzzy_hits(_queries(spark, sf), _usable(spark, sf, True), "norm", 70.0)
    return hits.select("query", "id", F.round("score", 6).alias("score"))


@query("match_quality", "A16", d.ctes(*BASE, INDEXED, sql_fuzzy("q", "raw", 70), """
pairs AS (SELECT DISTINCT name AS query, p_name FROM messy_names JOIN part ON p_partkey = item_id WHERE trim(name) <> ''),
swept AS (SELECT t AS threshold, coalesce(fz.score >= t, false) AS hit, coalesce(x.name = p_name, false) AS truth
  FROM pairs LEFT JOIN fz USING (query) LEFT JOIN indexed x ON x.id = fz.id, (SELECT unnest([70, 75, 80, 85, 90, 95]) AS t))""") + """
SELECT threshold, count(*) AS n, round(avg((hit = truth)::INT), 6) AS accuracy,
  round(count(*) FILTER (hit AND NOT truth) / greatest(count(*) FILTER (NOT truth), 1), 6) AS false_positive_rate,
  round(count(*) FILTER (NOT hit AND truth) / greatest(count(*) FILTER (truth), 1), 6) AS false_negative_rate FROM swept GROUP BY 1""")
def match_quality(spark, sf):
    """Whether the best match of a spelling is the part it was made from, by the score asked for."""
    names = _usable(spark, sf, True)
    made = d.messy_names(spark, sf).join(d.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name"), "item_id")
    pairs = made.where("trim(name) <> ''").select(F.col("name").alias("query"), "p_name").distinct()
    found = matching.fuzzy_hits(_queries(spark, sf), names, "raw", 70.0).join(names.select("id", F.col("name").alias("best")), "id")
    scored = materialise(pairs.join(found.select("query", "best", "score"), "query", "left"), "scored")
    key = ["query", "p_name"]
    swept = scored.withColumn("threshold", F.explode(F.lit([70, 75, 80, 85, 90, 95]))).select(
        *key, "threshold", (F.coalesce("score", F.lit(0.0)) >= F.col("threshold")).cast("int").alias("hit"))
    truth = scored.select(*key, F.coalesce(F.col("best") == F.col("p_name"), F.lit(False)).cast("int").alias("truth"))
    return quality.match_quality(swept, truth, key, ("threshold",))


@query("cosine_match", "J4", d.ctes(*BASE, INDEXED, sql_cosine("q", "norm", ">", 0.75)) + " SELECT query, id, round(score, 6) AS score FROM cz")
def cosine_match(spark, sf):
    hits = matching.cosine_hits(_queries(spark, sf), _usable(spark, sf, True), "norm", matching.CLAIM_RULES)
    return hits.select("query", "id", F.round("score", 6).alias("score"))


@query("bm25_match", "J5", d.ctes(*BASE, INDEXED, sql_bm25("q", "norm", 5.0)) + " SELECT query, id, round(score, 6) AS score FROM bz")
def bm25_match(spark, sf):
    hits = matching.bm25_hits(_queries(spark, sf), _usable(spark, sf, True), "norm", 5.0)
    return hits.select("query", "id", F.round("score", 6).alias("score"))


LEFT = "lo AS (SELECT * FROM q WHERE query NOT IN (SELECT query FROM e UNION SELECT query FROM en UNION SELECT query FROM pt))"
CASCADE = (QUERIES, EXACT, PARTIAL, INDEXED, LEFT, sql_fuzzy("lo", "raw", 85), sql_cosine("lo", "norm", ">", 0.75),
           sql_bm25("lo", "norm", 5.0), """
matched AS (SELECT query, coalesce(e.id, en.id, pt.id, fz.id, cz.id, bz.id) AS id,
  CASE WHEN e.id IS NOT NULL THEN 'EXACT_MATCH' WHEN en.id IS NOT NULL THEN 'EXACT_MATCH (normalized)' WHEN pt.id IS NOT NULL THEN 'PARTIAL_MATCH'
    WHEN fz.id IS NOT NULL THEN 'FUZZY_MATCH' WHEN cz.id IS NOT NULL THEN 'VECTOR_MATCH' WHEN bz.id IS NOT NULL THEN 'BM25_MATCH' ELSE 'NO_MATCH' END AS method,
  CASE WHEN coalesce(e.id, en.id) IS NOT NULL THEN 1.0 WHEN pt.id IS NOT NULL THEN 0.95 WHEN fz.id IS NOT NULL THEN 0.88
    WHEN cz.id IS NOT NULL THEN 0.9 WHEN bz.id IS NOT NULL THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN coalesce(e.id, en.id, pt.id) IS NULL THEN coalesce(fz.score, cz.score, bz.score) END AS score
FROM q LEFT JOIN e USING (query) LEFT JOIN en USING (query) LEFT JOIN pt USING (query) LEFT JOIN fz USING (query)
  LEFT JOIN cz USING (query) LEFT JOIN bz USING (query))""")


@query("match_cascade", "J6", d.ctes(d.DRUGS, d.VERIFIED, d.MESSY_NAMES, *CASCADE) + """
SELECT query, id, method, confidence, round(score, 6) AS score, CASE WHEN id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status FROM matched""")
def match_cascade(spark, sf):
    out = matching.match_catalogue(d.messy_names(spark, sf), "name", d.drugs(spark, sf))
    return out.withColumn("score", F.round("score", 6))


SEARCH_QUERIES = f"""q AS (SELECT query, trim(query) AS raw, {d.sql_norm('query')} AS norm
  FROM (SELECT DISTINCT name AS query FROM messy_names WHERE trim(name) <> '')),
vr AS (SELECT query, raw, norm, list_filter([nullif(raw, ''), CASE WHEN norm <> '' AND norm <> lower(raw) THEN norm END,
  nullif(regexp_extract(norm, '^(.*) ([^ ]*\\d[^ ]*)$', 1), '')], lambda x: x IS NOT NULL) AS vs FROM q),
vx AS (SELECT query, raw, unnest(range(0, len(vs))) AS rank, unnest(vs) AS variant FROM vr),
vh AS (SELECT query, raw, variant, rank, 0 AS kind, min(id) AS id FROM vx JOIN verified ON ten_thuoc = variant GROUP BY ALL
  UNION ALL SELECT query, raw, variant, rank, 1, min(id) FROM vx JOIN verified ON contains(lower(ten_thuoc), lower(variant)) GROUP BY ALL),
vb AS (SELECT * FROM vh QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, kind, id) = 1),
pool AS (SELECT id, ten_thuoc AS name, coalesce(nullif(search_text, ''), ten_thuoc) AS text FROM verified),
lo AS (SELECT * FROM q WHERE query NOT IN (SELECT query FROM vb))"""
SEARCH = (SEARCH_QUERIES, sql_fuzzy("lo", "raw", 85, "pool"), sql_cosine("lo", "norm", ">", 0.75, 1, "pool"), """
searched AS (SELECT query, id, CASE WHEN kind = 0 THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence,
  'Database (' || CASE WHEN kind = 0 THEN 'Exact' ELSE 'Partial' END || CASE WHEN variant <> raw THEN ' Fallback' ELSE '' END || ')' AS source FROM vb
  UNION ALL SELECT query, id, 0.88, 'Database (Fuzzy)' FROM fz
  UNION ALL SELECT query, id, 0.9, 'Database (Vector)' FROM cz WHERE query NOT IN (SELECT query FROM fz))""")


@query("search_cascade", "J7 F30", d.ctes(d.DRUGS, d.VERIFIED, d.MESSY_NAMES, *SEARCH) + " SELECT * FROM searched")
def search_cascade(spark, sf):
    return matching.search_catalogue(d.messy_names(spark, sf), "name", d.drugs(spark, sf)).drop("score")


def sql_kb_match(source: str) -> str:
    """J8 over kb for the names of `source(name)`; CTE kbm(query, drug_name_norm, match_score, match_method)."""
    return f"""kn AS (SELECT DISTINCT drug_name_norm AS id, drug_name_norm AS name, drug_name_norm AS text FROM kb WHERE trim(drug_name_norm) NOT IN ('', '_icd_list_')),
q AS (SELECT query, {d.sql_norm('query', 'claims')} AS norm FROM (SELECT DISTINCT name AS query FROM {source} WHERE trim(name) <> '') WHERE {d.sql_norm('query', 'claims')} <> ''),
ke AS (SELECT query, id FROM q JOIN kn ON name = norm),
kp AS (SELECT query, min(id) AS id FROM q JOIN kn ON contains(name, norm) GROUP BY 1),
lo AS (SELECT * FROM q WHERE query NOT IN (SELECT query FROM ke UNION SELECT query FROM kp)),
{sql_fuzzy('lo', 'norm', 70, 'kn')},
{sql_cosine('lo', 'norm', '>=', 0.5, 2, 'kn')},
kbm AS (SELECT query, coalesce(ke.id, kp.id, fz.id, cz.id) AS drug_name_norm,
  CASE WHEN ke.id IS NOT NULL THEN 1.0 WHEN kp.id IS NOT NULL THEN 0.95 WHEN fz.id IS NOT NULL THEN fz.score / 100 ELSE cz.score END AS match_score,
  CASE WHEN ke.id IS NOT NULL THEN 'exact' WHEN kp.id IS NOT NULL THEN 'partial' WHEN fz.id IS NOT NULL THEN 'fuzzy' ELSE 'tfidf' END AS match_method
  FROM q LEFT JOIN ke USING (query) LEFT JOIN kp USING (query) LEFT JOIN fz USING (query) LEFT JOIN cz USING (query)
  WHERE coalesce(ke.id, kp.id, fz.id, cz.id) IS NOT NULL)"""


@query("kb_name_match", "J8", d.ctes(*d.KB_CTES, d.MESSY_NAMES, sql_kb_match("messy_names")) +
       " SELECT query, drug_name_norm, round(match_score, 6) AS match_score, match_method FROM kbm")
def kb_name_match(spark, sf):
    out = matching.match_kb_names(d.messy_names(spark, sf), "name", d.kb_table(spark, sf))
    return out.withColumn("match_score", F.round("match_score", 6))


TOLD = "coalesce(tdv_feedback NOT IN ('', 'None', 'null'), FALSE)::INT"
BEST = f"""best_icd AS (SELECT * FROM kb QUALIFY row_number() OVER (PARTITION BY drug_name_norm, disease_icd ORDER BY {TOLD} DESC, frequency DESC, last_updated DESC) = 1),
best_any AS (SELECT * FROM kb QUALIFY row_number() OVER (PARTITION BY drug_name_norm ORDER BY {TOLD} DESC, frequency DESC, last_updated DESC, disease_icd) = 1)"""
ICD_PAIRS = """icd_pairs AS (SELECT item_id, name, chr((97 + item_id % 8)::INT) || (1 + item_id % 5) AS icd FROM messy_names)"""


@query("kb_match_with_icd", "J9 W3", d.ctes(*d.KB_CTES, d.MESSY_NAMES, ICD_PAIRS, sql_kb_match("messy_names"), BEST) + """
SELECT item_id, p.name, p.icd, m.drug_name_norm, CASE WHEN e.frequency IS NOT NULL THEN p.icd WHEN g.frequency IS NOT NULL THEN 'GENERIC' END AS disease_icd,
  coalesce(e.treatment_type, g.treatment_type) AS treatment_type, coalesce(e.frequency, g.frequency) AS frequency, round(match_score, 6) AS match_score,
  match_method || CASE WHEN e.frequency IS NULL THEN ' (Generic)' ELSE '' END AS match_method
FROM icd_pairs p LEFT JOIN kbm m ON m.query = p.name LEFT JOIN best_icd e ON e.drug_name_norm = m.drug_name_norm AND e.disease_icd = p.icd
  LEFT JOIN best_any g ON g.drug_name_norm = m.drug_name_norm""")
def kb_match_with_icd(spark, sf):
    pairs = d.messy_names(spark, sf).withColumn(
        "icd", F.concat(F.char(97 + F.col("item_id") % 8), (1 + F.col("item_id") % 5).cast("string")))
    kb = d.kb_table(spark, sf)
    matches = matching.match_kb_names(pairs, "name", kb)
    return consult.match_kb_with_icd(pairs, kb, matches).drop("tdv_feedback").withColumn("match_score", F.round("match_score", 6))


CONSULT = """items AS (SELECT l_orderkey AS request_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item_id, name FROM lineitem JOIN messy_names ON item_id = l_partkey),
diagnoses AS (SELECT o_orderkey AS request_id, 0 AS pos, ' ' || chr((65 + o_custkey % 7)::INT) || (1 + o_custkey % 5) AS code FROM orders WHERE o_orderkey % 10 <> 9
  UNION ALL SELECT o_orderkey, 1, 'A1' FROM orders WHERE o_orderkey % 10 <> 9)"""


def _items(spark, sf):
    li = d.table(spark, sf, "lineitem")
    return li.join(d.messy_names(spark, sf), F.col("l_partkey") == F.col("item_id")).select(
        F.col("l_orderkey").alias("request_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id"), "name")


def _diagnoses(spark, sf):
    od = d.table(spark, sf, "orders").where("o_orderkey % 10 <> 9")
    first = F.concat(F.lit(" "), F.char(65 + F.col("o_custkey") % 7), (1 + F.col("o_custkey") % 5).cast("string"))
    return od.select(F.col("o_orderkey").alias("request_id"), F.posexplode(F.array(first, F.lit("A1"))).alias("pos", "code"))


def _consult_sql() -> str:
    cat, val = sql_mapping("role")
    return f"""SELECT request_id, item_id, name, CASE WHEN found THEN {cat} ELSE 'drug' END AS category, CASE WHEN found THEN {val} ELSE 'unknown' END AS validity,
  CASE WHEN found THEN role ELSE '' END AS role, CASE WHEN NOT found THEN 'INTERNAL_KB_EMPTY' WHEN expert IS NOT NULL THEN 'INTERNAL_KB_TDV'
    WHEN ai IS NOT NULL THEN 'INTERNAL_KB_AI' ELSE 'INTERNAL_KB_DEFAULT' END AS source,
  CASE WHEN found THEN round(match_score, 6) END AS match_score, CASE WHEN found THEN drug_name_norm END AS matched_name
FROM (SELECT *, coalesce(expert, ai, 'main drug') AS role FROM (
  SELECT i.*, m.drug_name_norm, m.match_score, (m.drug_name_norm IS NOT NULL AND dg.icd IS NOT NULL) AS found,
    {sql_valid_role("coalesce(e.tdv_feedback, g.tdv_feedback, '')")} AS expert,
    {sql_valid_role("coalesce(e.treatment_type, g.treatment_type, '')")} AS ai
  FROM items i LEFT JOIN (SELECT request_id, lower(trim(arg_min(code, pos))) AS icd FROM diagnoses GROUP BY 1) dg USING (request_id)
  LEFT JOIN kbm m ON m.query = i.name LEFT JOIN best_icd e ON e.drug_name_norm = m.drug_name_norm AND e.disease_icd = dg.icd
  LEFT JOIN best_any g ON g.drug_name_norm = m.drug_name_norm))"""


@query("consultation", "J22 F12 F13 F14", d.ctes(*d.KB_CTES, d.MESSY_NAMES, CONSULT, sql_kb_match("messy_names"), BEST) + " " + _consult_sql())
def consultation(spark, sf):
    out = consult.consult(_items(spark, sf), _diagnoses(spark, sf), d.kb_table(spark, sf))
    return out.drop("explanation").withColumn("match_score", F.round("match_score", 6))


@query("strict_kb_lookup", "J23", d.ctes(*d.KB_CTES) + f"""
SELECT drug_name_norm, disease_icd, {sql_mapping('role')[0]} AS category, {sql_mapping('role')[1]} AS validity, role, source FROM (
  SELECT drug_name_norm, disease_icd, {sql_role('picked')} AS role, CASE WHEN told THEN 'INTERNAL_KB_TDV' ELSE 'INTERNAL_KB_AI' END AS source FROM (
    SELECT *, lower(coalesce(tdv_feedback, '')) NOT IN ('', 'none', 'null') AS told,
      CASE WHEN lower(coalesce(tdv_feedback, '')) NOT IN ('', 'none', 'null') THEN tdv_feedback ELSE treatment_type END AS picked FROM kb))""")
def strict_kb_lookup(spark, sf):
    kb = d.kb_table(spark, sf)
    return consult.strict_lookup(kb.select("drug_name_norm", "disease_icd"), kb)


FALLBACK = """fallback AS (SELECT 'pack ' || p_type || ' ' || p_brand AS query, 'WEB-' || any_value(p_type) AS so_dang_ky,
  p_type || ' generic' AS ten_thuoc, p_type AS hoat_chat, 'see leaflet' AS chi_dinh, 0.8 AS confidence FROM part GROUP BY p_type, p_brand)"""


@query("identify_batch", "J17 W5", d.ctes(d.DRUGS, d.VERIFIED, d.MESSY_NAMES.replace("messy_names AS", "base_names AS"), f"""
messy_names AS (SELECT item_id, name AS input_name, coalesce({sql_compound('trim(name)')}, trim(name)) AS name FROM base_names)""", *SEARCH, FALLBACK, """
inputs AS (SELECT input_name, any_value(name) AS keyword, min(item_id) AS pos FROM messy_names GROUP BY 1),
r AS (SELECT pos, input_name, coalesce(v.ten_thuoc, f.ten_thuoc) AS official_name, coalesce(v.so_dang_ky, f.so_dang_ky) AS sdk,
  CASE WHEN v.id IS NOT NULL THEN s.source WHEN f.query IS NOT NULL THEN 'Web Search (Advanced)' END AS source,
  CASE WHEN v.id IS NOT NULL THEN s.confidence WHEN f.query IS NOT NULL THEN f.confidence END AS confidence
  FROM inputs LEFT JOIN searched s ON s.query = keyword LEFT JOIN verified v ON v.id = s.id AND v.so_dang_ky <> ''
  LEFT JOIN fallback f ON f.query = keyword),
h AS (SELECT sdk, min(pos) AS first_pos, arg_min(input_name, pos) AS holder FROM r WHERE coalesce(sdk, '') NOT IN ('', 'N/A', 'Web Result (No SDK)') GROUP BY 1)""") + """
SELECT r.pos, input_name, official_name, r.sdk, source, confidence::DOUBLE AS confidence, CASE WHEN official_name IS NULL THEN 'Not Found' END AS status,
  coalesce(h.first_pos IS NOT NULL AND r.pos <> h.first_pos, FALSE)::INT AS is_duplicate, CASE WHEN r.pos <> h.first_pos THEN holder END AS duplicate_of
FROM r LEFT JOIN h ON h.sdk = r.sdk""")
def identify_batch(spark, sf):
    names = d.messy_names(spark, sf).select("name", F.col("item_id").alias("pos"))
    fallback = d.table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*")).select(
        F.concat_ws(" ", F.lit("pack"), "p_type", "p_brand").alias("query"), F.concat(F.lit("WEB-"), "p_type").alias("so_dang_ky"),
        F.concat("p_type", F.lit(" generic")).alias("ten_thuoc"), F.col("p_type").alias("hoat_chat"),
        F.lit("see leaflet").alias("chi_dinh"), F.lit(0.8).alias("confidence"))
    out = lookup.identify(names, d.drugs(spark, sf), fallback)
    return out.select("pos", "input_name", "official_name", "sdk", "source", "confidence", "status",
                      F.col("is_duplicate").cast("int").alias("is_duplicate"), "duplicate_of")


@query("disease_lookup", "J18 P3", d.ctes(*d.KB_CTES, """
dq AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN chr((97 + o_custkey % 9)::INT) || CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '' END ELSE '' END AS icd,
  upper(substring(o_orderpriority, 4, 5)) AS name FROM orders),
known AS (SELECT DISTINCT disease_icd, disease_name_norm, treatment_type FROM kb),
ic AS (SELECT icd, known.*, row_number() OVER (PARTITION BY icd ORDER BY length(disease_icd), disease_icd, disease_name_norm, treatment_type) AS rn
  FROM (SELECT DISTINCT icd FROM dq WHERE icd <> '') JOIN known ON starts_with(disease_icd, icd)),
nm AS (SELECT name, known.*, row_number() OVER (PARTITION BY name ORDER BY disease_icd, disease_name_norm, treatment_type) AS rn
  FROM (SELECT DISTINCT name FROM dq WHERE name <> '') JOIN known ON contains(lower(disease_name_norm), lower(name)))""") + """
SELECT query_id, coalesce(a.disease_icd, b.disease_icd) AS icd_code, coalesce(a.disease_name_norm, b.disease_name_norm) AS disease_name,
  coalesce(a.treatment_type, b.treatment_type) AS chapter_name, CASE WHEN coalesce(a.disease_icd, b.disease_icd) IS NULL THEN 'Not Found' ELSE 'KnowledgeBase' END AS source
FROM dq LEFT JOIN ic a ON a.icd = dq.icd AND a.rn = 1 LEFT JOIN nm b ON b.name = dq.name AND b.rn = 1""")
def disease_lookup(spark, sf):
    q = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.char(97 + F.col("o_custkey") % 9), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise(""))).otherwise("").alias("icd"),
        F.upper(F.substring("o_orderpriority", 4, 5)).alias("name"))
    return lookup.find_diseases(q, d.kb_table(spark, sf))


LINKS = """reqs AS (SELECT o_orderkey AS request_id, 'VN-' || o_custkey AS sdk, chr((97 + o_custkey % 6)::INT) || (1 + o_orderkey % 5) AS icd FROM orders),
top5 AS (SELECT * FROM kb QUALIFY row_number() OVER (PARTITION BY disease_icd ORDER BY frequency DESC, drug_name_norm) <= 5)"""


def _link_requests(spark, sf):
    return d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.array(F.concat(F.lit("VN-"), F.col("o_custkey").cast("string")), F.lit("VN-0")).alias("sdks"),
        F.array(F.concat(F.char(97 + F.col("o_custkey") % 6), (1 + F.col("o_orderkey") % 5).cast("string"))).alias("icds"))


@query("verified_links", "J19 W4", d.ctes(*d.KB_CTES, LINKS) + """
SELECT request_id, s.sdk, icd AS icd_code, drug_name_norm AS drug_name, frequency, treatment_type AS classification
FROM reqs JOIN top5 ON disease_icd = icd, LATERAL (SELECT unnest([reqs.sdk, 'VN-0']) AS sdk) s""")
def verified_links(spark, sf):
    out = lookup.verified_links(_link_requests(spark, sf), d.kb_table(spark, sf))
    return out.select("request_id", "sdk", "icd_code", "drug_name", "frequency", "classification")


@query("treatment_analysis", "J25", d.ctes(*d.KB_CTES, LINKS) + """
SELECT r.request_id, 1 AS n_drugs, 1 AS n_diseases, coalesce(n, 0) AS n_links FROM reqs r LEFT JOIN (
  SELECT request_id, count(*) * 2 AS n FROM reqs JOIN top5 ON disease_icd = icd GROUP BY 1) USING (request_id)""")
def treatment_analysis(spark, sf):
    kb = d.kb_table(spark, sf)
    reqs = _link_requests(spark, sf)
    drugs = reqs.select("request_id", F.get("sdks", F.lit(0)).alias("sdk"))
    found = lookup.find_diseases(
        reqs.select(F.col("request_id").alias("query_id"), F.get("icds", F.lit(0)).alias("icd"), F.lit("").alias("name")), kb)
    report = lookup.treatment_report(drugs, found.withColumnRenamed("query_id", "request_id"), lookup.verified_links(reqs, kb, nested=True))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return report.select("request_id", size("drugs").alias("n_drugs"), size("diseases").alias("n_diseases"),
                         F.when(F.col("links").isNull(), 0).otherwise(F.size("links")).alias("n_links"))


FTS = rf"""post AS (SELECT id, term, sum(w) AS weight FROM (
  SELECT id, unnest(list_distinct(regexp_extract_all(lower(ten_thuoc), '\w+'))) AS term, 1.0::DOUBLE AS w FROM drugs
  UNION ALL SELECT id, unnest(list_distinct(regexp_extract_all(lower(hoat_chat), '\w+'))), 0.4 FROM drugs
  UNION ALL SELECT id, unnest(list_distinct(regexp_extract_all(lower(cong_ty_san_xuat), '\w+'))), 0.2 FROM drugs
  UNION ALL SELECT id, unnest(list_distinct(regexp_extract_all(search_text, '\w+'))), 0.1 FROM drugs) GROUP BY 1, 2),
fq AS (SELECT query, {d.sql_norm('query')} AS text FROM (SELECT DISTINCT substring(split_part(p_name, ' ', 2), 1, 3) || ' ' || split_part(p_name, ' ', 1) || ' ' || lower(substring(p_type, 1, 4)) AS query FROM part)),
ft AS (SELECT query, unnest(list_distinct(string_split(text, ' '))) AS token FROM fq)"""


def _fts_sql(test: str, cut: bool) -> str:
    fts = FTS if cut else FTS.replace("substring(split_part(p_name, ' ', 2), 1, 3)", "split_part(p_name, ' ', 2)").replace("substring(p_type, 1, 4)", "p_type")
    return d.ctes(d.DRUGS, fts, f"""
fh AS (SELECT query, id, count(DISTINCT token) AS have, round(sum(weight), 9) AS score FROM ft JOIN post ON {test} GROUP BY 1, 2),
need AS (SELECT query, count(*) AS need FROM ft GROUP BY 1)""") + """
SELECT query, id, round(score, 6) AS score FROM fh JOIN need USING (query) WHERE have = need QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1"""


def _fts(spark, sf, prefix: bool, ranked: bool = False):
    drugs = d.drugs(spark, sf)
    p = d.table(spark, sf, "part")
    words = F.split("p_name", " ")
    parts = (F.substring(words[1], 1, 3), words[0], F.substring("p_type", 1, 4)) if prefix else (words[1], words[0], F.col("p_type"))
    q = p.select(F.concat_ws(" ", parts[0], parts[1], F.lower(parts[2])).alias("query")).distinct()
    fields = index.build_fields(drugs, {"a": F.col("ten_thuoc"), "b": F.col("hoat_chat"), "c": F.col("cong_ty_san_xuat"), "d": F.col("search_text")})
    hits = index.search_all_terms(q.select("query", normalize_text(F.col("query")).alias("text")), fields, prefix, ranked)
    return index.best_per_query(hits).select("query", "id", F.round("score", 6).alias("score"))


def _ranked_sql() -> str:
    """fulltext_prefix with every matched weight multiplied by ln(1 + (n - df + 0.5) / (df + 0.5))."""
    stats = "pd AS (SELECT term, ln(1 + ((SELECT count(*) FROM drugs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY 1),\nfh AS ("
    return _fts_sql("starts_with(term, token)", True).replace("fh AS (", stats).replace("sum(weight)", "sum(weight * idf)").replace(
        "ft JOIN post ON starts_with(term, token)", "ft JOIN post ON starts_with(term, token) JOIN pd USING (term)")


@query("fulltext_ranked", "J24", _ranked_sql())
def fulltext_ranked(spark, sf):
    return _fts(spark, sf, True, True)


@query("fulltext_prefix", "J24", _fts_sql("starts_with(term, token)", True))
def fulltext_prefix(spark, sf):
    return _fts(spark, sf, True)


@query("fulltext_exact", "J24", _fts_sql("term = token", False))
def fulltext_exact(spark, sf):
    return _fts(spark, sf, False)


@query("drug_ref_lookup", "J11", d.ctes(d.DRUGS, d.VERIFIED, d.MESSY_NAMES, *SEARCH) + """
SELECT item_id, s.id AS drug_ref_id FROM messy_names LEFT JOIN searched s ON s.query = name AND s.confidence >= 0.85""")
def drug_ref_lookup(spark, sf):
    from rxloom.operators.knowledge import lookup_drug_ref

    names = d.messy_names(spark, sf)
    matches = matching.search_catalogue(names, "name", d.drugs(spark, sf))
    return lookup_drug_ref(names, "name", matches).select("item_id", "drug_ref_id")


@query("drug_page", "O1 P2", d.ctes(d.DRUGS) + """
SELECT id, ten_thuoc, so_dang_ky, (SELECT count(*) FROM drugs WHERE contains(lower(ten_thuoc), 'ring') OR contains(lower(coalesce(so_dang_ky, '')), 'ring')) AS total
FROM drugs WHERE contains(lower(ten_thuoc), 'ring') OR contains(lower(coalesce(so_dang_ky, '')), 'ring') ORDER BY ten_thuoc, id LIMIT 20 OFFSET 20""")
def drug_page(spark, sf):
    kept = d.drugs(spark, sf).where(ranking.contains_text("ring", "ten_thuoc", "so_dang_ky"))
    page = ranking.page_of(kept.select("id", "ten_thuoc", "so_dang_ky"), [F.col("ten_thuoc"), F.col("id")], 2, 20)
    return ranking.with_total(page, kept)


@query("drug_page_recent", "O1", d.ctes(d.DRUGS) + " SELECT id, ten_thuoc, updated_at FROM drugs ORDER BY updated_at DESC, id LIMIT 10")
def drug_page_recent(spark, sf):
    rows = d.drugs(spark, sf).select("id", "ten_thuoc", "updated_at")
    return ranking.page_of(rows, [F.desc("updated_at"), F.col("id")], 1, 10)


@query("link_page", "O2 P2 P4", d.ctes(*d.KB_CTES) + """
SELECT disease_icd AS icd_code, drug_name_norm AS drug_name, frequency FROM kb WHERE drug_name_norm <> '_icd_list_' AND
  (contains(drug_name_norm, 'bolt') OR contains(disease_name_norm, 'bolt') OR contains(disease_icd, 'bolt')) ORDER BY frequency DESC, drug_name_norm, disease_icd LIMIT 20""")
def link_page(spark, sf):
    kept = d.kb(spark, sf).where("drug_name_norm != '_icd_list_'").where(
        ranking.contains_text("bolt", "drug_name_norm", "disease_name_norm", "disease_icd"))
    rows = kept.select(F.col("disease_icd").alias("icd_code"), F.col("drug_name_norm").alias("drug_name"), "frequency")
    return ranking.page_of(rows, [F.desc("frequency"), F.col("drug_name"), F.col("icd_code")], 1, 20)


@query("disease_page", "O3 P2", d.ctes(d.DISEASES) + """
SELECT id, icd_code, disease_name, chapter_name FROM diseases WHERE contains(lower(disease_name), 'n') OR contains(lower(icd_code), 'n') OR contains(lower(slug), 'n')
ORDER BY icd_code, id LIMIT 5 OFFSET 5""")
def disease_page(spark, sf):
    kept = d.diseases(spark, sf).where(ranking.contains_text("n", "disease_name", "icd_code", "slug"))
    return ranking.page_of(kept.select("id", "icd_code", "disease_name", "chapter_name"), [F.col("icd_code"), F.col("id")], 2, 5)


@query("drug_by_number", "P8", d.ctes(d.DRUGS) + " SELECT id, ten_thuoc, so_dang_ky FROM drugs WHERE so_dang_ky = 'VN-17' OR id = 33")
def drug_by_number(spark, sf):
    return d.drugs(spark, sf).where("so_dang_ky = 'VN-17' OR id = 33").select("id", "ten_thuoc", "so_dang_ky")
