"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxloom.functions import extract, fields, refine, text
from rxloom.functions.register import register_functions
from rxloom.functions.similarity import add_text_similarity
from rxloom.plans import domain as d
from rxloom.plans.registry import query

LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "

COMPOUND = "p_name || ' ' || p_size || 'mg/' || p_type || ' (' || p_brand || ') ' || (p_size % 9) || '.5 ml'"
PACKED = "p_name || ' - [x] 0' || p_size || 'mg (box ' || p_size || ') 12 ml chai ' || p_size || ' hop vien'"


def _part(spark, sf, sql: str, alias: str = "raw"):
    return d.table(spark, sf, "part").selectExpr("p_partkey AS id", f"{sql} AS {alias}", "*")


@query("normalize_documents", "F1 F2", f"""
SELECT doc_id, md5({d.sql_norm('text')}) AS kb_key, md5({d.sql_norm('text', 'claims')}) AS claims_key,
       length({d.sql_norm('text')}) AS n FROM documents""")
def normalize_documents(spark, sf):
    kb = text.normalize_text(F.col("text"))
    return d.table(spark, sf, "documents").select(
        "doc_id", F.md5(kb).alias("kb_key"),
        F.md5(text.normalize_for_matching(F.col("text"), "claims")).alias("claims_key"), F.length(kb).alias("n"))


def sql_compound(expr: str, kb: bool = True) -> str:
    """normalize_drug_name in SQL."""
    dose = r"\d+(?:\.\d+)?\s*(mg|g|mcg|iu|ml|l)"
    s = rf"regexp_replace(lower({expr}), '\s+', ' ', 'g')"
    act = "p" if not kb else r"trim(regexp_replace(regexp_replace(p, '\([^)]*\)', '', 'g'), '\s+', ' ', 'g'))"
    parts = (rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({s}, '{dose}', ' ', 'g'), "
             rf"'\+|/|,|\band\b|\bva\b'), lambda x: trim(x)), lambda x: length(x) >= 2 AND regexp_matches(x, '[a-z]'))")
    doses = rf"list_transform(regexp_extract_all({s}, '{dose}', 0), lambda x: regexp_replace(lower(x), '\s+', '', 'g'))"
    return (f"(SELECT array_to_string(list_transform(a, lambda p, i: CASE WHEN i <= len(b) THEN {d.sql_title(act)} || ' ' || b[i] "
            f"ELSE {d.sql_title(act)} END), ' + ') FROM (SELECT {parts} AS a, {doses} AS b) WHERE len(a) > 0 AND len(b) > 0)")


@query("compound_names", "F3 F4", f"""
SELECT p_partkey AS id, {sql_compound(COMPOUND)} AS kb_name, {sql_compound(COMPOUND, False)} AS claims_name FROM part""")
def compound_names(spark, sf):
    return _part(spark, sf, COMPOUND).select(
        "id", text.normalize_drug_name(F.col("raw")).alias("kb_name"),
        text.normalize_drug_name(F.col("raw"), "claims").alias("claims_name"))


@query("search_prefix", "F5", """
SELECT doc_id, trim(regexp_extract(text, '^[a-zA-Z ]*')) AS prefix FROM documents""")
def search_prefix(spark, sf):
    return d.table(spark, sf, "documents").select(
        "doc_id", text.normalize_for_search(F.col("text"), LATIN).alias("prefix"))


@query("search_name_strip", "F6", rf"""
WITH s AS (SELECT p_partkey AS id, {PACKED} AS raw FROM part),
a AS (SELECT id, raw, regexp_replace(regexp_replace(raw, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g') AS x FROM s),
b AS (SELECT id, raw, regexp_replace(regexp_replace(x, '[-–—/\\]', ' ', 'g'),
  '\d+\s*(mg|ml|g|mcg|iu|ui|liều|viên|ống|xịt|gói|chai|lọ|hộp)\b', '', 'gi') AS x FROM a),
c AS (SELECT id, raw, regexp_replace(regexp_replace(x, '\b(liều|xịt|viên|ống|gói|chai|lọ|hộp|mg|ml|mcg)\b', '', 'gi'),
  '\b\d+\b', '', 'g') AS x FROM b)
SELECT id, coalesce(nullif(trim(regexp_replace(x, '\s+', ' ', 'g')), ''), split_part(raw, ' ', 1)) AS name FROM c""")
def search_name_strip(spark, sf):
    return _part(spark, sf, PACKED).select("id", text.strip_search_name(F.col("raw")).alias("name"))


@query("name_keywords", "F7", f"""
SELECT p_partkey AS id, array_to_string(list_filter(string_split({d.sql_norm(PACKED, 'claims')}, ' '),
  lambda w: length(w) >= 2 AND NOT list_contains(['hop','box','chai','bottle','vi','vien','tabs','cap','capsule','tablet','ong','tube','goi','sachet'], w)), '|') AS words
FROM part""")
def name_keywords(spark, sf):
    return _part(spark, sf, PACKED).select("id", F.array_join(text.extract_keywords(F.col("raw")), "|").alias("words"))


@query("disease_fields", "F8 F9", d.ctes(d.RX_LOG) + f"""
SELECT pos, {d.sql_icd('primary_disease')[0]} AS icd, {d.sql_icd('primary_disease')[1]} AS disease,
  {d.sql_secondary('secondary_disease')[0]} AS second_icd, {d.sql_secondary('secondary_disease')[1]} AS second_disease
FROM rx_log""")
def disease_fields(spark, sf):
    first, second = fields.parse_icd(F.col("primary_disease")), fields.parse_secondary_disease(F.col("secondary_disease"))
    return d.rx_log(spark, sf).select(
        "pos", first["code"].alias("icd"), first["name"].alias("disease"),
        second["code"].alias("second_icd"), second["name"].alias("second_disease"))


@query("classification_tags", "F10", d.ctes(d.RX_LOG) + f"""
SELECT pos, {d.sql_json(d.sql_tags('classification'))} AS treatment, {d.sql_json(d.sql_tags('feedback'))} AS feedback
FROM rx_log""")
def classification_tags(spark, sf):
    return d.rx_log(spark, sf).select(
        "pos", fields.tags_json(fields.classification_tags(F.col("classification"))).alias("treatment"),
        fields.tags_json(fields.classification_tags(F.col("feedback"))).alias("feedback"))


def _sql_rules() -> str:
    key = "trim(translate(lower(feedback), '{}\"''', ''))"
    tags = "list_transform(string_split(translate(lower(classification) || ',' || lower(feedback), '{}\"''', ''), ','), lambda x: trim(x))"
    rules = fields.CLASSIFICATION_RULES
    exact = " ".join(f"WHEN {key} = '{v}' THEN '{v}'" for v, *_ in rules)
    part = " ".join(
        f"WHEN {key} <> '' AND ({' OR '.join(f'contains({key}, {k!r})' for k in ks)}) THEN '{v}'" for v, _, _, ks in rules)
    tag = " ".join(f"WHEN list_has_any({tags}, {ks!r}) THEN '{v}'" for v, _, _, ks in rules)
    return f"CASE {exact} {part} {tag} ELSE 'unknown' END"


@query("classification_labels", "F11", d.ctes(d.RX_LOG) + f""",
c AS (SELECT pos, {_sql_rules()} AS value FROM rx_log)
SELECT pos, value, CASE value {' '.join(f"WHEN '{v}' THEN '{l}'" for v, l, *_ in fields.CLASSIFICATION_RULES)}
  ELSE '{fields.UNKNOWN_LABEL}' END AS label FROM c""")
def classification_labels(spark, sf):
    c = fields.classify_labels(F.col("classification"), F.col("feedback"))
    return d.rx_log(spark, sf).select("pos", c["value"].alias("value"), c["label"].alias("label"))


def sql_role(col: str) -> str:
    items = f"list_transform(string_split(translate({col}, '[]\"''', ''), ','), lambda x: trim(translate(x, '{{}}', '')))"
    kept = f"list_filter({items}, lambda x: NOT list_contains(['drug','nodrug','valid','invalid',''], lower(x)))"
    return f"coalesce({kept}[-1], '')"


def sql_valid_role(col: str) -> str:
    r = sql_role(col)
    return f"CASE WHEN NOT list_contains(['','null','none','valid','invalid','unknown'], lower(trim({r}))) THEN {r} END"


SQL_NODRUG = "[" + ",".join(f"'{r}'" for r in fields.NODRUG_ROLES) + "]"


def sql_mapping(role: str) -> tuple[str, str]:
    low = f"lower(trim(coalesce({role}, '')))"
    return (
        f"CASE WHEN list_contains({SQL_NODRUG}, {low}) THEN 'nodrug' ELSE 'drug' END",
        f"CASE WHEN coalesce({role}, '') = '' THEN 'invalid' WHEN list_contains({SQL_NODRUG}, {low}) THEN '' "
        f"WHEN {low} IN ('main drug','secondary drug') THEN 'valid' "
        f"WHEN contains({low}, 'invalid') OR contains({low}, 'contraindication') THEN 'invalid' ELSE 'valid' END",
    )


@query("roles", "F12 F13 F14 F15", d.ctes(d.RX_LOG) + f""",
r AS (SELECT pos, {sql_role('classification')} AS role, {sql_valid_role('classification')} AS informative FROM rx_log),
m AS (SELECT pos, role, informative, {sql_mapping('role')[0]} AS category, {sql_mapping('role')[1]} AS validity FROM r)
SELECT pos, role, informative, category, validity,
  CASE WHEN lower(role) IN ('main drug','secondary drug') THEN 'drug'
       WHEN list_contains({SQL_NODRUG}, lower(role)) THEN 'nodrug' ELSE 'nodrug' END AS repaired_category,
  CASE WHEN lower(role) IN ('main drug','secondary drug') THEN 'valid' ELSE validity END AS repaired_validity
FROM m""")
def roles(spark, sf):
    role = fields.extract_role(F.col("classification"))
    rows = d.rx_log(spark, sf).select("pos", role.alias("role"), fields.valid_role(F.col("classification")).alias("informative"))
    m = fields.correct_mapping(F.col("role"))
    rows = rows.select("*", m["category"].alias("category"), m["validity"].alias("validity"))
    fixed = fields.validate_output(F.lit("nodrug"), F.col("validity"), F.col("role"))
    return rows.select("*", fixed["category"].alias("repaired_category"), fixed["validity"].alias("repaired_validity"))


@query("html_text", "F16", r"""
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '\s+', ' ', 'g'))) AS body FROM pages""")
def html_text(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", F.md5(refine.clean_html(F.col("html"))).alias("body"))


BOXED = "CASE p_size % 4 WHEN 0 THEN p_name || ' (hộp ' || p_size || ' vỉ) -' WHEN 1 THEN p_name || ' (Box of ' || p_size || ')' WHEN 2 THEN p_name || ' ' || p_size || 'mg strong' ELSE p_name END"


@query("packaging_split", "F17", rf"""
WITH s AS (SELECT p_partkey AS id, {BOXED} AS raw FROM part),
p AS (SELECT id, raw, coalesce(nullif(regexp_extract(raw, '(?i)\((hộp|vỉ|lọ|chai|tuýp|ống).*?\)'), ''),
  nullif(regexp_extract(raw, '(?i)\((box|bottle|tube|ampoule).*?\)'), ''),
  nullif(regexp_extract(raw, '(?i)\d+\s*(viên|ml|g|mg).*?$'), ''), '') AS packaging FROM s),
c AS (SELECT id, packaging, CASE WHEN packaging = '' THEN raw ELSE trim(regexp_replace(trim(regexp_replace(
  replace(raw, packaging, ''), '\s+', ' ', 'g')), '^-+|-+$', '', 'g')) END AS x FROM p)
SELECT id, packaging, {d.sql_title('x')} AS name FROM c""")
def packaging_split(spark, sf):
    s = refine.split_packaging(F.col("raw"))
    return _part(spark, sf, BOXED).select("id", s["packaging"].alias("packaging"), s["name"].alias("name"))


INGREDIENT = ("CASE p_size % 9 WHEN 0 THEN 'Amoxicillin' WHEN 1 THEN 'Losartan' WHEN 2 THEN 'Paracetamol' WHEN 3 THEN 'Metformin' "
              "WHEN 4 THEN 'Omeprazol' WHEN 5 THEN 'Cetirizin' WHEN 6 THEN 'Enalapril' WHEN 7 THEN '' ELSE 'Vitamin C' END || "
              "CASE WHEN p_size % 9 = 7 THEN '' ELSE ' ' || p_type END")


@query("ingredient_category", "F18", "WITH s AS (SELECT p_partkey AS id, " + INGREDIENT + " AS raw FROM part) SELECT id, CASE WHEN raw = '' THEN 'Khác' "
       + " ".join(f"WHEN regexp_matches(lower(raw), '{'|'.join(k)}') THEN '{n}'" for n, k in refine.CATEGORIES)
       + " ELSE 'Khác' END AS category FROM s")
def ingredient_category(spark, sf):
    return _part(spark, sf, INGREDIENT).select("id", refine.infer_category(F.col("raw")).alias("category"))


DOC_STOPS = [r"\bque la\b", r"\bof the\b", r"\bder die\b", r"\bde la\b", r"\bthe of\b"]
DOC_TERMS = ["the", "of", "in", "la", "que", "de la", "und", "para", "not here"]
SQL_FOLDED = r"trim(regexp_replace(replace(replace(strip_accents(lower(text)), 'đ', 'd'), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query("indication_summary", "F19 F20 M14", "WITH s AS (SELECT doc_id, " + SQL_FOLDED + " AS t FROM documents), c AS (SELECT doc_id, CASE "
       + " ".join(rf"WHEN regexp_matches(t, '{p}') THEN trim(regexp_extract(t, '(?s)^(.*?){p}', 1))" for p in DOC_STOPS)
       + " ELSE t END AS section FROM s) SELECT doc_id, md5(section) AS section, array_to_string(list_filter(["
       + ", ".join(rf"CASE WHEN regexp_matches(section, '\b{t}\b') THEN '{t}' END" for t in sorted(DOC_TERMS))
       + "], lambda x: x IS NOT NULL), ', ') AS terms FROM c")
def indication_summary(spark, sf):
    rows = d.table(spark, sf, "documents").select("doc_id", refine.indication_section(F.col("text"), DOC_STOPS).alias("section"))
    return rows.select("doc_id", F.md5("section").alias("section"), refine.indication_terms(F.col("section"), DOC_TERMS).alias("terms"))


LEAFLET = ("p_name || CASE p_size % 4 WHEN 0 THEN '\nSDK: VN-' || (10000 + p_partkey) || '-' || (10 + p_size) WHEN 1 THEN "
           "'\nno. vd-' || (20000 + p_partkey) || '-' || (10 + p_size) WHEN 2 THEN '\nReg.No: AB/' || p_partkey || 'xx' ELSE '\nnone' END || "
           "'\nThành phần: ' || p_type || '\nNhà sản xuất: ' || p_brand || '\n'")


@query("leaflet_fields", "F21", rf"""
WITH s AS (SELECT p_partkey AS id, replace({LEAFLET.replace(chr(10), '~')}, '~', chr(10)) AS t FROM part),
r AS (SELECT id, t, coalesce(nullif(regexp_extract(t, '(?i)(?:SĐK|Số đăng ký|SDK|Reg\.No)[:\.]?\s*([A-Z0-9\-\/]{{5,20}})', 1), ''),
 nullif(regexp_extract(t, '(?i)(VN-\d{{4,10}}-\d{{2}}|VD-\d{{4,10}}-\d{{2}}|QLD-\d+-\d+|GC-\d+-\d+|VNA-\d+-\d+|VNB-\d+-\d+)', 1), ''),
 nullif(regexp_extract(t, '(?i)([A-Z]{{1,3}}-\d{{4,10}}-\d{{2}})', 1), '')) AS sdk FROM s)
SELECT id, sdk AS so_dang_ky, trim(regexp_extract(t, '(?i)(?:Hoạt chất|Thành phần)[:\.]?\s*(.+?)(?:\n|$)', 1)) AS hoat_chat,
 trim(regexp_extract(t, '(?i)(?:Công ty|Nhà) sản xuất[:\.]?\s*(.+?)(?:\n|$)', 1)) AS maker,
 coalesce(nullif(regexp_extract(t, '(?i)(VN-\d{{4,5}}-\d{{2}}|VD-\d{{4,5}}-\d{{2}}|QLD-\d+-\d+|GC-\d+-\d+|VNA-\d+-\d+|VNB-\d+-\d+)', 1), ''),
  nullif(regexp_extract(t, '(?i)(?:Số\s+đăng\s+ký|SĐK|SDK|Reg\.No)[:.]?\s*([A-Za-z0-9\-\/Đđ]+)', 1), ''), 'Not Found') AS page_sdk
FROM r""")
def leaflet_fields(spark, sf):
    info = extract.parse_drug_info(F.col("raw"))
    return _part(spark, sf, LEAFLET).select(
        "id", info["so_dang_ky"].alias("so_dang_ky"), info["hoat_chat"].alias("hoat_chat"),
        info["cong_ty_san_xuat"].alias("maker"), extract.page_sdk(F.col("raw")).alias("page_sdk"))


# Written out here, so that a wrong list in the engine does not pass.
EXCLUDE = ["/search", "/drgsearch", "/category", "/danh-muc", "/tim-kiem", "/kết-quả", "/ketqua", "?q=", "?s="]
INCLUDE = ["/thuoc-", "/thuoc/", "/product/", "/san-pham/", "/detail/", "/chi-tiet/", "products/detail"]


def _sql_url(exclude, include):
    no = " OR ".join(f"contains(lower(url), '{x}')" for x in exclude)
    yes = " OR ".join(f"contains(lower(url), '{x}')" for x in include)
    return f"((NOT ({no})) AND ({yes}))::INT"


URLS = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '?srsltid=a' WHEN 1 THEN replace(url, '/en/', '/thuoc/') WHEN 2 THEN replace(url, '/fr/', '/product/') || '#x' ELSE url || '/search?q=1' END AS url, html FROM pages"


@query("url_rules", "F23", f"""
WITH u AS ({URLS})
SELECT page_id, split_part(split_part(url, '#', 1), '?srsltid=', 1) AS cleaned,
  contains(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'example.com')::INT AS allowed,
  {_sql_url(EXCLUDE, INCLUDE)} AS detail,
  {_sql_url(EXCLUDE[:4], INCLUDE[:2])} AS detail_strict FROM u""")
def url_rules(spark, sf):
    url = F.col("url")
    return _urls(spark, sf).select(
        "page_id", extract.clean_url(url).alias("cleaned"),
        extract.is_allowed_domain(url, ["example.com"]).cast("int").alias("allowed"),
        extract.is_detail_page(url).cast("int").alias("detail"),
        extract.is_detail_page(url, strict=True).cast("int").alias("detail_strict"))


def _urls(spark, sf):
    return d.table(spark, sf, "pages").selectExpr(
        "page_id", URLS[URLS.index("CASE"):URLS.index(" AS url")] + " AS url", "html")


@query("page_relevance", "F24", r"""
WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id % 3 = 0 THEN 'the-mg (xx)' ELSE 'Que (des)' END AS keyword FROM pages),
k AS (SELECT *, list_filter(regexp_split_to_array(keyword, '[\s\-\(\)mg]+'), lambda x: length(x) > 2) AS tokens FROM t)
SELECT page_id, (len(tokens) = 0 OR len(list_filter(tokens, lambda x: contains(lower(title), lower(x)) OR contains(lower(url), lower(x)))) > 0)::INT AS relevant
FROM k""")
def page_relevance(spark, sf):
    rows = d.table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(F.col("page_id") % 3 == 0, "the-mg (xx)").otherwise("Que (des)").alias("keyword"))
    return rows.select("page_id", extract.is_relevant_page(F.col("keyword"), F.col("title"), F.col("url")).cast("int").alias("relevant"))


@query("record_shaping", "F27 F28 F29", rf"""
WITH s AS (SELECT p_partkey AS id, p_name, CASE WHEN p_size % 5 = 0 THEN 'nan' ELSE p_type END AS ing, p_size || 'mg' AS dose,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS grp FROM part),
t AS (SELECT *, CASE WHEN ing <> '' AND lower(ing) <> 'nan' THEN ing END AS kept FROM s)
SELECT id, kept AS ingredient, CASE WHEN contains(coalesce(kept, ''), dose) THEN coalesce(kept, '') ELSE trim(coalesce(kept, '') || ' ' || dose) END AS full_ingredient,
  CASE WHEN grp <> '' THEN 'Bào chế: ' || grp || '; Nhóm: ' || grp ELSE '' END AS note,
  {d.sql_norm("p_name || ' ' || coalesce(kept, '')")} AS search_key,
  lower(trim(p_name || ' ' || coalesce(kept, '') || ' ' || grp)) AS search_plain FROM t""")
def record_shaping(spark, sf):
    s = d.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), "p_name",
        fields.drop_nan(F.when(F.col("p_size") % 5 == 0, "nan").otherwise(F.col("p_type"))).alias("ing"),
        F.concat(F.col("p_size").cast("string"), F.lit("mg")).alias("dose"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("grp"))
    return s.select(
        "id", F.col("ing").alias("ingredient"),
        fields.full_ingredient(F.col("ing"), F.col("dose")).alias("full_ingredient"),
        fields.labelled_note("; ", ("Bào chế: ", F.col("grp")), ("Nhóm: ", F.col("grp"))).alias("note"),
        text.search_text(F.col("p_name"), F.col("ing")).alias("search_key"),
        text.search_text(F.col("p_name"), F.col("ing"), F.col("grp"), recipe="lower").alias("search_plain"))


VARIANT = "' ' || p_name || ' (' || p_brand || ') 0' || p_size || 'mg'"


@query("query_variants", "F30", rf"""
WITH s AS (SELECT p_partkey AS id, trim({VARIANT}) AS raw, {d.sql_norm(VARIANT)} AS norm FROM part),
v AS (SELECT id, list_filter([nullif(raw, ''), CASE WHEN norm <> '' AND norm <> lower(raw) THEN norm END,
  nullif(regexp_extract(norm, '^(.*) ([^ ]*\d[^ ]*)$', 1), '')], lambda x: x IS NOT NULL) AS vs FROM s)
SELECT id, unnest(range(0, len(vs)))::INT AS rank, unnest(vs) AS variant FROM v""")
def query_variants(spark, sf):
    return _part(spark, sf, VARIANT).select("id", F.posexplode(text.query_variants(F.col("raw"))).alias("rank", "variant"))


@query("name_similarity", "F31", d.ctes(d.MESSY_NAMES, f"""
p AS (SELECT item_id, name, p_name FROM messy_names JOIN part ON item_id = p_partkey),
k AS (SELECT DISTINCT name, p_name, {d.sql_token_sort('name')} AS a, {d.sql_token_sort('p_name')} AS b FROM p),
s AS (SELECT name, p_name, round({d.sql_ratio('a', 'b')} / 100, 6) AS similarity FROM k)""") + """
SELECT item_id, similarity FROM p JOIN s USING (name, p_name)""")
def name_similarity(spark, sf):
    pairs = d.messy_names(spark, sf).join(
        d.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name"), "item_id")
    scored = add_text_similarity(pairs, "name", "p_name", "sim")
    return scored.select("item_id", F.round("sim", 6).alias("similarity"))


@query("confidence_rules", "F32 F33 F34 F35", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 3 THEN 0.0 ELSE l_extendedprice END AS a,
  CASE WHEN l_linenumber IN (2, 3) THEN 0.0 ELSE l_extendedprice * (1 - l_discount) END AS b, l_tax * 10 AS sim, l_discount * 10 AS db FROM lineitem),
x AS (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 1.0::DOUBLE WHEN a = 0 OR b = 0 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0 - abs(a - b) / greatest(a, b)) END AS amt FROM s),
c AS (SELECT *, least(1.0::DOUBLE, 0.5::DOUBLE * sim + 0.35::DOUBLE * db + 0.15::DOUBLE * amt) AS conf FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(amt, 6) AS amount_similarity, round(conf, 6) AS confidence,
  CASE WHEN conf >= 0.85::DOUBLE THEN 'matched' WHEN conf >= 0.7::DOUBLE THEN 'partially_matched' WHEN conf > 0.5::DOUBLE THEN 'weak_match' ELSE 'no_match' END AS match_status,
  CASE WHEN conf >= 0.85::DOUBLE THEN 'auto_approved' WHEN conf > 0.5::DOUBLE THEN 'manual_review' ELSE 'rejected' END AS decision
FROM c""")
def confidence_rules(spark, sf):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    n = F.col("l_linenumber")
    s = d.table(spark, sf, "lineitem").select(
        *key, F.when(n == 3, 0.0).otherwise(F.col("l_extendedprice")).alias("a"),
        F.when(n.isin(2, 3), 0.0).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"),
        (F.col("l_tax") * 10).alias("sim"), (F.col("l_discount") * 10).alias("db"))
    s = s.withColumn("amt", fields.amount_similarity(F.col("a"), F.col("b")))
    s = s.withColumn("conf", fields.match_confidence(F.col("sim"), F.col("amt"), F.col("db")))
    dec = fields.decide(F.col("conf"))
    return s.select(*key, F.round("amt", 6).alias("amount_similarity"), F.round("conf", 6).alias("confidence"),
                    dec["match_status"].alias("match_status"), dec["decision"].alias("decision"))


@query("external_scores", "F36", """
WITH s AS (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN 'Equivalent' WHEN 1 THEN 'partial_x' WHEN 2 THEN 'no_match' WHEN 3 THEN 'weird' END AS st FROM events)
SELECT event_id, CASE WHEN lower(st) = 'equivalent' THEN 'matched' WHEN contains(lower(st), 'partial') THEN 'partially_matched'
  WHEN lower(st) IN ('matched','weak_match','no_match') THEN lower(st) ELSE 'weak_match' END AS status,
  round(greatest(0.0, least(1.0, CASE WHEN value > 1 THEN value / 100 ELSE value END)), 6) AS score FROM s""")
def external_scores(spark, sf):
    k = F.col("event_id") % 5
    st = F.when(k == 0, "Equivalent").when(k == 1, "partial_x").when(k == 2, "no_match").when(k == 3, "weird")
    return d.table(spark, sf, "events").select(
        "event_id", fields.external_status(st).alias("status"),
        F.round(fields.external_score(F.col("value")), 6).alias("score"))


RESPONSE = ("CASE event_id % 4 WHEN 0 THEN '{\"matches\": [{\"claim_id\": \"c' || event_id || '\", \"confidence_score\": 0.5}]}' "
            "WHEN 1 THEN 'ok ```json\n{\"matches\": [{\"claim_id\": \"c' || event_id || '\"}, {\"claim_id\": \"d\"}]}\n``` done' "
            "WHEN 2 THEN 'x ```{\"matches\": []}``` y' ELSE event_type END")


@query("response_matches", "F37", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_matches,
  CASE WHEN event_id % 4 IN (0, 1) THEN 'c' || event_id END AS first_claim FROM events""")
def response_matches(spark, sf):
    rows = d.table(spark, sf, "events").selectExpr("event_id", f"{RESPONSE} AS body")
    m = fields.response_matches(F.col("body"))
    return rows.select("event_id", F.size(m).alias("n_matches"), F.get(m, F.lit(0))["claim_id"].alias("first_claim"))


LOGGED = ("CASE event_id % 3 WHEN 0 THEN '{\"results\": [{\"category\": \"drug\", \"validity\": \"valid\"}, {\"category\": \"' || event_type || '\"}]}' "
          "WHEN 1 THEN '{\"summary\": {\"matched_items\": ' || (user_id % 7) || ', \"unmatched_claims\": 2}}' ELSE 'not json' END")


@query("logged_counts", "F38", f"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN user_id % 7 ELSE 0 END::INT AS matched_count,
  CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS unmatched_count, length({LOGGED}) AS body_length, length(props) AS props_length
FROM events""")
def logged_counts(spark, sf):
    rows = d.table(spark, sf, "events").selectExpr(
        "event_id", "props", f"{LOGGED} AS body",
        "CASE event_id % 3 WHEN 0 THEN '/api/v1/consult_integrated' ELSE '/api/v1/mapping/match' END AS endpoint")
    c = fields.logged_counts(F.col("endpoint"), F.col("body"))
    return rows.select("event_id", c["matched_count"].alias("matched_count"), c["unmatched_count"].alias("unmatched_count"),
                       F.length(fields.stored_body(F.col("body"))).alias("body_length"), F.length(fields.stored_body(F.col("props"), 100_000)).alias("props_length"))


@query("page_usage", "F22", r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body, length(ltrim(text)) AS raw FROM documents)
SELECT doc_id, md5(found) AS whole, md5(CASE WHEN raw < 1500 THEN substring(found, 1, 400) || '...' ELSE 'Not Found' END) AS report
FROM (SELECT doc_id, raw, CASE WHEN raw >= 9 THEN body ELSE body || ' Liều dùng: 1' END AS found FROM s)""")
def page_usage(spark, sf):
    text = F.concat(F.lit("Chỉ định: "), "text", F.lit("\nLiều dùng: 1"))
    return d.table(spark, sf, "documents").select("doc_id", F.md5(extract.page_usage(text)).alias("whole"), F.md5(extract.page_usage(text, 400)).alias("report"))


@query("sql_functions", "X1", f"""
SELECT p_partkey AS id, {d.sql_norm(COMPOUND)} AS kb_key, {d.sql_norm(COMPOUND, 'claims')} AS claim_key, {sql_compound(COMPOUND)} AS drug_name,
  CASE WHEN p_size = 0 OR p_retailprice = 0 THEN 0.5 ELSE greatest(0.0::DOUBLE, 1 - abs(p_size - p_retailprice) / greatest(p_size, p_retailprice)) END::DOUBLE AS amount,
  CASE WHEN p_size >= 42.5 THEN 'matched' WHEN p_size >= 35 THEN 'partially_matched' WHEN p_size > 25 THEN 'weak_match' ELSE 'no_match' END AS status,
  CASE WHEN p_size >= 42.5 THEN 'auto_approved' WHEN p_size > 25 THEN 'manual_review' ELSE 'rejected' END AS decision FROM part""")
def sql_functions(spark, sf):
    register_functions(spark)
    _part(spark, sf, COMPOUND).createOrReplaceTempView("sql_function_rows")
    return spark.sql("""SELECT id, normalize_text(raw) AS kb_key, normalize_claim_name(raw) AS claim_key, normalize_drug_name(raw) AS drug_name,
        amount_similarity(p_size, p_retailprice) AS amount, match_status(p_size / 50) AS status, match_decision(p_size / 50) AS decision FROM sql_function_rows""")
