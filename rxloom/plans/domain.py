"""Domain tables derived from the driver's tables, as DataFrames and as SQL fragments.

The driver's tables hold no drug data, so drugs, prescription logs, claims, logs and
staging rows are derived from `part`, `lineitem`, `orders` and `events`. Each builder
has a CTE with the same meaning for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rxloom.functions.text import normalize_for_matching
from rxloom.session import materialise

_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Read a driver table; its schema is inferred once per path."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def sql_norm(expr: str, variant: str = "kb") -> str:
    """normalize_for_matching in SQL."""
    tail = r"\b" if variant == "kb" else ""
    folded = f"replace(strip_accents(lower(coalesce({expr}, ''))), 'đ', 'd')"
    kept = rf"regexp_replace({folded}, '[^a-z0-9\s\-+%.]', ' ', 'g')"
    squeezed = rf"trim(regexp_replace({kept}, '\s+', ' ', 'g'))"
    return rf"regexp_replace({squeezed}, '\b0+(\d+)(ml|mg|mcg|g|iu|ui|l|%)?{tail}', '\1\2', 'g')"


def sql_title(expr: str) -> str:
    runs = rf"regexp_extract_all(lower({expr}), '(\p{{L}}+|\P{{L}}+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1]) || x[2:]), '')"


def sql_token_sort(expr: str) -> str:
    return rf"array_to_string(list_sort(list_filter(regexp_split_to_array({expr}, '\s+'), lambda w: w <> '')), ' ')"


def sql_lcs(a: str, b: str) -> str:
    """LCS length by folding `a` over a row of the DP table of `b`."""
    return (
        f"list_reduce(string_split({a}, ''), lambda prow, ch: list_reduce(range(1, length({b}) + 1), "
        f"lambda cur, j: list_append(cur, CASE WHEN ({b})[j] = ch THEN prow[j] + 1 "
        f"ELSE greatest(prow[j + 1], cur[-1]) END), [0::BIGINT]), "
        f"list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT))[-1]"
    )


def sql_ratio(a: str, b: str) -> str:
    """Similarity of two token-sorted strings, 0..100."""
    return (
        f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE "
        f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE "
        f"WHEN {a} = {b} THEN 100.0::DOUBLE "
        f"ELSE 200.0::DOUBLE * {sql_lcs(a, b)} / (length({a}) + length({b})) END"
    )


# --- drug catalogue ---------------------------------------------------------

def drugs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("ten_thuoc"),
        F.col("p_type").alias("hoat_chat"),
        F.col("p_brand").alias("cong_ty_san_xuat"),
        F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("VN-"), F.col("p_partkey").cast("string"))).alias("so_dang_ky"),
        F.when(F.col("p_size") % 3 != 0, F.concat_ws(" ", F.lit("use"), F.col("p_type"))).alias("chi_dinh"),
        F.lit("").alias("tu_dong_nghia"),
        normalize_for_matching(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("search_text"),
        (F.col("p_size") % 5 != 0).cast("int").alias("is_verified"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("note"),
        (F.lit("2024-01-01").cast("date") + F.col("p_size").cast("int")).cast("timestamp").alias("updated_at"),
    )


DRUGS = rf"""drugs AS (
  SELECT p_partkey AS id, p_name AS ten_thuoc, p_type AS hoat_chat, p_brand AS cong_ty_san_xuat,
         CASE WHEN p_size % 7 <> 0 THEN 'VN-' || p_partkey END AS so_dang_ky,
         CASE WHEN p_size % 3 <> 0 THEN 'use ' || p_type END AS chi_dinh,
         '' AS tu_dong_nghia,
         {sql_norm("p_name || ' ' || p_type || ' ' || p_brand")} AS search_text,
         (p_size % 5 <> 0)::INT AS is_verified,
         CASE WHEN p_size % 2 = 0 THEN p_brand END AS note,
         (DATE '2024-01-01' + p_size)::TIMESTAMP AS updated_at
  FROM part)"""

VERIFIED = "verified AS (SELECT * FROM drugs WHERE is_verified = 1 AND so_dang_ky IS NOT NULL)"


def messy_names(spark: SparkSession, sf: str) -> DataFrame:
    """Free-text spellings of every part: exact, padded, cut, misspelt, reordered, descriptive."""
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    k = F.col("p_partkey") % 7
    name = (
        F.when(k == 0, F.col("p_name"))
        .when(k == 1, F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" ")))
        .when(k == 2, F.expr("substring(p_name, 2, length(p_name) - 3)"))
        .when(k == 3, F.expr("concat(substring(p_name, 1, 4), 'x', substring(p_name, 6))"))
        .when(k == 4, F.concat_ws(" ", words[1], words[0]))
        .when(k == 5, F.concat_ws(" ", "p_brand", words[1], "p_type", words[0]))
        .otherwise(F.concat_ws(" ", F.lit("pack"), "p_type", "p_brand"))
    )
    return p.select(F.col("p_partkey").alias("item_id"), name.alias("name"))


MESSY_NAMES = """messy_names AS (
  SELECT p_partkey AS item_id, CASE p_partkey % 7
    WHEN 0 THEN p_name
    WHEN 1 THEN ' ' || upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' '
             || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' '
    WHEN 2 THEN substring(p_name, 2, length(p_name) - 3)
    WHEN 3 THEN substring(p_name, 1, 4) || 'x' || substring(p_name, 6)
    WHEN 4 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
    WHEN 5 THEN p_brand || ' ' || split_part(p_name, ' ', 2) || ' ' || p_type || ' ' || split_part(p_name, ' ', 1)
    ELSE 'pack ' || p_type || ' ' || p_brand END AS name
  FROM part)"""


# --- prescription log -------------------------------------------------------

def position():
    return F.concat(
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
        F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0"),
        F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, "0"),
    )


SQL_POS = (
    "lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 2, '0') || "
    "lpad(l_partkey::VARCHAR, 12, '0') || lpad(l_suppkey::VARCHAR, 12, '0') || "
    "strftime(l_shipdate, '%Y%m%d') || lpad(l_quantity::INT::VARCHAR, 4, '0')"
)


def rx_log(spark: SparkSession, sf: str) -> DataFrame:
    """Prescription log rows in the shape of the long-header CSV, plus an input position."""
    li = table(spark, sf, "lineitem").drop("l_tax", "l_extendedprice", "l_linestatus")
    pa = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    # orders first: where both sides are exchanged, lines go without names
    rows = li.join(od, li.l_orderkey == od.o_orderkey).join(pa, li.l_partkey == pa.p_partkey)
    k = F.col("l_linenumber") % 7
    return rows.select(
        position().alias("pos"),
        F.col("l_orderkey").alias("order_id"),
        F.col("p_name").alias("drug_name"),
        F.concat(
            F.char(65 + F.col("l_suppkey") % 6), F.substring("o_orderpriority", 1, 1), F.lit(" - "),
            F.expr("substring(o_orderpriority, 3)"),
        ).alias("primary_disease"),
        F.when(F.col("l_linenumber") % 3 == 0, "")
        .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("B97.4 - "), F.col("p_type")))
        .otherwise(F.concat(F.lit('{"u": {"ma": "J06", "ten": "'), F.col("p_type"), F.lit('"}}')))
        .alias("secondary_disease"),
        F.when(k == 0, "drug, valid").when(k == 1, "supplement").when(k == 2, "{drug,invalid}")
        .when(k == 3, "secondary drug").when(k == 4, '["drug", "valid", "main drug"]')
        .when(k == 5, "medical supplies").otherwise("").alias("classification"),
        F.when(F.col("l_returnflag") == "N", "main drug").when(F.col("l_returnflag") == "R", "invalid")
        .otherwise("").alias("feedback"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")))
        .otherwise("").alias("symptom"),
        F.when(F.col("l_discount") > 0.05, F.col("o_orderstatus")).otherwise("").alias("reason"),
    )


RX_LOG = f"""rx_log AS (
  SELECT {SQL_POS} AS pos, l_orderkey AS order_id, p_name AS drug_name,
    chr((65 + l_suppkey % 6)::INT) || substring(o_orderpriority, 1, 1) || ' - ' || substring(o_orderpriority, 3) AS primary_disease,
    CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'B97.4 - ' || p_type
      ELSE '{{"u": {{"ma": "J06", "ten": "' || p_type || '"}}}}' END AS secondary_disease,
    CASE l_linenumber % 7 WHEN 0 THEN 'drug, valid' WHEN 1 THEN 'supplement' WHEN 2 THEN '{{drug,invalid}}'
      WHEN 3 THEN 'secondary drug' WHEN 4 THEN '["drug", "valid", "main drug"]'
      WHEN 5 THEN 'medical supplies' ELSE '' END AS classification,
    CASE l_returnflag WHEN 'N' THEN 'main drug' WHEN 'R' THEN 'invalid' ELSE '' END AS feedback,
    CASE WHEN l_quantity > 25 THEN 'q' || l_quantity::INT ELSE '' END AS symptom,
    CASE WHEN l_discount > 0.05 THEN o_orderstatus ELSE '' END AS reason
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def sql_tags(expr: str) -> str:
    """classification_tags in SQL (list, rule order)."""
    parts = (
        f"list_filter(list_transform(string_split(translate(lower(trim(coalesce({expr}, ''))), '[]''\"{{}}', ''), ','), "
        "lambda x: trim(x)), lambda x: x <> '')"
    )
    nod = "(list_has_any(p, ['supplement','medical supplies','cosmeceuticals','medical equipment']) AND NOT list_contains(p,'nodrug'))"
    drug = "(list_has_any(p, ['invalid','valid','secondary drug']) AND NOT list_contains(p,'drug'))"
    main = "(list_contains(p,'valid') AND NOT list_has_any(p, ['main drug','secondary drug']))"
    base = (
        f"(CASE WHEN {drug} THEN ['drug'] ELSE [] END || CASE WHEN {nod} THEN ['nodrug'] ELSE [] END || p || "
        f"CASE WHEN {main} THEN ['main drug'] ELSE [] END)"
    )
    full = (
        f"CASE WHEN list_contains(p,'secondary drug') AND NOT list_contains(p,'valid') "
        f"THEN {base}[:1] || ['valid'] || {base}[2:] ELSE {base} END"
    )
    distinct = f"list_transform([{full}], lambda f: list_filter(f, lambda x, i: list_position(f, x) = i))[1]"
    return f"list_transform([{parts}], lambda p: {distinct})[1]"


def sql_json(list_expr: str) -> str:
    return f"('[' || array_to_string(list_transform({list_expr}, lambda t: '\"' || t || '\"'), ', ') || ']')"


# --- claims and purchases ---------------------------------------------------

def claims(spark: SparkSession, sf: str) -> DataFrame:
    """One claim line per lineitem row; the order is the request."""
    li = table(spark, sf, "lineitem")
    pa = table(spark, sf, "part").select("p_partkey", "p_name")
    return li.join(pa, li.l_partkey == pa.p_partkey).select(
        F.col("l_orderkey").alias("request_id"),
        position().alias("claim_id"),
        position().alias("pos"),
        F.col("p_name").alias("service"),
        F.col("l_extendedprice").alias("amount"),
    )


CLAIMS = f"""claims AS (
  SELECT l_orderkey AS request_id, {SQL_POS} AS claim_id, {SQL_POS} AS pos, p_name AS service,
         l_extendedprice AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases are the finished lines; even lines carry a misspelt name and a changed price.

    Those of every eleventh order are requests of their own, without claims.
    """
    li = table(spark, sf, "lineitem").where(F.col("l_linestatus") == "F")
    pa = table(spark, sf, "part").select("p_partkey", "p_name")
    even = F.col("l_linenumber") % 2 == 0
    return li.join(pa, li.l_partkey == pa.p_partkey).select(
        F.when(F.col("l_orderkey") % 11 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("request_id"),
        F.concat(F.lit("m"), position()).alias("medicine_id"),
        position().alias("pos"),
        F.when(even, F.expr("concat(substring(p_name, 1, length(p_name) - 2), 'q')")).otherwise(F.col("p_name")).alias("service"),
        F.when(even, F.col("l_extendedprice") * 0.5).otherwise(F.col("l_extendedprice")).alias("amount"),
    )


PURCHASES = f"""purchases AS (
  SELECT CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS request_id, 'm' || {SQL_POS} AS medicine_id, {SQL_POS} AS pos,
    CASE WHEN l_linenumber % 2 = 0 THEN substring(p_name, 1, length(p_name) - 2) || 'q' ELSE p_name END AS service,
    CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * 0.5 ELSE l_extendedprice END AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F')"""


# --- logs -------------------------------------------------------------------

def request_logs(spark: SparkSession, sf: str) -> DataFrame:
    return as_request_logs(table(spark, sf, "events"))


def as_request_logs(ev: DataFrame) -> DataFrame:
    """Request-log rows of an events table or stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).when(k % 10 == 0, 404).otherwise(200).alias("status_code"),
        F.col("value").alias("latency_ms"),
        (k % 5).alias("matched_count"),
        (k % 3).alias("unmatched_count"),
        F.col("user_id").alias("user_id"),
        k.alias("k"),
    )


REQUEST_LOGS = """request_logs AS (
  SELECT event_id AS id, ts AS created_at, '/api/v1/' || event_type AS endpoint,
    CASE WHEN event_type = 'error' THEN 500 WHEN k % 10 = 0 THEN 404 ELSE 200 END AS status_code,
    value AS latency_ms, k % 5 AS matched_count, k % 3 AS unmatched_count, user_id, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


# --- diseases and knowledge base -------------------------------------------

def diseases(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(
        F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.char(65 + F.col("n_nationkey") % 6), F.expr("1 + n_nationkey div 6").cast("string")).alias("icd_code"),
        F.col("n_name").alias("disease_name"),
        F.col("r_name").alias("chapter_name"),
        F.lower("n_name").alias("slug"),
        F.lit("active").alias("is_active"),
    )


DISEASES = """diseases AS (
  SELECT 'd' || n_nationkey AS id, chr((65 + n_nationkey % 6)::INT) || (1 + n_nationkey // 6) AS icd_code,
    n_name AS disease_name, r_name AS chapter_name, lower(n_name) AS slug, 'active' AS is_active
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

NOW = "2024-06-01 00:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


def batch_id():
    return F.concat(F.lit("b"), (F.col("order_id") % 5).cast("string"))


def rx_half(spark: SparkSession, sf: str, part: int | None = None) -> DataFrame:
    """The log, or its even (0) or odd (1) orders, to play an old table against a new batch."""
    log = rx_log(spark, sf)
    return log if part is None else log.where(F.col("order_id") % 2 == part)


def prepared_log(spark: SparkSession, sf: str, part: int | None = None) -> DataFrame:
    """Parsed log rows with disease references; the batch is the order number modulo 5."""
    from rxloom.operators.knowledge import lookup_disease_ref, prepare_log

    rows = prepare_log(rx_half(spark, sf, part), batch_id())
    refs = diseases(spark, sf)
    rows = lookup_disease_ref(rows, refs, "disease_icd", "disease_ref_id")
    return lookup_disease_ref(rows, refs, "secondary_disease_icd", "secondary_disease_ref_id")


def kb(spark: SparkSession, sf: str, part: int | None = None) -> DataFrame:
    from rxloom.operators.knowledge import build_kb

    return build_kb(rx_half(spark, sf, part), diseases(spark, sf), batch_id(), now())


def kb_table(spark: SparkSession, sf: str) -> DataFrame:
    """The knowledge base as a stored table, as its readers meet it."""
    return materialise(kb(spark, sf), "kb")


def sql_icd(col: str) -> tuple[str, str]:
    pattern = r"(?i)^([A-Z]\d+(?:\.\d+)?)\s*-\s*(.+)$"
    code = f"lower(regexp_extract(trim({col}), '{pattern}', 1))"
    return code, f"CASE WHEN {code} <> '' THEN trim(regexp_extract(trim({col}), '{pattern}', 2)) ELSE trim({col}) END"


def sql_secondary(col: str) -> tuple[str, str]:
    code, name = sql_icd(col)
    js = f"replace({col}, '\"\"', '\"')"
    entry = f"json_extract({js}, '$.' || json_keys({js})[1])"
    return (
        f"CASE WHEN {col} LIKE '{{%}}' THEN lower(trim(json_extract_string({entry}, '$.ma'))) ELSE {code} END",
        f"CASE WHEN {col} LIKE '{{%}}' THEN trim(json_extract_string({entry}, '$.ten')) ELSE {name} END",
    )


PREPARED = f"""parsed_log AS (
  SELECT pos, order_id, trim(drug_name) AS drug_name, {sql_norm('drug_name')} AS drug_name_norm,
    {sql_icd('primary_disease')[0]} AS disease_icd, {sql_icd('primary_disease')[1]} AS disease_name,
    {sql_secondary('secondary_disease')[0]} AS secondary_disease_icd,
    {sql_secondary('secondary_disease')[1]} AS secondary_disease_name,
    {sql_json(sql_tags('classification'))} AS treatment_type, {sql_json(sql_tags('feedback'))} AS tdv_feedback,
    symptom, reason AS prescription_reason, 'b' || (order_id % 5) AS batch_id
  FROM rx_log WHERE trim(drug_name) <> '' AND trim(primary_disease) <> ''),
prepared AS (
  SELECT p.*, {sql_norm('p.disease_name')} AS disease_name_norm,
    {sql_norm('p.secondary_disease_name')} AS secondary_disease_name_norm,
    a.id AS disease_ref_id, b.id AS secondary_disease_ref_id
  FROM parsed_log p LEFT JOIN diseases a ON lower(a.icd_code) = p.disease_icd
    LEFT JOIN diseases b ON lower(b.icd_code) = p.secondary_disease_icd)"""

KB_FIRST = ["drug_name", "disease_name", "disease_name_norm", "disease_ref_id", "secondary_disease_icd",
            "secondary_disease_name", "secondary_disease_name_norm", "secondary_disease_ref_id", "batch_id"]


def sql_fold(name: str, source: str = "prepared") -> str:
    """fold_log in SQL."""
    first = ", ".join(f"arg_min_null({c}, pos) AS {c}" for c in KB_FIRST)
    return f"""{name} AS (
  SELECT drug_name_norm, disease_icd, count(*) AS frequency, {first}, NULL::BIGINT AS drug_ref_id,
    arg_max(treatment_type, pos) AS treatment_type, arg_max(tdv_feedback, pos) AS tdv_feedback,
    coalesce(arg_max(symptom, pos) FILTER (symptom <> ''), '') AS symptom,
    coalesce(arg_max(prescription_reason, pos) FILTER (prescription_reason <> ''), '') AS prescription_reason,
    TIMESTAMP '{NOW}' AS last_updated
  FROM {source} GROUP BY drug_name_norm, disease_icd)"""


KB = sql_fold("kb")
KB_CTES = (RX_LOG, DISEASES, PREPARED, KB)
