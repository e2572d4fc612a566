"""Staged approval, links, deletes and purges on tables derived from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxloom.operators import catalogue, curation
from rxloom.plans import domain as d
from rxloom.plans.registry import query

SUBMISSIONS = """subs AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' new' ELSE ' ' || p_name END AS ten_thuoc, p_type AS hoat_chat,
  p_brand AS cong_ty_san_xuat, CASE WHEN p_partkey % 4 = 0 THEN 'N/A' WHEN p_partkey % 4 = 1 THEN 'VN-' || (p_partkey + 1) ELSE 'XX-' || p_partkey END AS so_dang_ky,
  'treat ' || p_type AS chi_dinh, p_brand AS tu_dong_nghia FROM part)"""
CONFLICTS = f"""conf AS (SELECT s.id, trim(s.ten_thuoc) AS ten_thuoc, s.hoat_chat, s.cong_ty_san_xuat, s.so_dang_ky, s.chi_dinh, s.tu_dong_nghia,
  {d.sql_norm("trim(s.ten_thuoc) || ' ' || s.hoat_chat || ' ' || s.cong_ty_san_xuat || ' ' || s.tu_dong_nghia")} AS search_text,
  coalesce(a.id, b.id) AS conflict_id, CASE WHEN a.id IS NOT NULL THEN 'sdk' WHEN b.id IS NOT NULL THEN 'name' END AS conflict_type
  FROM subs s LEFT JOIN (SELECT so_dang_ky, min(id) AS id FROM drugs GROUP BY 1) a ON a.so_dang_ky = s.so_dang_ky AND s.so_dang_ky NOT IN ('', 'N/A', 'Web Result')
  LEFT JOIN (SELECT ten_thuoc, min(id) AS id FROM drugs GROUP BY 1) b ON b.ten_thuoc = trim(s.ten_thuoc))"""
LINKS = """links AS (SELECT p_partkey AS drug_id, 'VN-' || p_partkey AS sdk, chr((97 + p_size % 6)::INT) || (1 + p_size % 5) AS icd_code, 'note' AS treatment_note,
  0 AS is_verified, 'drug' AS coverage_type, 'sys' AS created_by, CASE WHEN p_partkey % 2 = 0 THEN 'pending' ELSE 'draft' END AS status, TIMESTAMP '2024-01-01' AS created_at FROM part WHERE p_size % 7 <> 0)"""
NOW = f"TIMESTAMP '{d.NOW}'"


def _submissions(spark, sf):
    k = F.col("p_partkey")
    return d.table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 3 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.concat(F.lit(" "), "p_name")).alias("ten_thuoc"),
        F.col("p_type").alias("hoat_chat"), F.col("p_brand").alias("cong_ty_san_xuat"),
        F.when(k % 4 == 0, "N/A").when(k % 4 == 1, F.concat(F.lit("VN-"), (k + 1).cast("string")))
        .otherwise(F.concat(F.lit("XX-"), k.cast("string"))).alias("so_dang_ky"),
        F.concat(F.lit("treat "), "p_type").alias("chi_dinh"), F.col("p_brand").alias("tu_dong_nghia"))


def _staging(spark, sf):
    """Every submission as a staging row, with or without a conflict."""
    return curation.find_conflicts(_submissions(spark, sf), d.drugs(spark, sf)).withColumn("status", F.lit("pending"))


STAGING = (d.DRUGS, SUBMISSIONS, CONFLICTS, "staging AS (SELECT *, 'pending' AS status FROM conf)")


def _links(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    return d.table(spark, sf, "part").where("p_size % 7 <> 0").select(
        k.alias("drug_id"), F.concat(F.lit("VN-"), k.cast("string")).alias("sdk"),
        F.concat(F.char(97 + s % 6), (1 + s % 5).cast("string")).alias("icd_code"), F.lit("note").alias("treatment_note"),
        F.lit(0).alias("is_verified"), F.lit("drug").alias("coverage_type"), F.lit("sys").alias("created_by"),
        F.when(k % 2 == 0, "pending").otherwise("draft").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))


def _ids(spark, sf):
    return d.table(spark, sf, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"))


@query("submission_conflicts", "J20", d.ctes(d.DRUGS, SUBMISSIONS, CONFLICTS) + " SELECT id, search_text, conflict_id, conflict_type FROM conf")
def submission_conflicts(spark, sf):
    return curation.find_conflicts(_submissions(spark, sf), d.drugs(spark, sf)).select("id", "search_text", "conflict_id", "conflict_type")


@query("submit_staged", "M6", d.ctes(d.DRUGS, SUBMISSIONS, CONFLICTS) + " SELECT id, ten_thuoc, 'pending' AS status, conflict_type FROM conf WHERE conflict_id IS NOT NULL")
def submit_staged(spark, sf):
    return curation.submit(_submissions(spark, sf), d.drugs(spark, sf), d.now()).staged.select("id", "ten_thuoc", "status", "conflict_type")


@query("submit_inserted", "M6", d.ctes(d.DRUGS, SUBMISSIONS, CONFLICTS) + f" SELECT id, ten_thuoc, so_dang_ky, 1 AS is_verified, {NOW} AS created_at FROM conf WHERE conflict_id IS NULL")
def submit_inserted(spark, sf):
    out = curation.submit(_submissions(spark, sf), d.drugs(spark, sf), d.now()).inserted
    return out.select("id", "ten_thuoc", "so_dang_ky", "is_verified", "created_at")


@query("pending_with_conflict", "J21 P6", d.ctes(*STAGING) + """
SELECT s.id, s.conflict_id, g.ten_thuoc AS conflict_name, g.so_dang_ky AS conflict_sdk FROM staging s LEFT JOIN drugs g ON g.id = s.conflict_id WHERE status = 'pending'""")
def pending_with_conflict(spark, sf):
    out = curation.pending_list(_staging(spark, sf), d.drugs(spark, sf))
    return out.select("id", "conflict_id", F.col("conflict_info.ten_thuoc").alias("conflict_name"), F.col("conflict_info.so_dang_ky").alias("conflict_sdk"))


APPROVED = (*STAGING, LINKS, "picked AS (SELECT * FROM staging WHERE id % 2 = 1)",
            "newest AS (SELECT * FROM picked WHERE conflict_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conflict_id ORDER BY id DESC) = 1)",
            "top AS (SELECT max(id) AS m FROM drugs)")


def _approve(spark, sf):
    return curation.approve(_staging(spark, sf), d.drugs(spark, sf), _links(spark, sf), _ids(spark, sf), "admin", d.now())


@query("approve_drugs", "M7", d.ctes(*APPROVED) + f"""
SELECT g.id, coalesce(n.ten_thuoc, g.ten_thuoc) AS ten_thuoc, CASE WHEN n.id IS NOT NULL THEN n.so_dang_ky ELSE g.so_dang_ky END AS so_dang_ky,
  coalesce(n.search_text, g.search_text) AS search_text, CASE WHEN n.id IS NOT NULL THEN 1 ELSE g.is_verified END AS is_verified,
  CASE WHEN n.id IS NOT NULL THEN 'admin' END AS updated_by, CASE WHEN n.id IS NOT NULL THEN {NOW} ELSE g.updated_at END AS updated_at
FROM drugs g LEFT JOIN newest n ON n.conflict_id = g.id
UNION ALL SELECT id + (SELECT m FROM top), ten_thuoc, so_dang_ky, search_text, 1, NULL, {NOW} FROM picked WHERE conflict_id IS NULL""")
def approve_drugs(spark, sf):
    return _approve(spark, sf).drugs.select("id", "ten_thuoc", "so_dang_ky", "search_text", "is_verified", "updated_by", "updated_at")


@query("approve_history", "M7", d.ctes(*APPROVED, """
states AS (SELECT id AS drug, -1 AS step, ten_thuoc, so_dang_ky FROM drugs WHERE id IN (SELECT conflict_id FROM picked)
  UNION ALL SELECT conflict_id, id, ten_thuoc, so_dang_ky FROM picked WHERE conflict_id IS NOT NULL)""") + """
SELECT drug AS original_drug_id, ten_thuoc, so_dang_ky, 'admin' AS archived_by FROM states QUALIFY row_number() OVER (PARTITION BY drug ORDER BY step DESC) > 1""")
def approve_history(spark, sf):
    return _approve(spark, sf).history.select("original_drug_id", "ten_thuoc", "so_dang_ky", "archived_by")


@query("approve_links", "M7", d.ctes(*APPROVED, """
tg AS (SELECT so_dang_ky AS sdk, arg_max(coalesce(conflict_id, id + (SELECT m FROM top)), id) AS target FROM picked WHERE so_dang_ky <> '' GROUP BY 1)""") + """
SELECT sdk, icd_code, coalesce(target, drug_id) AS drug_id, CASE WHEN target IS NOT NULL THEN 'active' ELSE status END AS status FROM links LEFT JOIN tg USING (sdk)""")
def approve_links(spark, sf):
    return _approve(spark, sf).links.select("sdk", "icd_code", "drug_id", "status")


@query("approve_archive", "M7", d.ctes(*APPROVED) + """
SELECT id AS staging_id, 'approved' AS action FROM picked UNION ALL SELECT id, 'still pending' FROM staging WHERE id % 2 = 0""")
def approve_archive(spark, sf):
    out = _approve(spark, sf)
    done = out.staging_history.select(F.col("original_staging_id").alias("staging_id"), "action")
    return done.unionByName(out.staging.select(F.col("id").alias("staging_id"), F.lit("still pending").alias("action")))


@query("reject_staging", "M8", d.ctes(*STAGING, LINKS) + """
SELECT sdk AS key, CASE WHEN status = 'pending' AND sdk IN (SELECT so_dang_ky FROM staging WHERE id % 2 = 1) THEN 'archived' ELSE status END AS state FROM links
UNION ALL SELECT id::VARCHAR, CASE WHEN id % 2 = 1 THEN 'rejected' ELSE 'pending' END FROM staging""")
def reject_staging(spark, sf):
    out = curation.reject(_staging(spark, sf), _links(spark, sf), _ids(spark, sf), "admin", d.now())
    return (out.links.select(F.col("sdk").alias("key"), F.col("status").alias("state"))
            .union(out.staging_history.select(F.col("original_staging_id").cast("string"), "action"))
            .union(out.staging.select(F.col("id").cast("string"), "status")))


@query("clear_staging", "M9", d.ctes(*STAGING) + """
SELECT id, CASE WHEN id % 3 = 0 THEN 'kept' ELSE 'cleared' END AS state FROM staging""")
def clear_staging(spark, sf):
    st = _staging(spark, sf).withColumn("status", F.when(F.col("id") % 3 == 0, "held").otherwise("pending"))
    out = curation.clear_pending(st, "admin", d.now())
    return out.staging_history.select(F.col("original_staging_id").alias("id"), F.col("action").alias("state")).union(
        out.staging.select("id", F.lit("kept")))


@query("edit_staging", "M10", d.ctes(*STAGING) + """
SELECT id, CASE WHEN id % 2 = 1 THEN 'edited' ELSE ten_thuoc END AS ten_thuoc, CASE WHEN id % 2 = 1 THEN NULL ELSE so_dang_ky END AS so_dang_ky, status FROM staging""")
def edit_staging(spark, sf):
    st = catalogue.add_missing_columns(_staging(spark, sf), {"classification": "string", "note": "string"})
    empty = {c: F.lit(None).cast("string") for c in curation.EDITABLE}
    edits = _ids(spark, sf).withColumns({**empty, "ten_thuoc": F.lit("edited")})
    return curation.edit_staging(st, edits).select("id", "ten_thuoc", "so_dang_ky", "status")


@query("delete_rows", "M11", d.ctes(d.DRUGS, LINKS) + """
SELECT 'drug' AS kind, id::VARCHAR AS key FROM drugs WHERE coalesce(so_dang_ky, '') NOT IN (SELECT sdk FROM links WHERE drug_id % 10 = 3) AND id % 11 <> 4
UNION ALL SELECT 'link', sdk FROM links WHERE icd_code NOT IN ('a1', 'b2')""")
def delete_rows(spark, sf):
    links = _links(spark, sf)
    sdks = links.where("drug_id % 10 = 3").select(F.col("sdk").alias("so_dang_ky"))
    drugs = curation.delete_keys(d.drugs(spark, sf), sdks, ["so_dang_ky"])
    drugs = curation.delete_keys(drugs, d.drugs(spark, sf).where("id % 11 = 4").select("id"), ["id"])
    codes = links.where("icd_code IN ('a1', 'b2')").select("icd_code").distinct()
    kept = curation.delete_keys(links, codes, ["icd_code"])
    return drugs.select(F.lit("drug").alias("kind"), F.col("id").cast("string").alias("key")).union(kept.select(F.lit("link"), "sdk"))


@query("purge_bad_names", "M12 P7", d.ctes(d.DRUGS, LINKS, """
nd AS (SELECT id, so_dang_ky, CASE id % 9 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE ten_thuoc END AS ten_thuoc FROM drugs)""") + """
SELECT 'drug' AS kind, id::VARCHAR AS key FROM nd WHERE id % 9 > 2 UNION ALL
SELECT 'link', sdk FROM links WHERE sdk NOT IN (SELECT so_dang_ky FROM nd WHERE id % 9 <= 2 AND so_dang_ky IS NOT NULL)""")
def purge_bad_names(spark, sf):
    k = F.col("id") % 9
    drugs = d.drugs(spark, sf).withColumn("ten_thuoc", F.when(k == 0, "NA").when(k == 1, "").when(k != 2, F.col("ten_thuoc")))
    kept, links = curation.purge_bad_names(drugs, _links(spark, sf))
    return kept.select(F.lit("drug").alias("kind"), F.col("id").cast("string").alias("key")).union(links.select(F.lit("link"), "sdk"))


LINK_REQS = """lr AS (SELECT pos, drug_name, 'dis ' || disease_icd AS disease_name, 'VN-' || (l_partkey % 300) AS sdk, upper(disease_icd) || ' ' AS icd_code,
  'n' || pos AS treatment_note, 1 AS is_verified, classification AS coverage_type, 'web' AS created_by, 'active' AS status
  FROM (SELECT *, substring(pos, 15, 12)::BIGINT AS l_partkey, lower(substring(primary_disease, 1, 2)) AS disease_icd FROM rx_log)),
lf AS (SELECT sdk, lower(trim(icd_code)) AS icd_code, arg_min(drug_name, pos) AS drug_name, arg_min(disease_name, pos) AS disease_name,
  arg_min(coverage_type, pos) AS first_type, arg_min(treatment_note, pos) AS first_note, min(pos) AS pos,
  arg_max(treatment_note, pos) AS treatment_note, arg_max(coverage_type, pos) AS coverage_type FROM lr GROUP BY 1, 2)"""


def _link_requests(spark, sf):
    rows = d.rx_log(spark, sf).select(
        "pos", "drug_name", F.lower(F.substring("primary_disease", 1, 2)).alias("code"), "classification",
        F.substring("pos", 15, 12).cast("bigint").alias("part"))
    return rows.select(
        "pos", "drug_name", F.concat(F.lit("dis "), "code").alias("disease_name"),
        F.concat(F.lit("VN-"), (F.col("part") % 300).cast("string")).alias("sdk"), F.concat(F.upper("code"), F.lit(" ")).alias("icd_code"),
        F.concat(F.lit("n"), "pos").alias("treatment_note"), F.lit(1).alias("is_verified"), F.col("classification").alias("coverage_type"),
        F.lit("web").alias("created_by"), F.lit("active").alias("status"))


@query("link_upsert", "M5", d.ctes(d.RX_LOG, LINKS, LINK_REQS) + """
SELECT sdk, icd_code, CASE WHEN f.pos IS NOT NULL THEN f.treatment_note ELSE l.treatment_note END AS treatment_note,
  CASE WHEN f.pos IS NOT NULL THEN 'active' ELSE l.status END AS status, CASE WHEN l.sdk IS NULL THEN 'web' ELSE l.created_by END AS created_by
FROM links l FULL JOIN lf f USING (sdk, icd_code)""")
def link_upsert(spark, sf):
    out = curation.upsert_links(_links(spark, sf), d.kb(spark, sf), _link_requests(spark, sf), d.now())
    return out.links.select("sdk", "icd_code", "treatment_note", "status", "created_by")


@query("link_kb_sync", "M5", d.ctes(*d.KB_CTES, LINKS, LINK_REQS, f"""
created AS (SELECT * FROM lf ANTI JOIN links USING (sdk, icd_code)),
sync AS (SELECT {d.sql_norm('drug_name')} AS drug_name_norm, icd_code AS disease_icd, count(*) AS n, arg_max(first_type, pos) AS t, arg_max(first_note, pos) AS note FROM created GROUP BY 1, 2)""") + """
SELECT drug_name_norm, disease_icd, coalesce(frequency, 0) + coalesce(n, 0) AS frequency, CASE WHEN n IS NOT NULL THEN t ELSE treatment_type END AS treatment_type,
  CASE WHEN n IS NOT NULL THEN note ELSE tdv_feedback END AS tdv_feedback FROM kb FULL JOIN sync USING (drug_name_norm, disease_icd)""")
def link_kb_sync(spark, sf):
    out = curation.upsert_links(_links(spark, sf), d.kb(spark, sf), _link_requests(spark, sf), d.now())
    return out.knowledge_base.select("drug_name_norm", "disease_icd", "frequency", "treatment_type", "tdv_feedback")


@query("catalogue_refine", "M13 F16 F17 F18", d.ctes(d.DRUGS) + f"""
, p AS (SELECT id, ten_thuoc || CASE WHEN id % 2 = 0 THEN ' (box of 3)' ELSE '' END AS raw, hoat_chat, so_dang_ky, '<b>' || coalesce(chi_dinh, '') || '</b> &amp; x' AS chi_dinh FROM drugs),
n AS (SELECT *, CASE WHEN id % 2 = 0 THEN '(box of 3)' ELSE '' END AS quy_cach, {d.sql_title("trim(replace(raw, '(box of 3)', ''))")} AS ten_thuoc FROM p)
SELECT id, ten_thuoc, quy_cach, trim(coalesce(nullif(trim(regexp_extract(chi_dinh, '<b>(.*)</b>', 1)), '') || ' ', '') || '& x') AS chi_dinh, 'Khác' AS nhom_duoc_ly,
  {d.sql_norm("ten_thuoc || ' ' || hoat_chat || ' ' || coalesce(so_dang_ky, '')")} AS search_text FROM n""")
def catalogue_refine(spark, sf):
    drugs = d.drugs(spark, sf).withColumns({
        "ten_thuoc": F.concat("ten_thuoc", F.when(F.col("id") % 2 == 0, " (box of 3)").otherwise("")),
        "chi_dinh": F.concat(F.lit("<b>"), F.coalesce("chi_dinh", F.lit("")), F.lit("</b> &amp; x"))})
    return catalogue.refine_catalogue(drugs).select("id", "ten_thuoc", "quy_cach", "chi_dinh", "nhom_duoc_ly", "search_text")
