"""Knowledge-base building, keyed sinks and catalogue loading over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxloom.operators import catalogue, knowledge, quality, ranking
from rxloom.plans import domain as d
from rxloom.plans.registry import query

KB_COLUMNS = ", ".join(["drug_name_norm", "disease_icd", "frequency", *d.KB_FIRST, "treatment_type", "tdv_feedback",
                        "symptom", "prescription_reason", "last_updated"])


@query("kb_fold", "S4 A1 J10", d.ctes(*d.KB_CTES) + f" SELECT {KB_COLUMNS} FROM kb")
def kb_fold(spark, sf):
    return d.kb(spark, sf).drop("drug_ref_id")


def _sql_upsert() -> str:
    first = ", ".join(f"CASE WHEN o.drug_name_norm IS NOT NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in d.KB_FIRST)
    return f"""SELECT coalesce(o.drug_name_norm, n.drug_name_norm) AS drug_name_norm, coalesce(o.disease_icd, n.disease_icd) AS disease_icd,
  coalesce(o.frequency, 0) + coalesce(n.frequency, 0) AS frequency, {first},
  coalesce(n.treatment_type, o.treatment_type) AS treatment_type, coalesce(n.tdv_feedback, o.tdv_feedback) AS tdv_feedback,
  coalesce(nullif(n.symptom, ''), o.symptom, n.symptom) AS symptom,
  coalesce(nullif(n.prescription_reason, ''), o.prescription_reason, n.prescription_reason) AS prescription_reason,
  coalesce(n.last_updated, o.last_updated) AS last_updated
FROM old_kb o FULL JOIN new_kb n ON o.drug_name_norm = n.drug_name_norm AND o.disease_icd = n.disease_icd"""


HALVES = (d.RX_LOG, d.DISEASES, d.PREPARED,
          "even AS (SELECT * FROM prepared WHERE order_id % 2 = 0)", "odd AS (SELECT * FROM prepared WHERE order_id % 2 = 1)",
          d.sql_fold("old_kb", "even"), d.sql_fold("new_kb", "odd"))


@query("kb_upsert", "M1", d.ctes(*HALVES) + " " + _sql_upsert())
def kb_upsert(spark, sf):
    return knowledge.upsert_kb(d.kb(spark, sf, 0), d.kb(spark, sf, 1)).drop("drug_ref_id")


@query("kb_batch_stats", "A2", d.ctes(*HALVES) + """
SELECT (SELECT count(*) FROM rx_log WHERE order_id % 2 = 1) AS total,
  (SELECT count(*) FROM rx_log WHERE order_id % 2 = 1) - (SELECT count(*) FROM odd) AS errors,
  (SELECT count(*) FROM new_kb n ANTI JOIN old_kb o ON o.drug_name_norm = n.drug_name_norm AND o.disease_icd = n.disease_icd) AS inserted,
  (SELECT count(*) FROM odd) - (SELECT count(*) FROM new_kb n ANTI JOIN old_kb o ON o.drug_name_norm = n.drug_name_norm AND o.disease_icd = n.disease_icd) AS updated,
  0 AS drugs_matched, (SELECT count(disease_ref_id) FROM odd) AS diseases_matched""")
def kb_batch_stats(spark, sf):
    log = d.rx_log(spark, sf).where(F.col("order_id") % 2 == 1)
    return knowledge.batch_stats(log, d.prepared_log(spark, sf, 1), d.kb(spark, sf, 0))


@query("kb_restore", "M2", d.ctes(d.RX_LOG, d.DISEASES, d.DRUGS, d.PREPARED, f"""
drug_map AS (SELECT lower(trim(ten_thuoc)) AS q, max(id) AS drug_ref FROM drugs GROUP BY 1),
strict_log AS (SELECT p.* EXCLUDE (drug_name_norm, disease_name_norm, secondary_disease_name_norm, batch_id), lower(p.drug_name) AS drug_name_norm, m.drug_ref,
  NULL::VARCHAR AS disease_name_norm, NULL::VARCHAR AS secondary_disease_name_norm, 'QUICK_RESTORE' AS batch_id
  FROM prepared p LEFT JOIN drug_map m ON m.q = lower(p.drug_name) WHERE disease_icd <> ''),
even AS (SELECT * FROM prepared WHERE order_id % 2 = 0)""", d.sql_fold("old_kb", "even"), """
n AS (SELECT drug_name_norm, disease_icd, count(*) AS frequency, arg_min_null(drug_name, pos) AS drug_name, arg_max_null(drug_ref, pos) AS drug_ref,
  arg_max_null(disease_ref_id, pos) AS disease_ref_id, arg_max(treatment_type, pos) AS treatment_type, arg_max(tdv_feedback, pos) AS tdv_feedback,
  arg_min_null(symptom, pos) AS symptom FROM strict_log GROUP BY 1, 2)""") + """
SELECT coalesce(o.drug_name_norm, n.drug_name_norm) AS drug_name_norm, coalesce(o.disease_icd, n.disease_icd) AS disease_icd,
  coalesce(o.frequency, 0) + coalesce(n.frequency, 0) AS frequency, coalesce(n.drug_ref, NULL) AS drug_ref_id,
  CASE WHEN n.drug_name_norm IS NOT NULL THEN n.disease_ref_id ELSE o.disease_ref_id END AS disease_ref_id,
  coalesce(n.treatment_type, o.treatment_type) AS treatment_type, coalesce(n.tdv_feedback, o.tdv_feedback) AS tdv_feedback,
  CASE WHEN o.drug_name_norm IS NOT NULL THEN o.symptom ELSE n.symptom END AS symptom,
  CASE WHEN o.drug_name_norm IS NOT NULL THEN o.batch_id ELSE 'QUICK_RESTORE' END AS batch_id
FROM old_kb o FULL JOIN n ON o.drug_name_norm = n.drug_name_norm AND o.disease_icd = n.disease_icd""")
def kb_restore(spark, sf):
    out = knowledge.restore_kb(d.kb(spark, sf, 0), d.rx_log(spark, sf), d.drugs(spark, sf), d.diseases(spark, sf), d.now())
    return out.select("drug_name_norm", "disease_icd", "frequency", "drug_ref_id", "disease_ref_id", "treatment_type",
                      "tdv_feedback", "symptom", "batch_id")


@query("kb_votes", "A14", d.ctes(d.RX_LOG, d.DISEASES, d.PREPARED, """
v AS (SELECT drug_name_norm, disease_icd, treatment_type, tdv_feedback, count(*) AS votes FROM prepared GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY drug_name_norm, disease_icd ORDER BY (tdv_feedback IN ('', '[]'))::INT, votes DESC, tdv_feedback, treatment_type) AS rn FROM v)""") + """
SELECT drug_name_norm, disease_icd, CASE WHEN tdv_feedback NOT IN ('', '[]') THEN tdv_feedback ELSE treatment_type END AS role_tags,
  CASE WHEN tdv_feedback NOT IN ('', '[]') THEN 'expert' ELSE 'ai' END AS source, votes FROM r WHERE rn = 1""")
def kb_votes(spark, sf):
    return knowledge.vote_and_promote(d.prepared_log(spark, sf))


@query("kb_frequency_confidence", "A15", d.ctes(*d.KB_CTES) + """
SELECT drug_name_norm, disease_icd, round(least(1.0, log10(frequency) / 2), 6) AS confidence,
  (round(least(1.0, log10(frequency) / 2), 9) >= 0.8)::INT AS trusted FROM kb""")
def kb_frequency_confidence(spark, sf):
    conf = knowledge.frequency_confidence(F.col("frequency"))
    return d.kb(spark, sf).select("drug_name_norm", "disease_icd", F.round(conf, 6).alias("confidence"),
                                  (F.round(conf, 9) >= 0.8).cast("int").alias("trusted"))


@query("icd_top30", "A13", d.ctes(d.RX_LOG, d.DISEASES, d.PREPARED) + """
SELECT disease_icd, count(*) AS n FROM prepared WHERE disease_icd <> '' GROUP BY 1 ORDER BY n DESC, disease_icd LIMIT 30""")
def icd_top30(spark, sf):
    return quality.code_frequency(d.prepared_log(spark, sf), "disease_icd")


@query("kb_names", "U1 P4", d.ctes(*d.KB_CTES) + """
SELECT DISTINCT drug_name_norm, disease_icd, disease_name_norm FROM kb WHERE drug_name_norm <> '_icd_list_'""")
def kb_names(spark, sf):
    return d.kb(spark, sf).where("drug_name_norm != '_icd_list_'").select("drug_name_norm", "disease_icd", "disease_name_norm").distinct()


@query("input_names_in_order", "U2", d.ctes(d.RX_LOG) + " SELECT drug_name, min(pos) AS pos FROM rx_log GROUP BY 1")
def input_names_in_order(spark, sf):
    return ranking.ordered_distinct(d.rx_log(spark, sf), "drug_name", "pos")


@query("first_per_name", "W1", d.ctes(d.DRUGS) + """
SELECT ten_thuoc, hoat_chat, min(id) AS id FROM drugs GROUP BY 1, 2""")
def first_per_name(spark, sf):
    return ranking.first_per_key(d.drugs(spark, sf), ["ten_thuoc", "hoat_chat"], [F.col("id")]).select("ten_thuoc", "hoat_chat", "id")


@query("insert_or_ignore", "K5 K7", d.ctes(d.DRUGS) + """
SELECT ten_thuoc, min(id) AS id, max(is_new) AS is_new FROM (
  SELECT ten_thuoc, min(id) AS id, 0 AS is_new FROM drugs WHERE id % 3 = 0 GROUP BY 1
  UNION ALL SELECT ten_thuoc, min(id), 1 FROM drugs b WHERE id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM drugs a WHERE a.id % 3 = 0 AND a.ten_thuoc = b.ten_thuoc) GROUP BY 1)
GROUP BY 1""")
def insert_or_ignore(spark, sf):
    rows = d.drugs(spark, sf).select("ten_thuoc", "id")
    target = ranking.first_per_key(rows.where("id % 3 = 0"), ["ten_thuoc"], [F.col("id")]).withColumn("is_new", F.lit(0))
    fresh = rows.where("id % 3 <> 0").withColumn("is_new", F.lit(1))
    return catalogue.insert_or_ignore(target, fresh, ["ten_thuoc"], [F.col("id")])


@query("insert_or_replace", "K6", d.ctes(d.DRUGS) + " SELECT ten_thuoc, max(id) AS id FROM drugs GROUP BY 1")
def insert_or_replace(spark, sf):
    return catalogue.last_per_key(d.drugs(spark, sf).select("ten_thuoc", "id"), ["ten_thuoc"], [F.col("id")])


CRAWL = ("SELECT p_partkey AS pos, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'VN-' || (p_partkey % 500) END AS so_dang_ky, "
         "' ' || p_name AS ten_thuoc, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS hoat_chat, "
         "CASE WHEN p_size % 2 = 0 THEN 'nan' ELSE p_brand END AS danh_muc, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size || 'mg' END AS ham_luong, "
         "CASE WHEN p_size % 5 = 0 THEN '' ELSE 'use ' || p_type END AS noi_dung_dieu_tri FROM part")


def _crawl(spark, sf):
    return d.table(spark, sf, "part").selectExpr(
        "p_partkey AS pos", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'VN-' || (p_partkey % 500) END AS so_dang_ky",
        "' ' || p_name AS ten_thuoc", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS hoat_chat",
        "CASE WHEN p_size % 2 = 0 THEN 'nan' ELSE p_brand END AS danh_muc",
        "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size || 'mg' END AS ham_luong",
        "CASE WHEN p_size % 5 = 0 THEN '' ELSE 'use ' || p_type END AS noi_dung_dieu_tri")


FILLED = " + ".join(
    f"(coalesce(trim({c}), '') <> '' AND lower(coalesce({c}, '')) <> 'nan')::INT"
    for c in ["so_dang_ky", "ten_thuoc", "hoat_chat", "danh_muc", "ham_luong", "noi_dung_dieu_tri"])
DEDUPED = f"""crawl AS ({CRAWL}), scored AS (SELECT pos, so_dang_ky, trim(ten_thuoc) AS ten_thuoc, hoat_chat, danh_muc, ham_luong, noi_dung_dieu_tri, {FILLED} AS score FROM crawl),
deduped AS (SELECT * EXCLUDE (score) FROM scored WHERE so_dang_ky IS NULL UNION ALL
  SELECT * EXCLUDE (score) FROM scored WHERE so_dang_ky IS NOT NULL QUALIFY row_number() OVER (PARTITION BY so_dang_ky ORDER BY score DESC, pos) = 1)"""


@query("catalogue_dedupe", "A8", f"WITH {DEDUPED} SELECT * FROM deduped")
def catalogue_dedupe(spark, sf):
    return quality.dedupe_by_completeness(_crawl(spark, sf), "so_dang_ky", "pos")


@query("catalogue_dedupe_collapsed", "A8", f"""WITH {DEDUPED}
SELECT pos, so_dang_ky FROM scored QUALIFY row_number() OVER (PARTITION BY so_dang_ky ORDER BY score DESC, pos) = 1""")
def catalogue_dedupe_collapsed(spark, sf):
    return quality.dedupe_by_completeness(_crawl(spark, sf), "so_dang_ky", "pos", null_key_collapses=True).select("pos", "so_dang_ky")


@query("duplicate_profile", "A9", f"""WITH crawl AS ({CRAWL}), g AS (SELECT so_dang_ky, count(*) AS n FROM crawl WHERE so_dang_ky IS NOT NULL GROUP BY 1)
SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_keys, sum(n - 1)::BIGINT AS surplus, count(*) FILTER (n > 1) AS repeated_keys FROM g""")
def duplicate_profile(spark, sf):
    return quality.duplicate_profile(_crawl(spark, sf), "so_dang_ky")


@query("duplicate_groups", "A9", f"""WITH crawl AS ({CRAWL})
SELECT so_dang_ky, count(*) AS n FROM crawl WHERE so_dang_ky IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, so_dang_ky LIMIT 5""")
def duplicate_groups(spark, sf):
    return quality.duplicate_groups(_crawl(spark, sf), "so_dang_ky")


@query("catalogue_enrich", "M3", f"""WITH {d.DRUGS}, crawl AS ({CRAWL}),
rec0 AS (SELECT pos, so_dang_ky, trim(ten_thuoc) AS ten_thuoc, CASE WHEN lower(noi_dung_dieu_tri) <> 'nan' THEN nullif(noi_dung_dieu_tri, '') END AS chi_dinh,
  CASE WHEN coalesce(ham_luong, '') <> '' AND NOT contains(hoat_chat, ham_luong) THEN trim(hoat_chat || ' ' || ham_luong) ELSE hoat_chat END AS hoat_chat,
  CASE WHEN danh_muc <> '' AND lower(danh_muc) <> 'nan' THEN 'Nhóm: ' || danh_muc ELSE '' END AS note
  FROM crawl WHERE coalesce(so_dang_ky, '') <> ''),
rec AS (SELECT so_dang_ky, arg_min(ten_thuoc, pos) AS ten_thuoc, arg_min(hoat_chat, pos) AS hoat_chat, arg_min(chi_dinh, pos) FILTER (chi_dinh <> '') AS chi_dinh,
  coalesce(arg_min(note, pos) FILTER (note <> ''), '') AS note, arg_max(ten_thuoc || ' ' || hoat_chat, pos) AS last_text FROM rec0 GROUP BY 1)
SELECT coalesce(o.so_dang_ky, r.so_dang_ky) AS so_dang_ky, coalesce(o.ten_thuoc, r.ten_thuoc) AS ten_thuoc,
  CASE WHEN o.id IS NULL THEN r.hoat_chat ELSE o.hoat_chat END AS hoat_chat,
  coalesce(nullif(o.chi_dinh, ''), r.chi_dinh) AS chi_dinh, coalesce(nullif(o.note, ''), CASE WHEN o.id IS NULL THEN r.note ELSE nullif(r.note, '') END) AS note,
  CASE WHEN r.so_dang_ky IS NOT NULL THEN {d.sql_norm("r.last_text")} ELSE o.search_text END AS search_text,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN r.so_dang_ky IS NOT NULL THEN 'updated' ELSE 'kept' END AS outcome
FROM drugs o FULL JOIN rec r ON o.so_dang_ky = r.so_dang_ky""")
def catalogue_enrich(spark, sf):
    # Numbers repeat, and every second one is padded.
    padded = F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" "), "so_dang_ky", F.lit(" "))).otherwise(F.col("so_dang_ky"))
    records = catalogue.shape_records(_crawl(spark, sf).withColumns({"so_dang_ky": padded, "ten_thuoc": F.trim("ten_thuoc")}))
    return catalogue.enrich_by_sdk(d.drugs(spark, sf), records, d.now(), "import", order="pos").select(
        "so_dang_ky", "ten_thuoc", "hoat_chat", "chi_dinh", "note", "search_text", "outcome")


@query("catalogue_reload", "M4 U3", f"""WITH crawl AS ({CRAWL})
SELECT trim(ten_thuoc) AS ten_thuoc, coalesce(so_dang_ky, '') AS so_dang_ky, hoat_chat, noi_dung_dieu_tri AS chi_dinh,
  'Group: ' || danh_muc || CASE WHEN coalesce(ham_luong, '') <> '' THEN ' | Strength: ' || ham_luong ELSE '' END AS note,
  lower(trim(trim(ten_thuoc) || ' ' || hoat_chat || ' ' || coalesce(so_dang_ky, '') || ' ' || danh_muc)) AS search_text
FROM crawl QUALIFY row_number() OVER (PARTITION BY coalesce(so_dang_ky, ''), trim(ten_thuoc) ORDER BY pos) = 1""")
def catalogue_reload(spark, sf):
    crawl = _crawl(spark, sf)
    both = crawl.where("pos % 2 = 0").unionByName(crawl.where("pos % 2 = 1"), allowMissingColumns=True)
    return catalogue.reload_catalogue(both, "crawl", "pos").select("ten_thuoc", "so_dang_ky", "hoat_chat", "chi_dinh", "note", "search_text")


@query("table_counts", "A18", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ["part", "lineitem", "orders", "events", "documents", "pages"]))
def table_counts(spark, sf):
    return quality.table_counts({t: d.table(spark, sf, t) for t in ["part", "lineitem", "orders", "events", "documents", "pages"]})


@query("schema_evolution", "K8", """
SELECT p_partkey AS id, p_name AS ten_thuoc, NULL::VARCHAR AS source_urls, NULL::VARCHAR AS nhom_duoc_ly FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_partkey % 2 = 1""")
def schema_evolution(spark, sf):
    p = d.table(spark, sf, "part")
    old = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("ten_thuoc"))
    new = p.where("p_partkey % 2 = 1").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("ten_thuoc"), F.col("p_brand").alias("source_urls"),
        F.col("p_type").alias("nhom_duoc_ly"))
    return catalogue.add_missing_columns(old, {"source_urls": "string", "nhom_duoc_ly": "string"}).unionByName(new)
