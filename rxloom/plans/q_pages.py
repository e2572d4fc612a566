"""Stored pages: the driver's pages with a drug block of the part of the same number added."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxloom.operators import quality
from rxloom.plans import domain as d
from rxloom.plans.registry import query
from rxloom.sources import pages as pg

BLOCK = ("'<div>Số đăng ký</div><div>: VN-' || p_partkey || '</div><table><tr><td>Nhà sản xuất</td><td>' || p_brand || '</td></tr></table>' || "
         "'<h2>Chỉ định</h2><p>use ' || p_type || '</p><p>twice</p><h2>Other</h2><p>x</p>' || "
         "'<table id=\"thanh-phan-hoat-chat\"><tbody><tr><td>' || p_type || '</td><td>' || p_size || ' mg</td></tr><tr><td>filler</td><td>1 g</td></tr></tbody></table>'")


def _drug_pages(spark, sf):
    p = d.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    rows = d.table(spark, sf, "pages").join(p, F.col("page_id") == F.col("p_partkey"))
    return rows.selectExpr("page_id", "p_type", "p_brand", f"replace(html, '</article>', {BLOCK} || '</article>') AS html")


@query("page_fields", "S6 F25", """
SELECT page_id, CASE WHEN contains(html, '</article>') THEN 'VN-' || p_partkey END AS so_dang_ky, CASE WHEN contains(html, '</article>') THEN p_brand END AS cong_ty_sx,
  CASE WHEN contains(html, '</article>') THEN 'use ' || p_type || chr(10) || 'twice' END AS chi_dinh FROM pages JOIN part ON page_id = p_partkey""")
def page_fields(spark, sf):
    return pg.extract_pages(_drug_pages(spark, sf)).select("page_id", "so_dang_ky", "cong_ty_sx", "chi_dinh")


@query("page_ingredients", "F26", """
SELECT page_id, unnest([0, 1]) AS pos, unnest([p_type, 'filler']) AS name, unnest([p_size || ' mg', '1 g']) AS dose
FROM pages JOIN part ON page_id = p_partkey WHERE contains(html, '</article>')""")
def page_ingredients(spark, sf):
    return pg.ingredient_rows(pg.extract_pages(_drug_pages(spark, sf)))


# The title is the first h1 before it is closed or another block begins; references are decoded, white space is folded.
@query("page_titles", "F25", r"""
SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&'), '\s+', ' ', 'g')) AS ten_thuoc FROM pages""")
def page_titles(spark, sf):
    return pg.extract_pages(d.table(spark, sf, "pages")).select("page_id", "ten_thuoc")


CAND = """cand AS (SELECT p_name AS query, p_partkey AS pos, CASE WHEN p_size % 3 = 0 OR p_name LIKE 'red%' THEN '' ELSE 'VN-' || (p_size % 4) END AS so_dang_ky, p_name AS ten_thuoc, p_type AS hoat_chat,
  p_brand AS cong_ty_san_xuat, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'use ' || p_type END AS chi_dinh, 'form ' || p_size AS dang_bao_che FROM part)"""


def _candidates(spark, sf):
    return d.table(spark, sf, "part").selectExpr(
        "p_name AS query", "p_partkey AS pos", "CASE WHEN p_size % 3 = 0 OR p_name LIKE 'red%' THEN '' ELSE 'VN-' || (p_size % 4) END AS so_dang_ky", "p_name AS ten_thuoc",
        "p_type AS hoat_chat", "p_brand AS cong_ty_san_xuat", "CASE WHEN p_size % 2 = 0 THEN '' ELSE 'use ' || p_type END AS chi_dinh", "'form ' || p_size AS dang_bao_che")


@query("candidate_merge", "A10", f"""WITH {CAND},
g AS (SELECT query, so_dang_ky, count(*) AS n, min(pos) AS first_pos, array_to_string(list_sort(list(DISTINCT hoat_chat)), ' | ') AS hoat_chat,
  array_to_string(list_sort(list(DISTINCT cong_ty_san_xuat)), ' | ') AS cong_ty_san_xuat, coalesce(array_to_string(list_sort(list(DISTINCT chi_dinh) FILTER (chi_dinh <> '')), ' | '), '') AS chi_dinh,
  arg_min(dang_bao_che, pos) AS dang_bao_che FROM cand WHERE so_dang_ky <> '' GROUP BY 1, 2),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, first_pos) = 1),
a AS (SELECT * FROM cand WHERE query NOT IN (SELECT query FROM b) QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos) = 1)
SELECT query, so_dang_ky, hoat_chat, cong_ty_san_xuat, chi_dinh, dang_bao_che, 0.8::DOUBLE AS confidence FROM b
UNION ALL SELECT query, 'Web Result (No SDK)', hoat_chat, cong_ty_san_xuat, chi_dinh, dang_bao_che, 0.8::DOUBLE FROM a""")
def candidate_merge(spark, sf):
    return quality.merge_candidates(_candidates(spark, sf), ["hoat_chat", "cong_ty_san_xuat", "chi_dinh"], ["dang_bao_che"])


@query("source_consolidation", "A11", f"""WITH {CAND}
SELECT query, so_dang_ky AS sdk, hoat_chat AS ingredients FROM cand QUALIFY row_number() OVER (PARTITION BY query ORDER BY (so_dang_ky = '')::INT, pos) = 1""")
def source_consolidation(spark, sf):
    rows = _candidates(spark, sf).select("query", "pos", F.col("so_dang_ky").alias("sdk"), F.col("hoat_chat").alias("ingredients"))
    return quality.consolidate_sources(rows, ["ingredients"])
