"""Identification of drug lists, disease lookups and verified links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.functions.text import normalize_drug_name, strip
from rxloom.operators.candidates import substring_first
from rxloom.operators.matching import search_catalogue
from rxloom.operators.ranking import mark_duplicates, ordered_distinct, top_per_key

UNUSABLE_SDK = ["N/A", "Web Result (No SDK)"]


def identify(names: DataFrame, drugs: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Identify the distinct names of `names(name, pos)` in input order.

    The catalogue answers first; `fallback` (query, so_dang_ky, ten_thuoc, hoat_chat, ...),
    keyed by the search keyword, supplies the rest. Later holders of a number are duplicates.
    """
    inputs = ordered_distinct(names, "name", "pos").withColumn(
        "keyword", F.coalesce(normalize_drug_name(strip("name")), strip("name")))
    hits = search_catalogue(inputs, "keyword", drugs)
    info = drugs.where((F.col("is_verified") == 1) & (F.coalesce("so_dang_ky", F.lit("")) != "")).select(
        "id", "ten_thuoc", "so_dang_ky", "hoat_chat", F.col("chi_dinh").alias("usage"))
    found = hits.join(info, "id").select(
        F.col("query").alias("keyword"), F.struct(
            F.col("ten_thuoc").alias("official_name"), F.col("so_dang_ky").alias("sdk"),
            F.col("hoat_chat").alias("active_ingredient"), "usage", "source", "confidence").alias("db"))
    rows = inputs.join(found, "keyword", "left")
    best = F.col("db")
    if fallback is not None:
        web = fallback.select(F.col("query").alias("keyword"), F.struct(
            F.col("ten_thuoc").alias("official_name"), F.col("so_dang_ky").alias("sdk"),
            F.col("hoat_chat").alias("active_ingredient"), F.col("chi_dinh").alias("usage"),
            F.lit("Web Search (Advanced)").alias("source"), F.col("confidence").cast("double").alias("confidence")).alias("web"))
        rows = rows.join(web, "keyword", "left")
        best = F.coalesce("db", "web")
    flat = rows.withColumn("r", best).select(
        "pos", F.col("name").alias("input_name"), "r.*", F.when(F.col("r").isNull(), "Not Found").alias("status"))
    return mark_duplicates(flat, "sdk", "input_name", "pos", UNUSABLE_SDK)


def find_diseases(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """Disease per query(query_id, name, icd): code equal or prefix first, then name contained, else Not Found."""
    entry = F.struct(F.col("disease_icd").alias("icd_code"), F.col("disease_name_norm").alias("disease_name"),
                     F.col("treatment_type").alias("chapter_name"))
    known = kb.select(entry.alias("entry"), "disease_icd", "disease_name_norm").distinct()
    reach = F.transform(F.sequence(F.lit(1), F.length("disease_icd")), lambda n: F.col("disease_icd").substr(F.lit(1), n))
    by_code = (
        known.where("disease_icd != ''")
        .select("entry", F.explode(reach).alias("icd"), "disease_icd")
        .groupBy("icd")
        .agg(F.min_by("entry", F.struct(F.length("disease_icd"), "entry")).alias("c"))
    )
    names = known.select(F.lower("disease_name_norm").alias("name"), F.col("entry").alias("id"))
    needles = queries.where("name != ''").select(F.lower("name").alias("needle")).distinct()
    by_name = substring_first(needles, names).withColumnRenamed("id", "n")
    j = queries.join(by_code, "icd", "left").join(by_name, F.lower("name") == F.col("needle"), "left")
    best = F.coalesce("c", "n")
    return j.select(
        "query_id", best["icd_code"].alias("icd_code"), best["disease_name"].alias("disease_name"),
        best["chapter_name"].alias("chapter_name"),
        F.when(best.isNotNull(), "KnowledgeBase").otherwise("Not Found").alias("source"))


def verified_links(requests: DataFrame, kb: DataFrame, per_code: int = 5, nested: bool = False) -> DataFrame:
    """Every number of a request with the top knowledge-base rows of every code of that request.

    requests(request_id, sdks array, icds array); numbers are carried along, not matched. `nested` gives one row per request
    with its `links` in order: the requests are brought together before they meet the rows of their codes.
    """
    top = top_per_key(kb, ["disease_icd"], [F.desc("frequency"), F.col("drug_name_norm")], per_code).select(
        F.col("disease_icd").alias("icd_code"), F.col("drug_name_norm").alias("drug_name"),
        F.col("disease_name_norm").alias("disease_name"), "frequency", "treatment_type")
    if nested:
        given = [F.coalesce("treatment_type", F.lit("supportive")).alias("classification"), F.coalesce("frequency", F.lit(1)).alias("frequency"), F.lit(True).alias("verified")]
        lists = top.groupBy("icd_code").agg(F.collect_list(F.struct("drug_name", "disease_name", *given)).alias("top"))
        codes = requests.repartition("request_id").select("request_id", "sdks", F.explode("icds").alias("icd_code")).join(lists, "icd_code")
        fields = ["drug_name", "disease_name", "classification", "frequency", "verified"]
        rows = F.flatten(F.transform("sdks", lambda s: F.transform(
            "top", lambda r: F.struct(s.alias("sdk"), F.col("icd_code").alias("icd_code"), *[r[c].alias(c) for c in fields]))))
        return codes.select("request_id", rows.alias("rows")).groupBy("request_id").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("links")).where("size(links) > 0")
    codes = requests.select("request_id", "sdks", F.explode("icds").alias("icd_code"))
    return codes.join(top, "icd_code").select(
        "request_id", F.explode("sdks").alias("sdk"), "icd_code", "drug_name", "disease_name",
        F.coalesce("treatment_type", F.lit("supportive")).alias("classification"),
        F.coalesce("frequency", F.lit(1)).alias("frequency"), F.lit(True).alias("verified"))


def treatment_report(identified: DataFrame, diseases: DataFrame, links: DataFrame) -> DataFrame:
    """One nested record per request from its drugs, diseases and links (each with request_id; links may be nested already).

    The record holds one request's own lists, which is what the report is.
    """
    def nest(df: DataFrame, out: str) -> DataFrame:
        cols = [c for c in df.columns if c != "request_id"]
        return df.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(out))

    linked = links if links.columns == ["request_id", "links"] else nest(links, "links")
    return nest(identified, "drugs").join(nest(diseases, "diseases"), "request_id", "full").join(linked, "request_id", "full")
