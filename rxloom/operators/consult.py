"""Classifying drug/diagnosis pairs from the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.fields import correct_mapping, extract_role, valid_role
from rxloom.functions.text import strip
from rxloom.operators.knowledge import KEY, authority
from rxloom.operators.matching import match_kb_names

NOT_IN_KB = "Không tìm thấy thông tin trong cơ sở dữ liệu."
_ROW = ["treatment_type", "tdv_feedback", "frequency"]


def _best_rows(kb: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Most authoritative knowledge-base row per key; the lowest code breaks ties."""
    a = authority()
    order = F.struct(-a["told"], -a["freq"], -F.unix_micros(a["at"]), F.col("disease_icd"))
    return kb.groupBy(*keys).agg(F.min_by(F.struct(*_ROW), order).alias(out))


def match_kb_with_icd(pairs: DataFrame, kb: DataFrame, matches: DataFrame) -> DataFrame:
    """Add the knowledge-base row for (name, icd) to `pairs(name, icd, ...)`.

    `matches` is the name-matching result. Without a row for the code the best row of the
    name is used, its code shown as GENERIC.
    """
    exact = _best_rows(kb, KEY, "e").select(*KEY, "e")
    generic = _best_rows(kb, ["drug_name_norm"], "g").select("drug_name_norm", "g")
    m = matches.withColumnRenamed("query", "name")
    j = (
        pairs.join(m, "name", "left")
        .join(exact.withColumnRenamed("disease_icd", "icd"), ["drug_name_norm", "icd"], "left")
        .join(generic, "drug_name_norm", "left")
    )
    hit = F.coalesce("e", "g")
    is_generic = F.col("e").isNull() & F.col("g").isNotNull()
    return j.select(
        *pairs.columns, "drug_name_norm",
        F.when(F.col("e").isNotNull(), F.col("icd")).when(is_generic, "GENERIC").alias("disease_icd"),
        *[hit[c].alias(c) for c in _ROW], "match_score",
        F.when(is_generic, F.concat("match_method", F.lit(" (Generic)"))).otherwise(F.col("match_method")).alias("match_method"),
    )


def consult(items: DataFrame, diagnoses: DataFrame, kb: DataFrame) -> DataFrame:
    """Category, validity and role per item of each request.

    items(request_id, item_id, name), diagnoses(request_id, pos, code). A matched name
    always has a knowledge-base row (generic if need be), so the first diagnosis of the
    request decides and the others need not be expanded.
    """
    first = diagnoses.groupBy("request_id").agg(F.min_by(F.lower(strip("code")), "pos").alias("icd"))
    pairs = items.select("request_id", "item_id", "name").join(first, "request_id", "left")
    matches = match_kb_names(items, "name", kb)
    rows = match_kb_with_icd(pairs, kb, matches)
    found = F.col("drug_name_norm").isNotNull() & F.col("icd").isNotNull()
    expert, ai = valid_role(F.col("tdv_feedback")), valid_role(F.col("treatment_type"))
    rows = rows.withColumns({"_expert": expert, "_ai": ai})
    role = F.coalesce("_expert", "_ai", F.lit("main drug"))
    m = correct_mapping(role)
    how = F.concat(F.lit(" (Match: "), F.col("match_method"), F.lit(")"))
    told = F.concat(F.lit("Expert Verified: '"), role, F.lit("' by TĐV."), how)
    ai_told = F.concat(F.lit("AI Classification: '"), role, F.lit("' (TĐV đồng ý)."), how)
    default = F.concat(F.lit("Thuốc có trong KB, mặc định là thuốc điều trị chính."), how)

    def pick(value: Column, otherwise: str | None) -> Column:
        return F.when(found, value).otherwise(F.lit(otherwise))

    return rows.select(
        "request_id", "item_id", "name",
        pick(m["category"], "drug").alias("category"), pick(m["validity"], "unknown").alias("validity"),
        pick(m["role"], "").alias("role"),
        F.when(~found, NOT_IN_KB).when(F.col("_expert").isNotNull(), told).when(F.col("_ai").isNotNull(), ai_told)
        .otherwise(default).alias("explanation"),
        F.when(~found, "INTERNAL_KB_EMPTY").when(F.col("_expert").isNotNull(), "INTERNAL_KB_TDV")
        .when(F.col("_ai").isNotNull(), "INTERNAL_KB_AI").otherwise("INTERNAL_KB_DEFAULT").alias("source"),
        pick(F.col("match_score"), None).alias("match_score"), pick(F.col("drug_name_norm"), None).alias("matched_name"),
    )


def strict_lookup(probes: DataFrame, kb: DataFrame) -> DataFrame:
    """Newest row with expert feedback, else newest row with an AI classification, per (name, code) probe."""
    told = ~F.lower(F.coalesce("tdv_feedback", F.lit(""))).isin("", "none", "null")
    typed = F.coalesce("treatment_type", F.lit("")) != ""
    at = F.col("last_updated")
    best = kb.groupBy(*KEY).agg(
        F.max_by("tdv_feedback", F.when(told, at)).alias("_tdv"), F.max_by("treatment_type", F.when(typed, at)).alias("_ai"))
    rows = probes.join(best, KEY).where("_tdv IS NOT NULL OR _ai IS NOT NULL")
    m = correct_mapping(extract_role(F.coalesce("_tdv", "_ai")))
    return rows.select(
        *probes.columns, m["category"].alias("category"), m["validity"].alias("validity"), m["role"].alias("role"),
        F.when(F.col("_tdv").isNotNull(), "INTERNAL_KB_TDV").otherwise("INTERNAL_KB_AI").alias("source"))
