"""Expose scalar functions to Spark SQL as temporary functions of a session.

SQL functions are inlined into the calling plan and stay in the JVM; the Arrow ones
serve where Python is needed. Each body builds on the functions registered before it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.functions import extract, fields, refine, text
from rxloom.functions.similarity import lcs_len, lcs_lengths


def _q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


RETURNS = {
    "parse_icd": "STRUCT<code: STRING, name: STRING>", "extract_keywords": "ARRAY<STRING>", "is_detail_page": "BOOLEAN",
    "amount_similarity": "DOUBLE", "match_confidence": "DOUBLE", "token_cost": "DOUBLE",
}


def _bodies() -> dict[str, tuple[str, str]]:
    source, target, many, many_class = text._fold_tables()
    blanks = _q(" \t\n\r\x0b\f 　")
    table = f"from_json({_q(json.dumps(many))}, 'map<string,string>')"
    runs = _q(r"(\p{L}+|\P{L}+)")
    icd, dose, sep = _q(fields.ICD_PATTERN), _q(text.DOSE_PATTERN), _q(text.SEPARATOR_PATTERN)
    roles = lambda items: (
        f"get(reverse(filter(transform({items}, x -> btrim(translate(x, '{{}}', ''), {blanks})), "
        f"x -> lower(x) NOT IN {_list(fields.NON_ROLES)})), 0)")
    as_json = roles("from_json(s, 'array<string>')")
    as_text = roles("split(translate(s, " + _q("[]\"'") + ", ''), ',')")
    category = " ".join(f"WHEN lower(s) RLIKE {_q('|'.join(words))} THEN {_q(name)}" for name, words in refine.CATEGORIES)

    def url_test(words: list[str]) -> str:
        return "(" + " OR ".join(f"contains(lower(s), {_q(w)})" for w in words) + ")"

    def zero(tail: str) -> str:
        return _q(rf"\b0+(\d+)({text.ZERO_UNITS})?{tail}")

    b = r"\b"
    other, spaces = _q(r"[^a-z0-9\s\-+%.]"), _q(r"\s+")
    key = f"trim(regexp_replace(regexp_replace(fold_accents(coalesce(s, '')), {other}, ' '), {spaces}, ' '))"
    return {
        "strip_blank": ("s STRING", f"btrim(s, {blanks})"),
        "fold_accents": ("s STRING",
            f"translate(CASE WHEN lower(s) RLIKE {_q(many_class)} THEN array_join(transform(split(lower(s), ''), "
            f"c -> CASE WHEN c RLIKE {_q(many_class)} THEN coalesce({table}[c], c) ELSE c END), '') ELSE lower(s) END, {_q(source)}, {_q(target)})"),
        "normalize_text": ("s STRING", f"regexp_replace({key}, {zero(b)}, '$1$2')"),
        "normalize_claim_name": ("s STRING", f"regexp_replace({key}, {zero('')}, '$1$2')"),
        "title_case": ("s STRING", f"array_join(transform(regexp_extract_all(lower(s), {runs}, 1), x -> initcap(x)), '')"),
        "normalize_dose": ("s STRING", f"regexp_replace(lower(s), {spaces}, '')"),
        "normalize_drug_name": ("s STRING",
            f"CASE WHEN size(filter(transform(split(regexp_replace(regexp_replace(lower(s), '\\\\s+', ' '), {dose}, ' '), {sep}), x -> btrim(x, {blanks})), x -> length(x) >= 2 AND x RLIKE '[a-z]')) > 0 "
            f"AND size(regexp_extract_all(regexp_replace(lower(s), '\\\\s+', ' '), {dose}, 0)) > 0 THEN "
            f"array_join(transform(filter(transform(split(regexp_replace(regexp_replace(lower(s), '\\\\s+', ' '), {dose}, ' '), {sep}), x -> btrim(x, {blanks})), x -> length(x) >= 2 AND x RLIKE '[a-z]'), "
            f"(x, i) -> concat_ws(' ', array_join(transform(regexp_extract_all(trim(regexp_replace(regexp_replace(x, '\\\\([^)]*\\\\)', ''), '\\\\s+', ' ')), {runs}, 1), y -> initcap(y)), ''), regexp_replace(get(regexp_extract_all(regexp_replace(lower(s), '\\\\s+', ' '), {dose}, 0), i), '\\\\s+', ''))), ' + ') END"),
        "extract_keywords": ("s STRING", f"filter(split(normalize_claim_name(s), ' '), w -> length(w) >= 2 AND w NOT IN {_list(text.NOISE_WORDS)})"),
        "parse_icd": ("s STRING",
            f"named_struct('code', lower(regexp_extract(strip_blank(coalesce(s, '')), {icd}, 1)), 'name', CASE WHEN strip_blank(coalesce(s, '')) RLIKE {icd} "
            f"THEN strip_blank(regexp_extract(strip_blank(coalesce(s, '')), {icd}, 2)) ELSE strip_blank(coalesce(s, '')) END)"),
        "extract_role": ("s STRING",
            f"coalesce(CASE WHEN startswith(strip_blank(s), '[') THEN {as_json} END, "
            f"{as_text}, '')"),
        "valid_role": ("s STRING", f"CASE WHEN lower(strip_blank(extract_role(s))) NOT IN {_list(fields.EMPTY_ROLES)} THEN extract_role(s) END"),
        "infer_category": ("s STRING", f"CASE WHEN coalesce(s, '') = '' THEN {_q(refine.OTHER_CATEGORY)} {category} ELSE {_q(refine.OTHER_CATEGORY)} END"),
        "clean_url": ("s STRING", "split_part(split_part(s, '#', 1), '?srsltid=', 1)"),
        "is_detail_page": ("s STRING", f"NOT {url_test(extract.URL_EXCLUDE)} AND {url_test(extract.URL_INCLUDE)}"),
        "amount_similarity": ("a DOUBLE, b DOUBLE",
            "CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 1.0D WHEN coalesce(a, 0) = 0 OR coalesce(b, 0) = 0 THEN 0.5D ELSE greatest(0.0D, 1.0D - abs(a - b) / greatest(a, b)) END"),
        "match_confidence": ("text_sim DOUBLE, amount_sim DOUBLE, db DOUBLE", "least(1.0D, 0.5D * text_sim + 0.35D * db + 0.15D * amount_sim)"),
        "match_status": ("c DOUBLE", "CASE WHEN c >= 0.85D THEN 'matched' WHEN c >= 0.7D THEN 'partially_matched' WHEN c > 0.5D THEN 'weak_match' ELSE 'no_match' END"),
        "match_decision": ("c DOUBLE", "CASE WHEN c >= 0.85D THEN 'auto_approved' WHEN c > 0.5D THEN 'manual_review' ELSE 'rejected' END"),
        "token_cost": ("tin DOUBLE, tout DOUBLE", f"round(tin / 1e6 * {fields.TOKEN_PRICE_IN} + tout / 1e6 * {fields.TOKEN_PRICE_OUT}, 8)"),
    }


#: In the SQL text of a Column operators are written as functions; Spark takes them as such where their names are quoted.
_OPERATOR = re.compile(r"'(?:\\.|[^'\\])*'|(?<![\w`])(?:and|or|in|not)(?=\()|[=<>!+*/%-]+(?=\()", re.DOTALL)


def _sql_of(column: Column) -> str:
    return _OPERATOR.sub(lambda m: m[0] if m[0].startswith("'") else f"`{m[0]}`", column._jc.node().sql())


def _derived() -> dict[str, tuple[list[str], Column]]:
    """Functions whose SQL body is that of the Column function itself, with their string parameters."""
    s, a, b, c = (F.col(x) for x in "sabc")
    return {
        "normalize_for_search": (["s"], text.normalize_for_search(s)),
        "strip_search_name": (["s"], text.strip_search_name(s)),
        "parse_secondary_disease": (["s"], fields.parse_secondary_disease(s)),
        "classification_tags": (["s"], fields.classification_tags(s)),
        "classify_labels": (["a", "b"], fields.classify_labels(a, b)),
        "correct_mapping": (["s"], fields.correct_mapping(s)),
        "validate_output": (["a", "b", "c"], fields.validate_output(a, b, c)),
        "clean_html": (["s"], refine.clean_html(s)),
        "split_packaging": (["s"], refine.split_packaging(s)),
        "indication_section": (["s"], refine.indication_section(s)),
        "indication_terms": (["s"], refine.indication_terms(s)),
        "summarize_indication": (["s"], refine.summarize_indication(s)),
        "parse_drug_info": (["s"], extract.parse_drug_info(s)),
        "page_usage": (["s"], extract.page_usage(s)),
        "is_relevant_page": (["a", "b", "c"], extract.is_relevant_page(a, b, c)),
    }


@F.pandas_udf(T.DoubleType())
def _token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    left = [" ".join(sorted((x or "").split())) for x in a]
    right = [" ".join(sorted((x or "").split())) for x in b]
    total = pd.Series([len(x) + len(y) for x, y in zip(left, right)])
    return (200.0 * pd.Series(lcs_lengths(left, right)) / total).where(total > 0, 100.0)


def register_functions(spark: SparkSession) -> list[str]:
    """Register all functions in the session and return their names."""
    names = []
    for name, (params, body) in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {RETURNS.get(name, 'STRING')} RETURN {body}")
        names.append(name)
    blank = spark.createDataFrame([], "s string, a string, b string, c string")
    for name, (params, column) in _derived().items():
        kind = blank.select(column.alias("out")).schema[0].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} STRING' for p in params)}) RETURNS {kind} RETURN {_sql_of(column)}")
        names.append(name)
    for name, udf in {"token_sort_ratio": _token_sort_ratio, "lcs_length": lcs_len, "unescape_html": refine.unescape_html}.items():
        spark.udf.register(name, udf)
        names.append(name)
    return names
