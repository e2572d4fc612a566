"""Field parsing, classification and scoring rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxloom.functions.text import strip

# --- fixed values -----------------------------------------------------------
NODRUG_TAGS = ["supplement", "medical supplies", "cosmeceuticals", "medical equipment"]
# (value, label, tags, keywords), in rule order
CLASSIFICATION_RULES = [
    ("valid", "Có điều trị", ["drug", "valid", "main drug"], ["main drug", "start_drug", "valid"]),
    ("secondary drug", "Hỗ trợ điều trị", ["drug", "valid", "secondary drug"], ["secondary drug"]),
    ("medical supplies", "Vật tư y tế", ["nodrug", "medical supplies"], ["medical supplies"]),
    ("supplement", "Thực phẩm chức năng", ["nodrug", "supplement"], ["supplement"]),
    ("cosmeceuticals", "Dược mĩ phẩm", ["nodrug", "cosmeceuticals"], ["cosmeceuticals"]),
    ("medical equipment", "Thiết bị y tế", ["nodrug", "medical equipment"], ["medical equipment"]),
    ("invalid", "Không điều trị", ["drug", "invalid"], ["invalid"]),
]
UNKNOWN_LABEL = "Chưa phân loại"
NON_ROLES = ["drug", "nodrug", "valid", "invalid", ""]
EMPTY_ROLES = ["", "null", "none", "valid", "invalid", "unknown"]
NODRUG_ROLES = [
    "supplement", "thực phẩm chức năng", "cosmeceuticals", "dược mỹ phẩm",
    "medical equipment", "thiết bị y tế", "medical supply", "vật tư y tế",
]
DRUG_ROLES = ["main drug", "secondary drug"]
TOKEN_PRICE_IN, TOKEN_PRICE_OUT = 0.15, 0.60
# ----------------------------------------------------------------------------

ICD_PATTERN = r"(?id)^([A-Z]\d+(?:\.\d+)?)\s*-\s*(.+)$"
EXTERNAL_MATCH_DDL = (
    "struct<claim_id:string,medicine_id:string,claim_service:string,medicine_service:string,"
    "match_status:string,confidence_score:double,reasoning:string>"
)


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First non-empty of several alias columns, trimmed; '' when all are empty."""
    return strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit("")))


def parse_icd(col: Column) -> Column:
    """`R51 - Name` -> struct(code='r51', name='Name'); anything else has code ''."""
    v = strip(_text(col))
    code = F.lower(F.regexp_extract(v, ICD_PATTERN, 1))
    name = F.when(code != "", strip(F.regexp_extract(v, ICD_PATTERN, 2))).otherwise(v)
    return F.struct(code.alias("code"), name.alias("name"))


def parse_secondary_disease(col: Column) -> Column:
    """Secondary disease as plain text or as a JSON object of `{ma, ten}` entries."""
    v = strip(_text(col))
    parsed = F.from_json(F.replace(v, F.lit('""'), F.lit('"')), "map<string,struct<ma:string,ten:string>>")
    entry = F.get(F.map_values(parsed), F.lit(0))
    plain = parse_icd(v)
    is_json = v.startswith("{") & v.endswith("}") & entry.isNotNull()
    code = (
        F.when(v == "{}", "")
        .when(is_json, F.lower(strip(F.coalesce(entry["ma"], F.lit("")))))
        .otherwise(plain["code"])
    )
    name = F.when(v == "{}", "").when(is_json, strip(F.coalesce(entry["ten"], F.lit("")))).otherwise(plain["name"])
    return F.struct(code.alias("code"), name.alias("name"))


def classification_tags(col: Column) -> Column:
    """Classification text -> tags completed by the expert rules, in rule order, without repeats."""
    v = F.translate(strip(F.lower(_text(col))), "[]'\"{}", "")
    parts = F.filter(F.transform(F.split(v, ","), strip), lambda p: p != "")

    def has(tag: str) -> Column:
        return F.array_contains(parts, tag)

    def tag_if(cond: Column, tag: str) -> Column:
        return F.when(cond, F.array(F.lit(tag))).otherwise(F.array().cast("array<string>"))

    nodrug = F.exists(parts, lambda p: p.isin(NODRUG_TAGS)) & ~has("nodrug")
    drug = (has("invalid") | has("valid") | has("secondary drug")) & ~has("drug")
    main = has("valid") & ~has("main drug") & ~has("secondary drug")
    tags = F.concat(tag_if(drug, "drug"), tag_if(nodrug, "nodrug"), parts, tag_if(main, "main drug"))
    with_valid = F.concat(F.slice(tags, 1, 1), F.array(F.lit("valid")), F.slice(tags, 2, F.greatest(F.size(tags), F.lit(1))))
    return F.array_distinct(F.when(has("secondary drug") & ~has("valid"), with_valid).otherwise(tags))


def tags_json(tags: Column) -> Column:
    """Tag array as the JSON list text stored in the knowledge base."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(tags, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]")
    )


def classify_labels(classification: Column, feedback: Column, fix_multi_tag: bool = False) -> Column:
    """Feedback first (exact value, then contained keyword), else exact tags, else unknown.

    A multi-tag feedback such as `drug,invalid` contains the keyword `valid` and so
    counts as valid; `fix_multi_tag` compares whole tags instead.
    """
    phan, tdv = F.lower(_text(classification)), F.lower(_text(feedback))
    key = strip(F.translate(tdv, "{}\"'", ""))
    joined = F.translate(F.concat_ws(",", phan, tdv), "{}\"'", "")
    tags = F.transform(F.split(joined, ","), strip)
    key_tags = F.transform(F.split(key, ","), strip)

    def rule(row: tuple) -> Column:
        value, label, rule_tags, _ = row
        return F.struct(
            F.lit(value).alias("value"),
            F.lit(label).alias("label"),
            F.array(*[F.lit(t) for t in rule_tags]).alias("tags"),
        )

    out = F.when(F.lit(False), rule(CLASSIFICATION_RULES[0]))
    for row in CLASSIFICATION_RULES:
        out = out.when(key == row[0], rule(row))
    for row in CLASSIFICATION_RULES:
        if fix_multi_tag:
            hit = F.arrays_overlap(key_tags, F.array(*[F.lit(k) for k in row[3]]))
        else:
            hit = F.lit(False)
            for keyword in row[3]:
                hit = hit | key.contains(keyword)
        out = out.when((key != "") & hit, rule(row))
    for row in CLASSIFICATION_RULES:
        out = out.when(F.arrays_overlap(tags, F.array(*[F.lit(k) for k in row[3]])), rule(row))
    return out.otherwise(
        F.struct(
            F.lit("unknown").alias("value"),
            F.lit(UNKNOWN_LABEL).alias("label"),
            F.array().cast("array<string>").alias("tags"),
        )
    )


def extract_role(col: Column) -> Column:
    """Last informative tag of a JSON list or comma text; '' when there is none."""
    raw = _text(col)

    def last_role(items: Column) -> Column:
        cleaned = F.transform(items, lambda x: strip(F.translate(x, "{}", "")))
        kept = F.filter(cleaned, lambda x: ~F.lower(x).isin(NON_ROLES))
        return F.get(F.reverse(kept), F.lit(0))

    as_json = F.when(strip(raw).startswith("["), last_role(F.from_json(raw, "array<string>")))
    as_text = last_role(F.split(F.translate(raw, "[]\"'", ""), ","))
    return F.coalesce(as_json, as_text, F.lit(""))


def valid_role(col: Column) -> Column:
    """Role of a raw value, or null when it says nothing about the role."""
    role = extract_role(col)
    return F.when(~F.lower(strip(role)).isin(EMPTY_ROLES), role)


def correct_mapping(role: Column, supplies_are_nodrug: bool = False) -> Column:
    """Role -> struct(category, validity, role). `medical supplies` counts as a drug unless told otherwise."""
    low = F.lower(strip(_text(role)))
    nodrug = NODRUG_ROLES + (["medical supplies"] if supplies_are_nodrug else [])
    category = F.when(low.isin(nodrug) & (_text(role) != ""), "nodrug").otherwise("drug")
    validity = (
        F.when(_text(role) == "", "invalid")
        .when(low.isin(nodrug), "")
        .when(low.isin(DRUG_ROLES), "valid")
        .when(low.contains("invalid") | low.contains("contraindication"), "invalid")
        .otherwise("valid")
    )
    return F.struct(category.alias("category"), validity.alias("validity"), _text(role).alias("role"))


def validate_output(category: Column, validity: Column, role: Column) -> Column:
    """Repair category/role pairs that contradict each other."""
    low = F.lower(strip(_text(role)))
    to_drug = low.isin(DRUG_ROLES) & (category != "drug")
    to_nodrug = low.isin(NODRUG_ROLES) & (category != "nodrug")
    return F.struct(
        F.when(to_drug, "drug").when(to_nodrug, "nodrug").otherwise(category).alias("category"),
        F.when(to_drug, "valid").when(to_nodrug, "").otherwise(validity).alias("validity"),
        role.alias("role"),
    )


def drop_nan(col: Column) -> Column:
    """Null for empty text and for the text 'nan'."""
    return F.when((col != "") & (F.lower(col) != "nan"), col)


def full_ingredient(ingredient: Column, strength: Column) -> Column:
    """Ingredient followed by its strength unless it already holds it."""
    ing, dose = _text(ingredient), _text(strength)
    return F.when((dose != "") & ~ing.contains(dose), strip(F.concat_ws(" ", ing, dose))).otherwise(ing)


def labelled_note(sep: str, *labelled: tuple[str, Column]) -> Column:
    """Join `label + value` for the non-empty values."""
    return F.concat_ws(sep, *[F.when(_text(c) != "", F.concat(F.lit(label), c)) for label, c in labelled])


def amount_similarity(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return (
        F.when((x == 0) & (y == 0), 1.0)
        .when((x == 0) | (y == 0), 0.5)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(x - y) / F.greatest(x, y)))
    )


def match_confidence(text_sim: Column, amount_sim: Column, db_score: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * text_sim + 0.35 * db_score + 0.15 * amount_sim)


def decide(confidence: Column) -> Column:
    status = (
        F.when(confidence >= 0.85, "matched")
        .when(confidence >= 0.70, "partially_matched")
        .when(confidence > 0.5, "weak_match")
        .otherwise("no_match")
    )
    decision = (
        F.when(confidence >= 0.85, "auto_approved").when(confidence > 0.5, "manual_review").otherwise("rejected")
    )
    return F.struct(status.alias("match_status"), decision.alias("decision"))


def match_notes(claim_name: Column, med_name: Column, claim_ing: Column, med_ing: Column) -> Column:
    names = F.when(
        (_text(claim_name) != "") & (_text(med_name) != ""),
        F.when(claim_name == med_name, "Cùng tên chuẩn trong DB").otherwise(
            F.concat(F.lit("Claim: "), claim_name, F.lit(", Medicine: "), med_name)
        ),
    )
    same_ing = F.when((_text(claim_ing) != "") & (claim_ing == med_ing), "Cùng hoạt chất")
    return F.coalesce(F.nullif(F.concat_ws("; ", names, same_ing), F.lit("")), F.lit("Match dựa trên tên thuốc"))


def external_status(col: Column, direct: bool = False) -> Column:
    """Status word of an external match brought to the engine's four statuses.

    The direct path also folds any status holding `partial`; both keep known words.
    """
    s = F.lower(F.coalesce(col, F.lit("uncertain")))
    return (
        F.when(s.isin("equivalent", "matched") if direct else (s == "equivalent"), "matched")
        .when(s.contains("partial"), "partially_matched")
        .when(s.isin("matched", "weak_match", "no_match"), s)
        .otherwise("weak_match")
    )


def external_score(col: Column) -> Column:
    s = F.coalesce(col, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(s > 1.0, s / 100.0).otherwise(s)))


def response_payload(col: Column) -> Column:
    """JSON text inside a model response: the text itself, a ```json block, a plain block, else null."""
    block = F.lit("```")
    tagged = F.split_part(F.split_part(col, F.lit("```json"), F.lit(2)), block, F.lit(1))
    plain = F.split_part(col, block, F.lit(2))
    return (
        F.when(strip(col).startswith("{"), col)
        .when(col.contains("```json"), strip(tagged))
        .when(col.contains("```"), strip(plain))
    )


def response_matches(col: Column) -> Column:
    """Array of match structs of a model response; empty when it holds none."""
    parsed = F.from_json(response_payload(col), f"struct<matches:array<{EXTERNAL_MATCH_DDL}>>")
    return F.coalesce(parsed["matches"], F.array().cast(f"array<{EXTERNAL_MATCH_DDL}>"))


def logged_counts(endpoint: Column, response: Column) -> Column:
    """struct(matched_count, unmatched_count) of a logged response body."""
    doc = F.from_json(
        response,
        "struct<results:array<struct<category:string,validity:string>>,"
        "summary:struct<matched_items:int,unmatched_claims:int>>",
    )
    results = F.coalesce(doc["results"], F.array().cast("array<struct<category:string,validity:string>>"))
    good = F.size(F.filter(results, lambda r: (r["category"] == "drug") & (r["validity"] == "valid")))
    consult = endpoint.contains("/consult_integrated")
    match = endpoint.contains("/mapping/match")
    zero = F.lit(0)
    return F.struct(
        F.when(consult, good).when(match, F.coalesce(doc["summary"]["matched_items"], zero)).otherwise(zero).alias("matched_count"),
        F.when(consult, F.size(results) - good)
        .when(match, F.coalesce(doc["summary"]["unmatched_claims"], zero))
        .otherwise(zero)
        .alias("unmatched_count"),
    )


def stored_body(col: Column, limit: int | None = None) -> Column:
    """A body as it is logged; `limit` keeps that many characters (the original log keeps 100,000)."""
    return col if limit is None else F.substring(col, 1, limit)


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / 1e6 * TOKEN_PRICE_IN + tokens_out / 1e6 * TOKEN_PRICE_OUT, 8)

