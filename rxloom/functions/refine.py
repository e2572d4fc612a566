"""Catalogue clean-up: HTML removal, packaging split, categories, indication summaries."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.functions.text import fold_accents, title_case

# --- fixed values -----------------------------------------------------------
PACKAGING_PATTERNS = [
    r"(?iU)\((hộp|vỉ|lọ|chai|tuýp|ống).*?\)",
    r"(?iU)\((box|bottle|tube|ampoule).*?\)",
    r"(?iU)\d+\s*(viên|ml|g|mg).*?$",
]
CATEGORIES = [
    ("Kháng sinh", ["amoxicillin", "cef", "mycin", "cilin", "floxacin", "cyclin"]),
    ("Giảm đau - Hạ sốt", ["paracetamol", "ibuprofen", "aspirin", "diclofenac", "tramadol"]),
    ("Tim mạch - Huyết áp", ["pril", "sartan", "lol", "statin", "amlodipin", "nifedipin"]),
    ("Tiểu đường", ["metformin", "gliclazide", "insulin", "glimepiride"]),
    ("Tiêu hóa - Dạ dày", ["omeprazol", "lansoprazol", "esomeprazol", "aluminium", "magnesium"]),
    ("Dị ứng - Kháng Histamin", ["loratadin", "cetirizin", "fexofenadin", "chlorpheniramine"]),
]
OTHER_CATEGORY = "Khác"
STOP_PATTERNS = [
    r"\bla thuoc\b", r"\bco che\b", r"\bhap thu\b", r"\bduoc dong hoc\b",
    r"\bchuyen hoa\b", r"\bthai tru\b", r"\bdu lieu thuc nghiem\b",
]
KEY_TERMS = [
    "sot", "sot sau tiem chung", "dau dau", "dau rang", "dau hong", "dau co", "dau co bap",
    "dau khop", "dau bung", "dau nhuc", "cam lanh", "cum", "viem", "viem hong", "viem mui", "viem xoang",
]
TRANSLITERATED = [
    ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("þ", "th"), ("ð", "d"), ("ı", "i"),
]
BASIC_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# ----------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """Full HTML entity table; batches arrive through Arrow."""
    return text.map(html.unescape, na_action="ignore")


def clean_html(col: Column, full_entities: bool = False) -> Column:
    """Text without tags and entities, white space collapsed; null gives ''.

    The default covers the basic entities inside the JVM; `full_entities` uses the
    complete table through Arrow.
    """
    s = F.regexp_replace(F.coalesce(col, F.lit("")), r"<[^>]+>", " ")
    if full_entities:
        s = unescape_html(s)
    else:
        for entity, char in BASIC_ENTITIES:
            s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def split_packaging(col: Column) -> Column:
    """struct(name, packaging): the first of the ordered patterns found is cut out of the name."""
    name = F.coalesce(col, F.lit(""))
    packaging = F.coalesce(
        *[F.nullif(F.regexp_extract(name, p, 0), F.lit("")) for p in PACKAGING_PATTERNS], F.lit("")
    )
    cut = F.trim(F.regexp_replace(F.replace(name, packaging, F.lit("")), r"\s+", " "))
    cut = F.trim(F.regexp_replace(cut, r"^-+|-+$", ""))
    return F.struct(
        title_case(F.when(packaging == "", name).otherwise(cut)).alias("name"), packaging.alias("packaging")
    )


def infer_category(col: Column) -> Column:
    ingredient = F.lower(F.coalesce(col, F.lit("")))
    out = F.when(ingredient == "", OTHER_CATEGORY)
    for name, keywords in CATEGORIES:
        out = out.when(ingredient.rlike("|".join(keywords)), name)
    return out.otherwise(OTHER_CATEGORY)


def fold_text(col: Column) -> Column:
    """ASCII rendering: accents folded, letters without a decomposition spelt out."""
    s = fold_accents(F.coalesce(col, F.lit("")))
    for letter, spelling in TRANSLITERATED:
        s = F.replace(s, F.lit(letter), F.lit(spelling))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def indication_section(col: Column, stop_patterns: list[str] = STOP_PATTERNS) -> Column:
    """Folded text up to the first match of the first listed stop pattern that occurs."""
    s = fold_text(col)
    out = F.when(F.lit(False), s)
    for p in stop_patterns:
        out = out.when(s.rlike(p), F.trim(F.regexp_extract(s, rf"(?s)^(.*?){p}", 1)))
    return out.otherwise(s)


def indication_terms(section: Column, terms: list[str] = KEY_TERMS) -> Column:
    """Lexicon terms found as whole words, sorted."""
    found = F.filter(
        F.array(*[F.when(section.rlike(rf"\b{t}\b"), F.lit(t)) for t in sorted(set(terms))]), lambda t: t.isNotNull()
    )
    return F.array_join(found, ", ")


def summarize_indication(col: Column) -> Column:
    return indication_terms(indication_section(col))
