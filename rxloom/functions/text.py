"""Name and text normalisation as Column expressions (no Python at run time)."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DOSE_UNITS = "mg|g|mcg|iu|ml|l"
ZERO_UNITS = "ml|mg|mcg|g|iu|ui|l|%"
SEARCH_UNITS = "mg|ml|g|mcg|iu|ui|liều|viên|ống|xịt|gói|chai|lọ|hộp"
SEARCH_BARE_UNITS = "liều|xịt|viên|ống|gói|chai|lọ|hộp|mg|ml|mcg"
NOISE_WORDS = [
    "hộp", "hop", "box", "chai", "bottle", "vỉ", "vi", "viên", "vien", "tabs", "cap",
    "capsule", "tablet", "ống", "ong", "tube", "gói", "goi", "sachet",
]
# ----------------------------------------------------------------------------

DOSE_PATTERN = rf"\d+(?:\.\d+)?\s*({DOSE_UNITS})"
SEPARATOR_PATTERN = r"(?U)\+|/|,|\band\b|\bva\b"


def strip(col: Column | str) -> Column:
    """Trim white space of any kind, not only blanks."""
    return F.btrim(col, F.lit(" \t\n\r\x0b\f\u00a0\u3000"))


def _compat(ch: str) -> str:
    """Compatibility decomposition of one character without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


def _char_class(codes: list[int]) -> str:
    """Regex class of sorted code points, written as ranges."""
    ranges, start = [], codes[0]
    for prev, cur in zip(codes, codes[1:] + [None]):
        if cur != prev + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
            start = cur
    return "[" + "".join(ranges) + "]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Rule-built tables: translate source and target, one-to-many map, class of rows that may need it."""
    source, target, many, marks = [], [], {}, []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(code)
            continue
        if ch.lower() != ch or unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            continue
        folded = _compat(ch).replace("đ", "d")
        if not re.search("[ -~]", folded):
            continue
        if code > 0xFFFF or len(folded) != 1:
            many[ch] = folded
        else:
            source.append(ch)
            target.append(folded)
    # translate() deletes the source characters that have no partner, so the marks go last
    high = [c for c in map(ord, many) if c >= 0x2000]
    many_class = _char_class(sorted(c for c in map(ord, many) if c < 0x2000) + list(range(min(high), max(high) + 1)))
    return "".join(source) + "đ" + "".join(map(chr, marks)), "".join(target) + "d", many, many_class


def fold_accents(col: Column) -> Column:
    """Lower-case and reduce accented or compatibility letters to their base letters.

    Plain ASCII rows skip all tables. One-to-many expansions (ligatures, unit signs such
    as U+338E) run only on rows that may hold such a character.
    """
    source, target, many, many_class = _fold_tables()
    low = F.lower(col)
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    expanded = F.array_join(
        F.transform(
            F.split(low, ""), lambda ch: F.when(ch.rlike(many_class), F.coalesce(table[ch], ch)).otherwise(ch)
        ),
        "",
    )
    whole = F.when(low.rlike(many_class), expanded).otherwise(low)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(whole, source, target)).otherwise(low)


def normalize_for_matching(col: Column, variant: str = "kb") -> Column:
    """Matching key of a name; null and empty give ''.

    `kb` keeps leading zeros that run into other letters (`05mlx`), `claims` strips
    them (`5mlx`). Both turn `1.05g` into `1.5g`.
    """
    s = F.regexp_replace(fold_accents(F.coalesce(col, F.lit(""))), r"[^a-z0-9\s\-+%.]", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    tail = r"\b" if variant == "kb" else ""
    return F.regexp_replace(s, rf"\b0+(\d+)({ZERO_UNITS})?{tail}", "$1$2")


normalize_text = normalize_for_matching


def title_case(col: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def normalize_name(col: Column) -> Column:
    s = F.regexp_replace(col, r"\([^)]*\)", "")
    return title_case(F.trim(F.regexp_replace(s, r"\s+", " ")))


def normalize_dose(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"\s+", "")


def normalize_drug_name(col: Column, variant: str = "kb") -> Column:
    """`a 16mg/b 12.5mg` -> `A 16mg + B 12.5mg`; null without an active or a dose."""
    s = F.regexp_replace(F.lower(col), r"\s+", " ")
    doses = F.transform(F.regexp_extract_all(s, F.lit(DOSE_PATTERN), F.lit(0)), normalize_dose)
    parts = F.transform(F.split(F.regexp_replace(s, DOSE_PATTERN, " "), SEPARATOR_PATTERN), strip)
    actives = F.filter(parts, lambda p: (F.length(p) >= 2) & p.rlike("[a-z]"))
    shape = normalize_name if variant == "kb" else title_case
    named = F.transform(
        actives,
        lambda p, i: F.when(i < F.size(doses), F.concat(shape(p), F.lit(" "), F.get(doses, i))).otherwise(shape(p)),
    )
    return F.when((F.size(actives) > 0) & (F.size(doses) > 0), F.array_join(named, " + "))


def normalize_for_search(col: Column, allowed: str = "") -> Column:
    """Longest prefix made only of `allowed` characters; '' without a whitelist."""
    if not allowed:
        return F.lit("")
    char_class = "".join(re.escape(c) for c in allowed)
    return strip(F.regexp_extract(F.coalesce(col, F.lit("")), f"^[{char_class}]*", 0))


def _squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def strip_search_name(col: Column) -> Column:
    """Product name without brackets, strengths, units and bare numbers."""
    s = F.regexp_replace(col, r"\([^)]*\)", "")
    s = F.regexp_replace(s, r"\[[^\]]*\]", "")
    s = F.regexp_replace(s, r"[-–—/\\]", " ")
    s = F.regexp_replace(s, rf"(?iU)\d+\s*({SEARCH_UNITS})\b", "")
    s = F.regexp_replace(s, rf"(?iU)\b({SEARCH_BARE_UNITS})\b", "")
    s = _squeeze(F.regexp_replace(s, r"(?U)\b\d+\b", ""))
    first_word = F.split(_squeeze(col), " ")[0]
    return F.coalesce(F.nullif(s, F.lit("")), first_word, F.lit(""))


def extract_keywords(col: Column) -> Column:
    words = F.split(normalize_for_matching(col, "claims"), " ")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(NOISE_WORDS))


def search_text(*cols: Column, recipe: str = "normalised") -> Column:
    """Search text of a record: `normalised` key or plain `lower` text."""
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])
    if recipe == "normalised":
        return normalize_for_matching(joined)
    return F.lower(F.trim(joined))


def query_variants(col: Column) -> Column:
    """Search variants in priority order: raw, normalised, normalised minus a digit-bearing last token."""
    raw = strip(col)
    norm = normalize_for_matching(col)
    head = F.regexp_extract(norm, r"^(.*) ([^ ]*\d[^ ]*)$", 1)
    return F.filter(
        F.array(
            F.nullif(raw, F.lit("")),
            F.when((norm != "") & (norm != F.lower(raw)), norm),
            F.nullif(head, F.lit("")),
        ),
        lambda v: v.isNotNull(),
    )
