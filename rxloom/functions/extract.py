"""Registration numbers, usage text and URL rules for stored pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
REGISTRATION_PATTERNS = [
    r"(?iU)(?:SĐK|Số đăng ký|SĐK|SDK|Reg\.No)[:\.]?\s*([A-Z0-9\-\/]{5,20})",
    r"(?i)(VN-\d{4,10}-\d{2}|VD-\d{4,10}-\d{2}|QLD-\d+-\d+|GC-\d+-\d+|VNA-\d+-\d+|VNB-\d+-\d+)",
    r"(?i)([A-Z]{1,3}-\d{4,10}-\d{2})",
]
INGREDIENT_PATTERN = r"(?idU)(?:Hoạt chất|Thành phần)[:\.]?\s*(.+?)(?:\n|$)"
MAKER_PATTERN = r"(?idU)(?:Công ty|Nhà) sản xuất[:\.]?\s*(.+?)(?:\n|$)"
STRICT_SDK = r"(?i)(VN-\d{4,5}-\d{2}|VD-\d{4,5}-\d{2}|QLD-\d+-\d+|GC-\d+-\d+|VNA-\d+-\d+|VNB-\d+-\d+)"
CONTEXT_SDK = r"(?iU)(?:Số\s+đăng\s+ký|SĐK|SDK|Reg\.No)[:.]?\s*([A-Za-z0-9\-\/Đđ]+)"
USAGE_PATTERN = (
    r"(?isU)(?:Công dụng|Chỉ định|Tác dụng|Indication|Điều trị)[:.]?\s*(.{10,%s}?)"
    r"(?=(?:Chống chỉ định|Liều dùng|Tác dụng phụ|Thận trọng|Lưu ý|Bảo quản|Đóng gói|\n\n\n|$))"
)
NOT_FOUND = "Not Found"
URL_EXCLUDE = [
    "/search", "/drgsearch", "/category", "/danh-muc", "/tim-kiem", "/kết-quả", "/ketqua", "?q=", "?s=",
]
URL_INCLUDE = ["/thuoc-", "/thuoc/", "/product/", "/san-pham/", "/detail/", "/chi-tiet/", "products/detail"]
URL_EXCLUDE_STRICT = ["/search", "/drgsearch", "/category", "/danh-muc"]
URL_INCLUDE_STRICT = ["/thuoc-", "/thuoc/"]
# ----------------------------------------------------------------------------


def _first_match(col: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(col, p, 1), F.lit("")) for p in patterns])


def registration_number(col: Column) -> Column:
    found = F.trim(_first_match(col, REGISTRATION_PATTERNS))
    return F.regexp_replace(F.regexp_replace(found, r"^:+|:+$", ""), r"^\.+|\.+$", "")


def parse_drug_info(col: Column) -> Column:
    """struct(so_dang_ky, hoat_chat, cong_ty_san_xuat) from raw page text."""
    return F.struct(
        registration_number(col).alias("so_dang_ky"),
        F.nullif(F.trim(F.regexp_extract(col, INGREDIENT_PATTERN, 1)), F.lit("")).alias("hoat_chat"),
        F.nullif(F.trim(F.regexp_extract(col, MAKER_PATTERN, 1)), F.lit("")).alias("cong_ty_san_xuat"),
    )


def page_sdk(col: Column) -> Column:
    """Registration number in strict form, else the one after a label, else 'Not Found'."""
    return F.coalesce(_first_match(col, [STRICT_SDK, CONTEXT_SDK]), F.lit(NOT_FOUND))


def page_usage(col: Column, limit: int | None = None) -> Column:
    """Usage passage after an indication label on one line; `limit` gives the report form of so many characters and '...'."""
    # The report form looks at 1,500 characters, as the original report does.
    pattern = USAGE_PATTERN % ("" if limit is None else "1500")
    found = F.trim(F.regexp_replace(F.trim(F.regexp_extract(col, pattern, 1)), r"(?U)\s+", " "))
    short = found if limit is None else F.concat(F.substring(found, 1, limit), F.lit("..."))
    return F.when(found != "", short).otherwise(NOT_FOUND)


def _contains_any(col: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | col.contains(needle)
    return out


def is_allowed_domain(url: Column, domains: list[str]) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    return _contains_any(host, domains)


def clean_url(url: Column) -> Column:
    return F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?srsltid="), F.lit(1))


def is_detail_page(url: Column, strict: bool = False) -> Column:
    low = F.lower(url)
    exclude, include = (URL_EXCLUDE_STRICT, URL_INCLUDE_STRICT) if strict else (URL_EXCLUDE, URL_INCLUDE)
    return ~_contains_any(low, exclude) & _contains_any(low, include)


def is_relevant_page(keyword: Column, title: Column, url: Column) -> Column:
    """Any keyword token longer than two letters occurs in title or URL; true without such tokens."""
    tokens = F.filter(F.split(keyword, r"[\s\-\(\)mg]+"), lambda t: F.length(t) > 2)
    hit = F.exists(
        F.transform(tokens, F.lower), lambda t: F.contains(F.lower(title), t) | F.contains(F.lower(url), t)
    )
    return hit | (F.size(tokens) == 0)
