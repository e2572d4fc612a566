"""Catalogue loading: keyed inserts, enriching upsert, full reload, refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.fields import drop_nan, full_ingredient, labelled_note
from rxloom.functions.refine import clean_html, infer_category, split_packaging
from rxloom.functions.text import search_text, strip
from rxloom.operators.ranking import first_per_key


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive schema evolution: missing columns arrive as nulls of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Target plus the first new row of every key it does not hold."""
    fresh = first_per_key(rows.join(target.select(*keys), keys, "left_anti"), keys, order)
    return target.unionByName(fresh.select(*target.columns))


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-replace into an empty table: the last row of each key stays."""
    return first_per_key(rows, keys, [c.desc() for c in order])


#: Fixed value: what imported records name as their source.
IMPORT_SOURCE = "ThuocBietDuoc Crawler (Import)"


def shape_records(df: DataFrame, source: str = IMPORT_SOURCE) -> DataFrame:
    """Crawled rows in catalogue columns, `pos` kept if there; empty and 'nan' values become null."""

    def col(name: str) -> Column:
        return drop_nan(F.col(name)) if name in df.columns else F.lit(None).cast("string")

    urls = F.when(col("url_nguon").isNotNull(), F.array(col("url_nguon")))
    return df.select(
        col("so_dang_ky").alias("so_dang_ky"), col("ten_thuoc").alias("ten_thuoc"), col("hoat_chat").alias("hoat_chat"),
        col("dang_bao_che").alias("dang_bao_che"), col("ham_luong").alias("nong_do"), col("danh_muc").alias("nhom_thuoc"),
        urls.alias("source_urls"), F.lit(source).alias("source"),
        col("noi_dung_dieu_tri").alias("chi_dinh"), *[F.col(c) for c in ("pos",) if c in df.columns],
    )


def enrich_by_sdk(drugs: DataFrame, records: DataFrame, now: Column, user: str, refresh_search: bool = True,
                  order: str | None = None) -> DataFrame:
    """New catalogue snapshot: empty fields are filled from records of the same number, unknown numbers are added.

    `outcome` says inserted, updated, skipped or kept. With `refresh_search` a known
    drug's search text is always rebuilt; without it a drug with nothing to fill is skipped.
    Records of one trimmed number count in input order (column `order`, else by value): the first makes or fills,
    later ones fill what is still empty, the last one's search text stays.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rec = records.where(text(F.col("so_dang_ky")) != "").select(
        F.trim("so_dang_ky").alias("_sdk"), text(F.col("ten_thuoc")).alias("_ten"),
        full_ingredient(F.col("hoat_chat"), F.col("nong_do")).alias("_ing"), F.col("chi_dinh").alias("_use"),
        labelled_note("; ", ("Bào chế: ", F.col("dang_bao_che")), ("Nhóm: ", F.col("nhom_thuoc"))).alias("_note"),
        F.get("source_urls", F.lit(0)).alias("_url"), F.col("nhom_thuoc").alias("_class"),
        *([F.col(order).alias("_at")] if order else []),
    )
    place = F.struct(*([F.col("_at")] if order else []), "_ten", "_ing", "_use", "_note", "_url", "_class")
    rec = rec.where("_sdk != ''").withColumn("_place", place).groupBy("_sdk").agg(
        *[F.min_by(c, "_place").alias(c) for c in ("_ten", "_ing", "_class")],
        *[F.coalesce(F.min_by(c, F.when(text(F.col(c)) != "", F.col("_place"))), F.min_by(c, "_place")).alias(c) for c in ("_use", "_note", "_url")],
        F.max_by(F.struct("_ten", "_ing"), "_place").alias("_last"))
    base = add_missing_columns(drugs, {
        "source_urls": "string", "classification": "string", "created_by": "string", "updated_by": "string",
        "created_at": "timestamp", "updated_at": "timestamp"})
    j = base.join(rec, F.trim("so_dang_ky") == F.col("_sdk"), "full")
    is_new, has_rec = base["id"].isNull(), F.col("_sdk").isNotNull()

    def fill(old: str, new: str) -> Column:
        return F.when(text(F.col(old)) == "", F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))).otherwise(F.col(old))

    fillable = F.lit(False)
    for old, new in (("chi_dinh", "_use"), ("note", "_note"), ("source_urls", "_url")):
        fillable = fillable | ((text(F.col(old)) == "") & (text(F.col(new)) != ""))
    touched = has_rec & ~is_new & (F.lit(True) if refresh_search else fillable)
    key_text = search_text(F.col("_last._ten"), F.col("_last._ing"))
    out = {c: F.col(c) for c in base.columns}
    out["so_dang_ky"] = F.coalesce("so_dang_ky", "_sdk")
    out["ten_thuoc"] = F.when(is_new, F.col("_ten")).otherwise(F.col("ten_thuoc"))
    out["hoat_chat"] = F.when(is_new, F.col("_ing")).otherwise(F.col("hoat_chat"))
    out["chi_dinh"] = fill("chi_dinh", "_use")
    out["note"] = F.when(is_new, F.col("_note")).otherwise(fill("note", "_note"))
    out["source_urls"] = fill("source_urls", "_url")
    out["classification"] = F.when(is_new, F.col("_class")).otherwise(F.col("classification"))
    out["is_verified"] = F.when(is_new, 1).otherwise(F.col("is_verified"))
    refresh = is_new | (touched if refresh_search else F.lit(False))
    out["search_text"] = F.when(refresh, key_text).otherwise(F.col("search_text"))
    out["created_by"] = F.when(is_new, F.lit(user)).otherwise(F.col("created_by"))
    out["created_at"] = F.when(is_new, now).otherwise(F.col("created_at"))
    out["updated_by"] = F.when(touched, F.lit(user)).otherwise(F.col("updated_by"))
    out["updated_at"] = F.when(touched | is_new, now).otherwise(F.col("updated_at"))
    out["outcome"] = (
        F.when(is_new, "inserted").when(touched, "updated").when(has_rec, "skipped").otherwise("kept")
    )
    return j.select(*[v.alias(k) for k, v in out.items()])


# recipe -> (key of the first-row rule, note labels, note separator, search columns, normalised search text)
RELOAD_RECIPES = {
    "crawl": (["so_dang_ky", "ten_thuoc"], [("Group: ", "danh_muc"), ("Strength: ", "ham_luong"), ("Source: ", "url_nguon")],
              " | ", ["ten_thuoc", "hoat_chat", "so_dang_ky", "danh_muc"], "lower"),
    "master": (None, [("Danh mục: ", "danh_muc"), ("Source: ", "url_nguon")], "; ",
               ["ten_thuoc", "hoat_chat", "so_dang_ky", "dang_bao_che"], "lower"),
    "final": (None, [("Source: ", "url_nguon")], "", ["ten_thuoc", "hoat_chat", "so_dang_ky", "dang_bao_che"], "normalised"),
}
RELOAD_COLUMNS = ["ten_thuoc", "so_dang_ky", "hoat_chat", "noi_dung_dieu_tri", "dang_bao_che", "danh_muc", "ham_luong", "url_nguon"]


def reload_catalogue(rows: DataFrame, recipe: str, pos: str) -> DataFrame:
    """Full catalogue from crawled rows. `crawl` keeps the first row per (number, name) and leaves it
    unverified; `master` and `final` keep all rows as verified, `final` drops rows without a name."""
    keys, labels, sep, search, style = RELOAD_RECIPES[recipe]
    base = add_missing_columns(rows, {c: "string" for c in RELOAD_COLUMNS})
    base = base.select(pos, *[F.coalesce(strip(c), F.lit("")).alias(c) for c in RELOAD_COLUMNS])
    if keys:
        base = first_per_key(base, keys, [F.col(pos)])
    if recipe == "final":
        base = base.where("ten_thuoc != ''")
    return base.select(
        "ten_thuoc", "hoat_chat", "so_dang_ky", F.col("noi_dung_dieu_tri").alias("chi_dinh"),
        F.col("dang_bao_che").alias("classification"),
        labelled_note(sep, *[(label, F.col(c)) for label, c in labels]).alias("note"),
        F.lit(0 if recipe == "crawl" else 1).alias("is_verified"),
        search_text(*[F.col(c) for c in search], recipe=style).alias("search_text"),
    )


def refine_catalogue(drugs: DataFrame) -> DataFrame:
    """Clean text fields, split packaging off the name, infer the category, rebuild the search text."""
    name = split_packaging(F.col("ten_thuoc"))
    refined = drugs.withColumns({
        "_name": name, "nhom_duoc_ly": infer_category(F.col("hoat_chat")), "chi_dinh": clean_html(F.col("chi_dinh")),
    })
    refined = refined.withColumns({"ten_thuoc": F.col("_name.name"), "quy_cach": F.col("_name.packaging")}).drop("_name")
    return refined.withColumn("search_text", search_text(F.col("ten_thuoc"), F.col("hoat_chat"), F.col("so_dang_ky")))
