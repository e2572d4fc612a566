"""Staged approval of master data: submit, approve, reject, clear, edit, delete, purge, link.

Every mutation takes tables and returns the new tables; nothing is changed in place.
A set of staging ids is handled at once, as if one after the other in id order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.text import normalize_text, search_text, strip
from rxloom.operators.catalogue import add_missing_columns

NO_SDK = ["", "N/A", "Web Result"]
BAD_NAMES = ["NA", "N/A", ""]
RECORD = ["ten_thuoc", "hoat_chat", "cong_ty_san_xuat", "so_dang_ky", "chi_dinh", "tu_dong_nghia"]


def find_conflicts(submissions: DataFrame, drugs: DataFrame) -> DataFrame:
    """Add search_text, conflict_id and conflict_type ('sdk' before 'name'; null for a new drug)."""
    rows = submissions.withColumns({
        "ten_thuoc": strip(F.coalesce("ten_thuoc", F.lit(""))), "so_dang_ky": strip(F.coalesce("so_dang_ky", F.lit("")))})
    rows = rows.withColumn("search_text", search_text(*[F.col(c) for c in ("ten_thuoc", "hoat_chat", "cong_ty_san_xuat", "tu_dong_nghia")]))
    by_sdk = drugs.where("so_dang_ky IS NOT NULL").groupBy(F.col("so_dang_ky").alias("_s")).agg(F.min("id").alias("_sid"))
    by_name = drugs.groupBy(F.col("ten_thuoc").alias("_n")).agg(F.min("id").alias("_nid"))
    j = rows.join(by_sdk, (F.col("so_dang_ky") == F.col("_s")) & ~F.col("so_dang_ky").isin(NO_SDK), "left")
    j = j.join(by_name, (F.col("ten_thuoc") == F.col("_n")) & (F.col("ten_thuoc") != ""), "left")
    return j.withColumns({
        "conflict_id": F.coalesce("_sid", "_nid"),
        "conflict_type": F.when(F.col("_sid").isNotNull(), "sdk").when(F.col("_nid").isNotNull(), "name"),
    }).drop("_s", "_sid", "_n", "_nid")


@dataclass
class Submission:
    staged: DataFrame
    inserted: DataFrame


def submit(submissions: DataFrame, drugs: DataFrame, now: Column) -> Submission:
    """Conflicting submissions become pending staging rows, the others verified drugs."""
    rows = find_conflicts(submissions, drugs)
    staged = rows.where("conflict_id IS NOT NULL").withColumn("status", F.lit("pending"))
    fresh = rows.where("conflict_id IS NULL").drop("conflict_id", "conflict_type")
    return Submission(staged, fresh.withColumns({"is_verified": F.lit(1), "created_at": now, "updated_at": now}))


def pending_list(staging: DataFrame, drugs: DataFrame) -> DataFrame:
    """Pending rows with the conflicting drug nested, newest first."""
    info = drugs.select(F.col("id").alias("conflict_id"), F.struct("ten_thuoc", "so_dang_ky", "hoat_chat").alias("conflict_info"))
    return staging.where("status = 'pending'").join(info, "conflict_id", "left").orderBy(F.desc("id"))


@dataclass
class Curated:
    """Tables after an approval, rejection or clearing; `drugs` and `history` only change on approval."""

    staging: DataFrame
    staging_history: DataFrame
    links: DataFrame | None = None
    drugs: DataFrame | None = None
    history: DataFrame | None = None


def _archived(rows: DataFrame, action: str, user: str, now: Column) -> DataFrame:
    return rows.select(F.col("id").alias("original_staging_id"), *RECORD, F.lit(action).alias("action"),
                       F.lit(user).alias("archived_by"), now.alias("archived_at"))


def approve(staging: DataFrame, drugs: DataFrame, links: DataFrame, ids: DataFrame, user: str, now: Column) -> Curated:
    """Approve the staging rows of `ids(id)`.

    The old drug goes to history and is overwritten, a row without conflict is inserted,
    links of the approved number become active, the staging rows are archived and removed.
    Rows whose conflicting drug is gone stay pending. When several approved rows aim at
    one drug the highest staging id wins, and each earlier state is kept in history.
    """
    extra = {"classification": "string", "note": "string"}
    st = add_missing_columns(staging, extra)
    base = add_missing_columns(drugs, {**extra, "updated_by": "string"})
    known = base.select(F.col("id").alias("conflict_id"), F.lit(True).alias("_known"))
    picked = st.join(ids, "id", "left_semi").join(known, "conflict_id", "left")
    picked = picked.where("conflict_id IS NULL OR _known").drop("_known")
    merges = picked.where("conflict_id IS NOT NULL")
    last = merges.groupBy("conflict_id").agg(F.max_by(F.struct(*RECORD, "search_text", *extra), "id").alias("_new"), F.max("id").alias("_last"))
    # States of a drug before its last: the stored one, and every approved row but the last.
    stored = base.join(last.select("conflict_id"), base["id"] == last["conflict_id"]).select(F.col("id").alias("original_drug_id"), *RECORD)
    earlier = merges.join(last.select("conflict_id", "_last"), "conflict_id").where("id < _last").select(
        F.col("conflict_id").alias("original_drug_id"), *RECORD)
    history = stored.unionByName(earlier).select("*", F.lit(user).alias("archived_by"), now.alias("archived_at"))
    hit = F.col("_new").isNotNull()
    fields = [*RECORD, "search_text", *extra]
    j = base.join(last.select(F.col("conflict_id").alias("_cid"), "_new"), F.col("id") == F.col("_cid"), "left")
    updated = j.select(*[
        F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields
        else F.when(hit, F.lit(1)).otherwise(F.col(c)).alias(c) if c == "is_verified"
        else F.when(hit, F.lit(user)).otherwise(F.col(c)).alias(c) if c == "updated_by"
        else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)
        for c in base.columns])
    # a new drug takes its id after the largest id in use, offset by its staging id
    top = base.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = picked.where("conflict_id IS NULL").withColumn("new_id", top + F.col("id"))
    inserted = add_missing_columns(fresh.drop("id").withColumnRenamed("new_id", "id").withColumns(
        {"is_verified": F.lit(1), "created_at": now, "updated_at": now}), dict(base.dtypes)).select(*base.columns)
    targets = picked.where(F.coalesce("so_dang_ky", F.lit("")) != "").groupBy(F.col("so_dang_ky").alias("sdk")).agg(
        F.max_by(F.coalesce("conflict_id", top + F.col("id")), "id").alias("_target"))
    new_links = links.join(targets, "sdk", "left").withColumns({
        "status": F.when(F.col("_target").isNotNull(), "active").otherwise(F.col("status")),
        "drug_id": F.coalesce("_target", "drug_id")}).drop("_target").select(*links.columns)
    left = staging.join(picked.select("id"), "id", "left_anti").select(*staging.columns)
    return Curated(left, _archived(picked, "approved", user, now), new_links, updated.unionByName(inserted), history)


def reject(staging: DataFrame, links: DataFrame, ids: DataFrame, user: str, now: Column) -> Curated:
    """Archive and remove staging rows; pending links of their numbers are archived."""
    picked = staging.join(ids, "id", "left_semi")
    sdks = picked.where("so_dang_ky IS NOT NULL").select(F.col("so_dang_ky").alias("sdk"), F.lit(True).alias("_hit")).distinct()
    new_links = links.join(sdks, "sdk", "left").withColumn(
        "status", F.when(F.col("_hit") & (F.col("status") == "pending"), "archived").otherwise(F.col("status"))
    ).select(*links.columns)
    return Curated(staging.join(ids, "id", "left_anti"), _archived(picked, "rejected", user, now), new_links)


def clear_pending(staging: DataFrame, user: str, now: Column) -> Curated:
    """Archive and remove every pending row."""
    pending = F.coalesce("status", F.lit("")) == "pending"
    return Curated(staging.where(~pending), _archived(staging.where(pending), "cleared", user, now))


EDITABLE = [*RECORD, "classification", "note", "search_text"]


def edit_staging(staging: DataFrame, edits: DataFrame) -> DataFrame:
    """Overwrite all editable columns of the staging rows named in `edits(id, ...)`, nulls included."""
    new = edits.select("id", F.struct(*EDITABLE).alias("_e"))
    j = staging.join(new, "id", "left")
    return j.select(*[
        F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) if c in EDITABLE else F.col(c)
        for c in staging.columns])


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in `keys`: deletes of drugs by number or id, and of diseases or links by code."""
    return table.join(keys, on, "left_anti").select(*table.columns)


def is_bad_name(col: str = "ten_thuoc") -> Column:
    return F.col(col).isNull() | F.col(col).isin(BAD_NAMES)


def purge_bad_names(drugs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop drugs without a real name, and the links of their numbers."""
    bad = drugs.where(is_bad_name() & (F.coalesce("so_dang_ky", F.lit("")) != "")).select(F.col("so_dang_ky").alias("sdk")).distinct()
    return drugs.where(~is_bad_name()), links.join(bad, "sdk", "left_anti").select(*links.columns)


@dataclass
class Linked:
    links: DataFrame
    knowledge_base: DataFrame


def upsert_links(links: DataFrame, kb: DataFrame, requests: DataFrame, now: Column) -> Linked:
    """Keyed upsert of links (sdk, icd_code); a link that is new also updates the knowledge base.

    requests(pos, drug_name, disease_name, sdk, icd_code, treatment_note, is_verified,
    coverage_type, created_by, status). Several requests of one key apply in `pos` order:
    the first one creates the link, the later ones update it.
    """
    req = requests.where((F.coalesce("drug_name", F.lit("")) != "") & (F.coalesce("disease_name", F.lit("")) != "")).withColumns({
        "sdk": F.coalesce("sdk", F.lit("")), "icd_code": F.lower(strip(F.coalesce("icd_code", F.lit(""))))})
    key, changing = ["sdk", "icd_code"], ["treatment_note", "is_verified", "coverage_type", "status"]
    first = req.groupBy(*key).agg(
        F.min_by(F.struct("drug_name", "disease_name", "created_by", "treatment_note", "coverage_type", "pos"), "pos").alias("_f"),
        F.max_by(F.struct(*changing), "pos").alias("_l"))
    j = links.join(first, key, "full")
    is_new = links["status"].isNull() & F.col("_l").isNotNull() if "created_at" not in links.columns else links["created_at"].isNull() & F.col("_l").isNotNull()
    out = {c: F.col(c) for c in links.columns}
    for c in changing:
        out[c] = F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(c))
    if "created_by" in out:
        out["created_by"] = F.when(is_new, F.col("_f.created_by")).otherwise(F.col("created_by"))
    if "created_at" in out:
        out["created_at"] = F.when(is_new, now).otherwise(F.col("created_at"))
    new_links = j.select(*[v.alias(k) for k, v in out.items()])
    created = first.join(links.select(*key), key, "left_anti").select("icd_code", "_f.*")
    sync = created.groupBy(normalize_text(F.col("drug_name")).alias("drug_name_norm"), F.col("icd_code").alias("disease_icd")).agg(
        F.count("*").alias("_n"), F.min_by("drug_name", "pos").alias("_name"), F.min_by("disease_name", "pos").alias("_disease"),
        F.max_by("coverage_type", "pos").alias("_type"), F.max_by("treatment_note", "pos").alias("_note"))
    k = kb.join(sync, ["drug_name_norm", "disease_icd"], "full")
    hit, fresh = F.col("_n").isNotNull(), kb["frequency"].isNull()
    kept = {c: F.col(c) for c in kb.columns}
    kept["frequency"] = F.coalesce("frequency", F.lit(0)) + F.coalesce("_n", F.lit(0))
    kept["treatment_type"] = F.when(hit, F.col("_type")).otherwise(F.col("treatment_type"))
    kept["tdv_feedback"] = F.when(hit, F.col("_note")).otherwise(F.col("tdv_feedback"))
    kept["last_updated"] = F.when(hit, now).otherwise(F.col("last_updated"))
    kept["drug_name"] = F.when(fresh, F.col("_name")).otherwise(F.col("drug_name"))
    kept["disease_name"] = F.when(fresh, F.col("_disease")).otherwise(F.col("disease_name"))
    return Linked(new_links, k.select(*[v.alias(c) for c, v in kept.items()]))
