"""Folding prescription logs into the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.fields import classification_tags, parse_icd, parse_secondary_disease, tags_json
from rxloom.functions.text import normalize_text, strip

KEY = ["drug_name_norm", "disease_icd"]
FIRST_COLUMNS = [
    "drug_name", "disease_name", "disease_name_norm", "disease_ref_id", "secondary_disease_icd",
    "secondary_disease_name", "secondary_disease_name_norm", "secondary_disease_ref_id", "batch_id",
]
LATEST_COLUMNS = ["treatment_type", "tdv_feedback"]
FILLED_COLUMNS = ["symptom", "prescription_reason"]


def is_bad_row() -> Column:
    """Log rows without a drug or a primary disease."""
    return (strip(F.coalesce("drug_name", F.lit(""))) == "") | (strip(F.coalesce("primary_disease", F.lit(""))) == "")


def lookup_disease_ref(rows: DataFrame, diseases: DataFrame, code: str, out: str) -> DataFrame:
    """Left join of the ICD reference, case ignored."""
    refs = diseases.groupBy(F.lower("icd_code").alias("_code")).agg(F.min("id").alias(out))
    return rows.join(refs, (F.col(code) == F.col("_code")) & (F.col(code) != ""), "left").drop("_code")


def lookup_drug_ref(rows: DataFrame, name: str, matches: DataFrame, minimum: float = 0.85) -> DataFrame:
    """Attach drug_ref_id from a name-matching result (query, id, confidence) of sufficient confidence."""
    refs = matches.where(F.col("confidence") >= minimum).select(F.col("query").alias("_q"), F.col("id").alias("drug_ref_id"))
    return rows.join(refs, F.col(name) == F.col("_q"), "left").drop("_q")


def lookup_drug_ref_exact(rows: DataFrame, name: str, drugs: DataFrame) -> DataFrame:
    """Attach drug_ref_id by lower-cased, trimmed catalogue name; the last id among equal names."""
    refs = drugs.groupBy(strip(F.lower("ten_thuoc")).alias("_q")).agg(F.max("id").alias("drug_ref_id"))
    return rows.join(refs, F.lower(strip(F.col(name))) == F.col("_q"), "left").drop("_q")


def compact_log(log: DataFrame, batch_id: Column) -> DataFrame:
    """Fold log rows per raw (drug, primary disease) spelling before anything is parsed.

    Parsing then runs once per distinct spelling instead of once per row, and the map
    side of this aggregate carries most of the reduction.
    """
    pos = F.col("pos")
    said = {c: F.when(strip(F.col(c)) != "", pos) for c in ("symptom", "reason")}
    first, last = F.struct("secondary_disease", batch_id.alias("batch_id")), F.struct("classification", "feedback")
    folded = log.where(~is_bad_row()).groupBy("drug_name", "primary_disease").agg(
        F.count("*").alias("frequency"), F.min("pos").alias("pos"), F.max("pos").alias("last_pos"),
        F.min_by(first, pos).alias("f"), F.max_by(last, pos).alias("l"),
        F.coalesce(F.max_by("symptom", said["symptom"]), F.lit("")).alias("symptom"),
        F.max(said["symptom"]).alias("symptom_pos"),
        F.coalesce(F.max_by("reason", said["reason"]), F.lit("")).alias("reason"),
        F.max(said["reason"]).alias("prescription_reason_pos"),
    )
    return folded.select("*", "f.*", "l.*").drop("f", "l")


def prepare_log(log: DataFrame, batch_id: Column, strict: bool = False) -> DataFrame:
    """Good log rows with parsed and normalised fields; `pos` is the input order.

    `strict` is the restore recipe: names are only lower-cased and trimmed, and rows
    without a disease code are dropped.
    """
    first = parse_icd(F.col("primary_disease"))
    second = parse_secondary_disease(F.col("secondary_disease"))
    name = strip("drug_name")
    rows = log.where(~is_bad_row()).select(
        "pos",
        name.alias("drug_name"),
        (F.lower(name) if strict else normalize_text(name)).alias("drug_name_norm"),
        first["code"].alias("disease_icd"),
        first["name"].alias("disease_name"),
        second["code"].alias("secondary_disease_icd"),
        second["name"].alias("secondary_disease_name"),
        tags_json(classification_tags(F.col("classification"))).alias("treatment_type"),
        tags_json(classification_tags(F.col("feedback"))).alias("tdv_feedback"),
        strip("symptom").alias("symptom"),
        strip("reason").alias("prescription_reason"),
        batch_id.alias("batch_id"),
        *[c for c in ("frequency", "last_pos", "symptom_pos", "prescription_reason_pos") if c in log.columns],
    )
    if strict:
        rows = rows.where("disease_icd != ''")
        return rows.withColumns({"disease_name_norm": F.lit(None).cast("string"),
                                 "secondary_disease_name_norm": F.lit(None).cast("string")})
    return rows.withColumns({
        "disease_name_norm": normalize_text(F.col("disease_name")),
        "secondary_disease_name_norm": normalize_text(F.col("secondary_disease_name")),
    })


def fold_log(rows: DataFrame, now: Column, keep_nonempty: bool = False, from_last: tuple[str, ...] = (),
             from_first: tuple[str, ...] = ()) -> DataFrame:
    """One knowledge-base row per (drug_name_norm, disease_icd).

    The first row supplies the descriptive columns, the latest row the classification
    columns, the last non-empty value symptom and reason. All aggregates combine on the
    map side, so a hot key costs one partial row per task. `keep_nonempty` ignores empty
    classifications when looking for the latest one; `from_last` and `from_first` move
    columns away from their usual rule.
    """
    refs = {c: F.lit(None).cast("string") for c in ("disease_ref_id", "secondary_disease_ref_id") if c not in rows.columns}
    if "drug_ref_id" not in rows.columns:
        refs["drug_ref_id"] = F.lit(None).cast("bigint")
    rows = rows.withColumns(refs) if refs else rows
    compacted = "frequency" in rows.columns
    pos = F.col("pos")
    last_pos = F.col("last_pos") if compacted else pos
    aggs = [F.sum("frequency").alias("frequency") if compacted else F.count("*").alias("frequency")]
    aggs += [(F.max_by(c, last_pos) if c in from_last else F.min_by(c, pos)).alias(c) for c in FIRST_COLUMNS]
    ref_order = last_pos if "drug_ref_id" in from_last else F.when(F.col("drug_ref_id").isNotNull(), last_pos)
    aggs.append(F.max_by("drug_ref_id", ref_order).alias("drug_ref_id"))
    for c in LATEST_COLUMNS:
        order = F.when(F.col(c) != "[]", last_pos) if keep_nonempty else last_pos
        aggs.append(F.coalesce(F.max_by(c, order), F.lit("[]")).alias(c))
    for c in FILLED_COLUMNS:
        said = F.col(f"{c}_pos") if compacted else F.when(F.col(c) != "", pos)
        value = F.min_by(c, pos) if c in from_first else F.coalesce(F.max_by(c, said), F.lit(""))
        aggs.append(value.alias(c))
    return rows.groupBy(*KEY).agg(*aggs).withColumn("last_updated", now)


def upsert_kb(kb: DataFrame, fold: DataFrame, keep_nonempty: bool = False) -> DataFrame:
    """New knowledge-base snapshot: frequencies add up, the batch supplies the latest columns."""
    cols = [*KEY, "frequency", *FIRST_COLUMNS, "drug_ref_id", *LATEST_COLUMNS, *FILLED_COLUMNS, "last_updated"]
    old, new = kb.select(*cols).alias("o"), fold.select(*cols).alias("n")
    on = (F.col("o.drug_name_norm") == F.col("n.drug_name_norm")) & (F.col("o.disease_icd") == F.col("n.disease_icd"))
    known = F.col("o.drug_name_norm").isNotNull()
    out = {"frequency": F.coalesce("o.frequency", F.lit(0)) + F.coalesce("n.frequency", F.lit(0))}
    for c in KEY:
        out[c] = F.coalesce(f"o.{c}", f"n.{c}")
    for c in FIRST_COLUMNS:
        out[c] = F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    out["drug_ref_id"] = F.coalesce("n.drug_ref_id", "o.drug_ref_id")
    for c in LATEST_COLUMNS:
        value = F.when(F.col(f"n.{c}") != "[]", F.col(f"n.{c}")) if keep_nonempty else F.col(f"n.{c}")
        out[c] = F.coalesce(value, f"o.{c}", f"n.{c}")
    for c in FILLED_COLUMNS:
        out[c] = F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), f"o.{c}", f"n.{c}")
    out["last_updated"] = F.coalesce("n.last_updated", "o.last_updated")
    return old.join(new, on, "full").select(*[v.alias(k) for k, v in out.items()])


def restore_kb(kb: DataFrame, log: DataFrame, drugs: DataFrame, diseases: DataFrame, now: Column) -> DataFrame:
    """Restore recipe: exact reference maps; an update overwrites references and classifications, nothing else."""
    rows = prepare_log(log, F.lit("QUICK_RESTORE"), strict=True)
    rows = lookup_drug_ref_exact(rows, "drug_name", drugs)
    rows = lookup_disease_ref(rows, diseases, "disease_icd", "disease_ref_id")
    rows = lookup_disease_ref(rows, diseases, "secondary_disease_icd", "secondary_disease_ref_id")
    fold = fold_log(
        rows, now, from_last=("drug_ref_id", "disease_ref_id"), from_first=("symptom", "prescription_reason")
    ).alias("n")
    old = kb.alias("o")
    on = (F.col("o.drug_name_norm") == F.col("n.drug_name_norm")) & (F.col("o.disease_icd") == F.col("n.disease_icd"))
    hit, known = F.col("n.drug_name_norm").isNotNull(), F.col("o.drug_name_norm").isNotNull()
    overwritten = ["drug_ref_id", "disease_ref_id", *LATEST_COLUMNS, "last_updated"]
    cols = [*KEY, *FIRST_COLUMNS, "drug_ref_id", *LATEST_COLUMNS, *FILLED_COLUMNS, "last_updated"]
    out = [(F.coalesce("o.frequency", F.lit(0)) + F.coalesce("n.frequency", F.lit(0))).alias("frequency")]
    for c in cols:
        take_new = hit if c in overwritten else hit & ~known
        out.append(F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(fold, on, "full").select(*out)


def build_kb(log: DataFrame, diseases: DataFrame, batch_id: Column, now: Column, matches: DataFrame | None = None) -> DataFrame:
    """Knowledge-base rows of a log: compact, parse, attach references, fold.

    `matches` is an optional name-matching result that supplies drug_ref_id.
    """
    rows = prepare_log(compact_log(log, batch_id), F.col("batch_id"))
    rows = lookup_disease_ref(rows, diseases, "disease_icd", "disease_ref_id")
    rows = lookup_disease_ref(rows, diseases, "secondary_disease_icd", "secondary_disease_ref_id")
    if matches is not None:
        rows = lookup_drug_ref(rows, "drug_name", matches)
    return fold_log(rows, now)


def batch_stats(log: DataFrame, rows: DataFrame, kb: DataFrame) -> DataFrame:
    """One row: total, errors, inserted, updated, drugs_matched, diseases_matched."""
    weight = F.col("frequency") if "frequency" in rows.columns else F.lit(1)
    fold = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    new_keys = fold.join(kb.select(*KEY), KEY, "left_anti").agg(F.count("*")).scalar()

    def matched(c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(c).isNotNull(), weight)), F.lit(0)) if c in rows.columns else F.lit(0)

    good = rows.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("good"), matched("drug_ref_id").alias("drugs_matched"),
        matched("disease_ref_id").alias("diseases_matched"),
    )
    total = log.agg(F.count("*")).scalar()
    return good.withColumns({"total": total, "inserted": new_keys}).select(
        "total", (F.col("total") - F.col("good")).alias("errors"), "inserted",
        (F.col("good") - F.col("inserted")).alias("updated"), "drugs_matched", "diseases_matched",
    )


def authority() -> Column:
    """Ordering value of knowledge-base rows: expert feedback, then frequency, then recency."""
    told = F.coalesce(~F.col("tdv_feedback").isin("", "None", "null"), F.lit(False))
    return F.struct(told.cast("int").alias("told"), F.col("frequency").alias("freq"), F.col("last_updated").alias("at"))


def vote_and_promote(votes: DataFrame) -> DataFrame:
    """Most voted classification per (drug, code); a feedback vote beats any AI vote."""
    counted = votes.groupBy(*KEY, "treatment_type", "tdv_feedback").agg(F.count("*").alias("votes"))
    told = F.coalesce(F.col("tdv_feedback"), F.lit("")).isin("", "[]")
    best = F.min(F.struct(told.cast("int").alias("by_ai"), (-F.col("votes")).alias("neg"), "tdv_feedback", "treatment_type"))
    return counted.groupBy(*KEY).agg(best.alias("b")).select(
        *KEY, F.when(F.col("b.by_ai") == 0, F.col("b.tdv_feedback")).otherwise(F.col("b.treatment_type")).alias("role_tags"),
        F.when(F.col("b.by_ai") == 0, "expert").otherwise("ai").alias("source"), (-F.col("b.neg")).alias("votes"),
    )


def frequency_confidence(frequency: Column) -> Column:
    """About log10 of the frequency, 1.0 from a hundred sightings on; trusted from 0.8."""
    return F.when(frequency > 0, F.least(F.lit(1.0), F.log10(frequency) / 2.0)).otherwise(0.0)
