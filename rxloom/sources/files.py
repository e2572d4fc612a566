"""File sources: prescription logs, catalogue files, ICD lists, request documents, raw batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.functions.fields import first_filled
from rxloom.schemas import CONSULT_REQUEST_DDL, MATCH_REQUEST_DDL
from rxloom.sources.csv_split import BOM, parsed, read_by_header, read_csv_records

# --- fixed values -----------------------------------------------------------
LOG_ALIASES = {
    "drug_name": ["Tên thuốc", "ten_thuoc", "Ten_thuoc", "?column?", "thuoc_chinh"],
    "primary_disease": ["Mã ICD (Chính)", "benh_chinh", "?column?"],
    "secondary_disease": ["Bệnh phụ", "benh_phu", "Benh_phu"],
    "classification": ["Phân loại", "phan_loai"],
    "feedback": ["Feedback", "tdv_feedback"],
    "symptom": ["Chẩn đoán ra viện", "chuan_doan_ra_vien"],
    "reason": ["Lý do kê đơn", "ly_do", "Ly_do"],
}
ICD_POSITIONS = {"id": 0, "icd_code": 10, "chapter_name": 14, "slug": 15, "disease_name": 16}
# ----------------------------------------------------------------------------
END_MARK = "\1"  # a value of no file


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_log_columns(df: DataFrame) -> DataFrame:
    """Header aliases -> log columns: the first non-empty alias of each field, trimmed."""
    present = {c.lstrip(BOM): c for c in df.columns}
    out = []
    for field, aliases in LOG_ALIASES.items():
        cols = [_quoted(present[a]) for a in aliases if a in present]
        out.append((first_filled(*cols) if cols else F.lit("")).alias(field))
    keep = [c for c in ("pos", "source_file") if c in df.columns]
    return df.select(*keep, *out)


def read_prescription_log(spark: SparkSession, path: str) -> DataFrame:
    """Prescription-log CSV with position and resolved columns; files may differ in their header.

    Rows lacking a drug or a primary disease stay in and are told apart by
    `knowledge.is_bad_row`. Without files there are no rows.
    """
    frames = []
    for names, records in read_by_header(spark, path):
        df = parsed(records, len(names)).withColumnRenamed("file", "source_file")
        repeated = {n.lower() for n in names if sum(m.lower() == n.lower() for m in names) > 1}
        # Spark's own names for columns that share one or have none.
        named = [f"{n}{i}" if n.lower() in repeated else n or f"_c{i}" for i, n in enumerate(names)]
        frames.append(resolve_log_columns(df.withColumnsRenamed({f"c{i}": n for i, n in enumerate(named)})))
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ["pos", "source_file", *LOG_ALIASES]))
    return reduce(lambda a, b: a.unionByName(b), frames)


def _is_short(raw: Column, fields: int) -> Column:
    """Whether a row that does not fit the header has fewer fields: a mark after its last field is still among them."""
    schema = ", ".join(f"c{i} string" for i in range(fields + 1))
    parsed = F.from_csv(F.concat(raw, F.lit("," + END_MARK)), schema, {"multiLine": "true", "quote": '"', "escape": '"'})
    return F.array_contains(F.array(*[parsed[f"c{i}"] for i in range(fields + 1)]), END_MARK)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """All catalogue CSV files under `path` as strings.

    Rows with more fields than the header are skipped, rows with fewer are filled up with nulls; columns that a
    file lacks are null. Without files there are no rows and only the column `pos`.
    """
    frames = []
    for names, records in read_by_header(spark, path):
        df = parsed(records, len(names), corrupt=True).where(F.col("_raw").isNull() | _is_short(F.col("_raw"), len(names)))
        frames.append(df.select("pos", *[F.col(f"c{i}").alias(n.strip()) for i, n in enumerate(names)]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else spark.createDataFrame([], "pos string")


def read_icd_list(spark: SparkSession, path: str, columns: int = 24) -> DataFrame:
    """Headerless ICD CSV by position; rows without id or code, or shorter than the name column, are skipped."""
    raw = parsed(read_csv_records(spark, path), columns)
    cols = {name: F.trim(f"c{i}") for name, i in ICD_POSITIONS.items()}
    out = raw.where(F.col("c16").isNotNull()).select(*[c.alias(n) for n, c in cols.items()])
    text = F.lower(F.trim(F.concat_ws(" ", "icd_code", "disease_name", "slug", "chapter_name")))
    return out.where("id != '' AND icd_code != ''").withColumns({"search_text": text, "is_active": F.lit("active")})


def read_match_requests(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reconciliation request documents -> flat claims and purchases. With `lines`, a document a line, files can be split."""
    docs = spark.read.schema(MATCH_REQUEST_DDL).json(path, multiLine=not lines)

    def flat(items: Column, id_name: str) -> DataFrame:
        rows = docs.select("request_id", F.posexplode(items).alias("pos", "i"))
        return rows.select(
            "request_id", F.coalesce(f"i.{id_name}", "i.id").alias(id_name), "pos",
            F.coalesce("i.service", "i.service_name", F.lit("")).alias("service"),
            F.coalesce("i.amount", F.lit(0.0)).alias("amount"))

    return flat(F.col("claims"), "claim_id"), flat(F.coalesce("medicine", "medicines"), "medicine_id")


def read_consult_requests(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Consultation request documents -> flat items and diagnoses. With `lines`, a document a line, files can be split."""
    docs = spark.read.schema(CONSULT_REQUEST_DDL).json(path, multiLine=not lines)
    items = docs.select("request_id", F.explode("items").alias("i")).select(
        "request_id", F.col("i.id").alias("item_id"), F.col("i.name").alias("name"))
    diagnoses = docs.select("request_id", F.posexplode("diagnoses").alias("pos", "x")).select("request_id", "pos", "x.code")
    return items, diagnoses


def read_raw_batches(spark: SparkSession, path: str, batch_id: Column, source: str, now: Column) -> DataFrame:
    """Whole files as raw archive rows (batch_id, raw_content, source_ip, created_at)."""
    return spark.read.text(path, wholetext=True).select(
        batch_id.alias("batch_id"), F.col("value").alias("raw_content"), F.lit(source).alias("source_ip"), now.alias("created_at"))


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """Relational table through Spark's JDBC source, split on a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
