"""Table schemas. Column names follow the public data model of the drug knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(" ".join(ddl.split()))


DDL = {
    "drugs": """id bigint, ten_thuoc string, hoat_chat string, cong_ty_san_xuat string, so_dang_ky string,
        chi_dinh string, tu_dong_nghia string, search_text string, is_verified int, classification string,
        note string, source_urls string, created_by string, updated_by string, created_at timestamp,
        updated_at timestamp""",
    "diseases": """id string, icd_code string, disease_name string, chapter_name string, slug string,
        search_text string, is_active string""",
    "drug_staging": """id bigint, ten_thuoc string, hoat_chat string, cong_ty_san_xuat string, so_dang_ky string,
        chi_dinh string, tu_dong_nghia string, search_text string, status string, classification string,
        note string, created_by string, conflict_type string, conflict_id bigint""",
    "drug_history": """original_drug_id bigint, ten_thuoc string, hoat_chat string, cong_ty_san_xuat string,
        so_dang_ky string, chi_dinh string, tu_dong_nghia string, archived_by string, archived_at timestamp""",
    "drug_staging_history": """original_staging_id bigint, ten_thuoc string, hoat_chat string,
        cong_ty_san_xuat string, so_dang_ky string, chi_dinh string, tu_dong_nghia string, action string,
        archived_by string, archived_at timestamp""",
    "drug_disease_links": """drug_id bigint, disease_id string, sdk string, icd_code string, treatment_note string,
        is_verified int, coverage_type string, created_by string, status string, created_at timestamp""",
    "raw_logs": "batch_id string, raw_content string, source_ip string, created_at timestamp",
    "api_logs": """endpoint string, method string, status_code int, response_time_ms double, client_ip string,
        created_at timestamp""",
    "knowledge_base": """drug_name string, drug_name_norm string, drug_ref_id bigint, disease_icd string,
        disease_name string, disease_name_norm string, disease_ref_id string, secondary_disease_icd string,
        secondary_disease_name string, secondary_disease_name_norm string, secondary_disease_ref_id string,
        treatment_type string, tdv_feedback string, symptom string, prescription_reason string,
        frequency bigint, batch_id string, last_updated timestamp""",
    "request_logs": """timestamp timestamp, request_id string, endpoint string, method string, status_code int,
        latency_ms double, matched_count int, unmatched_count int, request_body string, response_body string""",
    "token_usage": """timestamp timestamp, context string, model string, input_tokens bigint, output_tokens bigint,
        total_tokens bigint, cost_usd double""",
}


class _Lazy(dict):
    def __missing__(self, name: str) -> StructType:
        self[name] = _schema(DDL[name])
        return self[name]


SCHEMAS: dict[str, StructType] = _Lazy()

ITEM_DDL = (
    "array<struct<id:string,claim_id:string,medicine_id:string,service:string,service_name:string,"
    "description:string,amount:double>>"
)
MATCH_REQUEST_DDL = f"request_id string, claims {ITEM_DDL}, medicine {ITEM_DDL}, medicines {ITEM_DDL}"
CONSULT_REQUEST_DDL = (
    "request_id string, symptom string, diagnoses array<struct<code:string,name:string,type:string>>, "
    "items array<struct<id:string,name:string>>"
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the schema's missing columns as nulls, cast the others and keep extra columns at the end."""
    known = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return df.select(*known, *[c for c in df.columns if c not in schema.fieldNames()])
