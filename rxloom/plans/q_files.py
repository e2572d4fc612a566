"""Files written from the given tables and read back through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxloom.plans import domain as d
from rxloom.plans.registry import query
from rxloom.session import new_path
from rxloom.schemas import SCHEMAS
from rxloom.sources import archive, files, tables
from rxloom.sources.tables import SnapshotTable


def _lines(df, line: str, path: str, header: str | None = None) -> str:
    """Text files of the given lines, each file with the header."""
    raw = df.select(F.expr(line).alias(header or "line"))
    raw.write.option("header", header is not None).option("sep", "\1").option("quote", "").option("emptyValue", "").csv(path)
    return path


@query("catalogue_files", "S2", """
SELECT 'VN-' || p_partkey AS so_dang_ky, p_name AS ten_thuoc, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 2 THEN p_type END AS hoat_chat,
  CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 <> 0 THEN p_brand END AS danh_muc FROM part WHERE NOT (p_partkey % 2 = 0 AND p_partkey % 5 = 0)""")
def catalogue_files(spark, sf):
    part, root = d.table(spark, sf, "part"), new_path(spark, "catalogue")
    # Even parts: every fifth with a field too many, else those = 2 mod 4 with one too few. Odd parts: another header, every third short.
    _lines(part.where("p_partkey % 2 = 0"), "concat('VN-', p_partkey, ',', p_name, CASE WHEN p_partkey % 5 = 0 THEN ',a,' WHEN p_partkey % 4 = 2 THEN '' ELSE ',' || p_type END)",
           f"{root}/a", files.BOM + "so_dang_ky,ten_thuoc,hoat_chat")
    _lines(part.where("p_partkey % 2 = 1"), "concat('VN-', p_partkey, ',', p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',' || p_brand END)",
           f"{root}/b", "so_dang_ky,ten_thuoc,danh_muc")
    return files.read_catalogue(spark, f"{root}/*").drop("pos")


@query("icd_files", "S3", """
SELECT c_custkey::VARCHAR AS id, 'C' || c_custkey AS icd_code, c_mktsegment AS chapter_name, 's' || c_nationkey AS slug, c_name AS disease_name,
  lower('C' || c_custkey || ' ' || c_name || ' s' || c_nationkey || ' ' || c_mktsegment) AS search_text, 'active' AS is_active
FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""")
def icd_files(spark, sf):
    # Every third row is too short, every fifth has no code.
    line = ("CASE WHEN c_custkey % 3 = 0 THEN concat(c_custkey, ',x,y') ELSE concat(c_custkey, repeat(',', 10), CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('C', c_custkey) END, "
            "',,,,', c_mktsegment, ',s', c_nationkey, ',', c_name, repeat(',', 7)) END")
    return files.read_icd_list(spark, _lines(d.table(spark, sf, "customer"), line, new_path(spark, "icd")))


@query("request_files", "S5", d.ctes(d.CLAIMS, d.PURCHASES) + """
SELECT 'claim' AS kind, request_id::VARCHAR AS request_id, claim_id AS id, service, amount::DOUBLE AS amount FROM claims
UNION ALL SELECT 'medicine', request_id::VARCHAR, medicine_id, service, amount::DOUBLE FROM purchases""")
def request_files(spark, sf):
    path = new_path(spark, "requests")

    def lists(df, ident, name):
        item = F.struct(F.col(ident).alias("id"), F.col("service").alias("service_name"), "amount")
        return df.groupBy("request_id").agg(F.collect_list(item).alias(name))

    both = lists(d.claims(spark, sf), "claim_id", "claims").join(lists(d.purchases(spark, sf), "medicine_id", "medicines"), "request_id", "full")
    tables.write_json(both.withColumn("request_id", F.col("request_id").cast("string")), path)
    claims, bought = files.read_match_requests(spark, path, lines=True)
    shape = lambda df, kind, ident: df.select(F.lit(kind).alias("kind"), "request_id", F.col(ident).alias("id"), "service", F.col("amount").cast("double").alias("amount"))
    return shape(claims, "claim", "claim_id").unionByName(shape(bought, "medicine", "medicine_id"))


@query("prescription_files", "S1", d.ctes(d.RX_LOG) + """
SELECT drug_name, primary_disease, secondary_disease, classification, feedback, symptom, reason, count(*) AS n FROM rx_log GROUP BY ALL""")
def prescription_files(spark, sf):
    path, fields = new_path(spark, "log"), list(files.LOG_ALIASES)
    named = [F.col(f).alias(files.LOG_ALIASES[f][0]) for f in fields]
    tables.write_csv(d.rx_log(spark, sf).select(*named), path)
    return files.read_prescription_log(spark, path).groupBy(*fields).agg(F.count("*").alias("n"))


@query("raw_archive", "K1", "SELECT doc_id, 'b1' AS batch_id, md5(text || chr(10)) AS content FROM documents")
def raw_archive(spark, sf):
    inbox, store = new_path(spark, "raw"), new_path(spark, "archive")
    tables.write_json(d.table(spark, sf, "documents").select("doc_id", "text"), inbox)
    tables.append_archive(archive.read_chunks(spark, inbox, F.lit("b1"), "inbox", d.now()), store)
    back = archive.archived_lines(spark.read.parquet(store))
    doc = F.from_json("line", "doc_id long, text string")
    return back.select("batch_id", doc.alias("doc")).select(
        "doc.doc_id", "batch_id", F.md5(F.concat("doc.text", F.lit("\n"))).alias("content"))


@query("csv_log", "K2", "SELECT event_id, event_type, props FROM events")
def csv_log(spark, sf):
    path = new_path(spark, "csv-log")
    rows = d.table(spark, sf, "events").select("event_id", "event_type", "props")
    for part in (0, 1):  # appended twice
        tables.write_csv(rows.where(F.col("event_id") % 2 == part), path)
    return spark.read.schema("event_id long, event_type string, props string").options(header="true", escape='"').csv(path)


@query("daily_log", "K3", """
SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, sum(value::DECIMAL(18, 4))::DOUBLE AS total FROM events GROUP BY 1, 2""")
def daily_log(spark, sf):
    path = new_path(spark, "daily")
    rows = d.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):
        tables.append_by_day(rows.where(F.col("event_id") % 2 == part), path, "ts")
    days = tables.summarise_days(spark.read.parquet(path), "event_type", {"total": F.sum(F.col("value").cast("decimal(18,4)")).cast("double")})
    return days.select(F.col("date").cast("string").alias("day"), "event_type", "n", "total")


@query("json_dump", "K4", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_dump(spark, sf):
    path = new_path(spark, "json")
    rows = d.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    tables.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("table_copy", "K7", d.ctes(d.DISEASES) + " SELECT id, icd_code, disease_name FROM diseases")
def table_copy(spark, sf):
    target = SnapshotTable(spark, new_path(spark, "copy"), SCHEMAS["diseases"])
    rows = d.diseases(spark, sf)
    tables.copy_tables({"diseases": rows.where("icd_code < 'C'")}, {"diseases": target})
    tables.copy_tables({"diseases": rows.withColumn("disease_name", F.when(F.col("icd_code") < "C", "changed").otherwise(F.col("disease_name")))}, {"diseases": target})
    return target.read().select("id", "icd_code", "disease_name")
