"""File sources, sinks and snapshots."""

import json

from pyspark.sql import functions as F

from rxloom.operators.catalogue import reload_catalogue
from rxloom.operators.knowledge import batch_stats, build_kb, is_bad_row, prepare_log, upsert_kb
from rxloom.schemas import SCHEMAS
from rxloom.sources import files, tables
from rxloom.sources.pages import extract_pages, ingredient_rows

LONG_HEADER = "Tên thuốc,Mã ICD (Chính),Bệnh phụ,Phân loại,Feedback,Chẩn đoán ra viện,Lý do kê đơn\n"
LONG_ROWS = (
    'Paracetamol 500mg,R51 - Đau đầu,{},"drug,valid",,Sốt,"giảm\nđau"\n'
    'PARACETAMOL 500mg,R51 - Đau đầu,B97.4 - Vi rút,invalid,main drug,,\n'
    ",R51 - Đau đầu,,,,,\n"
)
EXPORT = (
    'id,?column?,benh_phu,ten_thuoc,phan_loai,tdv_feedback,ly_do\n'
    '"1","J00 - Viêm mũi","{""u"": {""ma"": ""J06"", ""ten"": ""Viêm""}}","Zinc","{drug,valid,""main drug""}","NULL",""\n'
)


def empty_diseases(spark):
    return spark.createDataFrame([("d1", "R51")], "id string, icd_code string")


def test_prescription_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LONG_HEADER + LONG_ROWS, encoding="utf-8")
    log = files.read_prescription_log(spark, str(tmp_path / "a.csv"))
    assert log.count() == 3 and log.where(is_bad_row()).count() == 1
    kb = build_kb(log, empty_diseases(spark), F.lit("b1"), F.current_timestamp())
    row = kb.first()
    assert kb.count() == 1 and row.frequency == 2 and row.disease_icd == "r51" and row.disease_ref_id == "d1"
    assert row.drug_name == "Paracetamol 500mg" and row.treatment_type == '["drug", "invalid"]'
    assert row.symptom == "Sốt" and row.prescription_reason == "giảm\nđau" and row.secondary_disease_icd == ""
    stats = batch_stats(log, prepare_log(log, F.lit("b1")), kb.limit(0)).first()
    assert (stats.total, stats.errors, stats.inserted, stats.updated) == (3, 1, 1, 1)
    twice = upsert_kb(kb, kb).first()
    assert twice.frequency == 4


def test_export_header(spark, tmp_path):
    (tmp_path / "b.csv").write_text(EXPORT, encoding="utf-8")
    row = files.read_prescription_log(spark, str(tmp_path / "b.csv")).first()
    assert row.drug_name == "Zinc" and row.primary_disease == "J00 - Viêm mũi" and row.feedback == "NULL"
    parsed = prepare_log(files.read_prescription_log(spark, str(tmp_path / "b.csv")), F.lit("b")).first()
    assert parsed.secondary_disease_icd == "j06" and parsed.treatment_type == '["drug", "valid", "main drug"]'


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿so_dang_ky,ten_thuoc,hoat_chat\nVN-1,A,aa\nVN-1,A,bb\n", encoding="utf-8")
    (tmp_path / "y.csv").write_text("so_dang_ky,ten_thuoc,danh_muc\nVN-2,B,cc\nVN-3,C\nVN-4,D,x,y\nVN-5,E,x,\nbroken\n", encoding="utf-8")
    rows = files.read_catalogue(spark, str(tmp_path))
    assert set(rows.columns) == {"so_dang_ky", "ten_thuoc", "hoat_chat", "danh_muc", "pos"}
    loaded = reload_catalogue(rows.where("ten_thuoc IS NOT NULL"), "crawl", "pos").orderBy("so_dang_ky").collect()
    assert [(r.so_dang_ky, r.hoat_chat, r.note) for r in loaded] == [("VN-1", "aa", ""), ("VN-2", "", "Group: cc"), ("VN-3", "", "")]
    assert {r.so_dang_ky for r in rows.collect()} == {"VN-1", "VN-2", "VN-3", "broken"}


def test_icd_list(spark, tmp_path):
    row = ["u1"] + [""] * 9 + ["R51", "", "", "", "Ch", "slug", "Đau đầu"] + [""] * 7
    short = ["u2"] * 5
    (tmp_path / "icd.csv").write_text("\n".join(",".join(r) for r in (row, short)) + "\n", encoding="utf-8")
    got = files.read_icd_list(spark, str(tmp_path / "icd.csv")).collect()
    assert [(r.id, r.icd_code, r.search_text) for r in got] == [("u1", "R51", "r51 đau đầu slug ch")]


def test_requests(spark, tmp_path):
    doc = {"request_id": "r", "claims": [{"id": "c1", "service_name": "A", "amount": 5.0}],
           "medicines": [{"id": "m1", "service": "B"}]}
    (tmp_path / "r.json").write_text(json.dumps(doc), encoding="utf-8")
    claims, meds = files.read_match_requests(spark, str(tmp_path / "r.json"))
    assert claims.first().claim_id == "c1" and claims.first().service == "A"
    assert meds.first().medicine_id == "m1" and meds.first().amount == 0.0
    consult = {"request_id": "q", "diagnoses": [{"code": "R51"}], "items": [{"id": "1", "name": "Zinc"}]}
    (tmp_path / "c.json").write_text(json.dumps(consult), encoding="utf-8")
    items, diagnoses = files.read_consult_requests(spark, str(tmp_path / "c.json"))
    assert items.first().name == "Zinc" and diagnoses.first().pos == 0


def test_snapshots(spark, tmp_path):
    schema = SCHEMAS["diseases"]
    table = tables.SnapshotTable(spark, str(tmp_path / "t"), schema)
    assert table.read().count() == 0 and table.version() is None
    one = spark.createDataFrame([("d1", "A00")], "id string, icd_code string")
    table.write(one)
    assert table.version() == 0 and table.read().first().slug is None
    (tmp_path / "t" / "v=1").mkdir()  # a job that died leaves no marker
    assert table.version() == 0
    tables.copy_tables({"diseases": one.union(spark.createDataFrame([("d2", "B00")], one.schema))}, {"diseases": table})
    assert sorted(r.id for r in table.read().collect()) == ["d1", "d2"]
    assert table.write(one, version=table.version()) == table.version() and table.read().count() == 2


def test_logs_and_dumps(spark, tmp_path):
    logs = spark.createDataFrame([(1, "2024-01-02 03:04:05")], "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    tables.append_by_day(logs, str(tmp_path / "log"), "ts")
    tables.append_by_day(logs, str(tmp_path / "log"), "ts")
    assert spark.read.parquet(str(tmp_path / "log")).where("date = DATE'2024-01-02'").count() == 2
    tables.write_csv(logs, str(tmp_path / "csv"))
    tables.write_json(logs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    (tmp_path / "raw.csv").write_text("a\nb", encoding="utf-8")
    raw = files.read_raw_batches(spark, str(tmp_path / "raw.csv"), F.lit("b1"), "test", F.current_timestamp())
    tables.append_archive(raw, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).first().raw_content == "a\nb"


def test_pages(spark):
    html = (
        "<html><body><nav>x</nav><main><h1>Panadol</h1><div class='ingredient-content big'>Para</div>"
        "<div>Số đăng ký</div><div>: VN-1</div><p>Nhà sản xuất<p>GSK</p>"
        "<h2>Chỉ định</h2><p>Sốt</p><ul><li>Đau</li></ul><h3>Khác</h3><p>no</p>"
        "<table id='thanh-phan-hoat-chat'><tbody><tr><td>Para</td><td>500 mg</td></tr></tbody></table>"
        "<b class='origin'>VN</b></main></body></html>")
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    out = extract_pages(df, extra={"nuoc_sx": [".missing", ".origin"]})
    r = out.where("page_id = 1").first()
    assert (r.ten_thuoc, r.hoat_chat, r.so_dang_ky, r.cong_ty_sx, r.chi_dinh, r.nuoc_sx) == (
        "Panadol", "Para", "VN-1", "GSK", "Sốt\nĐau", "VN")
    assert "x" not in r.content.split()
    assert [(i.name, i.dose) for i in ingredient_rows(out).collect()] == [("Para", "500 mg")]
    assert out.where("page_id = 2").first().ten_thuoc is None
