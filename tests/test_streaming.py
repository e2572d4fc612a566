"""Replay safety of the streaming jobs."""

from pyspark.sql import functions as F

from rxloom.schemas import SCHEMAS
from rxloom.sources.tables import SnapshotTable
from rxloom.streaming.ingest import start_ingest
from rxloom.streaming.metrics import read_metrics, start_metrics

HEADER = ["Tên thuốc", "Mã ICD (Chính)", "Phân loại"]


def test_ingest_folds_files_and_ignores_replays(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    diseases = spark.createDataFrame([("d1", "R51")], "id string, icd_code string")
    table = SnapshotTable(spark, str(tmp_path / "kb"), SCHEMAS["knowledge_base"])

    def run(checkpoint):
        start_ingest(spark, str(inbox), HEADER, diseases, table, str(tmp_path / checkpoint), str(tmp_path / "stats"),
                     str(tmp_path / "raw")).awaitTermination()

    (inbox / "a.csv").write_text(",".join(HEADER) + "\nZinc,R51 - Đau,valid\nZinc,R51 - Đau,invalid\n,R51 - x,\n", encoding="utf-8")
    run("cp")
    (inbox / "b.csv").write_text(",".join(HEADER) + "\nZINC,R51 - Đau,valid\nIron,J00 - Y,valid\n", encoding="utf-8")
    run("cp")
    got = {(r.drug_name_norm, r.disease_icd): (r.frequency, r.disease_ref_id) for r in table.read().collect()}
    assert got == {("zinc", "r51"): (3, "d1"), ("iron", "j00"): (1, None)}
    stats = spark.read.parquet(str(tmp_path / "stats")).orderBy("version").collect()
    assert [(s.total, s.errors, s.inserted, s.updated) for s in stats] == [(3, 1, 1, 1), (2, 0, 1, 1)]
    run("cp-lost")  # a lost checkpoint replays files that the snapshot already holds
    assert sum(r.frequency for r in table.read().collect()) == 4
    for old in ("a.csv", "b.csv"):
        (inbox / old).unlink()
    (inbox / "c.csv").write_text(",".join(HEADER) + "\nGold,R51 - Đau,valid\n", encoding="utf-8")
    run("cp-new")  # epochs begin again at 0, with a file that is new
    assert sum(r.frequency for r in table.read().collect()) == 5


def test_window_metrics(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 200), ("2024-01-01 00:50:00", 500), ("2024-01-01 01:10:00", 200)]
    logs = spark.createDataFrame(rows, "created_at string, status_code int").selectExpr(
        "cast(created_at as timestamp) created_at", "status_code", "1 matched_count", "0 unmatched_count", "5.0D latency_ms")
    logs.write.parquet(str(tmp_path / "logs"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs"))
    start_metrics(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = read_metrics(spark, str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r.total_requests, r.success_rate) for r in got] == [(2, 50.0), (1, 100.0)]
    assert got[0].window_end == got[1].window_start
    assert logs.where(F.col("created_at").isNull()).count() == 0
