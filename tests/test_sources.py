import base64
import json

import pytest
from pyspark.sql import functions as F

from platen.operators import findings
from platen.sources import files


def test_json_documents_and_lines(spark, tmp_path):
    for k, body in enumerate(('{"verdict": "PASS", "n": 1}', "{broken", '{"verdict": "FAIL", "n": 2}')):
        d = tmp_path / "docs" / f"2024010{k + 1}-000000"
        d.mkdir(parents=True)
        (d / "report.json").write_text(body)
    got = files.newest(files.json_documents(spark, f"{tmp_path}/docs/*/report.json", "verdict string, n int"), 5).collect()
    assert [(r.rec_id, r.verdict) for r in got] == [("20240103-000000", "FAIL"), ("20240101-000000", "PASS")]
    assert files.read_record(spark.createDataFrame([("20240101-000000",)], "rec_id string"), "20240101-000000").count() == 1
    with pytest.raises(ValueError):
        files.read_record(spark.range(1), "../x")
    (tmp_path / "log.jsonl").write_text('{"by": "a"}\n[1]\nnonsense\n{"by": broken\n{"by": "b"}\n')
    assert [r.by for r in files.json_lines(spark, f"{tmp_path}/log.jsonl", "by string").orderBy("line_no").collect()] == ["a", "b"]


def test_append_ids_and_clear(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp_ntz '2024-01-02 00:00:00', 1), (timestamp_ntz '2024-01-01 00:00:00', 2), (timestamp_ntz '2024-01-01 00:00:00', 1) as e(ts, seq)")
    path = f"{tmp_path}/events"
    files.append_events(rows, path)
    assert [(r.id, r.seq) for r in spark.read.parquet(path).orderBy("id").collect()] == [(1, 1), (2, 2), (3, 1)]
    assert files.clear_events(spark, path) == 3 and spark.read.parquet(path).count() == 0


def test_files_logs_blocks(spark, tmp_path):
    for n in ("1.jpg", "0012.jpg", "x1.jpg", "123456789.jpg"):
        (tmp_path / n).write_bytes(b"1")
    assert sorted(r.frame for r in files.frame_files(spark, str(tmp_path)).collect()) == [1, 12]
    (tmp_path / "d.log").write_text("noise\n12:00 Defect: dent | Confidence: 0.91 | BBox: [1, 2, 3, 4]\n")
    assert tuple(files.detection_log(spark, f"{tmp_path}/d.log").first()) == ("dent", 0.91, [1, 2, 3, 4])
    raw = json.dumps([{"text": "a", "conf": "0.5", "bbox": [1, 2, 3, 4]}, {"text": " "}, {"text": "b", "conf": "x", "bbox": [1]}])
    df = spark.createDataFrame([(raw, "y" * 5), ("{}", base64.b64encode(b"z" * 900).decode())], "b string, img string")
    got = files.embedded_image(df.withColumn("blocks", files.blocks("b")), ["img"]).collect()
    assert [(x.text, x.conf, x.bbox) for x in got[0].blocks] == [("a", 0.5, [1, 2, 3, 4]), ("b", 0, None)] and got[1].blocks == []
    assert got[0].image is None and bytes(got[1].image) == b"z" * 900
    assert [r.rec_id for r in files.distinct_ids(df.withColumn("k", F.lit("r")), "k", ["b"]).orderBy("rec_id").collect()] == ["r", "r-1"]


def test_findings(spark):
    box = [("i", "a", 1, [0.0, 0.0, 2.0, 2.0]), ("i", "a", 2, [0.0, 0.0, 2.0, 1.9]), ("i", "b", 7, [0.0, 0.0, 2.0, 2.0]), ("i", "b", 8, [5.0, 5.0, 6.0, 6.0])]
    got = findings.greedy_matches(spark.createDataFrame(box, "img string, side string, id long, bbox array<double>"), ["img"]).collect()
    assert [(r.base, r.test, r.iou) for r in got] == [(1, 7, 1.0)]
    rows = spark.createDataFrame([("p", "red", False, 1.0), ("p", "yellow", True, 0.5), ("q", "yellow", False, 0.95), ("r", "ok", False, 1.0), ("s", "ok", True, 1.0)], "k string, s string, u boolean, c double")
    got = {r.k: (r.verdict, r.reasons) for r in findings.compare_verdict(rows, ["k"], "s", "u", "c").collect()}
    assert got == {"p": ("FAIL", ["red", "unreadable", "yellow", "coverage"]), "q": ("REVIEW", ["yellow"]), "r": ("PASS", []), "s": ("UNREADABLE", ["unreadable"])}
    log = spark.createDataFrame([("j", 1, 1, "real"), ("j", 1, 2, None), ("j", 2, 3, "false"), ("j", 9, 4, "real")], "job string, id int, seq int, status string")
    known = spark.createDataFrame([("j", 1), ("j", 2)], "job string, id int")
    assert [(r.id, r.status) for r in findings.review_state(log, known).collect()] == [(2, "false")]
