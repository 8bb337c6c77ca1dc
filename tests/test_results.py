"""Sinks, reading back, staged files, search, streams."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from twinledger.model import SideConfig
from twinledger.operators import history as H, sinks
from twinledger.operators.search import relevance_search
from twinledger.sources import files, results
from twinledger.streaming import polling

LEGACY = "type string, id string, presentIn string, missingIn string, data string, note string"


def legacy(spark):
    return spark.createDataFrame([("missing_in_B", "1", "A", "B", '{"x":"say \\"hi\\", ok"}', "Present in A, missing in B"),
                                  ("missing_in_A", "2", "B", "A", None, "")], LEGACY)


def test_results_are_never_overwritten(spark, tmp_path):
    target = str(tmp_path / "run")
    first = sinks.write_diffs(legacy(spark), target, {"file1Label": "A"}, {"totalDifferences": 2}, ["bad row"], ["careful"])
    second = sinks.write_diffs(legacy(spark).withColumn("empty", F.lit(None).cast("int")), target, file_format="parquet")
    assert (first, second) == (target, target + "-1")
    summary, diffs = results.scan_diffs(spark, first)
    row = summary.first()
    assert json.loads(row["summary"]) == {"totalDifferences": 2, "writtenRows": 2}
    assert row["validationErrors"] == ["bad row"] and row["processingWarnings"] == ["careful"]
    assert sorted(r["id"] for r in diffs.collect()) == ["1", "2"]
    again = results.scan_diffs(spark, second)[1]
    assert again.columns == legacy(spark).columns + ["empty", "pos"] and again.count() == 2


def test_csv_layouts(spark, tmp_path):
    target = sinks.write_diff_csv(legacy(spark), str(tmp_path / "legacy"), single_file=True)
    text = open(glob.glob(target + "/*.csv")[0]).read()
    rows = list(csv.reader(text.splitlines()))
    assert rows[0] == ["type", "id", "presentIn", "missingIn", "note", "data"]
    assert rows[1] == ["missing_in_B", "1", "A", "B", "Present in A, missing in B", '{"x":"say \\"hi\\", ok"}']
    assert '"",""' in text.splitlines()[2] and '""hi' in text
    ruleset = spark.createDataFrame([("FIELD_MISMATCH", "7", "n")], "diffType string, id string, note string")
    view = sinks.csv_view(ruleset)
    assert view.columns == ["diffType", "primaryId", "field", "file1Value", "file2Value", "presentIn", "missingIn", "ruleId",
                            "severity", "message", "data"]
    assert list(view.first()) == ["FIELD_MISMATCH", "7", "", "", "", "", "", "", "", "n", ""]


def test_wrapped_document(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"metadata": {"run": 1}, "differences": [{"type": "T", "id": "b"}, {"type": "T", "id": "a"}]}, indent=1))
    meta, diffs = results.scan_diffs(spark, str(path), wrapped=True)
    assert meta.first()["metadata"]["run"] == 1
    assert [tuple(r) for r in diffs.select("pos", "id").collect()] == [(0, "b"), (1, "a")]
    page, numbers = H.paged_search(H.search_diffs(diffs, "%"), 9, 1)
    assert [r["id"] for r in page.collect()] == ["b"] and numbers == {"total": 2, "pageIndex": 0}


def test_search_uses_the_type_of_either_layout(spark):
    df = spark.createDataFrame([("MISSING_IN_FILE_1", "A1", "Web"), ("FIELD_MISMATCH", "A2", None)],
                               "diffType string, primaryId string, missingIn string")
    assert [r[1] for r in H.search_diffs(df, "a", "field_mismatch").collect()] == ["A2"]
    assert [r[1] for r in H.search_diffs(df, "", "nothing", "web").collect()] == ["A1"]
    assert H.search_diffs(df, "A_").count() == 2


def test_file_heads_and_guard(spark, tmp_path):
    schema_document = '{"$schema": "x", "properties": {}}'
    for name, text in {"a.csv": "id,x\n1,2\n", "b.csv": schema_document, "c.json": " [1]", "d.json": "id\n1\n", "e.json": "  ",
                       "f.json": schema_document, "g.json": "[" + "1," * 50_000 + "1]"}.items():
        (tmp_path / name).write_text(text)
    listing = files.list_files(spark, str(tmp_path))
    heads = files.file_heads(listing.withColumn("file_name", F.element_at(F.split("path", "/"), -1)))
    assert heads.filter("length(head) > 8192").count() == 0
    declared = F.upper(F.element_at(F.split("file_name", r"\."), -1))
    out = files.payload_shape_guard(heads.withColumn("declared_type", declared).withColumn("label", F.lit("")))
    found = {r["file_name"]: (r["shape"], r["error"]) for r in out.collect()}
    assert found["a.csv"] == ("OTHER", None) and found["c.json"] == ("JSON", None) and found["e.json"] == (None, None)
    assert found["b.csv"][1].startswith("b.csv expects CSV data, but b.csv looks like a JSON Schema document.")
    assert "does not look like JSON" in found["d.json"][1] and "instead of the schema definition" in found["f.json"][1]


def test_relevance_weights(spark):
    df = spark.createDataFrame([
        ("r1", "saved-run", "Order Sync", "nightly orders", "os", "orders from web"),
        ("r2", "run-result", "Orders", "", "", ""), ("r3", "schema", "Products", "open run", "", "")],
        "resultId string, type string, label string, description string, aliases string, content string")
    rows = [(r["resultId"], r["score"]) for r in relevance_search(df, "open Orders").collect()]
    # r1: orders in description 16, content 14, bonus 20.  r2: label 30, bonus 20.
    assert rows == [("r2", 50), ("r1", 50)]
    exact = {r["resultId"]: r["score"] for r in relevance_search(df, "ORDERS!").collect()}
    assert exact == {"r2": 160 + 100 + 30 + 20, "r1": 55 + 45 + 16 + 14 + 20}
    assert relevance_search(df, "x").count() == 0


def test_manifest_keeps_the_newest_value(spark):
    events = spark.createDataFrame([("r", 1, "RUNNING", 10, None), ("r", 2, "SUCCESS", None, "out.json"), ("r", 3, None, None, None)],
                                   "reconciliationRunResultId string, lastUpdatedDate int, statusEnumId string, n int, path string")
    assert list(H.latest_manifest(events).first()) == ["r", 3, "SUCCESS", 10, "out.json"]


@pytest.mark.parametrize("total, size, pages", [(0, 20, 1), (20, 20, 1), (21, 20, 2)])
def test_page_count(total, size, pages):
    assert H.page_count(total, size) == pages


def test_polling_takes_each_file_once(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("in1", "in2")]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def drop(folder, name, *ids):
        spark.createDataFrame([(i, 1) for i in ids], "id string, v int").coalesce(1).write.mode("append").json(folder)

    def poll(latest=False):
        streams = [polling.drop_stream(spark, f, "json", "id string, v int", archive=str(tmp_path / "done")) for f in folders]
        polling.stream_poll_reconcile(*streams, SideConfig("id", "CSV", label="A"), SideConfig("id", "CSV", label="B"), out,
                                      checkpoint, "CSV", "CSV", latest_only=latest).awaitTermination()

    drop(folders[0], "1", "a", "b")
    drop(folders[1], "1", "b", "c")
    poll()
    drop(folders[0], "2", "x")
    poll()
    drop(folders[1], "2", "x", "y")
    poll()
    runs = spark.read.json(out + "/runs").orderBy("batch_id").collect()
    assert [(r["statusEnumId"], r["file1_count"], r["file2_count"], r["matched"]) for r in runs] == [
        ("AUT_STAT_SUCCESS", 2, 2, 1), ("AUT_STAT_NO_DATA", 1, 0, 0), ("AUT_STAT_SUCCESS", 1, 2, 1)]
    diffs = {(r["type"], r["id"], r["data"]) for r in spark.read.json(out + "/differences").collect()}
    assert diffs == {("MISSING_IN_FILE_2", "a", '{"id":"a","v":1}'), ("MISSING_IN_FILE_1", "c", '{"id":"c","v":1}'),
                     ("MISSING_IN_FILE_1", "y", '{"id":"y","v":1}')}


def test_newest_file_only(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "{}", ("2026-01-01 00:00:00", "f1")), (1, "b", "{}", ("2026-01-02 00:00:00", "f2")),
                                (2, "b", "{}", ("2026-01-01 00:00:00", "g1"))],
                               "side int, compare_id string, payload string, file struct<mtime:string,name:string>")
    assert sorted(r["compare_id"] for r in polling._newest_only(df).collect()) == ["b", "b"]


def test_polled_times_keep_their_microseconds(spark):
    from datetime import datetime

    from pyspark.sql import functions as F
    from twinledger.streaming.polling import TIMES

    at = datetime(2026, 1, 2, 12, 0, 0, 123456)
    df = spark.createDataFrame([(at,)], "at timestamp").select(F.struct("at", F.col("at").cast("timestamp_ntz").alias("n")).alias("data"))
    back = df.select(F.from_json(F.to_json("data", TIMES), df.schema["data"].dataType, TIMES).alias("d")).select("d.*").first()
    assert (back["at"], back["n"]) == (at, at)
