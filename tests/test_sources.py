"""Readers, writers, streams, runs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagelens.operators import layout, runs
from pagelens.sources import readers, writers
from pagelens.streaming import ingest


def test_pages(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"file_name": "a.jpg", "regions": null, "extra": 1}\n\n[1]\n{"file_name": "b.jpg", "regions": [{"bbox": [1, 2, 3, 4], "text": "я"}]}\n{broken\n', encoding="utf-8")
    with pytest.raises(Exception):
        readers.pages(spark, str(p)).collect()
    loose = readers.pages(spark, str(p), strict=False).cache()
    assert loose.where("broken IS NOT NULL").count() >= 1
    assert [r["file_name"] for r in readers.objects(spark, str(p)).collect()] == ["a.jpg", "b.jpg"]
    good = tmp_path / "g.jsonl"
    good.write_text('{"file_name": "a.jpg"}\n\n{"file_name": "b.jpg"}\n')
    assert readers.pages(spark, str(good)).count() == 2


def test_submissions(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", '[{"text": "x, \\"y\\"\nz"}]'), ("b.jpg", None)], "image string, regions string")
    out = str(tmp_path / "run_submission")
    writers.submission(rows, out, one_file=True)
    back = {r["image"]: r["regions"] for r in readers.submissions(spark, out).collect()}
    assert back == {"a.jpg": '[{"text": "x, \\"y\\"\nz"}]', "b.jpg": "[]"}
    bom = tmp_path / "bom.csv"
    bom.write_text('\ufeff"image","regions"\nc.jpg,NA\n', encoding="utf-8")
    assert [(r["image"], r["regions"]) for r in readers.submissions(spark, str(bom)).collect()] == [("c.jpg", "[]")]
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.submissions(spark, str(wrong))
    writers.empty_submission(rows, str(tmp_path / "empty"))
    assert {r["regions"] for r in readers.submissions(spark, str(tmp_path / "empty")).collect()} == {"[]"}


def test_discovery(spark, tmp_path):
    for name in ("x/01_base_submission.csv", "y/submission.csv", "y/submission_summary.csv", "z/other.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("image,regions\n")
    assert [r["run_id"] for r in readers.submission_files(spark, str(tmp_path)).collect()] == ["01_base", "y"]
    assert readers.submission_files(spark, str(tmp_path), every=True).count() == 4
    assert spark.range(1).select(readers.run_label(F.lit("01_base-line")).alias("x")).first()["x"] == "base line"
    (tmp_path / "p.JPG").write_text("x")
    assert [r["name"] for r in readers.images(spark, str(tmp_path)).collect()] == ["p.JPG"]
    assert spark.range(1).select(readers.run_label(F.lit("07_x"), {"07_x": "Best"}).alias("x")).first()["x"] == "Best"
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "q.png").write_text("x")
    assert [r["name"] for r in readers.images(spark, str(tmp_path)).collect()] == ["q.png"]
    (tmp_path / "metadata.jsonl").write_text('{"file_name": "m/z.jpg"}\n')
    assert [(r["path"], r["name"]) for r in readers.images(spark, str(tmp_path)).collect()] == [("m/z.jpg", "z.jpg")]
    (tmp_path / "prompts.json").write_text('{"crop_prompts": {"table": "T"}}')
    assert readers.prompts(spark, str(tmp_path / "prompts.json"), {"table": "t", "default": "d"}) == {"table": "T", "default": "d"}
    assert readers.prompts(spark, str(tmp_path / "none.json"), {"default": "d"}) == {"default": "d"}
    want = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    have = spark.createDataFrame([("b",)], "path string")
    assert {(r["k"], r["path"]) for r in readers.resolve(want, have, "k", [F.col("x"), F.col("y")]).collect()} == {(1, "b"), (2, "c")}


def test_long_markdown(spark):
    with pytest.raises(ValueError):
        writers.markdown(spark.range(4), rows=3)
    assert writers.markdown(spark.range(3), rows=3).count("\n") == 5


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc", None)], "i int, t string, n string")
    assert writers.markdown(df) == "| i | t | n |\n| --- | --- | --- |\n| 1 | a\\|b<br>c |  |\n" and writers.markdown(df.limit(0)) == "_No rows._\n"
    writers.report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())[0]["t"] == "a|b\nc"
    with pytest.raises(ValueError):
        writers.report(spark.range(5), str(tmp_path / "s.json"), rows=3)
    writers.json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '{"i":1,"t":"a|b\\nc","n":null}'
    lines = [("x/p.jpg", "1 0.5"), ("x/p.jpg", "0 0.5"), ("x/p.jpg", None), ("q.png", "2 0.1")]
    writers.label_files(spark.createDataFrame(lines, "image string, line string"), str(tmp_path / "l"))
    assert {p.name: p.read_text() for p in (tmp_path / "l").iterdir()} == {"p.txt": "0 0.5\n1 0.5\n", "q.txt": "2 0.1\n"}
    writers.tables({"t": df}, str(tmp_path / "tables"))
    assert (tmp_path / "tables" / "t.md").read_text().startswith("| i | t | n |") and spark.read.csv(str(tmp_path / "tables" / "t"), header=True, multiLine=True).count() == 1
    writers.classes_yaml(str(tmp_path / "c.yaml"), "train.txt", "val.txt")
    assert "nc: 7" in (tmp_path / "c.yaml").read_text()
    regions = spark.createDataFrame([(1, 0, "printed", 0.0, 0.0, 9.0, 9.0), (1, 1, "printed", 20.0, 0.0, 29.0, 9.0)], "page int, idx int, type string, x1 double, y1 double, x2 double, y2 double")
    writers.relations(layout.lines(regions), str(tmp_path / "rel"))
    assert spark.read.json(str(tmp_path / "rel")).first()["edges"] == [["0", "1", "next"]]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"file_name": "a.jpg"}\n{"file_name": "a.jpg"}\n{"file_name": "b.jpg"}\n')
    timed = ingest.pages(spark, str(folder)).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    once = ingest.first_deliveries(timed, ["file_name"], "at")
    q = once.writeStream.format("memory").queryName("once_each").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once_each").count() == 2
    per = ingest.sessions(timed, "at", ["file_name"])
    q = per.writeStream.format("memory").queryName("per_session").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["file_name"], r["rows"]) for r in spark.table("per_session").collect()} == {("a.jpg", 2), ("b.jpg", 1)}


REGIONS = "array<struct<bbox:array<double>,type:string,language:string,legibility:string,text:string>>"


def test_runs(spark):
    box = [0.0, 0.0, 10.0, 10.0]
    pages = spark.createDataFrame(
        [(1, "i/a.jpg", "school", [(box, "printed", None, None, "слово"), (None, "printed", None, None, "x")]), (2, "i/b.jpg", None, [(box, "image", None, None, "")]), (3, "i/c.jpg", "school", None), (4, "a.jpg", "school", [])],
        f"record_id bigint, file_name string, source string, regions {REGIONS}",
    )
    sent = spark.createDataFrame(
        [(1, "r", "a.jpg", "[]", 1), (2, "r", "a.jpg", '[{"bbox": [0, 0, 10, 10], "type": "printed", "text": "слово"}]', 2), (3, "s", "b.jpg", '{"bbox": 1}', 1), (4, "s", None, "[]", 1), (5, "s", "zzz.jpg", "[]", 1)],
        "row_id bigint, run_id string, image string, regions string, submitted_at int",
    )
    got = {r["run_id"]: r for r in runs.evaluate(runs.solutions(pages), runs.predictions(sent)).collect()}
    assert (got["r"]["matched_regions"], got["r"]["false_negatives"], got["r"]["page_cer"], got["r"]["region_cer"]) == (1, 1, 0.0, 0.0)
    assert (got["s"]["matched_regions"], got["s"]["false_negatives"], got["s"]["page_cer"]) == (0, 2, 1.0)
    labels = spark.createDataFrame([("r", "full", "best")], "run_id string, run_group string, label string")
    rows = runs.formatted(runs.evaluate(runs.solutions(pages), runs.predictions(sent)), labels, ["full"]).collect()
    assert [(r["rank"], r["label"], r["page_cer"]) for r in rows] == [(1, "best", "0.0000"), (999, "s", "1.0000")]


def test_average_precision(spark):
    b = "struct<x1:double,y1:double,x2:double,y2:double,type:string,score:double>"
    at = lambda x, s: (float(x), 0.0, float(x + 10), 10.0, "printed", s)
    df = spark.createDataFrame([(1, [at(0, None), at(50, None)], [at(0, 0.9), at(200, 0.8), at(50, 0.7), at(0, 0.6)])], f"page int, gt array<{b}>, pred array<{b}>")
    r = runs.average_precision(df).first()
    assert (r["truths"], round(r["ap"], 6)) == (2, round(0.5 * 1 + 0.5 * 2 / 3, 6))
