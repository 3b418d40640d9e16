"""Small frame operations, raw files, settings, driver contract."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys
import time

from pyspark.sql import functions as F

from pagelens import config
from pagelens.operators import frames, match, rejects
from pagelens.sources import readers, writers

ROOT = pathlib.Path(__file__).parents[1]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [(r["v"], r["id"]) for r in frames.numbered(df, ["v"]).orderBy("v").collect()] == [(i, i + 1) for i in range(1000)]
    assert frames.numbered(df.limit(0), ["v"]).count() == 0


def test_dealt(spark, tmp_path):
    """Only what is too small to be split is dealt out, with pruning and filters kept below it."""
    from pagelens.session import dealt

    spark.range(100).select("id", F.col("id").alias("x")).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    one = dealt(spark.read.parquet(str(tmp_path / "one")))
    assert one.rdd.getNumPartitions() == 4 and one.count() == 100
    plan = one.where("id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "x:bigint" not in plan
    many = spark.read.parquet(str(tmp_path / "many"))
    assert dealt(many) is many and dealt(spark.range(3)).count() == 3


def test_fixed(spark, tmp_path):
    p = str(tmp_path / "split")
    assert frames.fixed(spark, p, lambda: spark.range(3)).count() == 3
    assert frames.fixed(spark, p, lambda: spark.range(9)).count() == 3


def test_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(frames.collapsed(F.lit("так так так так так ні"))) == "так так так ні"
    assert one(frames.lengths(F.lit("а  б"), "words")) == 2 and one(frames.lengths(F.lit("аб"), F.upper)) == "АБ"
    runs = spark.createDataFrame([("b", 1), ("a", 2)], "run_id string, v int")
    assert frames.run_or_first(runs, "b").first()["v"] == 1 and frames.run_or_first(runs, "z").first()["v"] == 2
    b = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double,text:string>>"
    boxes = [(0.0, 0.0, 10.0, 10.0, 0.9, "a"), (1.0, 0.0, 11.0, 10.0, 0.8, "a"), (1.0, 0.0, 11.0, 10.0, 0.7, "b"), (1.0, 0.0, 11.0, 10.0, 0.1, None)]
    assert len(spark.createDataFrame([(boxes,)], f"b {b}").select(match.same_text(F.col("b")).alias("k")).first()["k"]) == 3


def test_raw_files(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes('image,regions\r\na.jpg,"[\n]"\r\nb.jpg\r\n"c'.encode())
    (tmp_path / "empty.csv").write_text("")
    lines = readers.records_of_files(spark, str(tmp_path))
    assert [(r["line_no"], r["raw"]) for r in lines.orderBy("line_no").collect()] == [(1, "image,regions\r"), (2, 'a.jpg,"[\n]"\r'), (3, "b.jpg\r"), (4, '"c')]
    got = rejects.load(lines.withColumn("line_id", F.col("line_no").cast("bigint")))
    assert {(r["line_id"], r["reason"]) for r in got.collect()} == {(2, None), (3, "columns"), (4, "quoting")}


def test_raw_files_in_splits(spark, tmp_path):
    """Records that lie in several splits, and states that depend on the ones before."""
    import random

    r = random.Random(4)
    want = {}
    for name in "abc":
        records = [r.choice(['p.jpg,"[\n\n]"', "q.jpg,x", 'r.jpg,"a ""b"",\n,c"', '"k\nm",', 'z"z,"', ""]) for _ in range(200)]
        records += ['s.jpg,"' + "line\n" * 40 + '"', 'open,"' + "\nno end" * 30] if name == "a" else []
        (tmp_path / f"{name}.csv").write_text("\n".join(records) + "\n")
        want[f"{name}.csv"] = list(rejects.assemble("\n".join(records).split("\n")))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got: dict = {}
        for x in readers.records_of_files(spark, str(tmp_path)).orderBy("csv_file", "line_no").collect():
            got.setdefault(x["csv_file"], []).append((x["line_no"], x["raw"]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {n: list(enumerate(rows, 1)) for n, rows in want.items()}


def test_coco(spark, tmp_path):
    regions = "array<struct<type:string,x1:double,y1:double,x2:double,y2:double>>"
    df = spark.createDataFrame([("b.jpg", 100, 100, [("printed", 0.0, 0.0, 10.0, 20.0), ("map", 0.0, 0.0, 9.0, 9.0)]), ("a.jpg", 50, 50, [("graph", 60.0, 0.0, 90.0, 9.0), ("image", 1.0, 1.0, 2.0, 9.0)])], f"image string, w int, h int, regions {regions}")
    out = writers.coco(df, str(tmp_path))
    assert [(r["id"], r["file_name"]) for r in out["images"].orderBy("id").collect()] == [(1, "a.jpg"), (2, "b.jpg")]
    a = spark.read.json(str(tmp_path / "annotations")).orderBy("id").collect()
    assert [(r["image_id"], r["category_id"], r["bbox"]) for r in a] == [(1, 7, [48.0, 0.0, 2.0, 9.0]), (2, 2, [0.0, 0.0, 10.0, 20.0])]
    assert spark.read.json(str(tmp_path / "categories")).count() == 7


def test_coco_query(spark, tmp_path):
    """The query is what the writer builds: running ids, and no box with a side of one pixel."""
    from pagelens.plans import reports

    rows = [(2, "b.jpg", 100, 100, [(" Printed", [0.0, 0.0, 10.0, 20.0]), ("printed", [0.0, 0.0, 1.0, 9.0])]), (1, "b.jpg", 50, 50, [("image", [1.0, 1.0, 5.0, 9.0]), ("map", None)]), (3, "a.jpg", 9, 9, None)]
    ddl = "record_id bigint, file_name string, image_width int, image_height int, regions array<struct<type:string,bbox:array<double>>>"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "page_metadata.parquet"))
    query = lambda n: sorted(reports.QUERIES[n](spark, str(tmp_path)).collect())
    assert [(r["id"], r["file_name"], r["width"]) for r in query("k7_images")] == [(1, "a.jpg", 9), (2, "b.jpg", 50), (3, "b.jpg", 100)]
    assert [(r["id"], r["image_id"], r["region_idx_in_image"]) for r in query("k7_coco")] == [(1, 2, 0), (2, 3, 0)] and len(query("k7_categories")) == 7


def test_settings(monkeypatch):
    monkeypatch.setenv("PAGELENS_NMS_IOU", "0.5")
    monkeypatch.setenv("PAGELENS_PER_CLASS", "true")
    d = config.from_environment(config.Detection)
    assert (d.nms_iou, d.per_class, d.most) == (0.5, True, 200) and config.from_environment(config.Scoring).dialect == "v1"


def test_contract():
    """Names resolve without a session; the rest does not need the subpackage."""
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_without_the_subpackage(tmp_path):
    """Without either folder the rest imports, and tests of it pass."""
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("pagelens", "tests"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=ignore)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p5_ids' not in q; assert set(e.oracle_sql()) <= set(q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_sources.py"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]


def test_shuffled_files_end_with_the_table(spark):
    """What was shuffled for a table is deleted once it is written; the setting stays as it was."""
    from pagelens import session

    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before = files()
    tables = [session.materialize(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()) for _ in range(3)]
    until = time.monotonic() + 10
    while files() > before and time.monotonic() < until:  # deleted in the background
        time.sleep(0.1)
    assert files() <= before
    assert [t.count() for t in tables] == [10] * 3
    assert spark.conf.get(session._CLEANUP) == "false"
