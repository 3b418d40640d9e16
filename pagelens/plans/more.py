"""Queries of the small frame operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import frames, match
from ..operators import selection as X
from ..session import table
from . import fixture, show
from .evaluation import _records


def w7_numbered(spark, d):
    """Pages numbered in the order of their file names."""
    p = table(spark, d, "page_metadata").select("record_id", "file_name")
    return frames.numbered(p, ["file_name", "record_id"]).select("record_id", "id")


def filter_projection(spark, d):
    """Regions as they are sent, one row each."""
    p = table(spark, d, "page_metadata").select("record_id", F.posexplode(frames.projected(F.col("regions"))).alias("idx", "r"))
    return p.select("record_id", "idx", "r.type", "r.text", F.round(F.get("r.bbox", F.lit(0)), 6).alias("x1"))


def filter_visual(spark, d):
    t = text.normal_type(F.col("label"))
    return table(spark, d, "crop_records").select("crop_id", frames.without_visual_text(t, F.col("text")).alias("text"))


def filter_label(spark, d):
    """Runs whose label says hybrid."""
    return table(spark, d, "runs").where(F.col("label").rlike("(?i)hybrid")).select("run_id")


def t10_training(spark, d):
    return table(spark, d, "crop_records").select("crop_id", text.training_text(F.col("text"), True).alias("text"))


def t22_lengths(spark, d):
    c = table(spark, d, "crop_records").where("text IS NOT NULL")
    return c.select("crop_id", frames.lengths(F.col("text")).alias("chars"), frames.lengths(F.col("text"), "words").alias("words"))


def v4_run(spark, d):
    """Rows of the run asked for; it is not there, so of the first."""
    s = table(spark, d, "sample_submission").where("run_id IS NOT NULL").select("run_id", "row_id")
    return frames.run_or_first(s, "final").select("run_id", "row_id")


def g21_same_text(spark, d):
    p = fixture.nested(fixture.pred(spark, d), "boxes", "score")
    kept = match.same_text(F.col("boxes"))
    return p.select("page", F.size(kept).alias("kept"), F.size("boxes").alias("boxes"))


def x8_crops(spark, d):
    r = _records(spark, d)
    scorable = text.scorable(F.col("gt_type"), F.lit(None), F.lit(None)) & F.col("gt_type").isNotNull()
    r = r.withColumns({"shown": X.status(F.col("scored"), True), "scorable": scorable})
    q = X.crop_quality(F.lit(1000), F.lit(400))
    return X.crop_examples(r, q, 4, X.few_buckets(q))


def u5_distinct(spark, d):
    return table(spark, d, "sample_submission").select("run_id", "image").dropDuplicates(["run_id", "image"])


QUERIES = {f.__name__: f for f in (
    w7_numbered, filter_projection, filter_visual, filter_label, t10_training, t22_lengths, v4_run, g21_same_text, x8_crops, u5_distinct,
)}

_T = r"lower(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'))"
_KNOWN = "('handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph')"
SQL = {
    "w7_numbered": "SELECT record_id, row_number() OVER (ORDER BY file_name COLLATE \"C\", record_id) AS id FROM page_metadata",
    "filter_projection": "WITH e AS (SELECT record_id, unnest(range(len(regions))) AS i, unnest(regions) AS r FROM page_metadata) SELECT record_id, CAST(i AS INT) AS idx, "
    f"CASE WHEN {_T.format('r.type')} IN {_KNOWN} THEN {_T.format('r.type')} ELSE 'handwritten' END AS type, coalesce(r.text, '') AS text, CAST(round_even(r.bbox[1], 2) AS DOUBLE) AS x1 FROM e",
    "filter_visual": f"SELECT crop_id, CASE WHEN {_T.format('label')} IN ('image', 'graph') THEN '' ELSE text END AS text FROM crop_records",
    "filter_label": "SELECT run_id FROM runs WHERE regexp_matches(label, '(?i)hybrid')",
    "t10_training": r"SELECT crop_id, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS text FROM crop_records",
    "t22_lengths": r"SELECT crop_id, length(text) AS chars, CAST(len(list_filter(regexp_split_to_array(replace(text, chr(160), ' '), '\s+'), lambda w: w <> '')) AS INT) AS words FROM crop_records WHERE text IS NOT NULL",
    "v4_run": "SELECT run_id, row_id FROM sample_submission WHERE run_id = (SELECT min(run_id) FROM sample_submission)",
    "x8_crops": show.FEW,
    "u5_distinct": "SELECT DISTINCT run_id, image FROM sample_submission",
}
