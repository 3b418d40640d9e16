"""Choosing pages and crops to show.

Every choice is a maximum with an explicit order: first the preference, then the
smallest page and regions, so that the result does not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..schema import STRUCTURED_TYPES, VISUAL_TYPES
from ..session import materialize

# ---------------------------------------------------------------- fixed values
# Weights of a page, of an error and of a crop; bounds of error rates; names of buckets.
PAGE = {"f1": 10, "classes": 6, "type": 1.5, "structured": 2, "sized": 1, "there": 2, "absent": -100}
PAGE_SIZE = (5, 38)  # predictions
ERROR = {"confusion": 8, "missed": 1.5, "extra": 1.2, "classes": 6, "f1": 5}
CROP = {"iou": 3, "area": 1.2, "no_area": -1.0, "length": 1.0, "there": 0.5, "absent": -5.0}
CROP_AREA, CROP_LENGTH = (0.0015, 0.22), (2, 140)
CORRECT, NEAR = 0.10, 0.35  # error rates up to which a match is correct, near-correct
BUCKETS = (
    "handwritten success", "printed success", "formula near-correct", "formula failure", "table example", "table formatting failure",
    "annotation near-correct", "annotation failure", "formula-handwritten confusion", "type confusion", "empty-text route",
)
FEW_BUCKETS = ("handwritten success", "printed success", "formula near-correct", "table example", "annotation near-correct", "type confusion")
# ------------------------------------------------------------------------------
SOURCE_ORDER = ("school", "dictation", "university", "archive")


def page_score(predictions: Column, there: Column | None = None) -> Column:
    """Worth of a page from its statistics; ``there`` tells whether its image exists."""
    several = F.arrays_overlap("gt_types", F.array(*map(F.lit, (*STRUCTURED_TYPES, *VISUAL_TYPES))))
    return (
        F.col("det_f1") * PAGE["f1"] + F.col("class_acc") * PAGE["classes"] + F.size("gt_types") * PAGE["type"] + several.cast("int") * PAGE["structured"]
        + predictions.between(*PAGE_SIZE).cast("int") * PAGE["sized"] + (F.when(there, PAGE["there"]).otherwise(PAGE["absent"]) if there is not None else F.lit(PAGE["there"]))
    )


def error_score() -> Column:
    """How much there is to see on a page that went wrong."""
    return (
        F.col("type_confusions") * ERROR["confusion"] + F.col("missed") * ERROR["missed"] + F.col("false_positive") * ERROR["extra"]
        + (1 - F.col("class_acc")) * ERROR["classes"] + (1 - F.col("det_f1")) * ERROR["f1"]
    )


def status(scored: Column, extended: bool = False) -> Column:
    """Status of a record; ``extended`` tells missed, false positive and unscored apart."""
    both, same = F.col("gt_type").isNotNull() & F.col("pred_type").isNotNull(), F.col("gt_type") == F.col("pred_type")
    s = (
        F.when(F.col("gt_type").isNull(), "false positive").when(F.col("pred_type").isNull(), "missed")
        if extended
        else F.when(~both, "failure")
    )
    s = s.when(~scored, F.when(same, "unscored" if extended else "correct").otherwise("type confusion"))
    return s.when(~same, "type confusion").when(F.col("cer") <= CORRECT, "correct").when(F.col("cer") <= NEAR, "near-correct").otherwise("failure")


def crop_quality(w: Column, h: Column, there: Column | None = None) -> Column:
    """How well a record's crop can be shown: overlap, size on the page, length of its text."""
    ratio = G.area_ratio(F.col("crop"), w, h)
    length = F.coalesce(F.char_length("gt_text"), F.char_length("pred_text"), F.lit(0))
    return (
        F.coalesce("iou", F.lit(0.0)) * CROP["iou"] + F.when(ratio.between(*CROP_AREA), CROP["area"]).otherwise(CROP["no_area"])
        + F.when(length.between(*CROP_LENGTH), CROP["length"]).otherwise(0.0) + (F.when(there, CROP["there"]).otherwise(CROP["absent"]) if there is not None else F.lit(CROP["there"]))
    )


def observation() -> Column:
    """A sentence on a page from its statistics."""
    return (
        F.when(F.col("type_confusions") > 0, F.format_string("Types of %d matched regions differ.", "type_confusions"))
        .when(F.col("missed") + F.col("false_positive") > 0, F.format_string("%d regions missed and %d extra.", "missed", "false_positive"))
        .when((F.col("det_f1") >= 0.95) & (F.col("class_acc") >= 0.95), "Detection and types agree.")
        .otherwise("A representative page.")
    )


def full_pages(stats: DataFrame, desired: int = 6) -> DataFrame:
    """``(place, page, reason)``: the best page of each source, the most notable error, then by score.

    ``stats`` are page statistics with ``score``, ``error`` and ``predictions``.
    """
    stats = materialize(stats.where("predictions > 0").select("page", "source", "score", "error", "det_f1", "class_acc"))  # read four times
    rank = {s: i for i, s in enumerate(SOURCE_ORDER)}
    place = reduce(lambda c, s: c.when(F.col("source") == s, rank[s]), SOURCE_ORDER, F.when(F.lit(False), -1))
    best = stats.where(F.col("source").isin(*SOURCE_ORDER)).groupBy("source").agg(F.max_by("page", F.struct("score", -F.col("page"))).alias("page"))
    best = best.select(place.alias("place"), "page", F.lit("source").alias("reason"))
    rest = stats.join(best.select("page"), "page", "left_anti")
    wrong = rest.where("det_f1 >= 0.5 AND error > 0").orderBy(F.desc("error"), F.desc("det_f1"), F.desc("class_acc"), "page").limit(1)
    wrong = wrong.select(F.lit(len(SOURCE_ORDER)).alias("place"), "page", F.lit("error").alias("reason"))
    more = rest.join(wrong.select("page"), "page", "left_anti").orderBy(F.desc("score"), "page").limit(desired)
    more = more.select((F.row_number().over(Window.orderBy(F.desc("score"), "page")) + len(SOURCE_ORDER)).alias("place"), "page", F.lit("score").alias("reason"))
    return best.unionByName(wrong).unionByName(more).orderBy("place").limit(desired)


def buckets(quality: Column) -> list[tuple[str, Column, Column]]:
    """Names, conditions and preferences of the crops to show, in the order of choice."""
    gt, pred, cer, scored = F.col("gt_type"), F.col("pred_type"), F.col("cer"), F.col("scored")
    e = F.coalesce(cer, F.lit(0.0))
    both = lambda t: (gt == t) & (pred == t)
    wrong = lambda t: (gt == t) & F.col("scorable") & (~F.coalesce(pred == t, F.lit(False)) | (cer > NEAR))
    pair = lambda a, b: ((gt == a) & (pred == b)) | ((gt == b) & (pred == a))
    untabular = F.col("pred_text").isNotNull() & ~F.col("pred_text").contains("|")
    rules = [
        (both("handwritten") & (cer <= CORRECT), quality - F.abs(e - 0.04)),
        (both("printed") & (cer <= CORRECT), quality),
        (both("formula") & cer.between(0.02, NEAR), quality - F.abs(e - 0.16)),
        (wrong("formula"), quality + e),
        (both("table") & scored, quality - F.least(e, F.lit(0.5))),
        ((gt == "table") & F.col("scorable") & (~F.coalesce(pred == "table", F.lit(False)) | (cer >= 0.20) | untabular), quality + F.least(e, F.lit(1.0))),
        (both("annotation") & (cer > CORRECT) & (cer <= NEAR), quality),
        (wrong("annotation"), quality + F.least(e, F.lit(1.0))),
        (pair("formula", "handwritten"), quality + 2),
        (gt != pred, quality + 1.5),
        (gt.isin(*VISUAL_TYPES) & (gt == pred), quality),
    ]
    return [(name, *rule) for name, rule in zip(BUCKETS, rules)]


def few_buckets(quality: Column) -> list[tuple[str, Column, Column]]:
    """The six buckets of a small figure."""
    return [b for b in buckets(quality) if b[0] in FEW_BUCKETS]


def crop_examples(records: DataFrame, quality: Column, desired: int = 12, wanted: list[tuple[str, Column, Column]] | None = None) -> DataFrame:
    """``(place, bucket, page, gt_idx, pred_idx)``: one record a bucket, none twice, then the best left.

    Each bucket's candidates are cut to as many as there are choices before it plus one:
    an earlier choice can take at most one from it.  These few rows are settled on the
    driver.
    """
    key = ["page", "gt_idx", "pred_idx"]
    wanted = list(wanted or buckets(quality))
    order = (
        F.when(F.col("shown") == "type confusion", 2.0).otherwise(0.0) * 1e6 + F.when(F.col("shown") == "failure", 1.0).otherwise(0.0) * 1e6 + quality
    )
    wanted.append(("fallback", F.col("gt_type").isNotNull() & F.col("pred_type").isNotNull() & F.col("scorable"), order))
    entries = F.filter(
        F.array(*(F.struct(F.lit(i).alias("b"), F.when(F.coalesce(c, F.lit(False)), p.cast("double")).alias("p")) for i, (_, c, p) in enumerate(wanted))),
        lambda x: x["p"].isNotNull(),
    )
    rows = records.select(*key, "gt_type", "shown", F.explode(entries).alias("e")).select(*key, "gt_type", "shown", "e.b", "e.p")
    w = Window.partitionBy("b").orderBy(F.desc("p"), *key)
    top = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= len(wanted) + desired).collect()
    used: set[tuple] = set()
    out: list[tuple] = []
    for i, (name, *_) in enumerate(wanted):
        for r in sorted((r for r in top if r["b"] == i), key=lambda r: r["k"]):
            k = tuple(r[c] for c in key)
            if k in used or len(out) >= desired:
                continue
            used.add(k)
            out.append((len(out), name if name != "fallback" else f"{r['gt_type']} {r['shown']}", *k))
            if name != "fallback":
                break
    return records.sparkSession.createDataFrame(out, "place int, bucket string, page bigint, gt_idx int, pred_idx int")


def missing_buckets(chosen: DataFrame, wanted: list[tuple[str, Column, Column]]) -> DataFrame:
    """``(place, warning)`` of the buckets for which no record was found."""
    names = chosen.sparkSession.createDataFrame([(i, name) for i, (name, *_) in enumerate(wanted)], "place int, bucket string")
    return names.join(chosen.select("bucket").distinct(), "bucket", "left_anti").select("place", F.concat(F.lit("missing bucket: "), "bucket").alias("warning"))


def metadata(chosen_pages: DataFrame, stats: DataFrame, chosen_crops: DataFrame, records: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row ``full_page_examples, crop_examples, warnings``: what is shown, with its figures, for :func:`writers.report`."""
    four = lambda c: F.round(c, 4).alias(c)
    p = chosen_pages.join(stats, "page").select("place", F.struct(
        F.col("page").alias("source_image"), "source", "gt_types", four("det_f1"), four("class_acc"), "matched", "missed", "false_positive", observation().alias("observation"),
    ).alias("x"))
    key = ["page", "gt_idx", "pred_idx"]
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    c = chosen_crops.alias("c").join(records.alias("r"), same).select("c.place", F.struct(
        "c.bucket", F.col("r.page").alias("source_image"), "r.source", "r.gt_type", "r.pred_type", F.round("r.iou", 4).alias("iou"), F.round("r.cer", 4).alias("cer"),
        "r.gt_text", "r.pred_text", F.col("r.gt_norm").alias("gt_text_official_normalized"), F.col("r.pred_norm").alias("pred_text_official_normalized"),
    ).alias("x"))
    ordered = lambda df, x, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", x))), lambda e: e[x]).alias(name))
    one = ordered(p, "x", "full_page_examples").withColumn("_", F.lit(1))
    two = ordered(c, "x", "crop_examples").withColumn("_", F.lit(1))
    three = ordered(warnings, "warning", "warnings").withColumn("_", F.lit(1))
    return one.join(two, "_").join(three, "_").drop("_")
