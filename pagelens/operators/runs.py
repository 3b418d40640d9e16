"""Evaluation of many runs at once, and detection precision over ranked scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text
from . import match, metrics, quality

_REGION = "struct<idx:int,x1:double,y1:double,x2:double,y2:double,type:string,text:string,language:string,legibility:string>"


def region_structs(regions: Column) -> Column:
    """Regions as boxes with type, text and defaults; those without four numbers are left out."""
    kept = F.filter(regions, lambda r: F.coalesce(F.size(F.filter(r["bbox"], lambda v: v.isNotNull())) == 4, F.lit(False)))
    return F.transform(
        kept,
        lambda r, i: F.struct(
            i.cast("int").alias("idx"), *(r["bbox"][k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), text.normal_type(r["type"]).alias("type"),
            F.coalesce(r["text"], F.lit("")).alias("text"), F.coalesce(r["language"], F.lit("uk")).alias("language"), F.coalesce(r["legibility"], F.lit("legible")).alias("legibility"),
        ),
    )


def solutions(pages: DataFrame) -> DataFrame:
    """``image, source, gt`` of pages with regions: of repeated deliveries the one of the smallest id."""
    row = F.struct("record_id", F.coalesce(F.lower(text.strip(F.col("source"))), F.lit("unknown")).alias("source"), region_structs(F.col("regions")).alias("gt"))
    return pages.where("regions IS NOT NULL").groupBy(text.basename(F.col("file_name")).alias("image")).agg(F.min_by(row, "record_id").alias("r")).select("image", "r.source", "r.gt")


def predictions(sent: DataFrame) -> DataFrame:
    """``run_id, image, pred`` of what each run sent last for an image."""
    last = quality.keep_last(sent.where("image IS NOT NULL").select("run_id", "image", "submitted_at", "row_id", "regions"), ["run_id", "image"], ["submitted_at", "row_id"])
    return last.select("run_id", "image", region_structs(quality.regions_json(F.col("regions"))).alias("pred"))


def errors(sent: DataFrame, solution: DataFrame) -> DataFrame:
    """``(run_id, code, n)``: what keeps the files of a run from being scored strictly.

    Faults of its regions (all rows count, those of unknown images too), and
    ``missing_image`` for solution pages it sent nothing for.
    """
    rows = sent.where("image IS NOT NULL").select("run_id", "row_id", "regions")
    faults = quality.region_errors(rows, ["run_id", "row_id"]).groupBy("run_id", "code").agg(F.count("*").alias("n"))
    pages = solution.select("image").distinct()
    there = sent.select("run_id", "image").join(pages, "image", "left_semi").groupBy("run_id").agg(F.count_distinct("image").alias("there"))
    runs = sent.select("run_id").distinct().join(there, "run_id", "left")
    wanted = pages.agg(F.count("*").alias("pages"))  # one row
    absent = runs.join(F.broadcast(wanted)).select("run_id", F.lit("missing_image").alias("code"), (F.col("pages") - F.coalesce("there", F.lit(0))).alias("n"))
    return faults.unionByName(absent.where("n > 0"))


def evaluate(solution: DataFrame, sent: DataFrame, dialect: str = "v1") -> DataFrame:
    """Scores of every run over all solution pages.

    A page a run sent nothing for has all its truths missed and, if it has text, a page
    error of 1; :func:`errors` tells which runs a strict evaluation refuses.  Such pages
    are not built: their sums are those of all pages less those of the pages sent.
    """
    figures = metrics.per_page(solution.join(sent, "image"), ["run_id", "image"], dialect)
    own = solution.withColumn("pred", F.expr("array()").cast(f"array<{_REGION}>"))
    all_pages = metrics.per_page(own, ["image"], dialect).agg(F.coalesce(F.sum("fn"), F.lit(0)).alias("truths"), F.count("page_cer").alias("texts"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = figures.groupBy("run_id").agg(
        s("tp").alias("tp"), s("fp").alias("fp"), s("hits").alias("hits"), s("cer_sum").alias("cer_sum"), s("cer_count").alias("cer_count"),
        F.sum("page_cer").alias("p"), F.count("page_cer").alias("t"),
    )
    missed = (F.coalesce("p", F.lit(0.0)) + F.col("texts") - F.col("t")) / F.col("texts")
    whole = sums.join(F.broadcast(all_pages)).withColumns(  # one row
        {"fn": F.col("truths") - F.col("tp"), "page_cer": F.when(F.col("texts") > 0, missed).otherwise(1.0)}
    )
    return metrics.summary(whole, ["run_id"])


def formatted(scores: DataFrame, runs: DataFrame, order: list[str]) -> DataFrame:
    """Scores as a table to print: four digits, labels, runs in a given order, unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("run_group"))
    named = scores.join(runs, "run_id", "left").withColumns({"run_group": F.coalesce("run_group", F.lit("unknown")), "label": F.coalesce("label", "run_id")})
    cols = [text.four_digits(F.col(c)).alias(c) for c in ("score", "det_f1", "class_acc", "region_cer", "page_cer")]
    return named.withColumn("rank", F.when(at > 0, at).otherwise(999).cast("int")).select("rank", "run_id", "run_group", "label", *cols).orderBy("rank", "run_id")


def average_precision(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(type, truths, ap)``: area under precision over recall of predictions by falling ``score``.

    Predictions find truths of their own type by falling score, the best overlap first.
    Hits are counted per score ahead of the shuffle; what is ranked are distinct scores.
    (An extension: such figures are reported but no rule for them is given.)
    """
    gt, pred = F.col("gt"), F.col("pred")

    def row(r: Column, g: Column) -> Column:
        hits = F.transform(pred, lambda q, p: F.struct((-q["score"]).alias("order"), g.alias("g"), p.alias("p"), G.iou(r, q).alias("iou"), (r["type"] == q["type"]).alias("same")))
        return F.filter(hits, lambda x: x["same"] & (x["iou"] >= threshold))

    ranked = F.array_sort(F.transform(F.flatten(F.transform(gt, row)), lambda x: F.struct(x["order"].alias("order"), (-x["iou"]).alias("v"), x["g"].alias("g"), x["p"].alias("p"))))
    pairs = F.transform(ranked, lambda x: F.struct(x["order"].alias("order"), x["g"].cast("int").alias("g"), x["p"].cast("int").alias("p")))
    found = pages.where("pred IS NOT NULL").withColumn("m", match.greedy(pairs))
    marked = F.transform(pred, lambda q, p: F.struct(q["type"].alias("type"), q["score"].alias("score"), F.exists(F.col("m"), lambda x: x["p"] == p).alias("hit")))
    n = found.select(F.explode(marked).alias("d")).groupBy("d.type", "d.score").agg(F.count_if("d.hit").alias("tp"), F.count("*").alias("n"))
    truths = pages.select(F.explode("gt").alias("g")).groupBy("g.type").agg(F.count("*").alias("truths"))
    down = Window.partitionBy("type").orderBy(F.desc("score"))
    curve = n.join(truths, "type").withColumns({"t": F.sum("tp").over(down), "all": F.sum("n").over(down)})
    curve = curve.withColumns({"recall": F.col("t") / F.col("truths"), "precision": F.col("t") / F.col("all")})
    envelope = F.max("precision").over(Window.partitionBy("type").orderBy("score"))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0))
    area = curve.withColumns({"envelope": envelope, "step": step}).groupBy("type").agg(F.sum(F.col("envelope") * F.col("step")).alias("ap"))
    return truths.join(area, "type", "left").select("type", "truths", F.coalesce("ap", F.lit(0.0)).alias("ap"))
