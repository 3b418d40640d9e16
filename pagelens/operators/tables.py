"""The tables of an evaluation of many runs, and the short ones made from them to print.

Everything comes from the records of the matches, which are written once.  ``pages``
hold ``run_id, image, source, gt, pred`` for what was sent; truths of pages a run sent
nothing for only add to the truths counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import editdist, text
from ..schema import STRUCTURED_TYPES, TEXT_TYPES
from ..session import materialize
from . import frames, metrics, runs

KEYS = ["run_id", "image", "source"]


def counted_over(breakdown: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """A breakdown of runs whose truths are those of all solution pages: ``totals`` is ``(by, truths)``."""
    rows = breakdown.join(totals, by, "left").withColumn("gt_count", F.coalesce("truths", F.lit(0))).drop("truths")
    return rows.withColumn("det_f1", 2 * F.col("matched") / F.greatest(F.col("gt_count") + F.col("pred_count"), F.lit(1)))


def records(solution: DataFrame, sent: DataFrame, dialect: str = "v1") -> DataFrame:
    """Records of all runs, written once; ``solution`` and ``sent`` as in :func:`runs.evaluate`."""
    return materialize(metrics.records(solution.join(sent, "image"), KEYS, dialect))


def per_type(rows: DataFrame, solution: DataFrame) -> DataFrame:
    totals = solution.select(F.explode("gt.type").alias("type")).groupBy("type").agg(F.count("*").alias("truths"))
    return counted_over(metrics.by_type(rows, ["run_id"]), ["type"], totals)


def per_source(rows: DataFrame, solution: DataFrame) -> DataFrame:
    totals = solution.groupBy("source").agg(F.sum(F.size("gt")).alias("truths"))
    return counted_over(metrics.by_column(rows, ["run_id", "source"]), ["source"], totals)


def structured_details(rows: DataFrame) -> DataFrame:
    """A row a scored formula or table, with the reason why its answer is invalid."""
    r = rows.where(F.col("scored") & F.col("gt_type").isin(*STRUCTURED_TYPES))
    reason = text.invalid_reason(F.col("pred_text"), F.col("gt_type"), F.col("gt_text"))
    r = r.select(*KEYS, "gt_idx", F.col("gt_type").alias("type"), "gt_text", "pred_text", "cer", reason.alias("invalid_reason"))
    return r.withColumn("invalid", F.col("invalid_reason") != "")


def text_details(rows: DataFrame) -> DataFrame:
    """A row a scored text region with its error rates."""
    r = rows.where(F.col("scored") & F.col("gt_type").isin(*TEXT_TYPES))
    wer = editdist.wer(F.col("pred_norm"), F.col("gt_norm"))
    return r.select(*KEYS, "gt_idx", F.col("gt_type").alias("type"), "gt_text", "pred_text", "cer", wer.alias("wer"), "exact")


def text_summary(details: DataFrame, by: list[str]) -> DataFrame:
    """N, mean error rates and exact share of text regions, error rates of each text type beside them."""
    of = lambda t: F.avg(F.when(F.col("type") == t, F.col("cer"))).alias(f"{t}_cer")
    return details.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("cer").alias("overall_cer"), *(of(t) for t in TEXT_TYPES), F.avg("wer").alias("overall_wer"), F.avg(F.col("exact").cast("int")).alias("exact_match"),
    )


def printed(df: DataFrame, keep: list[str], numbers: list[str]) -> DataFrame:
    """Columns as they are printed: numbers with four digits, missing ones empty."""
    return df.select(*keep, *(text.four_digits(F.col(c)).alias(c) for c in numbers))


def ordered(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows in the order of given labels, others after them by name."""
    at = F.array_position(F.array(*map(F.lit, labels or [""])), F.col("label"))
    return df.orderBy(F.when(at > 0, at).otherwise(999), "label")


def filled(df: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """A row for each type, N 0 where there is none."""
    every = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(types)], "place int, type string")
    return every.join(df, "type", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("place").drop("place")


def module(df: DataFrame, component: str, group: Column, metrics_: dict[str, str]) -> DataFrame:
    """Rows ``component, group, metric, n, value`` of the module table."""
    entry = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), text.four_digits(F.col(c)).alias("value")) for name, c in metrics_.items()))).alias("m")
    return df.select(F.lit(component).alias("component"), group.alias("group"), entry, "n").select("component", "group", "m.metric", "n", "m.value")


def evaluation(
    solution: DataFrame, sent: DataFrame, known: DataFrame, errors: DataFrame, groups: dict[str, str], final: str,
    order: list[str] = [], dialect: str = "v1", worst: int = 50,  # noqa: B006
) -> dict[str, DataFrame]:
    """All tables by name, for :func:`writers.tables`.

    ``known`` names the runs (``run_id, run_group, label``), ``groups`` the run group of
    each printed table, ``final`` the run of the module tables (the first one by name if
    it is not there).  Breakdowns and details come from one set of records.
    """
    rows = records(solution, sent, dialect)
    scores = runs.evaluate(solution, sent, dialect)
    structured, texts = structured_details(rows), text_details(rows)
    of_type = lambda t: F.avg(F.when(F.col("type") == t, F.col("cer"))).alias(f"{t}_cer")
    answers = structured.groupBy("run_id").agg(
        *(of_type(t) for t in STRUCTURED_TYPES), (1 - F.avg(F.col("invalid").cast("int"))).alias("struct_acc"), F.avg(F.col("invalid").cast("int")).alias("invalid_rate"), F.count("*").alias("structured_count"),
    )
    named = scores.join(answers, "run_id", "left").join(known.select("run_id", "run_group", "label"), "run_id", "left").withColumns(
        {"run_group": F.coalesce("run_group", F.lit("unknown")), "label": F.coalesce("label", "run_id"), "structured_count": F.coalesce("structured_count", F.lit(0))}
    )
    named = materialize(named)
    of_group = lambda name: ordered(named.where(F.col("run_group") == groups[name]), order)
    summary = materialize(text_summary(texts, ["run_id"]))
    by_type = text_summary(texts, ["run_id", "type"]).select("run_id", "type", "n", F.col("overall_cer").alias("cer"), F.col("overall_wer").alias("wer"), "exact_match")
    labelled = summary.join(known.select("run_id", "label"), "run_id", "left").withColumn("label", F.coalesce("label", "run_id"))
    chosen = frames.run_or_first(by_type, final)
    kinds = filled(chosen.drop("run_id"), TEXT_TYPES)
    formulas = filled(frames.run_or_first(structured, final).groupBy("type").agg(F.count("*").alias("n"), F.avg("cer").alias("cer")), STRUCTURED_TYPES)
    whole = frames.run_or_first(summary, final)
    score = ["score", "det_f1", "class_acc", "region_cer", "page_cer"]
    out = {
        "all_submission_metrics": named, "per_type_metrics": per_type(rows, solution), "per_source_metrics": per_source(rows, solution),
        "structured_details": structured, "evaluation_errors": errors,
        "text_metrics": labelled, "text_per_type": by_type, "text_per_source": text_summary(texts, ["run_id", "source"]), "text_details": texts,
        "text_worst": texts.orderBy(F.desc("cer"), *KEYS, "gt_idx").limit(worst),
        "invalid_examples": structured.where("invalid").orderBy(*KEYS, "gt_idx").limit(worst),
        "paper_text": ordered(printed(labelled, ["label", "n"], ["overall_cer", *(f"{t}_cer" for t in TEXT_TYPES), "overall_wer", "exact_match"]), order),
        "paper_text_per_type": printed(kinds, ["type", "n"], ["cer", "wer", "exact_match"]),
        "paper_modules": module(whole, "text", F.lit("overall"), {"CER": "overall_cer", "WER": "overall_wer", "Exact Match": "exact_match"})
        .unionByName(module(kinds, "text", F.col("type"), {"CER": "cer"})).unionByName(module(formulas, "structured", F.col("type"), {"CER": "cer"})),
    }
    for name in groups:
        numbers = score if "structured" not in name else ["score", *(f"{t}_cer" for t in STRUCTURED_TYPES), "struct_acc", "invalid_rate"]
        out[f"paper_{name}"] = printed(of_group(name), ["label", "structured_count"] if "structured" in name else ["label"], numbers)
    return out
