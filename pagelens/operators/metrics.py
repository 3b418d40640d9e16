"""Scores of predicted pages: detection, classes, error rates, composite and breakdowns.

Input is one row per page and run with the arrays ``gt`` and ``pred`` (boxes with
``type`` and ``text``; truths also ``language`` and ``legibility``).  A page's own
figures are expressions of that row; what follows are sums over pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import editdist, text
from ..schema import REGION_TYPES, STRUCTURED_TYPES, TEXT_TYPES, VISUAL_TYPES
from . import layout, match

WEIGHTS = {"det_f1": 0.15, "class_acc": 0.05, "region_cer": 0.30, "page_cer": 0.50}


def _scorable_gt(r: Column) -> Column:
    return text.scorable(r["type"], r["language"], r["legibility"])


def _scorable_pred(r: Column) -> Column:
    return ~F.coalesce(r["type"].isin(*VISUAL_TYPES), F.lit(False))


def matched(pages: DataFrame, threshold: float = match.THRESHOLD) -> DataFrame:
    """Pages with ``m``, their greedy matches."""
    return pages.withColumn("m", match.matches(F.col("gt"), F.col("pred"), threshold))


def records(pages: DataFrame, keys: list[str], dialect: str = "v1") -> DataFrame:
    """A row per match, missed truth and false positive, with normalized texts and error rates.

    ``cer``, ``wer`` and ``exact`` are null unless a scorable truth is matched.  Both
    texts are normalized by the type of the truth.
    """
    rows = matched(pages).select(*keys, F.explode(match.records(F.col("gt"), F.col("pred"), F.col("m"))).alias("r")).select(
        *keys, "r.gt", "r.pred", "r.iou"
    )
    scored = F.col("gt").isNotNull() & F.col("pred").isNotNull() & _scorable_gt(F.col("gt"))
    norm = lambda side: F.when(scored, text.normalize(F.col(f"{side}.text"), F.col("gt.type"), dialect))
    rows = rows.withColumns({"scored": scored, "gt_norm": norm("gt"), "pred_norm": norm("pred")})
    a, b = F.col("pred_norm"), F.col("gt_norm")
    return rows.select(
        *keys,
        F.when(F.col("pred").isNull(), "missed").when(F.col("gt").isNull(), "false positive").otherwise("matched").alias("status"),
        F.col("gt.idx").alias("gt_idx"), F.col("pred.idx").alias("pred_idx"), "iou",
        F.col("gt.type").alias("gt_type"), F.col("pred.type").alias("pred_type"),
        F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{v}").alias(v) for v in ("x1", "y1", "x2", "y2")))) for c in ("gt", "pred"))).alias("crop"),
        F.col("gt.text").alias("gt_text"), F.col("pred.text").alias("pred_text"), "gt_norm", "pred_norm", "scored",
        editdist.chars(a, b).alias("distance"), F.char_length(b).alias("gt_length"),
        editdist.cer(a, b).alias("cer"), (a == b).alias("exact"),
    )


def per_page(pages: DataFrame, keys: list[str], dialect: str = "v1") -> DataFrame:
    """Figures of each page: tp, fp, fn, class hits, region error sum and count, page error."""
    gt, pred, m = F.col("gt"), F.col("pred"), F.col("m")
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    get = lambda side, i: F.get(side, i)
    hits = F.filter(m, lambda x: get(gt, x["g"])["type"] == get(pred, x["p"])["type"])
    scored = F.filter(m, lambda x: _scorable_gt(get(gt, x["g"])))

    def error(x: Column) -> Column:
        g, p = get(gt, x["g"]), get(pred, x["p"])
        both = F.struct(text.normalize(p["text"], g["type"], dialect).alias("p"), text.normalize(g["text"], g["type"], dialect).alias("g"))
        unlike = text.bound(both, lambda t: editdist.cer(t["p"], t["g"]))
        return F.when(p["text"] == g["text"], 0.0).otherwise(unlike)  # equal texts are equal when normalized

    own = lambda r: text.normalize(r["text"], r["type"], dialect)
    if dialect == "v1":
        read = pred
    else:  # predictions on truths that do not count are left out of the page
        idle = F.transform(F.filter(m, lambda x: ~_scorable_gt(get(gt, x["g"]))), lambda x: x["p"])
        read = F.transform(
            F.filter(F.transform(pred, lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda x: ~F.array_contains(idle, x["i"])), lambda x: x["r"]
        )
    rows = matched(pages).select(
        *keys,
        n(m).cast("bigint").alias("tp"),
        (n(pred) - n(m)).cast("bigint").alias("fp"),
        (n(gt) - n(m)).cast("bigint").alias("fn"),
        n(hits).cast("bigint").alias("hits"),
        n(scored).cast("bigint").alias("cer_count"),
        F.aggregate(F.transform(scored, error), F.lit(0.0), lambda acc, x: acc + x).alias("cer_sum"),
        layout.page_lines(gt, own, _scorable_gt, dialect).alias("gt_lines"),
        layout.page_lines(read, own, _scorable_pred, dialect).alias("pred_lines"),
    )
    length = F.char_length(F.array_join("gt_lines", "\n"))
    error = editdist.lines(F.col("pred_lines"), F.col("gt_lines")) / length
    return rows.withColumn("page_cer", F.when(F.size("gt_lines") > 0, error)).drop("gt_lines", "pred_lines")


def summary(figures: DataFrame, by: list[str]) -> DataFrame:
    """Composite score and its parts over pages, by the given columns.

    Detection and classes are counted over all pages, error rates are means; without a
    scorable match or a page with text they are 1.
    """
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = figures.groupBy(*by).agg(
        s("tp").alias("tp"), s("fp").alias("fp"), s("fn").alias("fn"), s("hits").alias("hits"),
        s("cer_sum").alias("cer_sum"), s("cer_count").alias("cer_count"), F.coalesce(F.avg("page_cer"), F.lit(1.0)).alias("page_cer"),
    )
    ratio = lambda a, b: F.col(a) / F.greatest(b, F.lit(1))
    parts = sums.withColumns(
        {
            "det_precision": ratio("tp", F.col("tp") + F.col("fp")),
            "det_recall": ratio("tp", F.col("tp") + F.col("fn")),
            "class_acc": ratio("hits", F.col("tp")),
            "region_cer": F.when(F.col("cer_count") > 0, F.col("cer_sum") / F.greatest(F.col("cer_count"), F.lit(1))).otherwise(1.0),
        }
    )
    p, r = F.col("det_precision"), F.col("det_recall")
    parts = parts.withColumn("det_f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))
    good = lambda c: F.greatest(F.lit(0.0), 1 - F.col(c))
    w = WEIGHTS
    score = w["det_f1"] * F.col("det_f1") + w["class_acc"] * F.col("class_acc") + w["region_cer"] * good("region_cer") + w["page_cer"] * good("page_cer")
    return parts.select(
        *by, score.alias("score"), "det_f1", "det_precision", "det_recall", "class_acc", "region_cer", "page_cer",
        F.col("tp").alias("matched_regions"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"),
    )


def _breakdown(events: DataFrame, by: list[str]) -> DataFrame:
    agg = events.groupBy(*by).agg(
        F.count_if("is_gt").alias("gt_count"), F.count_if("is_pred").alias("pred_count"), F.count_if("is_match").alias("matched"),
        F.count_if("is_hit").alias("hits"), F.avg("cer").alias("cer"),
    )
    f1 = 2 * F.col("matched") / F.greatest(F.col("gt_count") + F.col("pred_count"), F.lit(1))
    return agg.select(*by, "gt_count", "pred_count", "matched", f1.alias("det_f1"), F.when(F.col("matched") > 0, F.col("hits") / F.col("matched")).alias("class_acc"), "cer")


def by_type(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Breakdown of records by type; false positives count with the type predicted.

    All seven types have a row for every group there is; rates of an empty one are null.
    """
    t = F.explode(
        F.filter(
            F.array(
                F.struct(F.col("gt_type").alias("type"), F.lit(True).alias("is_gt"), F.lit(False).alias("is_pred"), (F.col("status") == "matched").alias("is_match"),
                         (F.col("gt_type") == F.col("pred_type")).alias("is_hit"), F.col("cer").alias("cer")),
                F.struct(F.col("pred_type").alias("type"), F.lit(False).alias("is_gt"), F.lit(True).alias("is_pred"), F.lit(False).alias("is_match"),
                         F.lit(False).alias("is_hit"), F.lit(None).cast("double").alias("cer")),
            ), lambda x: x["type"].isNotNull(),
        )
    ).alias("e")
    counts = _breakdown(rows.select(*by, t).select(*by, "e.*"), [*by, "type"])
    figures = ["gt_count", "pred_count", "matched", "det_f1", "class_acc", "cer"]
    entries = F.map_from_entries(F.collect_list(F.struct("type", F.struct(*figures))))  # a type an entry
    grouped = counts.groupBy(*by).agg(entries.alias("m")).select(*by, "m", F.explode(F.array(*map(F.lit, REGION_TYPES))).alias("type"))
    got = grouped.select(*by, "type", F.try_element_at("m", F.col("type")).alias("f")).select(*by, "type", *(F.col(f"f.{c}").alias(c) for c in figures))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("gt_count", "pred_count", "matched")} | {"det_f1": F.coalesce("det_f1", F.lit(0.0))}
    return got.withColumns(zero)


def by_column(rows: DataFrame, by: list[str]) -> DataFrame:
    """Breakdown by observed values of other columns, e.g. the source."""
    flags = {
        "is_gt": F.col("gt_type").isNotNull(), "is_pred": F.col("pred_type").isNotNull(), "is_match": F.col("status") == "matched",
        "is_hit": F.coalesce(F.col("gt_type") == F.col("pred_type"), F.lit(False)),
    }
    return _breakdown(rows.withColumns(flags), by)


def macro(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means over scored text regions: error rates in characters and words, exact share."""
    r = rows.where(F.col("scored") & F.col("gt_type").isin(*TEXT_TYPES))
    wer = editdist.wer(F.col("pred_norm"), F.col("gt_norm"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg(wer).alias("wer"), F.avg(F.col("exact").cast("int")).alias("exact"))


def micro(rows: DataFrame, by: list[str]) -> DataFrame:
    """Error rates of all scored text together: distances over lengths; null without text."""
    r = rows.where(F.col("scored") & F.col("gt_type").isin(*TEXT_TYPES))
    a, b = F.col("pred_norm"), F.col("gt_norm")
    share = lambda x, y: F.when(F.sum(y) > 0, F.sum(x) / F.sum(y))
    return r.groupBy(*by).agg(
        F.count("*").alias("n"), share(F.col("distance"), F.col("gt_length")).alias("cer"),
        share(editdist.words(a, b), F.size(editdist.words_of(b))).alias("wer"), F.coalesce(F.avg(F.col("exact").cast("int")), F.lit(0.0)).alias("exact"),
    )


def structured(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Formulas and tables: mean error rates, shares of valid and invalid answers."""
    r = rows.where(F.col("scored") & F.col("gt_type").isin(*STRUCTURED_TYPES))
    bad = text.invalid_reason(F.col("pred_text"), F.col("gt_type"), F.col("gt_text")) != ""
    of = lambda t: F.avg(F.when(F.col("gt_type") == t, F.col("cer")))
    return r.groupBy(*by).agg(
        F.count("*").alias("n"), of("formula").alias("formula_cer"), of("table").alias("table_cer"),
        (1 - F.avg(bad.cast("int"))).alias("struct_acc"), F.avg(bad.cast("int")).alias("invalid_rate"),
    )


def text_branch(rows: DataFrame) -> DataFrame:
    """Text regions overall, by type and by source, in one pass over grouping sets."""
    r = rows.where(F.col("scored") & F.col("gt_type").isin(*TEXT_TYPES)).withColumn("w", editdist.wer(F.col("pred_norm"), F.col("gt_norm")))
    g = r.groupingSets([[], ["gt_type"], ["source"]], "gt_type", "source").agg(
        F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg("w").alias("wer"), F.avg(F.col("exact").cast("int")).alias("exact"),
    )
    return g.select(F.coalesce("gt_type", F.lit("all")).alias("type"), F.coalesce("source", F.lit("all")).alias("source"), "n", "cer", "wer", "exact")


def page_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: matches, misses, extras, F1, class accuracy, mean error rate, types there are."""
    g = rows.groupBy(*keys).agg(
        F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "missed").alias("missed"),
        F.count_if(F.col("status") == "false positive").alias("false_positive"), F.count_if(F.col("gt_type") == F.col("pred_type")).alias("hits"),
        F.avg("cer").alias("mean_cer"), F.array_sort(F.collect_set("gt_type")).alias("gt_types"),
    )
    tp2 = 2 * F.col("matched")
    return g.withColumns(
        {
            "det_f1": tp2 / F.greatest(tp2 + F.col("missed") + F.col("false_positive"), F.lit(1)),
            "class_acc": F.col("hits") / F.greatest(F.col("matched"), F.lit(1)),
            "type_confusions": F.col("matched") - F.col("hits"),
        }
    )


def confusion(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Matches by pair of types."""
    return rows.where("status = 'matched'").groupBy(*by, "gt_type", "pred_type").agg(F.count("*").alias("n"))
