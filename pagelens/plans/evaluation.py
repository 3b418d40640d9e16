"""Queries of matching and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editdist, text
from ..operators import layout, match, metrics
from . import compare, fixture

KEYS = ["page", "source"]


def _records(spark: SparkSession, d: str, dialect: str = "v1") -> DataFrame:
    return metrics.records(fixture.pages(spark, d), KEYS, dialect)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def j3_matches(spark, d):
    m = metrics.matched(fixture.pages(spark, d)).select("page", F.inline("m"))
    return _rounded(m.select("page", F.col("g").alias("gt_idx"), F.col("p").alias("pred_idx"), (-F.col("order")).alias("iou")))


def j3_mutual_best(spark, d):
    """The same matches from flat pairs, by rounds."""
    p = fixture.pages(spark, d).select("page", F.inline(match.pairs(F.col("gt"), F.col("pred"))))
    m = match.mutual_best(p.select("page", "g", "p", (-F.col("order")).alias("iou")), ["page"])
    return _rounded(m.select("page", F.col("g").alias("gt_idx"), F.col("p").alias("pred_idx"), "iou"))


def j4_records(spark, d):
    r = _records(spark, d)
    return _rounded(r.select("page", "gt_idx", "pred_idx", "status", "gt_type", "pred_type", "cer"))


def _score(dialect, by):
    def query(spark, d):
        f = metrics.per_page(fixture.pages(spark, d), KEYS, dialect)
        return _rounded(metrics.summary(f, by))

    return query


def a2_by_source(spark, d):
    return _score("v1", ["source"])(spark, d)


def a3_macro(spark, d):
    return _rounded(metrics.macro(_records(spark, d), ["gt_type"]))


def a4_micro(spark, d):
    return _rounded(metrics.micro(_records(spark, d), ["source"]))


def a5_types(spark, d):
    return _rounded(metrics.by_type(_records(spark, d), ["source"]))


def a6_sources(spark, d):
    return _rounded(metrics.by_column(_records(spark, d), ["source"]))


def a7_structured(spark, d):
    return _rounded(metrics.structured(_records(spark, d), ["source"]))


def a8_text_branch(spark, d):
    return _rounded(metrics.text_branch(_records(spark, d)))


def a9_pages(spark, d):
    p = metrics.page_stats(_records(spark, d), KEYS)
    return _rounded(p.select(*KEYS, "matched", "missed", "false_positive", "det_f1", "class_acc", "type_confusions", "mean_cer", F.array_join("gt_types", ",").alias("gt_types")))


def a16_confusion(spark, d):
    return metrics.confusion(_records(spark, d), ["source"])


def a17_page_text(spark, d):
    p = fixture.pages(spark, d)
    own = lambda r: r["text"]
    keep = lambda r: text.scorable(r["type"], r["language"], r["legibility"])
    return p.select("page", layout.page_text(F.col("gt"), own, keep).alias("text"))


def g14_order(spark, d):
    """Both reading orders of the predictions of a page."""
    p = fixture.pages(spark, d).where("pred IS NOT NULL")
    ids = lambda dialect: F.array_join(F.transform(layout.in_order(F.col("pred"), dialect), lambda r: r["idx"].cast("string")), ",")
    return p.select("page", ids("v1").alias("v1"), ids("v2").alias("v2"))


def g12_lines(spark, d):
    return layout.lines(fixture.pred(spark, d))


def v2_regions(spark, d):
    """Detail of the text branch: error rates of every scored text region."""
    r = _records(spark, d).where("scored AND gt_type IN ('handwritten', 'printed', 'annotation')")
    return _rounded(r.select("page", "source", F.col("gt_type").alias("type"), "gt_idx", "cer", editdist.wer(F.col("pred_norm"), F.col("gt_norm")).alias("wer"), "exact"))


QUERIES = {
    "j3_matches": j3_matches, "j3_mutual_best": j3_mutual_best, "j4_records": j4_records,
    "a1_score": _score("v1", []), "a2_by_source": a2_by_source, "a2_second_dialect": _score("v2", ["source"]),
    "a3_macro": a3_macro, "a4_micro": a4_micro, "a5_types": a5_types, "a6_sources": a6_sources, "a7_structured": a7_structured,
    "a8_text_branch": a8_text_branch, "a9_pages": a9_pages, "a16_confusion": a16_confusion, "a17_page_text": a17_page_text,
    "g12_lines": g12_lines, "g14_order": g14_order, "v2_regions": v2_regions,
}

R, M = fixture.WITH_RECORDS, fixture.WITH_MATCHES


def _summary(by: str, pages: str = "page_cers", head: str = R) -> str:
    group = f"GROUP BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""{head},
sums AS (SELECT {cols} count(*) FILTER (status = 'matched') AS tp, count(*) FILTER (status = 'false positive') AS fp, count(*) FILTER (status = 'missed') AS fn,
  count(*) FILTER (gt_type = pred_type) AS hits, coalesce(avg(cer), 1e0) AS region_cer FROM scores {group}),
read AS (SELECT {cols} coalesce(avg(page_cer), 1e0) AS page_cer FROM pages LEFT JOIN {pages} USING (page) {group}),
parts AS (SELECT *, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS det_precision, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS det_recall,
  hits / CAST(greatest(tp, 1) AS DOUBLE) AS class_acc FROM sums {'JOIN read USING (' + by + ')' if by else ', read'}),
done AS (SELECT *, 2e0 * det_precision * det_recall / greatest(det_precision + det_recall, 1e-9) AS det_f1 FROM parts)
SELECT {cols} round(0.15e0 * det_f1 + 0.05e0 * class_acc + 0.3e0 * greatest(0e0, 1e0 - region_cer) + 0.5e0 * greatest(0e0, 1e0 - page_cer), 6) AS score,
  round(det_f1, 6) AS det_f1, round(det_precision, 6) AS det_precision, round(det_recall, 6) AS det_recall, round(class_acc, 6) AS class_acc,
  round(region_cer, 6) AS region_cer, round(page_cer, 6) AS page_cer, tp AS matched_regions, fp AS false_positives, fn AS false_negatives FROM done"""


_SECOND = R + """,
idle AS (SELECT m.page, m.p FROM matches m JOIN gt g ON g.page = m.page AND g.idx = m.g
  WHERE g.type IN ('image', 'graph') OR g.language = 'other' OR g.legibility = 'illegible'),
gt_second AS (SELECT page, string_agg(text, chr(10) ORDER BY floor((y1 + y2) / 2 / 15), (x1 + x2) / 2, idx) AS t FROM gt
  WHERE type NOT IN ('image', 'graph') AND language <> 'other' AND legibility <> 'illegible' AND text <> '' GROUP BY page),
pred_second AS (SELECT p.page, string_agg(text, chr(10) ORDER BY floor((y1 + y2) / 2 / 15), (x1 + x2) / 2, idx) AS t FROM pred p
  LEFT JOIN idle i ON i.page = p.page AND i.p = p.idx WHERE i.p IS NULL AND type NOT IN ('image', 'graph') AND text <> '' GROUP BY p.page),
second AS (SELECT g.page, levenshtein(coalesce(p.t, ''), g.t) / CAST(length(g.t) AS DOUBLE) AS page_cer FROM gt_second g LEFT JOIN pred_second p USING (page))"""
_BY = """count(gt_type) AS gt_count, count(pred_type) AS pred_count, count(*) FILTER (status = 'matched') AS matched"""
_F1 = "round(2e0 * {m} / greatest({g} + {p}, 1), 6) AS det_f1"

SQL = {
    "j3_matches": M + "SELECT page, g AS gt_idx, p AS pred_idx, round(iou, 6) AS iou FROM matches",
    "j3_mutual_best": M + "SELECT page, g AS gt_idx, p AS pred_idx, round(iou, 6) AS iou FROM matches",
    "j4_records": R + "SELECT page, gt_idx, pred_idx, status, gt_type, pred_type, round(cer, 6) AS cer FROM scores",
    "a1_score": _summary(""),
    "a2_by_source": _summary("source"),
    "a2_second_dialect": _summary("source", "second", _SECOND),
    "a5_types": R + f""", kinds AS (SELECT unnest(['handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph']) AS type),
groups AS (SELECT DISTINCT source FROM scores),
t AS (SELECT source, gt_type AS type, count(*) AS g, count(*) FILTER (status = 'matched') AS m, count(*) FILTER (gt_type = pred_type) AS h, avg(cer) AS cer
  FROM scores WHERE gt_type IS NOT NULL GROUP BY ALL),
p AS (SELECT source, pred_type AS type, count(*) AS p FROM scores WHERE pred_type IS NOT NULL GROUP BY ALL)
SELECT s.source, k.type, coalesce(g, 0) AS gt_count, coalesce(p, 0) AS pred_count, coalesce(m, 0) AS matched,
  round(2e0 * coalesce(m, 0) / greatest(coalesce(g, 0) + coalesce(p, 0), 1), 6) AS det_f1,
  CASE WHEN m > 0 THEN round(h / CAST(m AS DOUBLE), 6) END AS class_acc, round(cer, 6) AS cer
FROM groups s JOIN kinds k ON true LEFT JOIN t ON t.source = s.source AND t.type = k.type LEFT JOIN p ON p.source = s.source AND p.type = k.type""",
    "a6_sources": R + f"SELECT source, {_BY}, " + _F1.format(m="count(*) FILTER (status = 'matched')", g="count(gt_type)", p="count(pred_type)")
    + ", round(count(*) FILTER (gt_type = pred_type) / CAST(count(*) FILTER (status = 'matched') AS DOUBLE), 6) AS class_acc, round(avg(cer), 6) AS cer FROM scores GROUP BY source",
    "a7_structured": R + """SELECT source, count(*) AS n, round(avg(cer) FILTER (gt_type = 'formula'), 6) AS formula_cer, round(avg(cer) FILTER (gt_type = 'table'), 6) AS table_cer,
  round(1 - avg(CASE WHEN trim(pred_text) = '' THEN 1e0 ELSE 0e0 END), 6) AS struct_acc, round(avg(CASE WHEN trim(pred_text) = '' THEN 1e0 ELSE 0e0 END), 6) AS invalid_rate
  FROM scores WHERE scored AND gt_type IN ('formula', 'table') GROUP BY source""",
    "a9_pages": R + """SELECT page, source, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missed') AS missed,
  count(*) FILTER (status = 'false positive') AS false_positive,
  round(2e0 * count(*) FILTER (status = 'matched') / greatest(2 * count(*) FILTER (status = 'matched') + count(*) FILTER (status <> 'matched'), 1), 6) AS det_f1,
  round(count(*) FILTER (gt_type = pred_type) / CAST(greatest(count(*) FILTER (status = 'matched'), 1) AS DOUBLE), 6) AS class_acc,
  count(*) FILTER (status = 'matched') - count(*) FILTER (gt_type = pred_type) AS type_confusions, round(avg(cer), 6) AS mean_cer,
  string_agg(DISTINCT gt_type, ',' ORDER BY gt_type) AS gt_types FROM scores GROUP BY page, source""",
    "a16_confusion": R + "SELECT source, gt_type, pred_type, count(*) AS n FROM records WHERE status = 'matched' GROUP BY ALL",
    "a17_page_text": R + "SELECT p.page, coalesce(t, '') AS text FROM pages p LEFT JOIN gt_pages USING (page)",
    "g14_order": fixture.WITH_PRED + """SELECT page, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY y1, x1, idx) AS v1,
  string_agg(CAST(idx AS VARCHAR), ',' ORDER BY floor((y1 + y2) / 2 / 15), (x1 + x2) / 2, idx) AS v2 FROM pred GROUP BY page""",
    "g12_lines": fixture.WITH_PRED + """, r AS (SELECT page, idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 - y1 AS h FROM pred WHERE type IN ('handwritten', 'printed', 'annotation', 'formula')),
n AS (SELECT *, CASE WHEN abs(cy - lag(cy) OVER w) >= 0.5e0 * greatest(lag(h) OVER w, h) THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY page ORDER BY cy, idx)),
l AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY cy, idx) AS INT) AS line FROM n)
SELECT page, idx, line, CAST(row_number() OVER w - 1 AS INT) AS place, lead(idx) OVER w AS next_idx FROM l WINDOW w AS (PARTITION BY page ORDER BY line, cx, cy, idx)""",
    "a3_macro": R + f""", w AS (SELECT *, CASE WHEN scored THEN {compare.wer('pred_text', 'gt_text')} END AS wer FROM scores WHERE scored AND gt_type IN ('handwritten', 'printed', 'annotation'))
SELECT gt_type, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer, round(avg(CASE WHEN pred_text = gt_text THEN 1e0 ELSE 0e0 END), 6) AS exact FROM w GROUP BY gt_type""",
    "a4_micro": R + f""", w AS (SELECT *, levenshtein(pred_text, gt_text) AS c, {compare.words('pred_text', 'gt_text')} AS d, len({compare.words_of('gt_text')}) AS m FROM scores WHERE scored AND gt_type IN ('handwritten', 'printed', 'annotation'))
SELECT source, count(*) AS n, round(sum(c) / CAST(sum(length(gt_text)) AS DOUBLE), 6) AS cer, round(sum(d) / CAST(sum(m) AS DOUBLE), 6) AS wer, round(avg(CASE WHEN pred_text = gt_text THEN 1e0 ELSE 0e0 END), 6) AS exact FROM w GROUP BY source""",
    "a8_text_branch": R + f""", w AS (SELECT *, {compare.wer('pred_text', 'gt_text')} AS wer FROM scores WHERE scored AND gt_type IN ('handwritten', 'printed', 'annotation'))
SELECT coalesce(gt_type, 'all') AS type, coalesce(source, 'all') AS source, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer, round(avg(CASE WHEN pred_text = gt_text THEN 1e0 ELSE 0e0 END), 6) AS exact
FROM w GROUP BY GROUPING SETS ((), (gt_type), (source))""",
    "v2_regions": R + f"""SELECT page, source, gt_type AS type, gt_idx, round(cer, 6) AS cer, round({compare.wer('pred_text', 'gt_text')}, 6) AS wer, pred_text = gt_text AS exact
FROM scores WHERE scored AND gt_type IN ('handwritten', 'printed', 'annotation')""",
}
