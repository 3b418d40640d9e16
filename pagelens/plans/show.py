"""Queries that choose examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics
from ..operators import selection as X
from . import fixture
from .evaluation import KEYS, _records, _rounded


def _stats(spark, d):
    s = metrics.page_stats(_records(spark, d), KEYS).withColumn("predictions", F.col("matched") + F.col("false_positive"))
    return s.withColumns({"score": F.round(X.page_score(F.col("predictions")), 6), "error": F.round(X.error_score(), 6)})


def x1_scores(spark, d):
    return _stats(spark, d).select("page", "score", "error", X.observation().alias("note"))


def x3_status(spark, d):
    r = _records(spark, d)
    return r.groupBy("gt_type", X.status(F.col("scored")).alias("plain"), X.status(F.col("scored"), True).alias("extended")).agg(F.count("*").alias("n"))


def x4_quality(spark, d):
    r = _records(spark, d)
    return _rounded(r.select("page", "gt_idx", "pred_idx", X.crop_quality(F.lit(1000), F.lit(400)).alias("quality")))


def x5_pages(spark, d):
    return X.full_pages(_stats(spark, d))


def x6_page(spark, d):
    """One page with at least three types and predictions."""
    return _stats(spark, d).where("size(gt_types) >= 3 AND predictions >= 3").orderBy(F.desc("score"), "page").limit(1).select("page", "score")


def x7_crops(spark, d):
    r = _records(spark, d)
    scorable = text.scorable(F.col("gt_type"), F.lit(None), F.lit(None)) & F.col("gt_type").isNotNull()
    r = r.withColumns({"shown": X.status(F.col("scored")), "scorable": scorable})
    return X.crop_examples(r, X.crop_quality(F.lit(1000), F.lit(400)))


def x7_warnings(spark, d):
    """Buckets for which there was nothing to show."""
    wanted = X.buckets(X.crop_quality(F.lit(1000), F.lit(400)))
    return X.missing_buckets(x7_crops(spark, d), wanted)


def x10_metadata(spark, d):
    """What the report of the choice says, as one text a part."""
    r = _records(spark, d).withColumn("shown", X.status(F.col("scored")))
    m = X.metadata(x5_pages(spark, d), _stats(spark, d), x7_crops(spark, d), r, x7_warnings(spark, d))
    return m.select(*(F.to_json(c).alias(c) for c in m.columns))


def o2_worst(spark, d):
    r = _records(spark, d).where("cer IS NOT NULL").select("page", "gt_idx", F.round("cer", 6).alias("cer"))
    return r.orderBy(F.desc("cer"), "page", "gt_idx").limit(50)


QUERIES = {f.__name__: f for f in (x1_scores, x3_status, x4_quality, x5_pages, x6_page, x7_crops, x7_warnings, x10_metadata, o2_worst)}

_STATS = fixture.WITH_RECORDS + """,
ps AS (SELECT page, source, count(*) FILTER (status = 'matched') AS m, count(*) FILTER (status = 'missed') AS fn, count(*) FILTER (status = 'false positive') AS fp,
  count(*) FILTER (gt_type = pred_type) AS h, count(DISTINCT gt_type) AS kinds, bool_or(coalesce(gt_type, '') IN ('formula', 'table', 'image', 'graph')) AS several FROM scores GROUP BY page, source),
pq AS (SELECT *, m + fp AS predictions, m - h AS mix, 2e0 * m / greatest(2 * m + fn + fp, 1) AS f1, h / CAST(greatest(m, 1) AS DOUBLE) AS acc FROM ps),
pz AS (SELECT *, round(f1 * 10 + acc * 6 + kinds * 1.5e0 + CAST(several AS INT) * 2 + CASE WHEN predictions BETWEEN 5 AND 38 THEN 1 ELSE 0 END + 2, 6) AS score,
  round(mix * 8e0 + fn * 1.5e0 + fp * 1.2e0 + (1 - acc) * 6 + (1 - f1) * 5, 6) AS error FROM pq)"""
SQL = {
    "x1_scores": _STATS + """ SELECT page, score, error, CASE WHEN mix > 0 THEN 'Types of ' || mix || ' matched regions differ.' WHEN fn + fp > 0 THEN fn || ' regions missed and ' || fp || ' extra.'
  WHEN f1 >= 0.95e0 AND acc >= 0.95e0 THEN 'Detection and types agree.' ELSE 'A representative page.' END AS note FROM pz""",
    "x3_status": fixture.WITH_RECORDS + """, s AS (SELECT gt_type, CASE WHEN status <> 'matched' THEN 'failure' WHEN NOT scored THEN CASE WHEN gt_type = pred_type THEN 'correct' ELSE 'type confusion' END
  WHEN gt_type <> pred_type THEN 'type confusion' WHEN cer <= 0.1e0 THEN 'correct' WHEN cer <= 0.35e0 THEN 'near-correct' ELSE 'failure' END AS plain,
  CASE WHEN status <> 'matched' THEN status WHEN NOT scored THEN CASE WHEN gt_type = pred_type THEN 'unscored' ELSE 'type confusion' END
  WHEN gt_type <> pred_type THEN 'type confusion' WHEN cer <= 0.1e0 THEN 'correct' WHEN cer <= 0.35e0 THEN 'near-correct' ELSE 'failure' END AS extended FROM scores)
SELECT gt_type, plain, extended, count(*) AS n FROM s GROUP BY ALL""",
    "x5_pages": _STATS + """, z AS (SELECT * FROM pz WHERE predictions > 0),
b AS (SELECT CAST(list_position(['school', 'dictation', 'university', 'archive'], source) - 1 AS INT) AS place, page, 'source' AS reason FROM
  (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, page) AS k FROM z) WHERE k = 1),
e AS (SELECT 4 AS place, page, 'error' AS reason FROM z WHERE page NOT IN (SELECT page FROM b) AND f1 >= 0.5e0 AND error > 0 ORDER BY error DESC, f1 DESC, acc DESC, page LIMIT 1),
f AS (SELECT CAST(4 + row_number() OVER (ORDER BY score DESC, page) AS INT) AS place, page, 'score' AS reason FROM z WHERE page NOT IN (SELECT page FROM b) AND page NOT IN (SELECT page FROM e))
SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f) ORDER BY place LIMIT 6""",
    "x6_page": _STATS + " SELECT page, score FROM pz WHERE kinds >= 3 AND predictions >= 3 ORDER BY score DESC, page LIMIT 1",
    "o2_worst": fixture.WITH_RECORDS + "SELECT page, gt_idx, round(cer, 6) AS cer FROM scores WHERE cer IS NOT NULL ORDER BY round(cer, 6) DESC, page, gt_idx LIMIT 50",
    "x4_quality": fixture.WITH_RECORDS + """, b AS (SELECT r.*, coalesce((g.x2 - g.x1) * (g.y2 - g.y1), (p.x2 - p.x1) * (p.y2 - p.y1)) AS area FROM records r
  LEFT JOIN gt g ON g.page = r.page AND g.idx = r.gt_idx LEFT JOIN pred p ON p.page = r.page AND p.idx = r.pred_idx),
q AS (SELECT *, greatest(1e0, area) / 400000e0 AS ratio, length(coalesce(gt_text, pred_text)) AS n FROM b)
SELECT page, CAST(gt_idx AS INT) AS gt_idx, pred_idx, round(coalesce(iou, 0e0) * 3 + CASE WHEN ratio BETWEEN 0.0015 AND 0.22 THEN 1.2e0 ELSE -1e0 END + CASE WHEN n BETWEEN 2 AND 140 THEN 1e0 ELSE 0e0 END + 0.5e0, 6) AS quality FROM q""",
}

_QUALITY = SQL["x4_quality"][: SQL["x4_quality"].rindex("SELECT page")]
_E = "coalesce(cer, 0e0)"
_BOTH = "gt_type = '{0}' AND pred_type = '{0}'"
_WRONG = "gt_type = '{0}' AND scorable AND (NOT coalesce(pred_type = '{0}', false) OR cer > 0.35e0)"
#: Conditions and preferences of the buckets, and of what fills up.
_RULES = {
    "handwritten success": (_BOTH.format("handwritten") + " AND cer <= 0.1e0", f"v - abs({_E} - 0.04e0)"),
    "printed success": (_BOTH.format("printed") + " AND cer <= 0.1e0", "v"),
    "formula near-correct": (_BOTH.format("formula") + " AND cer BETWEEN 0.02e0 AND 0.35e0", f"v - abs({_E} - 0.16e0)"),
    "formula failure": (_WRONG.format("formula"), f"v + {_E}"),
    "table example": (_BOTH.format("table") + " AND scored", f"v - least({_E}, 0.5e0)"),
    "table formatting failure": ("gt_type = 'table' AND scorable AND (NOT coalesce(pred_type = 'table', false) OR cer >= 0.2e0 OR (pred_text IS NOT NULL AND NOT contains(pred_text, '|')))", f"v + least({_E}, 1e0)"),
    "annotation near-correct": (_BOTH.format("annotation") + " AND cer > 0.1e0 AND cer <= 0.35e0", "v"),
    "annotation failure": (_WRONG.format("annotation"), f"v + least({_E}, 1e0)"),
    "formula-handwritten confusion": ("(gt_type = 'formula' AND pred_type = 'handwritten') OR (gt_type = 'handwritten' AND pred_type = 'formula')", "v + 2e0"),
    "type confusion": ("gt_type <> pred_type", "v + 1.5e0"),
    "empty-text route": ("gt_type IN ('image', 'graph') AND gt_type = pred_type", "v"),
}


def _choice(names, desired: int, extended: bool) -> str:
    """One bucket after the other, each without what was taken before."""
    outside = "status" if extended else "'failure'"
    same = "'unscored'" if extended else "'correct'"
    shown = f"""CASE WHEN status <> 'matched' THEN {outside} WHEN NOT scored THEN CASE WHEN gt_type = pred_type THEN {same} ELSE 'type confusion' END
  WHEN gt_type <> pred_type THEN 'type confusion' WHEN cer <= 0.1e0 THEN 'correct' WHEN cer <= 0.35e0 THEN 'near-correct' ELSE 'failure' END"""
    value = "coalesce(iou, 0e0) * 3e0 + CASE WHEN ratio BETWEEN 0.0015 AND 0.22 THEN 1.2e0 ELSE -1e0 END + CASE WHEN n BETWEEN 2 AND 140 THEN 1e0 ELSE 0e0 END + 0.5e0"
    filling = "CASE WHEN shown = 'type confusion' THEN 2e6 WHEN shown = 'failure' THEN 1e6 ELSE 0e0 END + v"
    rules = [*(_RULES[n] for n in names), ("gt_type IS NOT NULL AND pred_type IS NOT NULL AND scorable", filling)]
    union = " UNION ALL ".join(f"SELECT {i} AS b, page, gt_idx, pred_idx, gt_type, shown, key, {p} AS p FROM w WHERE {c}" for i, (c, p) in enumerate(rules))
    steps = []
    for i in range(len(names)):
        taken = " UNION ALL ".join(f"SELECT key FROM s{j}" for j in range(i)) or "SELECT '' AS key"
        enough = f" AND (SELECT count(*) FROM ({taken}) WHERE key <> '') < {desired}"
        steps.append(f"s{i} AS (SELECT * FROM cand WHERE b = {i} AND key NOT IN ({taken}){enough} ORDER BY k LIMIT 1)")
    picked = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(names)))
    labels = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return _QUALITY + f""", w AS (SELECT q.*, sc.cer, {shown} AS shown, {value} AS v, coalesce(q.gt_type NOT IN ('image', 'graph'), false) AS scorable,
  q.page || ':' || coalesce(CAST(q.gt_idx AS VARCHAR), '-') || ':' || coalesce(CAST(q.pred_idx AS VARCHAR), '-') AS key
  FROM (SELECT * FROM q) q JOIN (SELECT page, gt_idx, pred_idx, cer FROM scores) sc ON sc.page = q.page AND sc.gt_idx IS NOT DISTINCT FROM q.gt_idx AND sc.pred_idx IS NOT DISTINCT FROM q.pred_idx),
cand AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p DESC, page, gt_idx NULLS FIRST, pred_idx NULLS FIRST) AS k FROM ({union})),
{", ".join(steps)},
picked AS ({picked}), fill AS (SELECT * FROM cand WHERE b = {len(names)} AND key NOT IN (SELECT key FROM picked) ORDER BY k LIMIT (SELECT {desired} - count(*) FROM picked)),
done AS (SELECT *, {labels}[b + 1] AS bucket FROM picked UNION ALL SELECT *, gt_type || ' ' || shown FROM fill)"""


SQL["x7_crops"] = _choice(_RULES, 12, False) + " SELECT CAST(row_number() OVER (ORDER BY b, k) - 1 AS INT) AS place, bucket, page, CAST(gt_idx AS INT) AS gt_idx, pred_idx FROM done"
SQL["x7_warnings"] = _choice(_RULES, 12, False) + ", n AS (SELECT unnest(range(11)) AS i, unnest([" + ", ".join(f"'{n}'" for n in _RULES) + (
    "]) AS bucket) SELECT CAST(i AS INT) AS place, 'missing bucket: ' || bucket AS warning FROM n WHERE bucket NOT IN (SELECT bucket FROM done)"
)
#: Of the query in the other module: six buckets, four to show.
FEW = _choice([n for n in _RULES if n in X.FEW_BUCKETS], 4, True) + " SELECT CAST(row_number() OVER (ORDER BY b, k) - 1 AS INT) AS place, bucket, page, CAST(gt_idx AS INT) AS gt_idx, pred_idx FROM done"
