"""Pages with truths and predictions, derived from the star schema.

The text is the same for Spark SQL and for the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

GT = """
base AS (
 SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx,
        l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, p_name, p_brand
 FROM lineitem JOIN part ON p_partkey = l_partkey),
gt AS (
 SELECT page, CAST(idx AS INT) AS idx, pk, sk,
  CAST((pk % 40) * 20 AS DOUBLE) AS x1, CAST(idx * 40 AS DOUBLE) AS y1,
  CAST((pk % 40) * 20 + 100 AS DOUBLE) + q * 6e0 AS x2, CAST(idx * 40 + 30 AS DOUBLE) AS y2,
  CASE WHEN pk % 20 < 12 THEN 'handwritten' WHEN pk % 20 < 14 THEN 'printed' WHEN pk % 20 < 17 THEN 'formula' WHEN pk % 20 = 17 THEN 'table'
       WHEN pk % 20 = 18 THEN 'annotation' WHEN sk % 2 = 0 THEN 'image' ELSE 'graph' END AS type,
  CASE WHEN sk % 17 = 0 THEN 'other' ELSE 'uk' END AS language,
  CASE WHEN sk % 19 = 0 THEN 'illegible' ELSE 'legible' END AS legibility,
  concat(p_name, ' ', p_brand) AS text,
  CASE page % 4 WHEN 0 THEN 'archive' WHEN 1 THEN 'dictation' WHEN 2 THEN 'school' ELSE 'university' END AS source
 FROM base)
"""
PRED = """
pred0 AS (
 SELECT page, idx AS src, d, source, x1 + (sk % 5) * 4e0 AS x1, y1 + ((pk + d) % 5) * 3e0 AS y1, x2 + (sk % 5) * 4e0 AS x2, y2 + ((pk + d) % 5) * 3e0 AS y2,
  CASE WHEN pk % 9 = 0 THEN 'printed' ELSE type END AS type,
  CASE WHEN type IN ('image', 'graph') THEN '' WHEN sk % 3 = 0 THEN replace(text, 'e', 'a') ELSE text END AS text,
  CAST(((pk * 7 + sk * 3 + d * 5) % 100) AS DOUBLE) / 1e2 AS score
 FROM gt JOIN (SELECT 0 AS d UNION ALL SELECT 1 AS d UNION ALL SELECT 5 AS d) k ON k.d = 0 OR (pk % 11 = 0)
 WHERE (pk + sk) % 13 <> 0),
pred AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY src, d) - 1 AS INT) AS idx, source, x1, y1, x2, y2, type, text, score FROM pred0)
"""
_OVERLAP = """
inter AS (SELECT g.page, g.idx AS g, p.idx AS p,
  greatest(0e0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0e0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i,
  (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS area FROM gt g JOIN pred p ON g.page = p.page),
pairs AS (SELECT page, g, p, i / (area - i) AS iou, row_number() OVER (PARTITION BY page ORDER BY i / (area - i) DESC, g, p) AS n
  FROM inter WHERE i > 0 AND i / (area - i) >= 0.5e0),
walk AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS gs, CAST([] AS INT[]) AS ps FROM (SELECT DISTINCT page FROM pairs)
  UNION ALL SELECT w.page, x.n, CASE WHEN list_contains(w.gs, x.g) OR list_contains(w.ps, x.p) THEN w.gs ELSE list_append(w.gs, x.g) END,
    CASE WHEN list_contains(w.gs, x.g) OR list_contains(w.ps, x.p) THEN w.ps ELSE list_append(w.ps, x.p) END
  FROM walk w JOIN pairs x ON x.page = w.page AND x.n = w.n + 1),
ends AS (SELECT page, arg_max(gs, n) AS gs, arg_max(ps, n) AS ps FROM walk GROUP BY page),
matches AS (SELECT e.page, e.g, e.p, x.iou FROM (SELECT page, unnest(gs) AS g, unnest(ps) AS p FROM ends) e JOIN pairs x USING (page, g, p))
"""
WITH_GT = f"WITH {GT}"
WITH_PRED = f"WITH {GT}, {PRED}"
#: For the checking SQL only: the greedy walk as a recursive query.
WITH_MATCHES = f"WITH RECURSIVE {GT}, {PRED}, {_OVERLAP}"
WITH_RECORDS = f"""{WITH_MATCHES},
records AS (
  SELECT g.page, g.source, g.idx AS gt_idx, m.p AS pred_idx, m.iou, g.type AS gt_type, p.type AS pred_type, g.text AS gt_text, p.text AS pred_text,
    CASE WHEN m.p IS NULL THEN 'missed' ELSE 'matched' END AS status,
    m.p IS NOT NULL AND g.type NOT IN ('image', 'graph') AND g.language <> 'other' AND g.legibility <> 'illegible' AS scored
  FROM gt g LEFT JOIN matches m ON m.page = g.page AND m.g = g.idx LEFT JOIN pred p ON p.page = g.page AND p.idx = m.p
  UNION ALL
  SELECT p.page, p.source, NULL, p.idx, NULL, NULL, p.type, NULL, p.text, 'false positive', false
  FROM pred p LEFT JOIN matches m ON m.page = p.page AND m.p = p.idx WHERE m.p IS NULL),
scores AS (SELECT *, CASE WHEN scored THEN levenshtein(pred_text, gt_text) / CAST(greatest(length(gt_text), 1) AS DOUBLE) END AS cer FROM records),
pages AS (SELECT DISTINCT page, source FROM gt),
gt_pages AS (SELECT page, string_agg(text, chr(10) ORDER BY y1, x1, idx) AS t FROM gt
  WHERE type NOT IN ('image', 'graph') AND language <> 'other' AND legibility <> 'illegible' AND text <> '' GROUP BY page),
pred_pages AS (SELECT page, string_agg(text, chr(10) ORDER BY y1, x1, idx) AS t FROM pred WHERE type NOT IN ('image', 'graph') AND text <> '' GROUP BY page),
page_cers AS (SELECT g.page, levenshtein(coalesce(p.t, ''), g.t) / CAST(length(g.t) AS DOUBLE) AS page_cer FROM gt_pages g LEFT JOIN pred_pages p USING (page))
"""


def _views(spark: SparkSession, d: str) -> None:
    for name in ("lineitem", "part"):
        table(spark, d, name).createOrReplaceTempView(name)


def gt(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d)
    return spark.sql(f"{WITH_GT} SELECT page, idx, x1, y1, x2, y2, type, language, legibility, text, source FROM gt")


def pred(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d)
    return spark.sql(f"{WITH_PRED} SELECT * FROM pred")


def nested(df: DataFrame, name: str, *fields: str) -> DataFrame:
    """A page a row, its regions an array in their order."""
    entry = F.struct("idx", "x1", "y1", "x2", "y2", "type", "text", *fields)
    return df.groupBy("page").agg(F.array_sort(F.collect_list(entry)).alias(name), F.min("source").alias("source"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """``page, source, gt, pred``; a page without predictions has a null array."""
    g = nested(gt(spark, d), "gt", "language", "legibility")
    p = nested(pred(spark, d), "pred", "score").drop("source")
    return g.join(p, "page", "left")
