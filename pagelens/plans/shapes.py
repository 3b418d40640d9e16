"""Queries of box geometry, over all regions of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import match
from ..schema import type_index
from ..session import table
from . import fixture


def boxes(spark, d):
    """``record_id, idx, w, h, type, b``: regions with a box of four numbers."""
    r = table(spark, d, "page_metadata").select("record_id", F.col("image_width").alias("w"), F.col("image_height").alias("h"), F.posexplode("regions").alias("idx", "r"))
    return r.select("record_id", "idx", "w", "h", F.col("r.type").alias("type"), G.from_array(F.col("r.bbox")).alias("b")).where("b IS NOT NULL")


def _expand(c, names="x1 y1 x2 y2"):
    return [F.round(c[n].cast("double"), 6).alias(n) for n in names.split()]


def _boxes_query(make, names="x1 y1 x2 y2", keep=True):
    def query(spark, d):
        b = F.col("b")
        rows = boxes(spark, d).select("record_id", "idx", make(b, F.col("w"), F.col("h")).alias("o"))
        return (rows.where("o IS NOT NULL") if keep else rows).select("record_id", "idx", *_expand(F.col("o"), names))

    return query


def g9_yolo(spark, d):
    b = boxes(spark, d).withColumn("t", type_index(F.lower(F.trim("type"))))
    inner = G.clamp_inner(F.col("b"), F.col("w"), F.col("h"))
    return b.select("record_id", "idx", G.yolo_line(F.col("t"), G.to_yolo(inner, F.col("w"), F.col("h"))).alias("line")).where("line IS NOT NULL")


def g1_iou(spark, d):
    """Overlap of every truth with every prediction of its page that touches it, both formulas."""
    p = fixture.pages(spark, d).where("pred IS NOT NULL")
    pairs = p.select("page", F.explode("gt").alias("g"), "pred").select("page", "g", F.explode("pred").alias("q"))
    rows = pairs.select("page", F.col("g.idx").alias("g"), F.col("q.idx").alias("p"), G.iou(F.col("g"), F.col("q")).alias("a"), G.iou_floored(F.col("g"), F.col("q")).alias("b"))
    return rows.where("a > 0").select("page", "g", "p", F.round("a", 6).alias("iou"), F.round("b", 6).alias("iou_floored"))


def _suppressed(threshold, per_class=False):
    def query(spark, d):
        p = fixture.nested(fixture.pred(spark, d), "boxes", "score", F.col("type").alias("label"))
        kept = match.suppress(F.col("boxes"), threshold, per_class=per_class)
        return p.select("page", F.explode(kept).alias("k")).select("page", F.col("k.idx").alias("idx"))

    return query


def g17_merge(spark, d):
    """Detections of two models (truths and predictions) merged, then suppressed."""
    a = fixture.gt(spark, d).select("page", F.lit("a").alias("model"), "idx", "source", "x1", "y1", "x2", "y2", "type", "text", F.lit(0.5).alias("score"))
    b = fixture.pred(spark, d).select("page", F.lit("b").alias("model"), "idx", "source", "x1", "y1", "x2", "y2", "type", "text", "score")
    entry = F.struct("model", "idx", "x1", "y1", "x2", "y2", "score")
    p = a.unionByName(b).groupBy("page").agg(F.array_sort(F.collect_list(entry)).alias("boxes"))
    return p.select("page", F.explode(match.suppress(F.col("boxes"), 0.6)).alias("k")).groupBy("page").agg(
        F.count("*").alias("kept"), F.count_if(F.col("k.model") == "a").alias("of_a")
    )


def g19_shrink(spark, d):
    p = table(spark, d, "page_metadata").select("record_id", G.shrink(F.col("image_width"), F.col("image_height"), 2000).alias("s"))
    return p.select("record_id", F.round("s.scale", 6).alias("scale"), "s.w", "s.h")


def g20_budget(spark, d):
    p = table(spark, d, "page_metadata").select("record_id", G.budget(F.col("image_width"), F.col("image_height"), 1_000_000).alias("s"))
    return p.select("record_id", "s.w", "s.h")


def g22_shares(spark, d):
    b = boxes(spark, d)
    return b.select("record_id", "idx", G.area_ratio(F.col("b"), F.col("w"), F.col("h")).alias("ratio"), G.percent(F.col("b.x1"), F.col("w")).alias("left"))


QUERIES = {
    "g1_iou": g1_iou,
    "g3_clamp": _boxes_query(lambda b, w, h: G.clamp(b, w, h, 3)),
    "g3b_clamp_wide": _boxes_query(lambda b, w, h: G.clamp(b, w, h, 8)),
    "g4_clamp_decimals": _boxes_query(lambda b, w, h: G.clamp(b, w, h, 3, 2)),
    "g5_clamp_guess": _boxes_query(G.clamp_guess),
    "g6_clamp_coco": _boxes_query(lambda b, w, h: G.clamp_coco(G.to_coco(b), w, h), "x y w h"),
    "g7_clamp_inner": _boxes_query(G.clamp_inner),
    "g8_coco": _boxes_query(lambda b, w, h: G.to_coco(b), "x y w h"),
    "g9_yolo": g9_yolo,
    "g10_grid": _boxes_query(lambda b, w, h: G.grid(b, w, h)),
    "g11_pad_longest": _boxes_query(lambda b, w, h: G.pad_by_longest(b, w, h, 0.04)),
    "g11_pad_height": _boxes_query(lambda b, w, h: G.pad_by_height(b, 0.05, 0.1)),
    "g11_pad_side": _boxes_query(lambda b, w, h: G.pad_by_side(b, w, h)),
    "g15_nms": _suppressed(0.6), "g15_nms_per_class": _suppressed(0.6, True), "g16_dedup": _suppressed(0.9), "g17_merge": g17_merge,
    "g19_shrink": g19_shrink, "g20_budget": g20_budget, "g22_shares": g22_shares,
}

BOXES = """WITH r AS (SELECT record_id, CAST(image_width AS DOUBLE) AS w, CAST(image_height AS DOUBLE) AS h, unnest(range(len(regions))) AS i, unnest(regions) AS r FROM page_metadata),
b AS (SELECT record_id, CAST(i AS INT) AS idx, w, h, r.type AS type, r.bbox[1] AS x1, r.bbox[2] AS y1, r.bbox[3] AS x2, r.bbox[4] AS y2 FROM r WHERE len(r.bbox) = 4
  AND r.bbox[1] IS NOT NULL AND r.bbox[2] IS NOT NULL AND r.bbox[3] IS NOT NULL AND r.bbox[4] IS NOT NULL)"""
_in = lambda v, most: f"greatest(0e0, least({most}, {v}))"
_SORTED = f"""{BOXES}, s AS (SELECT record_id, idx, least({_in('x1', 'w')}, {_in('x2', 'w')}) AS x1, least({_in('y1', 'h')}, {_in('y2', 'h')}) AS y1,
  greatest({_in('x1', 'w')}, {_in('x2', 'w')}) AS x2, greatest({_in('y1', 'h')}, {_in('y2', 'h')}) AS y2 FROM b)"""


def _round(names, digits=0, table="s"):
    return ", ".join(f"CAST(round_even({n}, {digits}) AS DOUBLE) AS {n}" for n in names.split())


def _six(**named):
    return "record_id, idx, " + ", ".join(f"round({v}, 6) AS {n}" for n, v in named.items())


def _clamped(side, digits=0):
    return f"{_SORTED} SELECT record_id, idx, {_round('x1 y1 x2 y2', digits)} FROM s WHERE x2 - x1 >= {side} AND y2 - y1 >= {side}"


_INNER = f"""{BOXES}, c AS (SELECT record_id, idx, w, h, type, {_in('x1', 'w - 1')} AS x1, {_in('y1', 'h - 1')} AS y1, {_in('x2', 'w - 1')} AS x2, {_in('y2', 'h - 1')} AS y2 FROM b),
k AS (SELECT * FROM c WHERE x2 - x1 > 1 AND y2 - y1 > 1)"""
_GUESS = f"""{BOXES}, g AS (SELECT *, x2 <= x1 OR y2 <= y1 AS bad FROM b),
c AS (SELECT record_id, idx, w, h, {_in('x1', 'w')} AS x1, {_in('y1', 'h')} AS y1, {_in('CASE WHEN bad THEN x1 + greatest(0e0, x2) ELSE x2 END', 'w')} AS x2,
  {_in('CASE WHEN bad THEN y1 + greatest(0e0, y2) ELSE y2 END', 'h')} AS y2 FROM g)"""


def _nms(threshold, per_class=False, boxes="pred", order="idx", out="unnest(kept).idx AS idx FROM ends"):
    """Suppression as a recursive walk over the boxes by falling score."""
    return f"""WITH RECURSIVE {fixture.GT}, {fixture.PRED},
both_models AS (SELECT page, 'a' AS type, CAST(idx AS INT) AS idx, x1, y1, x2, y2, 0.5e0 AS score FROM gt UNION ALL SELECT page, 'b', idx, x1, y1, x2, y2, score FROM pred),
by_text AS (SELECT page, text AS type, idx, x1, y1, x2, y2, score FROM pred),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, {order}) AS n FROM {boxes}),
walk AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(idx INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, t VARCHAR)[]) AS kept FROM (SELECT DISTINCT page FROM {boxes})
  UNION ALL SELECT w.page, r.n, CASE WHEN len(list_filter(w.kept, lambda k: {'k.t = r.type AND ' if per_class else ''}
    greatest(0e0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0e0, least(k.y2, r.y2) - greatest(k.y1, r.y1))
    / greatest(1e0, (k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(0e0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0e0, least(k.y2, r.y2) - greatest(k.y1, r.y1))) > {threshold}e0)) > 0
    THEN w.kept ELSE list_append(w.kept, struct_pack(idx := r.idx, x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2, t := r.type)) END
  FROM walk w JOIN ranked r ON r.page = w.page AND r.n = w.n + 1),
ends AS (SELECT page, arg_max(kept, n) AS kept FROM walk GROUP BY page)
SELECT page, {out}"""


_I = "greatest(0e0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0e0, least(g.y2, p.y2) - greatest(g.y1, p.y1))"
_A = "(g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1)"
SQL = {
    "g1_iou": fixture.WITH_PRED + f", o AS (SELECT g.page, g.idx AS g, p.idx AS p, {_I} AS i, {_A} AS a FROM gt g JOIN pred p ON p.page = g.page) "
    "SELECT page, g, p, round(i / (a - i), 6) AS iou, round(i / greatest(1e0, a - i), 6) AS iou_floored FROM o WHERE i > 0",
    "g3_clamp": _clamped(3), "g3b_clamp_wide": _clamped(8), "g4_clamp_decimals": _clamped(3, 2),
    "g5_clamp_guess": _GUESS + f" SELECT {_six(x1='x1', y1='y1', x2='CASE WHEN x2 <= x1 THEN least(w, x1 + 1e0) ELSE x2 END', y2='CASE WHEN y2 <= y1 THEN least(h, y1 + 1e0) ELSE y2 END')} FROM c",
    "g6_clamp_coco": BOXES + f", c AS (SELECT *, {_in('x1', 'w - 2')} AS x, {_in('y1', 'h - 2')} AS y FROM b) "
    "SELECT record_id, idx, round(x, 6) AS x, round(y, 6) AS y, round(greatest(1e0, least(x2 - x1, w - x)), 6) AS w, round(greatest(1e0, least(y2 - y1, h - y)), 6) AS h FROM c",
    "g7_clamp_inner": _INNER + f" SELECT {_six(x1='x1', y1='y1', x2='x2', y2='y2')} FROM k",
    "g8_coco": BOXES + " SELECT record_id, idx, round(x1, 6) AS x, round(y1, 6) AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM b",
    "g9_yolo": _INNER + """, t AS (SELECT *, list_position(['handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph'], lower(trim(type, ' '))) - 1 AS t FROM k),
y AS (SELECT record_id, idx, t, (x1 + (x2 - x1) / 2) / w AS cx, (y1 + (y2 - y1) / 2) / h AS cy, (x2 - x1) / w AS bw, (y2 - y1) / h AS bh FROM t WHERE t IS NOT NULL AND t >= 0)
SELECT record_id, idx, printf('%d %.6f %.6f %.6f %.6f', t, cx, cy, bw, bh) AS line FROM y WHERE cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND bw > 0 AND bw <= 1 AND bh > 0 AND bh <= 1""",
    "g10_grid": BOXES + " SELECT record_id, idx, " + ", ".join(f"least(1000e0, greatest(0e0, CAST(round_even({c} / {m} * 1000, 0) AS DOUBLE))) AS {c}" for c, m in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))) + " FROM b",
    "g11_pad_longest": BOXES + ", p AS (SELECT *, CAST(round_even(greatest(x2 - x1, y2 - y1) * 0.04e0, 0) AS DOUBLE) AS p FROM b) SELECT record_id, idx, "
    "CAST(round_even(greatest(0e0, x1 - p), 0) AS DOUBLE) AS x1, CAST(round_even(greatest(0e0, y1 - p), 0) AS DOUBLE) AS y1, CAST(round_even(least(w, x2 + p), 0) AS DOUBLE) AS x2, CAST(round_even(least(h, y2 + p), 0) AS DOUBLE) AS y2 FROM p",
    "g11_pad_height": BOXES + f", p AS (SELECT *, greatest(1e0, y2 - y1) AS t FROM b) SELECT {_six(x1='x1 - t * 0.05e0', y1='y1 - t * 0.1e0', x2='x2 + t * 0.05e0', y2='y2 + t * 0.1e0')} FROM p",
    "g11_pad_side": BOXES + f", p AS (SELECT *, greatest(12e0, (x2 - x1) * 0.12e0) AS px, greatest(12e0, (y2 - y1) * 0.12e0) AS py FROM b) SELECT {_six(x1='greatest(0e0, x1 - px)', y1='greatest(0e0, y1 - py)', x2='least(w, x2 + px)', y2='least(h, y2 + py)')} FROM p",
    "g15_nms": _nms("0.6"), "g15_nms_per_class": _nms("0.6", True), "g16_dedup": _nms("0.9"),
    "g17_merge": _nms("0.6", boxes="both_models", order="type, idx", out="len(kept) AS kept, len(list_filter(kept, lambda k: k.t = 'a')) AS of_a FROM ends"),
    "g21_same_text": _nms("0.5", True, boxes="by_text", out="CAST(len(kept) AS INT) AS kept, CAST((SELECT count(*) FROM pred p WHERE p.page = ends.page) AS INT) AS boxes FROM ends"),
    "g19_shrink": "SELECT record_id, round(s, 6) AS scale, CAST(floor(image_width * s) AS INT) AS w, CAST(floor(image_height * s) AS INT) AS h FROM "
    "(SELECT *, CASE WHEN greatest(image_width, image_height) > 2000 THEN 2000e0 / greatest(image_width, image_height) ELSE 1e0 END AS s FROM page_metadata)",
    "g20_budget": "SELECT record_id, CASE WHEN image_width * image_height <= 1000000 THEN image_width ELSE greatest(1, CAST(round_even(image_width * s, 0) AS INT)) END AS w, "
    "CASE WHEN image_width * image_height <= 1000000 THEN image_height ELSE greatest(1, CAST(round_even(image_height * s, 0) AS INT)) END AS h FROM "
    "(SELECT *, sqrt(1e6 / greatest(1, image_width * image_height)) AS s FROM page_metadata)",
    "g22_shares": BOXES + " SELECT record_id, idx, greatest(1e0, (x2 - x1) * (y2 - y1)) / greatest(1e0, w * h) AS ratio, CASE WHEN w > 0 THEN round(x1 / w * 100, 4) ELSE 0e0 END AS \"left\" FROM b",
}
