"""One-to-one matching of boxes within a page, and suppression of duplicates.

Regions stay nested in their page: a page is a row with two arrays, so matching,
scoring and suppression are expressions of a row and need no shuffle of their own.
A page's pairs come from two cells of a table; for flat tables whose pages hold
thousands of regions, :func:`mutual_best` gives the same result without folding a
page in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..session import materialize

THRESHOLD = 0.5
_PAIR = "array<struct<order:double,g:int,p:int>>"


def pairs(gt: Column, pred: Column, threshold: float = THRESHOLD) -> Column:
    """``array<struct<order, g, p>>`` of the pairs that overlap enough, best first.

    ``g`` and ``p`` are positions from 0; ``order`` is the negative overlap; ties go by
    position.  Null arrays hold nothing.
    """

    def order(r: Column, q: Column) -> Column:
        if threshold <= 0:
            return -G.iou(r, q)
        meet = (q["y1"] < r["y2"]) & (r["y1"] < q["y2"]) & (q["x1"] < r["x2"]) & (r["x1"] < q["x2"])
        return F.when(meet, -G.iou(r, q))  # boxes that lie apart, nearly all, are not measured

    def row(r: Column, g: Column) -> Column:
        hits = F.transform(pred, lambda q, p: F.struct(order(r, q).alias("order"), g.alias("g"), p.alias("p")))
        return F.filter(hits, lambda x: x["order"] <= -threshold)

    both = gt.isNotNull() & pred.isNotNull()
    return F.when(both, F.array_sort(F.flatten(F.transform(gt, row)))).otherwise(F.expr("array()").cast(_PAIR))


def greedy(ordered: Column) -> Column:
    """Walk ordered pairs and keep those of which neither side is taken."""
    none = F.expr("array()").cast(_PAIR)
    taken = lambda acc, x: F.exists(acc, lambda y: (y["g"] == x["g"]) | (y["p"] == x["p"]))
    return F.aggregate(ordered, none, lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.array_append(acc, x)))


def matches(gt: Column, pred: Column, threshold: float = THRESHOLD) -> Column:
    """``array<struct<order, g, p>>``: greedy one-to-one matches."""
    return greedy(pairs(gt, pred, threshold))


def records(gt: Column, pred: Column, matched: Column) -> Column:
    """``array<struct<gt, pred, iou>>``: matches, then truths and predictions left over.

    A side that is missing is null, as in a full outer join.
    """
    found = F.transform(matched, lambda m: F.struct(F.get(gt, m["g"]).alias("gt"), F.get(pred, m["p"]).alias("pred"), (-m["order"]).alias("iou")))

    def left(side: Column, key: str) -> Column:
        numbered = F.transform(side, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
        return F.filter(numbered, lambda x: ~F.exists(matched, lambda m: m[key] == x["i"]))

    none_gt, none_pred = F.get(gt, F.lit(-1)), F.get(pred, F.lit(-1))
    missed = F.transform(left(gt, "g"), lambda x: F.struct(x["r"].alias("gt"), none_pred.alias("pred"), F.lit(None).cast("double").alias("iou")))
    extra = F.transform(left(pred, "p"), lambda x: F.struct(none_gt.alias("gt"), x["r"].alias("pred"), F.lit(None).cast("double").alias("iou")))
    return F.concat(found, F.coalesce(missed, F.slice(found, 1, 0)), F.coalesce(extra, F.slice(found, 1, 0)))


def mutual_best(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy matches of flat pairs ``(keys, g, p, iou)`` by rounds of mutually best pairs.

    A pair that comes first for both of its sides is always chosen by the greedy walk;
    taking all such pairs and dropping their sides, again and again, ends in its result.
    Rounds are written to the shared folder; there are at most as many as a page has
    matches, in practice a few.
    """
    order = [F.desc("iou"), F.asc("g"), F.asc("p")]
    rest, out = materialize(pairs.select(*keys, "g", "p", "iou")), None
    while not rest.isEmpty():
        ranked = rest.withColumns(
            {
                "a": F.row_number().over(Window.partitionBy(*keys, "g").orderBy(*order)),
                "b": F.row_number().over(Window.partitionBy(*keys, "p").orderBy(*order)),
            }
        )
        best = materialize(ranked.where("a = 1 and b = 1").select(*keys, "g", "p", "iou"))
        out = best if out is None else out.unionByName(best)
        rest = materialize(rest.join(best.select(*keys, "g"), [*keys, "g"], "left_anti").join(best.select(*keys, "p"), [*keys, "p"], "left_anti"))
    return out if out is not None else rest


def suppress(boxes: Column, threshold: float, overlap=G.iou_floored, per_class: bool = False) -> Column:
    """Boxes of which no better one overlaps more than ``threshold``, by falling ``score``.

    Elements need the fields of a box, ``score`` and, for ``per_class``, ``label``.
    Equal scores keep their order.  Used for suppression and for dropping duplicates.
    """
    ranked = F.transform(
        F.array_sort(F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("order"), i.alias("i"), b.alias("b")))), lambda x: x["b"]
    )

    def hit(acc: Column, b: Column) -> Column:
        same = (lambda k: k["label"] == b["label"]) if per_class else (lambda k: F.lit(True))
        return F.exists(acc, lambda k: same(k) & (overlap(k, b) > threshold))

    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda acc, b: F.when(hit(acc, b), acc).otherwise(F.array_append(acc, b)))


def same_text(boxes: Column, threshold: float = 0.5) -> Column:
    """Boxes without those that repeat the text of a better one they overlap (an extension)."""
    labelled = F.transform(boxes, lambda b: b.withField("label", F.coalesce(b["text"], F.lit(""))))
    return suppress(labelled, threshold, overlap=G.iou, per_class=True)
