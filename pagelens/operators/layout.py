"""Reading order of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

READABLE = ("handwritten", "printed", "annotation", "formula")
LINE = 15  # pixels of a line band in the second dialect


def order_key(r: Column, i: Column, dialect: str = "v1") -> Column:
    """Sort key of a region: top then left, or line band of the centre then centre; then position."""
    if dialect == "v1":
        return F.struct(r["y1"].alias("a"), r["x1"].alias("b"), i.alias("i"))
    return F.struct(F.floor((r["y1"] + r["y2"]) / 2 / LINE).cast("double").alias("a"), ((r["x1"] + r["x2"]) / 2).alias("b"), i.alias("i"))


def in_order(regions: Column, dialect: str = "v1") -> Column:
    """Array of the regions in reading order."""
    keyed = F.transform(regions, lambda r, i: F.struct(order_key(r, i, dialect).alias("k"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def page_lines(regions: Column, text, keep=None, dialect: str = "v1") -> Column:
    """Texts of the kept regions that are not empty, in reading order."""
    kept = F.filter(regions, keep) if keep is not None else regions
    return F.coalesce(F.filter(F.transform(in_order(kept, dialect), text), lambda t: t != ""), F.array().cast("array<string>"))


def page_text(regions: Column, text, keep=None, dialect: str = "v1") -> Column:
    """:func:`page_lines`, a line each."""
    return F.array_join(page_lines(regions, text, keep, dialect), "\n")


def lines(regions: DataFrame, page: str = "page") -> DataFrame:
    """``(page, idx, line, place, next_idx)`` of readable regions ``(page, idx, type, x1, y1, x2, y2)``.

    By the height of their centres, a region joins the line of the one before it if the
    centres are closer than half the taller of the two; lines read from left to right.
    ``next_idx`` is the reading-order edge, null for the last.
    """
    r = regions.where(F.col("type").isin(*READABLE)).select(
        page, "idx", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("y2") - F.col("y1")).alias("h")
    )
    down = Window.partitionBy(page).orderBy("cy", "idx")
    new = F.coalesce(F.abs(F.col("cy") - F.lag("cy").over(down)) >= 0.5 * F.greatest(F.lag("h").over(down), "h"), F.lit(False))
    r = r.withColumn("new", new.cast("int")).withColumn("line", F.sum("new").over(down).cast("int"))
    read = Window.partitionBy(page).orderBy("line", "cx", "cy", "idx")
    return r.select(page, "idx", "line", (F.row_number().over(read) - 1).alias("place"), F.lead("idx").over(read).alias("next_idx"))
