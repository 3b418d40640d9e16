"""Splits, caps, balanced takes and rebalancing plans.

Random order is the order of a hash of seed and id, the same on every cluster and in
plain SQL.  Ranks within a group are found through a histogram of the hashes: bins
that no limit falls into are decided as a whole, only the others are ranked, so that
a group with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

DIGITS = 3  # hexadecimal digits of a bin: 4,096 bins a group
# ---------------------------------------------------------------- fixed values
HEAD, MID, TAIL = ("handwritten", "formula"), ("printed", "annotation", "table"), ("image", "graph")
# Weights of what makes a page worth repeating, and worth adding.
REPEAT = {"tail": 3.0, "mid": 1.2, "rare_ratio": 8.0, "n_image": 2.0, "n_graph": 3.0, "head_ratio": -6.0}
ADD = {"n_graph": 5.0, "n_image": 4.0, "n_table": 1.5, "n_annotation": 1.0, "rare_ratio": 10.0, "head_ratio": -6.0}
CROWDED = {"n_handwritten": (20, 0.15), "n_formula": (10, 0.20)}  # so many are free, each more costs
COMMON = (0.8, 1)  # a page is left out with this share of common types and so few rare ones
RARE_SHARE, MANY_MID, MANY_LINES = 0.1, 5, 15
LIGHT, RARE, DENSE = "aug_light", "aug_rare", "aug_dense"
# ------------------------------------------------------------------------------


def random_key(seed: int, *ids: str) -> Column:
    """Hexadecimal hash of seed and ids; nulls count as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids)))


def parts(df: DataFrame, group: list[str], key: Column, cuts: Callable[[Column], list[Column]], tie: list[str]) -> DataFrame:
    """``df`` with ``part``: how many of the cumulative ``cuts`` a row's rank in its group exceeds.

    ``cuts`` gets the size of the group and gives rising limits.  Ranks go by ``key``,
    equal keys by ``tie``; rows equal in both are interchangeable.  Null group values
    are a group.  An empty table stays empty.
    """
    df = df.withColumns({"_key": key, "_bin": F.left(key, F.lit(DIGITS))})
    on = [*group, "_bin"]
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    bins = df.groupBy(*on).agg(F.count("*").alias("_n"))  # at most 4,096 rows a group
    limits = F.array(*(c.cast("bigint") for c in cuts(F.sum("_n").over(whole))))
    bins = bins.withColumns({"_cuts": limits, "_before": F.coalesce(F.sum("_n").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    passed = lambda rank: F.size(F.filter("_cuts", lambda c: c < rank))
    bins = bins.withColumns({"_low": passed(F.col("_before") + 1), "_high": passed(F.col("_before") + F.col("_n"))})
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = df.alias("d").join(bins.alias("b"), cond).select("d.*", "b._low", "b._high", "b._before", "b._cuts")
    sure = joined.where("_low = _high").withColumn("part", F.col("_low"))
    rank = F.row_number().over(Window.partitionBy(*on).orderBy("_key", *tie)) + F.col("_before")
    torn = joined.where("_low < _high").withColumn("part", passed(rank))
    return sure.unionByName(torn).drop("_key", "_bin", "_low", "_high", "_before", "_cuts")


def stratified(df: DataFrame, stratum: list[str], ids: list[str], ratio: float, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: of each stratum about ``ratio`` validates, at least one and not all.

    A stratum of one row trains.  Rounded half to even.
    """
    n_val = lambda n: F.when(n < 2, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * ratio))))
    out = parts(df, stratum, random_key(seed, *ids), lambda n: [n_val(n)], ids)
    return out.withColumn("split", F.when(F.col("part") == 0, "val").otherwise("train")).drop("part")


def three_way(df: DataFrame, stratum: list[str], ids: list[str], val: float = 0.15, test: float = 0.15, seed: int = 1089) -> DataFrame:
    """``df`` with ``split`` train, val or test, shares rounded half to even in each stratum."""
    cuts = lambda n: [F.bround(n * val), F.bround(n * val) + F.bround(n * test)]
    out = parts(df, stratum, random_key(seed, *ids), cuts, ids)
    return out.withColumn("split", F.when(F.col("part") == 0, "val").when(F.col("part") == 1, "test").otherwise("train")).drop("part")


def cap(df: DataFrame, group: list[str], ids: list[str], most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each group, drawn by hash; 0 or less keeps all."""
    if most <= 0:
        return df
    return parts(df, group, random_key(seed, *ids), lambda n: [F.lit(most)], ids).where("part = 0").drop("part")


def balanced(df: DataFrame, bucket: list[str], ids: list[str], take: int, seed: int = 42) -> DataFrame:
    """``take`` rows by turns from the buckets, in the order of their names, until all are empty.

    Taking turns gives every bucket the same number as far as it goes: the level is
    found on the bucket counts, the rows then drawn by it.
    """
    counts = df.groupBy(*bucket).agg(F.count("*").alias("_size"))
    one = Window.partitionBy(F.lit(0))
    by_size = one.orderBy("_size", *bucket)
    c = counts.withColumns({"_i": F.row_number().over(by_size), "_b": F.count("*").over(one), "_sum": F.coalesce(F.sum("_size").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    fits = F.col("_sum") + F.col("_size") * (F.col("_b") - F.col("_i") + 1) <= take
    level = F.floor((take - F.col("_sum")) / (F.col("_b") - F.col("_i") + 1))
    c = c.withColumn("_level", F.coalesce(F.min_by(F.when(~fits, level), F.when(~fits, F.col("_i"))).over(one), F.max("_size").over(one)))
    base = F.least("_size", "_level")
    c = c.withColumns({"_quota": base, "_more": (F.col("_size") > F.col("_level")).cast("int")})
    turn = F.sum("_more").over(one.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = F.lit(take) - F.sum("_quota").over(one)
    c = c.select(*bucket, (F.col("_quota") + F.when((F.col("_more") == 1) & (turn <= left), 1).otherwise(0)).alias("_quota"))
    cond = None
    for b in bucket:
        x = F.col(f"d.{b}").eqNullSafe(F.col(f"c.{b}"))
        cond = x if cond is None else cond & x
    rows = df.alias("d").join(c.alias("c"), cond).select("d.*", "c._quota")
    return parts(rows, [*bucket, "_quota"], random_key(seed, *ids), lambda n: [F.col("_quota")], ids).where("part = 0").drop("part", "_quota")


def without_leaks(pages: DataFrame, name: str = "file_name", ratio: float = 0.15, seed: int = 42, literal: bool = False) -> DataFrame:
    """Pages with ``base`` and ``split``: all copies of one image go to one side.

    The first ``int(n * (1 - ratio))`` bases train; augmented pages of validation bases
    are dropped.
    """
    based = pages.withColumn("base", text.base_image(F.col(name), literal))
    bases = parts(based.select("base").distinct(), [], random_key(seed, "base"), lambda n: [F.floor(n * (1 - ratio) + 1e-9)], ["base"])
    side = F.when(F.col("part") == 0, "train").otherwise("val").alias("split")
    out = based.join(bases.select("base", side), "base")
    return out.where((F.col("split") == "train") | ~text.basename(F.col(name)).rlike(r"_aug\d+"))


def class_counts(pages: DataFrame, types: str = "types") -> DataFrame:
    """Pages with a count ``n_<type>`` of every type, ``boxes`` and the shares of head and tail."""
    count = lambda t: F.size(F.filter(types, lambda x: x == t)).cast("bigint")
    n = {t: count(t) for t in (*HEAD, *MID, *TAIL)}
    out = pages.withColumns({f"n_{t}": c for t, c in n.items()})
    total = lambda kinds: sum((F.col(f"n_{t}") for t in kinds[1:]), F.col(f"n_{kinds[0]}"))
    out = out.withColumns({"boxes": F.size(types).cast("bigint"), "head": total(HEAD), "mid": total(MID), "tail": total(TAIL)})
    share = lambda c: F.when(F.col("boxes") > 0, F.col(c) / F.greatest("boxes", F.lit(1))).otherwise(0.0)
    return out.withColumns({"rare_ratio": share("tail"), "head_ratio": share("head")})


def _weighed(weights: dict[str, float]) -> Column:
    """Weighted sum of counts and shares, less what crowds a page."""
    total = reduce(lambda x, y: x + y, (F.col(c) * w for c, w in weights.items()))
    return reduce(lambda x, y: x - y, (F.greatest(F.lit(0), F.col(c) - free) * cost for c, (free, cost) in CROWDED.items()), total)


def _common() -> Column:
    return (F.col("head_ratio") >= COMMON[0]) & (F.col("tail") <= COMMON[1])


def augmentation_plan(pages: DataFrame, ids: list[str], seed: int = 42, most: int = 4) -> DataFrame:
    """Counted pages with ``repeats``, ``pipeline`` and ``score``.

    Choices between two numbers go by the parity of a hash.  Pages of common types only
    have no repeats and no score.
    """
    coin = F.conv(F.right(random_key(seed, *ids), F.lit(1)), 16, 10).cast("int") % 2
    score = _weighed(REPEAT)
    skip = (F.col("boxes") == 0) | _common()
    rare, some = (F.col("tail") > 0) & (F.col("rare_ratio") >= RARE_SHARE), (F.col("tail") > 0) | (F.col("mid") > MANY_MID)
    dense = F.col("n_handwritten") >= MANY_LINES
    repeats = F.when(skip, 0).when(rare, 3 + coin).when(some, 1 + coin).when(dense, 1).when(score > 0, coin).otherwise(0)
    pipeline = F.when(skip, LIGHT).when(F.col("tail") > 0, RARE).when((F.col("mid") > MANY_MID) | dense, DENSE).otherwise(LIGHT)
    return pages.withColumns({"repeats": F.least(F.lit(most), repeats), "pipeline": pipeline, "score": F.when(~skip, score)})


def augmented(plan: DataFrame, name: str = "file_name") -> DataFrame:
    """A row per repeat with ``copy`` from 1 and ``new_name``."""
    rows = plan.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "repeats")))
    base = text.basename(F.col(name))
    stem, suffix = F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(base, r"(\.[^.]*)?$", 1)
    return rows.withColumn("new_name", F.format_string("%s_%s_aug%03d%s", stem, "pipeline", "copy", suffix))


def silver_score(pages: DataFrame) -> DataFrame:
    """Counted pages worth adding, with ``score``; pages of common types only are left out."""
    return pages.where(F.col("boxes") > 0).where(~_common()).withColumn("score", _weighed(ADD))


def shared_keys(df: DataFrame, key: str, trains: Column) -> DataFrame:
    """Keys on both sides of a split, with the rows on each: empty if the split is clean."""
    side = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(trains).alias("train_rows"), F.count_if(~trains).alias("other_rows"))
    return side.where("train_rows > 0 and other_rows > 0")
