"""Small frame operations: running ids, fixed splits, projections, lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import editdist, text
from ..schema import VISUAL_TYPES


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """``df`` with running numbers in the given order, without bringing it into one task.

    Rows are sorted by range; each partition numbers its own, shifted by the sizes of the
    partitions before it (a row a partition).
    """
    ranged = df.sortWithinPartitions(*order) if df.isStreaming else df.repartitionByRange(*order).sortWithinPartitions(*order)
    from ..session import materialize

    placed = materialize(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # a row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(offsets, "_part").withColumn(name, rank + F.col("_before") + (start - 1)).drop("_part", "_before")


def fixed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What stands at ``path``, made and written there the first time only."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def projected(regions: Column, digits: int = 2) -> Column:
    """Regions as they are sent: rounded box, normal type, text."""
    return F.transform(
        regions,
        lambda r: F.struct(
            F.transform(r["bbox"], lambda v: F.bround(v, digits)).alias("bbox"), text.normal_type(r["type"]).alias("type"), F.coalesce(r["text"], F.lit("")).alias("text")
        ),
    )


def read_again(value: Column, mode: str = "smart") -> Column:
    """Whether a region is to be read again: ``none``, ``all``, or ``smart`` for blank, very short and very long texts."""
    t = text.strip(F.coalesce(value, F.lit("")))
    smart = (t == "") | (F.char_length(t) < 4) | (F.char_length(t) > 160)
    return {"none": F.lit(False), "all": F.lit(True), "smart": smart}[mode]


def candidate(region_type: Column, value: Column, language: Column, legibility: Column) -> Column:
    """Whether a region makes a training crop: it counts in error rates and its text is sane."""
    return text.scorable(text.normal_type(region_type), F.lower(language), F.lower(legibility)) & text.sane(value)


def page_answer(regions: Column, w: Column, h: Column) -> Column:
    """Regions as a compact JSON answer: boxes on a grid of 1000, reading order, visual ones without text."""
    from ..functions import geometry as G

    def bbox(c: Column) -> Column:
        on_grid = lambda b: F.when(b.isNotNull(), F.array(*(G.grid(b, w, h)[x] for x in ("x1", "y1", "x2", "y2"))))
        return text.bound(G.clamp(G.from_array(c), w, h, 8), on_grid)

    rows = F.transform(regions, lambda r, i: F.struct(bbox(r["bbox"]).alias("bbox"), text.normal_type(r["type"]).alias("type"), r["text"].alias("text"), i.alias("i")))
    kept = F.filter(rows, lambda r: r["bbox"].isNotNull())
    order = F.array_sort(F.transform(kept, lambda r: F.struct(F.get(r["bbox"], F.lit(1)).alias("y"), F.get(r["bbox"], F.lit(0)).alias("x"), r["i"].alias("i"), r.alias("r"))))
    return F.to_json(F.transform(order, lambda o: F.struct(o["r"]["bbox"].alias("bbox"), o["r"]["type"].alias("type"), without_visual_text(o["r"]["type"], F.coalesce(o["r"]["text"], F.lit(""))).alias("text"))))


def prompt(region_type: Column, source: Column, hints: dict[str, str], prompts: dict[str, str], rules: tuple[str, ...] = ()) -> Column:
    """Hint of the source, prompt of the type and rules, a line each; unknown ones take ``default``.

    Images and graphs get the prompt of their type alone.
    """
    pick = lambda c, of: F.coalesce(F.create_map(*(F.lit(x) for p in of.items() for x in p))[c], F.lit(of["default"]))
    kind = text.normal_type(region_type)
    hint = pick(F.lower(text.strip(F.coalesce(source, F.lit("")))), hints)
    whole = F.concat_ws("\n", hint, pick(kind, prompts), *map(F.lit, rules))
    return F.when(kind.isin(*VISUAL_TYPES), pick(kind, prompts)).otherwise(whole)


def without_visual_text(region_type: Column, value: Column) -> Column:
    """Images and graphs carry no text."""
    return F.when(region_type.isin(*VISUAL_TYPES), "").otherwise(value)


def lengths(value: Column, measure: str | Callable[[Column], Column] = "chars") -> Column:
    """Length of a text in code points, in words, or by any measure given as a column function."""
    if callable(measure):
        return measure(value)
    return F.char_length(value) if measure == "chars" else F.size(editdist.words_of(value))


def run_or_first(df: DataFrame, run: str) -> DataFrame:
    """Rows of one run, or of the first one by name if it is not there."""
    there = df.select("run_id").distinct()
    chosen = there.agg(F.coalesce(F.max(F.when(F.col("run_id") == run, F.col("run_id"))), F.min("run_id")).alias("run_id"))
    return df.join(chosen, "run_id", "left_semi")


def collapsed(value: Column, most: int = 3) -> Column:
    """A word said more than ``most`` times on end, as answers in a loop do, is said ``most`` times."""
    return F.regexp_replace(value, rf"(?U)\b(\S+)((?:\s+\1){{{most - 1}}})(?:\s+\1)+(?=\s|$)", "$1$2")


def patched(sent: DataFrame, answers: DataFrame, pages: DataFrame) -> DataFrame:
    """``sent`` with the texts of ``answers`` written over the old ones, its lists put together again.

    ``sent`` has ``image`` and ``regions`` (JSON), ``answers`` ``image, idx, text`` by
    position from 0, ``pages`` ``image, w, h``.  Only regions of text types change whose
    box has four numbers and, cut to whole pixels of the page, is not empty; a failed
    answer (null) leaves the old text.  Rows of unknown images and unreadable lists stay
    as they are.  Fields of the declared region survive, others do not in rows that change.
    """
    from ..schema import TEXT_TYPES
    from .quality import regions_json

    new = answers.where("text IS NOT NULL").groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "text"))).alias("_new"))
    rows = sent.join(new, "image", "left").join(pages.select("image", F.col("w").alias("_w"), F.col("h").alias("_h")), "image", "left")
    within = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("bigint"), most))

    def fit(r: Column) -> Column:
        b = [F.get(r["bbox"], F.lit(k)) for k in range(4)]
        side = (within(b[2], F.col("_w")) > within(b[0], F.col("_w"))) & (within(b[3], F.col("_h")) > within(b[1], F.col("_h")))
        return r["type"].isin(*TEXT_TYPES) & (F.size(r["bbox"]) == 4) & side

    def step(r: Column, i: Column) -> Column:
        to = F.try_element_at(F.col("_new"), i)
        return r.withField("text", F.when(F.coalesce(fit(r), F.lit(False)) & to.isNotNull(), to).otherwise(r["text"]))

    old = regions_json(F.col("regions"))
    changed = bound_pair(old, lambda o: F.transform(o, step))
    known = F.col("_w").isNotNull() & F.col("_new").isNotNull()
    after = F.when(known & changed["more"], F.to_json(changed["to"])).otherwise(F.col("regions"))
    return rows.withColumn("regions", after).drop("_new", "_w", "_h")


def bound_pair(old: Column, change: Callable[[Column], Column]) -> Column:
    """``to``: the changed value, ``more``: whether it differs; null where there is no value."""
    return F.element_at(F.transform(F.array(old), lambda o: F.struct(change(o).alias("to"), (~o.eqNullSafe(change(o)) & o.isNotNull()).alias("more"))), 1)
