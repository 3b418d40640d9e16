"""Data quality: reasons for dropping rows, errors of nested input, checks of output, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..schema import REGION_TYPES

REGION_DDL = "array<struct<bbox: array<double>, type: string, language: string, legibility: string, text: string, score: double>>"


def drop_reason(label: Column, image: Column, value: Column, labels: tuple[str, ...]) -> Column:
    """Why a crop is left out, the first reason that holds; null if it is kept."""
    return (
        F.when(~F.coalesce(label.isin(*labels), F.lit(False)), "non_target_label")
        .when(text.strip(F.coalesce(image, F.lit(""))) == "", "missing_image")
        .when(text.strip(F.coalesce(value, F.lit(""))) == "", "empty_text")
    )


def load_crops(lines: DataFrame, labels: tuple[str, ...], files: DataFrame | None = None, root: str = "") -> DataFrame:
    """``(line_no, raw_label, image, label, text, reason, missing_file)`` of JSON lines ``(line_no, value)``.

    Blank lines are none.  ``reason`` is the first that holds of bad_json,
    non_target_label, missing_image and empty_text, null for rows that are kept; a file
    that is not among ``files`` (``path``) is reported, its row kept all the same.
    """
    v = F.try_parse_json(F.col("value"))
    rows = lines.where(text.strip(F.col("value")) != "").select("line_no", v.alias("v"), F.json_object_keys("value").alias("k"))
    field = lambda *names: text.first_of(*(F.try_variant_get("v", f"$.{n}", "string") for n in names))
    label = F.when(F.array_contains("k", "label"), F.try_variant_get("v", F.lit("$.label"), "string")).otherwise(F.try_variant_get("v", F.lit("$.type"), "string"))
    rows = rows.select(
        "line_no", F.col("k").isNull().alias("bad"), F.coalesce(label, F.lit("")).alias("raw_label"), field("image", "file_name", "path").alias("image"),
        text.training_text(F.try_variant_get("v", F.lit("$.text"), "string")).alias("text"),
    )
    reason = F.when(F.col("bad"), "bad_json").otherwise(drop_reason(F.col("raw_label"), F.col("image"), F.col("text"), labels))
    rows = rows.select("line_no", F.when(~F.col("bad"), F.col("raw_label")).alias("raw_label"), "image", F.col("raw_label").alias("label"), "text", reason.alias("reason"))
    if files is None:
        return rows.withColumn("missing_file", F.lit(False))
    there = files.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    joined = rows.withColumn("_path", F.concat(F.lit(root), "image")).join(there, "_path", "left")
    return joined.withColumn("missing_file", F.col("reason").isNull() & F.col("_there").isNull()).drop("_path", "_there")


def load_report(loaded: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``(measure, label, n)``: totals, reasons, missing files, raw and kept labels (those asked for, zero included)."""
    kept = F.col("reason").isNull()
    event = lambda measure, label: F.struct(measure.alias("measure"), label.alias("label"))
    none = F.lit("")
    events = F.array(
        event(F.lit("total"), none), event(F.coalesce("reason", F.lit("kept")), none),
        F.when(F.col("raw_label").isNotNull(), event(F.lit("raw_label"), F.col("raw_label"))),
        F.when(kept, event(F.lit("kept_label"), F.col("label"))), F.when(F.col("missing_file"), event(F.lit("missing_file"), none)),
    )
    zero = loaded.sparkSession.createDataFrame([(m, "") for m in ("total", "bad_json", "kept", "non_target_label", "missing_image", "empty_text", "missing_file")] + [("kept_label", x) for x in labels], "measure string, label string")
    counted = loaded.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*").groupBy("measure", "label").agg(F.count("*").alias("n"))
    return zero.withColumn("n", F.lit(0).cast("bigint")).unionByName(counted).groupBy("measure", "label").agg(F.sum("n").alias("n"))


def first_missing(loaded: DataFrame, most: int = 20) -> DataFrame:
    """The first lines whose file is missing."""
    return loaded.where("missing_file").select("line_no", "image").orderBy("line_no").limit(most)


def regions_json(value: Column) -> Column:
    """Nested regions of a JSON list; empty for null and empty text; null if it is no list."""
    empty = F.coalesce(value, F.lit("")) == ""
    none = F.expr("array()").cast(REGION_DDL)
    return F.when(empty, none).when(F.json_array_length(value).isNotNull(), F.from_json(value, REGION_DDL))


#: A quotation of either kind, or what lies between quotations.
_LITERALS = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[^'"]++|['"]"""


def lenient(value: Column) -> Column:
    """As :func:`regions_json`, Python literals included; null if it is neither.

    Quotations are set apart first, so that their contents stay as they are: single
    ones are turned into double ones; outside of them None, True and False, tuples
    and commas at the end of a list become what JSON has for them.
    """

    def token(t: Column) -> Column:
        inner = F.substring(t, F.lit(2), F.char_length(t) - 2)
        unquoted = F.regexp_replace(F.regexp_replace(inner, r"\\'", "'"), r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
        bare = F.translate(t, "()", "[]")
        for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
            bare = F.regexp_replace(bare, rf"\b{a}\b", b)
        return F.when(t.rlike("(?s)^'.*'$") & (F.char_length(t) > 1), F.concat(F.lit('"'), unquoted, F.lit('"'))).when(t.startswith('"'), t).otherwise(bare)

    joined = F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_LITERALS), F.lit(0)), token), "")
    literal = F.array_join(F.transform(F.regexp_extract_all(joined, F.lit(_LITERALS), F.lit(0)), lambda t: F.when(t.startswith('"'), t).otherwise(F.regexp_replace(t, r",(\s*[\]}])", "$1"))), "")
    return F.coalesce(regions_json(value), F.when(F.json_array_length(literal).isNotNull(), F.from_json(literal, REGION_DDL)))


def region_errors(df: DataFrame, keys: list[str], value: str = "regions", submission: bool = True) -> DataFrame:
    """``(keys, region_idx, code)``: one row per fault, the first of a region.

    ``bad_json`` and ``not_a_list`` concern the whole value (region_idx -1); a region may
    be ``not_an_object``, have ``no_bbox``, a ``bbox_length`` other than four or, in a
    submission, an ``invalid_type``.  A missing type is fine, a null one is not.
    """
    v = F.try_parse_json(F.col(value))
    rows = df.where(F.coalesce(F.col(value), F.lit("")) != "").select(*keys, F.col(value).alias("s"), v.alias("v"))
    rows = rows.withColumns({"parsed": F.col("v").isNotNull(), "items": F.when(F.json_array_length("s").isNotNull(), F.expr("try_cast(v AS array<variant>)"))})
    whole = rows.where("NOT parsed OR items IS NULL").select(*keys, F.lit(-1).alias("region_idx"), F.when(~F.col("parsed"), "bad_json").otherwise("not_a_list").alias("code"))
    each = rows.where("items IS NOT NULL").select(*keys, F.posexplode("items").alias("region_idx", "r"))
    kind = F.schema_of_variant("r")
    box = F.expr("try_variant_get(r, '$.bbox', 'array<variant>')")
    t, raw = F.expr("try_variant_get(r, '$.type', 'string')"), F.expr("try_variant_get(r, '$.type')")
    code = (
        F.when(~kind.startswith("OBJECT"), "not_an_object")
        .when(F.expr("try_variant_get(r, '$.bbox')").isNull() | F.expr("is_variant_null(try_variant_get(r, '$.bbox'))"), "no_bbox")
        .when(box.isNull() | (F.size(box) != 4), "bbox_length")
    )
    if submission:
        code = code.when(raw.isNotNull() & ~F.coalesce(t.isin(*REGION_TYPES), F.lit(False)), "invalid_type")
    return whole.unionByName(each.select(*keys, "region_idx", code.alias("code")).where("code IS NOT NULL"))


def violations(
    df: DataFrame, keys: list[str], value: str = "regions", allowed: tuple[str, ...] = ("bbox", "type", "text"),
    columns: tuple[str, ...] | None = None, rows: int | None = None,
) -> DataFrame:
    """``(keys, region_idx, violation)`` of output rows; empty if the output is as it must be.

    Of a value ``no_list`` (region_idx -1); of a region the first of ``no_object``,
    ``region_keys`` (others than ``allowed``, or one missing), ``bbox_length`` (no list of
    four) and ``type`` (none of the seven).  Given ``columns`` or ``rows``, other columns
    or another number of rows are violations of the output (null keys).
    """
    s = F.col(value)
    items = F.when(F.json_array_length(s).isNotNull(), F.from_json(s, "array<string>"))
    each = df.select(*keys, F.posexplode_outer(items).alias("i", "r"), items.isNull().alias("no_list"))
    wanted = F.array_sort(F.array(*map(F.lit, allowed)))
    box = F.get_json_object("r", "$.bbox")
    v = (
        F.when(F.col("no_list"), "no_list")
        .when(F.col("i").isNull(), None)
        .when(F.json_object_keys("r").isNull(), "no_object")
        .when(F.array_sort(F.json_object_keys("r")) != wanted, "region_keys")
        .when(F.coalesce(F.json_array_length(box), F.lit(-1)) != 4, "bbox_length")
        .when(~F.coalesce(F.get_json_object("r", "$.type").isin(*REGION_TYPES), F.lit(False)), "type")
    )
    found = each.select(*keys, F.coalesce("i", F.lit(-1)).alias("region_idx"), v.alias("violation")).where("violation IS NOT NULL")
    none = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
    whole = []
    if columns is not None and set(columns) != set(df.columns):
        whole.append(df.sparkSession.range(1).select(*none, F.lit(-1).alias("region_idx"), F.lit("columns").alias("violation")))
    if rows is not None:
        whole.append(df.agg(F.count("*").alias("n")).where(F.col("n") != rows).select(*none, F.lit(-1).alias("region_idx"), F.lit("row_count").alias("violation")))
    for w in whole:
        found = found.unionByName(w)
    return found


def numeric_summary(df: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Count, least, most, mean and percentiles of an integer by group, over grouping sets ``()`` and ``by``.

    A percentile is the value at position ``int((n - 1) * p)`` of the sorted values.
    Values are counted ahead of the shuffle, so a group is its distinct values, never its
    rows.  The row over all has ``all`` in the columns of ``by``.  Nulls are not counted.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("bigint").alias("v"))
    counts = rows.groupingSets([["v"], [*by, "v"]], *by, "v").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    g = ["level", *by]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*g).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = counts.withColumns({"before": before, "total": F.sum("n").over(Window.partitionBy(*g))})
    at = lambda p: F.max(F.when((F.col("before") <= F.floor((F.col("total") - 1) * p)) & (F.floor((F.col("total") - 1) * p) < F.col("before") + F.col("n")), F.col("v")))
    out = c.groupBy(*g).agg(
        F.sum("n").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        *(at(p).alias(f"p{round(p * 100)}") for p in points),
    )
    return out.select(*(F.when(F.col("level") > 0, "all").otherwise(F.col(b)).alias(b) for b in by), "count", "min", "max", "mean", *(f"p{round(p * 100)}" for p in points))


def truncation(df: DataFrame, by: list[str], value: str, limit: int) -> DataFrame:
    """How many values exceed a limit, and their share of at least one row."""
    n = F.count_if(F.col(value) > limit)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), n.alias("over"), (n / F.greatest(F.lit(1), F.count("*"))).alias("rate"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order; rows equal in it are interchangeable.

    A maximum per key, combined ahead of the shuffle.  Spark aggregates such wide values
    by sorting each side of it by key; a key's rows are never brought together whole.
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    top = F.max_by(F.struct(*(F.col(c) for c in [*order, *rest])), F.struct(*(F.col(c) for c in order)))
    return df.groupBy(*keys).agg(top.alias("r")).select(*keys, "r.*")


def coverage(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """``(key, side)`` of keys on one side only: ``missing`` or ``unknown``.

    What counts as there is the caller's: for pages, those with a region at least.
    """
    a, b = wanted.select(key).distinct(), there.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unknown")))
