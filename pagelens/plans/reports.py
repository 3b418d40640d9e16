"""Queries of sources, data quality, text rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import editdist, text
from ..operators import frames
from ..operators import quality as Q
from ..operators import runs as R
from ..schema import REGION_TYPES, STRUCTURED_TYPES, TEXT_TYPES
from ..session import dealt, table
from ..sources import readers, writers
from . import compare


def _label():
    return F.lower(text.strip(F.col("label")))


def crops(spark, d):
    return table(spark, d, "crop_records")


def _regions(spark, d, costly=False):
    p = table(spark, d, "page_metadata")
    p = dealt(p.select("record_id", "source", "regions")) if costly else p
    return p.select("record_id", F.coalesce(F.lower(text.strip(F.col("source"))), F.lit("unknown")).alias("source"), F.posexplode("regions").alias("idx", "r")).select("record_id", "source", "idx", "r.*")


def s4_reasons(spark, d):
    """Crops kept or dropped, by reason and split."""
    r = Q.drop_reason(_label(), F.col("image"), F.col("text"), TEXT_TYPES)
    return crops(spark, d).groupBy("source_split", F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def s4_examples(spark, d):
    """The first twenty dropped crops of each reason by id."""
    from pyspark.sql.window import Window

    r = Q.drop_reason(_label(), F.col("image"), F.col("text"), TEXT_TYPES)
    rows = crops(spark, d).select("crop_id", r.alias("reason")).where("reason IS NOT NULL")
    w = Window.partitionBy("reason").orderBy("crop_id")  # the limit is applied ahead of the shuffle too
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 20")


def s5_fields(spark, d):
    """First usable name of the image and of the type, from either kind of record."""
    c = crops(spark, d).select(F.col("crop_id").alias("id"), text.normal_type(text.first_of(F.col("label"))).alias("type"), text.basename(text.first_of(F.col("image"), F.col("collection_id"))).alias("image"))
    return c.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("image").alias("images"))


def s10_run_ids(spark, d):
    """Run id and label of submission files, one label given."""
    f = table(spark, d, "submission_lines").select("csv_file").distinct()
    run = readers.run_id(F.col("csv_file"))
    return f.select("csv_file", run.alias("run_id"), readers.run_label(run, {"submission": "Unnamed"}).alias("label"))


def _loaded(spark, d):
    """Crops as the JSON lines they were delivered in, with two broken lines and a blank one."""
    lines = crops(spark, d).select(F.col("crop_id").alias("line_no"), F.to_json(F.struct("label", "image", "text")).alias("value"))
    broken = spark.createDataFrame([(-1, "{"), (-2, "[1]"), (-3, "  ")], "line_no bigint, value string")
    files = table(spark, d, "page_metadata").select(text.basename(F.col("file_name")).alias("path"))
    return Q.load_crops(lines.unionByName(broken), TEXT_TYPES, files)


def s4_report(spark, d):
    return Q.load_report(_loaded(spark, d), TEXT_TYPES)


def s4_missing(spark, d):
    """The first twenty crops whose page is not there."""
    return Q.first_missing(_loaded(spark, d))


def s17_regions(spark, d):
    r = readers.page_regions(table(spark, d, "page_metadata"))
    return r.select("image", "region_idx", "type", "language", "legibility", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


def s14_basename(spark, d):
    return table(spark, d, "page_metadata").select("record_id", text.basename(F.col("file_name")).alias("name"), text.base_image(F.col("file_name")).alias("base"))


def s15_errors(spark, d):
    return Q.region_errors(table(spark, d, "sample_submission"), ["row_id"])


def s16_lenient(spark, d):
    """Regions of all submissions and of some Python literals, read leniently: their number and texts."""
    s = table(spark, d, "sample_submission").select("row_id", "regions")
    literals = spark.createDataFrame([(-1 - i, v) for i, v in enumerate(LITERALS)], "row_id bigint, regions string")
    r = Q.lenient(F.col("regions"))
    return s.unionByName(literals).select("row_id", F.size(r).alias("n"), F.array_join(F.transform(r, lambda x: F.coalesce(x["text"], F.lit("-"))), "|").alias("texts"))


#: Literals and, beside them, what they say.
LITERALS = {
    "[{'text': 'a, None, b', 'type': None}]": (1, "a, None, b"), "[{'text': \"it's\"}, {'text': None}, {}]": (3, "it's|-|-"), "[{'text': 'x \"True\" y', 'bbox': (1, 2, 3, 4,),},]": (1, 'x "True" y'),
    "None": (None, None), "{'a': 1}": (None, None), "[{'text': 'it\\'s'}]": (1, "it's"),
}


def s21_union(spark, d):
    p = table(spark, d, "page_metadata").select("record_id", "split", "source")
    both = p.where("split = 'train'").unionByName(p.where("split = 'silver'"), allowMissingColumns=True)
    return both.groupBy("split").agg(F.count("*").alias("pages"))


def j1_solution(spark, d):
    """Pages with regions and the regions sent last for them by each run."""
    s = Q.keep_last(table(spark, d, "sample_submission").where("image IS NOT NULL").select("run_id", "image", "submitted_at", "row_id", "regions"), ["run_id", "image"], ["submitted_at", "row_id"])
    p = table(spark, d, "page_metadata").where("regions IS NOT NULL").groupBy(text.basename(F.col("file_name")).alias("image")).agg(F.max(F.size("regions")).alias("gt"))
    return p.join(s, "image").select("run_id", "image", "gt", F.coalesce(F.size(Q.regions_json(F.col("regions"))), F.lit(0)).alias("pred"))


def j2_coverage(spark, d):
    """Pages without predictions (an empty list counts as none) and predicted images that are no pages."""
    p = table(spark, d, "page_metadata").select(text.basename(F.col("file_name")).alias("image"))
    s = table(spark, d, "sample_submission").where("image IS NOT NULL").where(F.size(Q.regions_json(F.col("regions"))) > 0)
    return Q.coverage(p, s.select("image"), "image")


def w2_keep_last(spark, d):
    s = table(spark, d, "sample_submission").where("image IS NOT NULL").select("run_id", "image", "submitted_at", "row_id")
    return Q.keep_last(s, ["run_id", "image"], ["submitted_at", "row_id"]).select("run_id", "image", "row_id")


def j6_labels(spark, d):
    """Rows of each run with its group and label; unknown runs keep their id."""
    r = table(spark, d, "runs")
    s = table(spark, d, "sample_submission").groupBy("run_id").agg(F.count("*").alias("n"))
    return s.join(r, "run_id", "left").select("run_id", F.coalesce("run_group", F.lit("unknown")).alias("run_group"), F.coalesce("label", "run_id").alias("label"), "n")


def j12_patch(spark, d):
    """Texts of the truths at the same place written over what was sent."""
    s = table(spark, d, "sample_submission").select("row_id", "image", "regions")
    name = text.basename(F.col("file_name"))
    first = table(spark, d, "page_metadata").groupBy(name.alias("image")).agg(F.min_by(F.struct(F.col("image_width").alias("w"), F.col("image_height").alias("h"), F.col("regions.text").alias("texts")), "record_id").alias("p"))
    pages = first.select("image", "p.w", "p.h")
    answers = first.select("image", F.posexplode("p.texts").alias("idx", "text"))
    out = frames.patched(s, answers, pages)
    return out.select("row_id", F.posexplode(Q.regions_json(F.col("regions"))).alias("idx", "r")).select("row_id", "idx", "r.text")


def filter_scorable(spark, d):
    r = _regions(spark, d)
    ok = text.scorable(text.normal_type(F.col("type")), F.col("language"), F.col("legibility"))
    return r.groupBy("source").agg(F.count("*").alias("regions"), F.count_if(ok).alias("scorable"))


def filter_route(spark, d):
    t = F.lower(text.strip(F.col("type")))
    return _regions(spark, d).groupBy(text.route(t).alias("route")).agg(F.count("*").alias("n"))


def filter_candidates(spark, d):
    """Regions fit for training crops."""
    return _regions(spark, d).where(frames.candidate(F.col("type"), F.col("text"), F.col("language"), F.col("legibility"))).select("record_id", "idx")


def filter_smart(spark, d):
    """How many regions each mode reads again, by source."""
    modes = ("none", "all", "smart")
    return _regions(spark, d).groupBy("source").agg(*(F.count_if(frames.read_again(F.col("text"), m)).alias(m) for m in modes))


def filter_limits(spark, d):
    """Pages whose answer has at most 60 regions and 9,000 characters of compact JSON."""
    p = table(spark, d, "page_metadata").select("record_id", frames.page_answer(F.col("regions"), F.col("image_width"), F.col("image_height")).alias("a"))
    p = p.select("record_id", F.json_array_length("a").alias("n"), F.char_length("a").alias("chars"))
    most = config.from_environment(config.Limits)  # 60 and 9,000 unless set otherwise
    return p.where(F.col("n").between(1, most.regions) & (F.col("chars") <= most.page_chars))


def a10_labels(spark, d):
    return crops(spark, d).groupBy(F.coalesce(_label(), F.lit("")).alias("label")).agg(F.count("*").alias("n"))


def a11_lengths(spark, d):
    c = crops(spark, d).select(F.coalesce(_label(), F.lit("")).alias("label"), F.char_length("text").alias("chars"))
    return Q.numeric_summary(c, ["label"], "chars").withColumn("mean", F.round("mean", 6))


def a12_truncation(spark, d):
    c = crops(spark, d).select(F.coalesce(_label(), F.lit("")).alias("label"), F.char_length("text").alias("chars"))
    return Q.truncation(c, ["label"], "chars", 40).withColumn("rate", F.round("rate", 6))


def a14_before_after(spark, d):
    """Regions by type in two splits, over all types of either."""
    t = text.normal_type(F.col("r.type"))
    r = table(spark, d, "page_metadata").select("split", F.explode("regions").alias("r")).select("split", t.alias("type"))
    a = r.where("split = 'train'").groupBy("type").agg(F.count("*").alias("before"))
    b = r.where("split = 'silver'").groupBy("type").agg(F.count("*").alias("added"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, "type", "full").select("type", zero("before").alias("before"), zero("added").alias("added"), (zero("before") + zero("added")).alias("final"))


def a15_totals(spark, d):
    p = table(spark, d, "page_metadata")
    n = F.coalesce(F.array_size("regions"), F.lit(0))
    return p.groupBy("split").agg(F.count("*").alias("pages"), F.sum(n).alias("regions"), F.round(F.sum(n) / F.greatest(F.lit(1), F.count("*")), 6).alias("mean"))


def a18_summary(spark, d):
    """Pages, regions, characters and pages with each structured type, by split and source."""
    p = table(spark, d, "page_metadata").select("split", F.coalesce(F.lower(text.strip(F.col("source"))), F.lit("unknown")).alias("source"), "regions")
    chars = F.aggregate(F.coalesce("regions", F.expr("array()").cast(p.schema["regions"].dataType)), F.lit(0), lambda a, r: a + F.coalesce(F.char_length(r["text"]), F.lit(0)))
    has = lambda t: F.count_if(F.exists("regions", lambda r: text.normal_type(r["type"]) == t)).alias(f"with_{t}")
    return p.groupBy("split", "source").agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.array_size("regions"), F.lit(0))).alias("regions"), F.sum(chars).alias("chars"), has("formula"), has("table"), has("graph"))


def t3_crops(spark, d):
    """Each crop against what was sent for its page in regions of its type: the least error rates."""
    kind = text.normal_type(F.col("label"))
    c = crops(spark, d).where("text IS NOT NULL").select("crop_id", "image", kind.alias("type"), F.col("text").alias("gt"))
    s = table(spark, d, "sample_submission").select("image", F.explode(Q.regions_json(F.col("regions"))).alias("r")).where("r.text IS NOT NULL")
    s = s.select("image", text.normal_type(F.col("r.type")).alias("type"), F.col("r.text").alias("pred"))
    pairs = c.join(s, ["image", "type"])
    return pairs.groupBy("crop_id").agg(
        F.count("*").alias("n"), F.round(F.min(editdist.cer(F.col("pred"), F.col("gt"))), 6).alias("cer"), F.round(F.min(editdist.wer(F.col("pred"), F.col("gt"))), 6).alias("wer"),
    )


def t1_normalized(spark, d):
    """Normalized texts of all regions, both dialects."""
    t = text.normal_type(F.col("type"))
    return _regions(spark, d, costly=True).select("record_id", "idx", text.normalize(F.col("text"), t, "v1").alias("v1"), text.normalize(F.col("text"), t, "v2").alias("v2"))


def t1_text(spark, d):
    """The same of all regions but formulas and tables, whose rules plain SQL can state."""
    t = text.normal_type(F.col("type"))
    r = _regions(spark, d, costly=True).where(~t.isin(*STRUCTURED_TYPES))
    return r.select("record_id", "idx", text.normalize(F.col("text"), t, "v1").alias("v1"), text.normalize(F.col("text"), t, "v2").alias("v2"))


def t8_invalid(spark, d):
    """Texts of all regions judged as if they were answers, of tables but for formulas."""
    t = F.when(text.normal_type(F.col("type")) == "formula", "formula").otherwise("table")
    r = _regions(spark, d).select(t.alias("type"), "text")
    return r.groupBy("type", text.invalid_reason(F.col("text"), F.col("type"), F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


def t9_cleaned(spark, d):
    return crops(spark, d).select("crop_id", text.clean_output(F.col("text")).alias("text"))


def t11_sane(spark, d):
    return crops(spark, d).select("crop_id", text.sane(F.col("text")).alias("sane"))


def t13_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("h"))


def t14_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 60).alias("text"))


def t15_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


def t19_numbers(spark, d):
    return table(spark, d, "part").select("p_partkey", text.four_digits(F.col("p_retailprice")).alias("price"))


def t20_cyrillic(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cyrillic_count(F.coalesce("text", F.lit(""))).alias("n"))


def o1_ranked(spark, d):
    """Types by a fixed order, unknown ones last, then by name."""
    c = crops(spark, d).groupBy(F.coalesce(_label(), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, REGION_TYPES)), F.col("label"))
    return c.withColumn("rank", F.when(at > 0, at).otherwise(999).cast("int")).orderBy("rank", "label")


def u2_difference(spark, d):
    """Collections of pages that no crop has."""
    a = table(spark, d, "page_metadata").select("collection_id").where("collection_id IS NOT NULL")
    return a.distinct().join(crops(spark, d).select("collection_id"), "collection_id", "left_anti")


def k6_markdown(spark, d):
    """The table of runs as Markdown, a row a line."""
    lines = writers.markdown(table(spark, d, "runs").select("run_id", "run_group", "label").orderBy("run_id")).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


def o3_invalid(spark, d):
    """The first fifty regions that would be invalid answers, of tables but for formulas."""
    t = F.when(text.normal_type(F.col("type")) == "formula", "formula").otherwise("table")
    r = _regions(spark, d).select("record_id", "idx", t.alias("type"), "text")
    r = r.withColumn("reason", text.invalid_reason(F.col("text"), F.col("type"), F.col("text"))).where("reason <> ''")
    return r.select("record_id", "idx", "type", "reason").orderBy("record_id", "idx").limit(50)


def v1_errors(spark, d):
    """What keeps runs from being scored strictly."""
    return R.errors(table(spark, d, "sample_submission"), R.solutions(table(spark, d, "page_metadata")))


def _coco(spark, d):
    from ..functions import geometry as G

    def region(r):
        b = G.from_array(r["bbox"])
        return F.struct(F.lower(text.strip(r["type"])).alias("type"), *(b[x].alias(x) for x in ("x1", "y1", "x2", "y2")))

    pages = table(spark, d, "page_metadata").select(
        "record_id", F.col("file_name").alias("image"), F.col("image_width").alias("w"), F.col("image_height").alias("h"), F.transform("regions", region).alias("regions")
    )
    return writers.coco_frames(pages, ("record_id",))


def k7_coco(spark, d):
    """Annotations as the writer builds them: running ids, category, rounded box, area, ordinal of the region."""
    return _coco(spark, d)["annotations"]


def k7_images(spark, d):
    return _coco(spark, d)["images"]


def k7_categories(spark, d):
    return _coco(spark, d)["categories"]


def k10_violations(spark, d):
    """Submissions checked as output: their columns, the number of rows, every region."""
    s = table(spark, d, "sample_submission")
    images = table(spark, d, "page_metadata").select(text.basename(F.col("file_name"))).distinct().count()
    return Q.violations(s.select("row_id", "image", "regions"), ["row_id"], columns=("image", "regions"), rows=images)


QUERIES = {f.__name__: f for f in (
    s4_reasons, s4_examples, s4_report, s4_missing, s5_fields, s10_run_ids, s14_basename, s15_errors, s16_lenient, s17_regions, s21_union, j1_solution, j2_coverage, w2_keep_last, j6_labels, j12_patch,
    filter_scorable, filter_route, filter_candidates, filter_smart, filter_limits, a10_labels, a11_lengths, a12_truncation, a14_before_after, a15_totals, a18_summary, t3_crops, t1_normalized, t1_text, t8_invalid, t9_cleaned, t11_sane, t13_clean, t14_truncated,
    t15_slug, t19_numbers, t20_cyrillic, o1_ranked, u2_difference, k6_markdown, k7_coco, k7_images, k7_categories, k10_violations, o3_invalid, v1_errors,
)}
_S = r"regexp_replace({}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"
_LABEL = f"lower({_S.format('label')})"
_KNOWN = "('handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph')"
_TYPE = f"CASE WHEN lower({_S.format('type')}) IN {_KNOWN} THEN lower({_S.format('type')}) ELSE 'handwritten' END"
_R = f"""WITH e AS (SELECT record_id, split, coalesce(lower({_S.format('source')}), 'unknown') AS source, unnest(range(len(regions))) AS i, unnest(regions) AS r FROM page_metadata),
r AS (SELECT record_id, split, source, CAST(i AS INT) AS idx, r.type AS type, r.text AS text, r.language AS language, r.legibility AS legibility FROM e)"""
_NAME = r"regexp_extract(replace(file_name, '\', '/'), '([^/]+)/*$', 1)"
_REASON = f"""CASE WHEN NOT coalesce({_LABEL} IN ('handwritten', 'printed', 'annotation'), false) THEN 'non_target_label'
  WHEN {_S.format("coalesce(image, '')")} = '' THEN 'missing_image' WHEN {_S.format("coalesce(text, '')")} = '' THEN 'empty_text' END"""
_SANE = f"""({_S.format("coalesce(text, '')")} <> '' AND length(coalesce(text, '')) <= 260 AND NOT contains(coalesce(text, ''), chr(65533)) AND NOT coalesce(list_bool_or(list_transform(
  list_distinct(string_split(text, '')), lambda c: contains(text, repeat(c, 11)))), false))"""
_T = _S.format("coalesce(text, '')")
_INVALID = f"""CASE WHEN {_T} = '' THEN 'empty' WHEN contains({_T}, '```') THEN 'markdown_fence' WHEN regexp_matches({_T}, '^[\\[{{]') THEN 'json_or_list_wrapper'
  WHEN regexp_matches({_T}, '(?i)^(?:text|transcription|answer|output)[\\s\\x{{00a0}}]*:') THEN 'prefixed_label'
  WHEN regexp_matches({_T}, '(?i)\\b(?:i can see|the image|this is|the answer|solution|solve|simplif)') THEN 'explanation_or_solution_like'
  WHEN type = 'table' AND regexp_matches(coalesce(text, ''), '[|\\n]') AND NOT regexp_matches({_T}, '[|\\n]') THEN 'missing_table_separator'
  WHEN type = 'table' AND len(list_filter(regexp_split_to_array({_T}, '\\r\\n|[\\n\\r]'), lambda x: {_S.format('x')} <> '')) > 1
    AND len(list_filter(regexp_split_to_array({_T}, '\\r\\n|[\\n\\r]'), lambda x: {_S.format('x')} <> '' AND NOT contains(x, '|'))) > 0 THEN 'malformed_table_rows' ELSE '' END"""
_LAST = "SELECT run_id, image, max_by(row_id, (submitted_at, row_id)) AS row_id FROM sample_submission WHERE image IS NOT NULL GROUP BY 1, 2"

SQL = {
    "s4_reasons": f"SELECT source_split, coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM crop_records GROUP BY ALL",
    "s4_examples": f"SELECT * FROM (SELECT crop_id, {_REASON} AS reason, CAST(row_number() OVER (PARTITION BY {_REASON} ORDER BY crop_id) AS INT) AS place FROM crop_records) WHERE reason IS NOT NULL AND place <= 20",
    "s5_fields": f"WITH c AS (SELECT {_TYPE.replace('type', 'label')} AS type, coalesce(nullif(image, ''), nullif(collection_id, '')) AS image FROM crop_records) "
    r"SELECT type, count(*) AS n, count(DISTINCT regexp_extract(replace(image, '\', '/'), '([^/]+)/*$', 1)) AS images FROM c GROUP BY type",
    "s14_basename": f"SELECT record_id, {_NAME} AS name, regexp_replace({_NAME}, '(?:_(?:aug_)?(?:light|dense|rare|heavy|mix))?_aug[0-9]+', '', 'g') AS base FROM page_metadata",
    "s15_errors": """WITH g AS (SELECT row_id, regions, CASE WHEN json_valid(regions) THEN CAST(regions AS JSON) END AS j FROM sample_submission WHERE regions <> ''),
e AS (SELECT row_id, unnest(range(json_array_length(j)::BIGINT)) AS i, j FROM g WHERE json_type(j) = 'ARRAY'), r AS (SELECT row_id, CAST(i AS INT) AS i, json_extract(j, '$[' || i || ']') AS r FROM e),
c AS (SELECT row_id, i, CASE WHEN json_type(r) <> 'OBJECT' THEN 'not_an_object' WHEN coalesce(json_type(r, '$.bbox'), 'NULL') = 'NULL' THEN 'no_bbox'
  WHEN json_type(r, '$.bbox') <> 'ARRAY' OR json_array_length(r, '$.bbox') <> 4 THEN 'bbox_length'
  WHEN json_type(r, '$.type') IS NOT NULL AND coalesce(json_extract_string(r, '$.type'), '') NOT IN """ + _KNOWN + """ THEN 'invalid_type' END AS code FROM r)
SELECT row_id, i AS region_idx, code FROM c WHERE code IS NOT NULL
UNION ALL SELECT row_id, -1, CASE WHEN j IS NULL THEN 'bad_json' ELSE 'not_a_list' END FROM g WHERE j IS NULL OR json_type(j) <> 'ARRAY'""",
    "s21_union": "SELECT split, count(*) AS pages FROM page_metadata WHERE split IN ('train', 'silver') GROUP BY split",
    "j1_solution": f"""WITH l AS ({_LAST}), p AS (SELECT {_NAME} AS image, max(len(regions)) AS gt FROM page_metadata WHERE regions IS NOT NULL GROUP BY 1)
SELECT l.run_id, l.image, CAST(gt AS INT) AS gt, CAST(CASE WHEN json_valid(s.regions) AND json_type(s.regions::JSON) = 'ARRAY' THEN json_array_length(s.regions::JSON) ELSE 0 END AS INT) AS pred
FROM p JOIN l USING (image) JOIN sample_submission s USING (row_id)""",
    "w2_keep_last": _LAST,
    "j6_labels": "SELECT s.run_id, coalesce(run_group, 'unknown') AS run_group, coalesce(label, s.run_id) AS label, count(*) AS n FROM sample_submission s LEFT JOIN runs r ON r.run_id = s.run_id GROUP BY ALL",
    "filter_scorable": f"{_R} SELECT source, count(*) AS regions, count(*) FILTER ({_TYPE} NOT IN ('image', 'graph') AND coalesce(language, '') <> 'other' AND coalesce(legibility, '') <> 'illegible') AS scorable FROM r GROUP BY source",
    "filter_route": f"{_R}, t AS (SELECT lower({_S.format('type')}) AS t FROM r) SELECT CASE WHEN t IN ('handwritten', 'printed', 'annotation') THEN 'text' WHEN t IN ('formula', 'table') THEN 'structured' WHEN t IN ('image', 'graph') THEN 'empty' ELSE 'unknown' END AS route, count(*) AS n FROM t GROUP BY 1",
    "a10_labels": f"SELECT coalesce({_LABEL}, '') AS label, count(*) AS n FROM crop_records GROUP BY 1",
    "a11_lengths": f"""WITH c AS (SELECT coalesce({_LABEL}, '') AS label, length(text) AS v FROM crop_records WHERE text IS NOT NULL), b AS (SELECT * FROM c UNION ALL SELECT 'all', v FROM c),
s AS (SELECT label, list_sort(list(v)) AS vs FROM b GROUP BY label)
SELECT label, len(vs) AS count, vs[1] AS min, vs[len(vs)] AS max, round(list_sum(vs) / CAST(len(vs) AS DOUBLE), 6) AS mean, vs[CAST(floor((len(vs) - 1) * 0.95e0) AS BIGINT) + 1] AS p95, vs[CAST(floor((len(vs) - 1) * 0.99e0) AS BIGINT) + 1] AS p99 FROM s""",
    "a12_truncation": f"SELECT coalesce({_LABEL}, '') AS label, count(*) AS rows, count(*) FILTER (length(text) > 40) AS over, round(count(*) FILTER (length(text) > 40) / CAST(count(*) AS DOUBLE), 6) AS rate FROM crop_records GROUP BY 1",
    "a14_before_after": f"{_R}, t AS (SELECT split, {_TYPE} AS type FROM r WHERE split IN ('train', 'silver')) SELECT type, count(*) FILTER (split = 'train') AS before, count(*) FILTER (split = 'silver') AS added, count(*) AS final FROM t GROUP BY type",
    "a15_totals": "SELECT split, count(*) AS pages, CAST(sum(coalesce(len(regions), 0)) AS BIGINT) AS regions, round(sum(coalesce(len(regions), 0)) / CAST(count(*) AS DOUBLE), 6) AS mean FROM page_metadata GROUP BY split",
    "a18_summary": f"""SELECT split, coalesce(lower({_S.format('source')}), 'unknown') AS source, count(*) AS pages, CAST(sum(coalesce(len(regions), 0)) AS BIGINT) AS regions,
  CAST(sum(coalesce(list_sum(list_transform(regions, lambda r: length(r.text))), 0)) AS BIGINT) AS chars,
""" + ", ".join(f"count(*) FILTER (len(list_filter(regions, lambda r: lower({_S.format('r.type')}) = '{t}')) > 0) AS with_{t}" for t in ("formula", "table", "graph")) + " FROM page_metadata GROUP BY 1, 2",
    "t11_sane": f"SELECT crop_id, {_SANE} AS sane FROM crop_records",
    "t15_slug": "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
    "t19_numbers": "SELECT p_partkey, printf('%.4f', p_retailprice) AS price FROM part",
    "t20_cyrillic": "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\x{0400}-\\x{04ff}]')) AS INT) AS n FROM documents",
    "o1_ranked": f"WITH c AS (SELECT coalesce({_LABEL}, '') AS label, count(*) AS n FROM crop_records GROUP BY 1) SELECT label, n, CAST(CASE WHEN label IN {_KNOWN} THEN list_position(['handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph'], label) ELSE 999 END AS INT) AS rank FROM c",
    "u2_difference": "SELECT DISTINCT collection_id FROM page_metadata WHERE collection_id IS NOT NULL AND collection_id NOT IN (SELECT collection_id FROM crop_records WHERE collection_id IS NOT NULL)",
    "s10_run_ids": "WITH f AS (SELECT DISTINCT csv_file, regexp_replace(regexp_replace(csv_file, '\\.csv$', ''), '_submission$', '') AS r FROM submission_lines) "
    "SELECT csv_file, r AS run_id, CASE WHEN r = 'submission' THEN 'Unnamed' ELSE trim(translate(regexp_replace(r, '^[0-9]+[_-]', ''), '_-', '  ')) END AS label FROM f",
    "s4_report": f"""WITH l AS (SELECT coalesce(label, '') AS raw, image, text, CASE WHEN coalesce(label, '') NOT IN ('handwritten', 'printed', 'annotation') THEN 'non_target_label'
  WHEN {_S.format("coalesce(image, '')")} = '' THEN 'missing_image' WHEN {_S.format("coalesce(text, '')")} = '' THEN 'empty_text' ELSE 'kept' END AS reason FROM crop_records),
e AS (SELECT 'total' AS measure, '' AS label FROM l UNION ALL SELECT reason, '' FROM l UNION ALL SELECT 'raw_label', raw FROM l UNION ALL SELECT 'kept_label', raw FROM l WHERE reason = 'kept'
  UNION ALL SELECT 'missing_file', '' FROM l WHERE reason = 'kept' AND image NOT IN (SELECT {_NAME} FROM page_metadata WHERE file_name IS NOT NULL)
  UNION ALL SELECT unnest(['total', 'total', 'bad_json', 'bad_json']), ''),
z AS (SELECT unnest(['total', 'bad_json', 'kept', 'non_target_label', 'missing_image', 'empty_text', 'missing_file']) AS measure, '' AS label UNION ALL SELECT 'kept_label', unnest(['handwritten', 'printed', 'annotation']))
SELECT measure, label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT measure, label, 1 AS n FROM e UNION ALL SELECT measure, label, 0 FROM z) GROUP BY 1, 2""",
    "s4_missing": f"""SELECT crop_id AS line_no, image FROM crop_records WHERE label IN ('handwritten', 'printed', 'annotation') AND {_S.format("coalesce(image, '')")} <> '' AND {_S.format("coalesce(text, '')")} <> ''
  AND image NOT IN (SELECT {_NAME} FROM page_metadata WHERE file_name IS NOT NULL) ORDER BY crop_id LIMIT 20""",
    "s16_lenient": "WITH s AS (SELECT row_id, CASE WHEN coalesce(regions, '') = '' THEN '[]' ELSE regions END AS j FROM sample_submission) SELECT row_id, CAST(json_array_length(j) AS INT) AS n, "
    "array_to_string(list_transform(CAST(j AS JSON[]), lambda x: coalesce(json_extract_string(x, '$.text'), '-')), '|') AS texts FROM s UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({-1 - i}, {'NULL' if n is None else n}, {'NULL' if t is None else chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39)})" for i, (n, t) in enumerate(LITERALS.values())) + ") AS v(row_id, n, texts)",
    "s17_regions": f"""WITH p AS (SELECT {_NAME} AS image, CAST(coalesce(nullif(image_width, 0), 1) AS DOUBLE) AS w, CAST(coalesce(nullif(image_height, 0), 1) AS DOUBLE) AS h, CASE WHEN len(regions) > 0 THEN regions ELSE [NULL] END AS rs FROM page_metadata),
e AS (SELECT image, w, h, unnest(range(len(rs))) AS i, unnest(rs) AS r FROM p), b AS (SELECT *, CASE WHEN len(r.bbox) = 4 AND len(list_filter(r.bbox, lambda v: v IS NULL)) = 0 THEN r.bbox WHEN coalesce(len(r.bbox), 0) <> 4 THEN [0e0, 0e0, 1e0, 1e0] END AS b FROM e),
g AS (SELECT *, b[3] <= b[1] OR b[4] <= b[2] AS bad FROM b),
c AS (SELECT *, greatest(0e0, least(w, b[1])) AS x1, greatest(0e0, least(h, b[2])) AS y1, greatest(0e0, least(w, CASE WHEN bad THEN b[1] + greatest(0e0, b[3]) ELSE b[3] END)) AS x2,
  greatest(0e0, least(h, CASE WHEN bad THEN b[2] + greatest(0e0, b[4]) ELSE b[4] END)) AS y2 FROM g)
SELECT image, CASE WHEN r IS NOT NULL THEN CAST(i AS INT) END AS region_idx, CASE WHEN r IS NOT NULL THEN {_S.format("coalesce(r.type, '')")} END AS type, CASE WHEN r IS NOT NULL THEN coalesce(r.language, 'uk') END AS language,
  CASE WHEN r IS NOT NULL THEN coalesce(r.legibility, 'legible') END AS legibility, CASE WHEN r IS NOT NULL AND b IS NOT NULL THEN round(x1, 6) END AS x1, CASE WHEN r IS NOT NULL AND b IS NOT NULL THEN round(y1, 6) END AS y1,
  CASE WHEN r IS NOT NULL AND b IS NOT NULL THEN round(CASE WHEN x2 <= x1 THEN least(w, x1 + 1e0) ELSE x2 END, 6) END AS x2, CASE WHEN r IS NOT NULL AND b IS NOT NULL THEN round(CASE WHEN y2 <= y1 THEN least(h, y1 + 1e0) ELSE y2 END, 6) END AS y2 FROM c""",
    "j2_coverage": f"""WITH p AS (SELECT DISTINCT {_NAME} AS image FROM page_metadata),
s AS (SELECT DISTINCT image FROM sample_submission WHERE image IS NOT NULL AND regions <> '' AND json_valid(regions) AND json_type(regions::JSON) = 'ARRAY' AND json_array_length(regions::JSON) > 0)
SELECT image, 'missing' AS side FROM p WHERE image NOT IN (SELECT image FROM s) UNION ALL SELECT image, 'unknown' FROM s WHERE image NOT IN (SELECT image FROM p)""",
    "j12_patch": f"""WITH f AS (SELECT {_NAME} AS image, min_by(struct_pack(w := image_width, h := image_height, t := list_transform(regions, lambda r: r.text), k := regions IS NOT NULL), record_id) AS p FROM page_metadata GROUP BY 1),
s AS (SELECT row_id, image, CAST(regions AS JSON) AS j FROM sample_submission WHERE regions <> '' AND json_valid(regions) AND json_type(regions::JSON) = 'ARRAY'),
e AS (SELECT row_id, image, i, json_extract(j, '$[' || i || ']') AS r FROM (SELECT *, unnest(range(json_array_length(j)::BIGINT)) AS i FROM s)),
b AS (SELECT e.*, f.p, CASE WHEN json_type(r, '$.bbox') = 'ARRAY' AND json_array_length(r, '$.bbox') = 4 THEN CAST(json_extract(r, '$.bbox') AS DOUBLE[]) END AS b FROM e LEFT JOIN f USING (image)),
c AS (SELECT *, list_transform(b, lambda v, k: greatest(0, least(CAST(trunc(v) AS BIGINT), CASE WHEN k % 2 = 1 THEN p.w ELSE p.h END))) AS q FROM b)
SELECT row_id, CAST(i AS INT) AS idx, CASE WHEN json_extract_string(r, '$.type') IN ('handwritten', 'printed', 'annotation') AND q[3] > q[1] AND q[4] > q[2] AND p.t[i + 1] IS NOT NULL THEN p.t[i + 1]
  ELSE json_extract_string(r, '$.text') END AS text FROM c""",
    "filter_candidates": f"{_R} SELECT record_id, idx FROM r WHERE {_TYPE} NOT IN ('image', 'graph') AND lower(coalesce(language, 'uk')) <> 'other' AND lower(coalesce(legibility, 'legible')) <> 'illegible' AND {_SANE}",
    "filter_smart": f"""{_R}, t AS (SELECT source, {_S.format("coalesce(text, '')")} AS t FROM r) SELECT source, CAST(0 AS BIGINT) AS none, count(*) AS \"all\", count(*) FILTER (length(t) < 4 OR length(t) > 160) AS smart FROM t GROUP BY source""",
    "filter_limits": f"""WITH e AS (SELECT record_id, CAST(image_width AS DOUBLE) AS w, CAST(image_height AS DOUBLE) AS h, unnest(range(len(regions))) AS i, unnest(regions) AS r FROM page_metadata),
b AS (SELECT record_id, i, w, h, r.text AS text, {_TYPE.replace('type', 'r.type')} AS kind, least(greatest(0e0, least(w, r.bbox[1])), greatest(0e0, least(w, r.bbox[3]))) AS x1, least(greatest(0e0, least(h, r.bbox[2])), greatest(0e0, least(h, r.bbox[4]))) AS y1,
  greatest(greatest(0e0, least(w, r.bbox[1])), greatest(0e0, least(w, r.bbox[3]))) AS x2, greatest(greatest(0e0, least(h, r.bbox[2])), greatest(0e0, least(h, r.bbox[4]))) AS y2
  FROM e WHERE len(r.bbox) = 4 AND len(list_filter(r.bbox, lambda v: v IS NULL)) = 0),
g AS (SELECT record_id, kind, text, [least(1000, CAST(round_even(round_even(x1, 0) / w * 1000, 0) AS INT)), least(1000, CAST(round_even(round_even(y1, 0) / h * 1000, 0) AS INT)),
  least(1000, CAST(round_even(round_even(x2, 0) / w * 1000, 0) AS INT)), least(1000, CAST(round_even(round_even(y2, 0) / h * 1000, 0) AS INT))] AS bbox FROM b WHERE x2 - x1 >= 8 AND y2 - y1 >= 8),
o AS (SELECT record_id, count(*) AS n, sum(length(CAST(to_json(struct_pack(bbox := bbox, type := kind, text := CASE WHEN kind IN ('image', 'graph') THEN '' ELSE coalesce(text, '') END)) AS VARCHAR)) + 1) + 1 AS chars FROM g GROUP BY 1)
SELECT record_id, CAST(n AS INT) AS n, CAST(chars AS INT) AS chars FROM o WHERE n <= 60 AND chars <= 9000""",
    "t3_crops": f"""WITH c AS (SELECT crop_id, image, {_TYPE.replace('type', 'label')} AS type, text AS gt FROM crop_records WHERE text IS NOT NULL),
s AS (SELECT image, CAST(regions AS JSON) AS j FROM sample_submission WHERE regions <> '' AND json_valid(regions) AND json_type(regions::JSON) = 'ARRAY'),
e AS (SELECT image, json_extract(j, '$[' || i || ']') AS r FROM (SELECT *, unnest(range(json_array_length(j)::BIGINT)) AS i FROM s)),
r AS (SELECT image, json_extract_string(r, '$.type') AS type0, json_extract_string(r, '$.text') AS pred FROM e), k AS (SELECT image, {_TYPE.replace('type', 'type0')} AS type, pred FROM r WHERE pred IS NOT NULL),
p AS (SELECT c.crop_id, gt, pred FROM c JOIN k ON k.image = c.image AND k.type = c.type),
d AS (SELECT crop_id, ({compare.chars('pred', 'gt')}) / CAST(greatest(length(gt), 1) AS DOUBLE) AS cer, {compare.wer('pred', 'gt')} AS wer FROM p)
SELECT crop_id, count(*) AS n, round(min(cer), 6) AS cer, round(min(wer), 6) AS wer FROM d GROUP BY 1""",
    "t8_invalid": f"{_R}, t AS (SELECT CASE {_TYPE} WHEN 'formula' THEN 'formula' ELSE 'table' END AS type, text FROM r), j AS (SELECT type, {_INVALID} AS reason FROM t) SELECT type, reason, count(*) AS n FROM j GROUP BY ALL",
    "o3_invalid": f"{_R}, t AS (SELECT record_id, idx, CASE {_TYPE} WHEN 'formula' THEN 'formula' ELSE 'table' END AS type, text FROM r), j AS (SELECT record_id, idx, type, {_INVALID} AS reason FROM t) "
    "SELECT record_id, idx, type, reason FROM j WHERE reason <> '' ORDER BY record_id, idx LIMIT 50",
    "k6_markdown": "WITH r AS (SELECT CAST(row_number() OVER (ORDER BY run_id) + 1 AS INT) AS place, '| ' || array_to_string(list_transform([run_id, run_group, label], lambda x: replace(replace(coalesce(x, ''), '|', '\\|'), chr(10), '<br>')), ' | ') || ' |' AS line FROM runs) "
    "SELECT * FROM r UNION ALL SELECT 0, '| run_id | run_group | label |' UNION ALL SELECT 1, '| --- | --- | --- |'",
    "k7_images": "SELECT row_number() OVER (ORDER BY file_name COLLATE \"C\", record_id) AS id, file_name, image_width AS width, image_height AS height FROM page_metadata",
    "k7_categories": "SELECT CAST(i AS INT) AS id, n AS name FROM (SELECT unnest(range(1, 8)) AS i, unnest(['handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph']) AS n)",
    "k7_coco": f"""WITH n AS (SELECT row_number() OVER (ORDER BY file_name COLLATE "C", record_id) AS image_id, CAST(image_width AS DOUBLE) AS w, CAST(image_height AS DOUBLE) AS h, regions FROM page_metadata),
e AS (SELECT image_id, w, h, unnest(range(len(regions))) AS i, unnest(regions) AS r FROM n),
c AS (SELECT *, list_position(['handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph'], lower({_S.format('r.type')})) AS k, greatest(0e0, least(w - 2, r.bbox[1])) AS x, greatest(0e0, least(h - 2, r.bbox[2])) AS y
  FROM e WHERE len(r.bbox) = 4 AND len(list_filter(r.bbox, lambda v: v IS NULL)) = 0),
s AS (SELECT *, greatest(1e0, least(r.bbox[3] - r.bbox[1], w - x)) AS bw, greatest(1e0, least(r.bbox[4] - r.bbox[2], h - y)) AS bh FROM c WHERE k > 0)
SELECT row_number() OVER (ORDER BY image_id, i) AS id, image_id, CAST(k AS INT) AS category_id, [round(x, 2), round(y, 2), round(bw, 2), round(bh, 2)] AS bbox, round(bw * bh, 2) AS area, CAST(0 AS INT) AS iscrowd, CAST(i AS INT) AS region_idx_in_image FROM s WHERE bw > 1 AND bh > 1""",
    "k10_violations": f"""WITH g AS (SELECT row_id, CASE WHEN json_valid(regions) AND json_type(regions::JSON) = 'ARRAY' THEN CAST(regions AS JSON) END AS j FROM sample_submission),
e AS (SELECT row_id, CAST(i AS INT) AS i, json_extract(j, '$[' || i || ']') AS r FROM (SELECT *, unnest(range(json_array_length(j)::BIGINT)) AS i FROM g WHERE j IS NOT NULL)),
v AS (SELECT row_id, i, CASE WHEN json_type(r) <> 'OBJECT' THEN 'no_object' WHEN list_sort(json_keys(r)) <> ['bbox', 'text', 'type'] THEN 'region_keys'
  WHEN json_type(r, '$.bbox') <> 'ARRAY' OR json_array_length(r, '$.bbox') <> 4 THEN 'bbox_length' WHEN coalesce(json_extract_string(r, '$.type'), '') NOT IN {_KNOWN} THEN 'type' END AS violation FROM e)
SELECT row_id, i AS region_idx, violation FROM v WHERE violation IS NOT NULL UNION ALL SELECT row_id, -1, 'no_list' FROM g WHERE j IS NULL UNION ALL SELECT NULL, -1, 'columns'
UNION ALL SELECT NULL, -1, 'row_count' FROM (SELECT count(*) AS n FROM sample_submission) WHERE n <> (SELECT count(DISTINCT {_NAME}) FROM page_metadata)""",
}
_C = compare.BLANK
SQL["t9_cleaned"] = f"""WITH a AS (SELECT crop_id, {_S.format("coalesce(text, '')")} AS t FROM crop_records),
b AS (SELECT crop_id, CASE WHEN starts_with(t, '```') THEN {_S.format("regexp_replace(" + _S.format("regexp_replace(t, '^```[a-zA-Z]*', '')") + ", '```$', '')")} ELSE t END AS t FROM a),
c AS (SELECT crop_id, {_S.format(f"regexp_replace(t, '(?i)^(?:text|transcription|answer){_C}*:{_C}*', '')".replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")} AS t FROM b),
d AS (SELECT crop_id, CASE WHEN length(t) >= 2 AND ((starts_with(t, chr(39)) AND ends_with(t, chr(39))) OR (starts_with(t, '"') AND ends_with(t, '"'))) THEN {_S.format('substr(t, 2, length(t) - 2)')} ELSE t END AS t FROM c)
SELECT crop_id, left(CASE WHEN starts_with(t, '{{') THEN CASE WHEN json_valid(t) THEN coalesce(json_extract_string(t, '$.text'), '') ELSE '' END WHEN starts_with(t, '[') THEN '' ELSE t END, 500) AS text FROM d"""
#: No document has the marks of a wrong code page, so that there is nothing to repair.
_CLEAN = f"regexp_replace(regexp_replace(coalesce(text, ''), '^{_C}+|{_C}+$', '', 'g'), '{_C}+', ' ', 'g')"
SQL["t13_clean"] = f"SELECT doc_id, md5({_CLEAN}) AS h FROM documents"
SQL["t14_truncated"] = f"""WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(array_to_string(regexp_extract_all(t, '(?s).')[1:57], ''), '{_C}+$', '') || '...' END AS text FROM c"""
_STEPS = [
    ("~~.*?~~\\{(.*?)\\}", "\\1"), ("~~(.*?)~~", "\\1"), None,
    ("[\\x{2010}\\x{2011}\\x{2012}\\x{2013}\\x{2014}\\x{2015}\\x{2212}\\x{fe58}\\x{fe63}\\x{ff0d}]", "-"), ("[_\\-]{3,}", "___"),
    ('["\\x{201c}\\x{201d}\\x{201e}\\x{00ab}\\x{00bb}\\x{2033}]', '"'), ("[''\\x{2018}\\x{2019}\\x{02bc}\\x{2032}]", "''"),
    ("[ \\t\\x{00a0}\\x{2000}-\\x{200b}\\x{3000}]+", " "), (f"\\({_C}+", "("), (f"{_C}+\\)", ")"),
]


def _normalized(steps) -> str:
    x = "coalesce(text, '')"
    for step in steps:
        x = f"translate({x}, '{text.LATIN}', '{text.CYRILLIC}')" if step is None else f"regexp_replace({x}, '{step[0]}', '{step[1]}', 'g')"
    return f"regexp_replace({x}, '^{_C}+|{_C}+$', '', 'g')"


def normalized_sql(column: str) -> str:
    """The first dialect of a text that is neither formula nor table."""
    return _normalized(_STEPS).replace("coalesce(text, '')", f"coalesce({column}, '')")


SQL["t1_text"] = f"{_R} SELECT record_id, idx, {_normalized(_STEPS)} AS v1, " + _normalized([*_STEPS, (" +\\(", "("), (" +([_^])", "\\1")]) + f" AS v2 FROM r WHERE {_TYPE} NOT IN ('formula', 'table')"
SQL["v1_errors"] = f"""WITH x AS ({SQL['s15_errors']}), s AS (SELECT run_id, row_id FROM sample_submission WHERE image IS NOT NULL),
f AS (SELECT DISTINCT {_NAME} AS image FROM page_metadata WHERE regions IS NOT NULL), t AS (SELECT run_id, count(DISTINCT image) AS n FROM sample_submission WHERE image IN (SELECT image FROM f) GROUP BY 1)
SELECT run_id, code, count(*) AS n FROM x JOIN s USING (row_id) GROUP BY 1, 2
UNION ALL SELECT * FROM (SELECT r.run_id, 'missing_image', (SELECT count(*) FROM f) - coalesce(n, 0) AS n FROM (SELECT DISTINCT run_id FROM sample_submission) r LEFT JOIN t USING (run_id)) WHERE n > 0"""
