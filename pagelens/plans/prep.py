"""Queries of data preparation: splits, samples, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import frames
from ..operators import sampling as S
from ..session import table

def _label():
    return F.lower(text.strip(F.col("label")))


def crops(spark, d):
    return table(spark, d, "crop_records").select("crop_id", "image", F.coalesce(_label(), F.lit("")).alias("label"), "text", "source_split", "collection_id")


def pages(spark, d):
    """One row a page with normalized source and the types of its regions."""
    p = table(spark, d, "page_metadata")
    types = F.transform(F.col("regions.type"), lambda t: F.lower(text.strip(t)))
    return p.select("record_id", "split", "file_name", F.coalesce(F.lower(text.strip(F.col("source"))), F.lit("unknown")).alias("source"), "collection_id",
                    F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda t: t.isin(*S.HEAD, *S.MID, *S.TAIL)).alias("types"))


def r1_split(spark, d):
    return S.stratified(crops(spark, d), ["label"], ["crop_id"], 0.1).select("crop_id", "label", "split")


def r2_split_source(spark, d):
    return S.stratified(pages(spark, d), ["source"], ["record_id"], 0.12).select("record_id", "source", "split")


def r3_three_way(spark, d):
    return S.three_way(pages(spark, d).drop("split"), ["source"], ["record_id"]).select("record_id", "source", "split")


def r4_without_leaks(spark, d):
    return S.without_leaks(pages(spark, d).drop("split")).select("record_id", "base", "split")


def r4_literal(spark, d):
    return S.without_leaks(pages(spark, d).drop("split"), literal=True).select("record_id", "base", "split")


def r6_cap(spark, d):
    return S.cap(crops(spark, d), ["label"], ["crop_id"], 300).select("crop_id", "label")


def r7_balanced(spark, d):
    return S.balanced(crops(spark, d), ["source_split", "label"], ["crop_id"], 2000).select("crop_id", "source_split", "label")


def _counted(spark, d):
    return S.class_counts(pages(spark, d))


def r8_plan(spark, d):
    p = S.augmentation_plan(_counted(spark, d), ["record_id"])
    return p.select("record_id", "repeats", "pipeline", F.round("score", 6).alias("score"))


def r9_silver(spark, d):
    p = S.silver_score(_counted(spark, d).where("split = 'silver'"))
    return p.select("record_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "record_id").limit(300)


def r10_augmented(spark, d):
    p = S.augmented(S.augmentation_plan(_counted(spark, d), ["record_id"]))
    return p.select("record_id", "copy", "new_name")


def r11_samples(spark, d):
    """Pages and crops as one table of samples, each part capped."""
    p = S.balanced(pages(spark, d).where("size(types) > 0"), ["source"], ["record_id"], 200).select(F.lit("page_json").alias("task"), F.col("record_id").alias("id"), F.col("source").alias("bucket"))
    c = S.balanced(crops(spark, d).where(text.sane(F.col("text"))), ["label"], ["crop_id"], 500).select(F.lit("crop_ocr").alias("task"), F.col("crop_id").alias("id"), F.col("label").alias("bucket"))
    return p.unionByName(c)


def r12_shared(spark, d):
    return S.shared_keys(pages(spark, d), "collection_id", F.col("split").isin("train", "silver"))


def r13_annotators(spark, d):
    """Pages by who annotated them, with a weight for each."""
    a = F.coalesce("annotation_source", F.lit("unknown"))
    w = F.when(a == "annotator", 1.0).when(a == "volunteer", 0.8).otherwise(0.5)
    return table(spark, d, "page_metadata").groupBy(a.alias("annotation_source")).agg(F.count("*").alias("pages"), F.round(F.sum(w), 3).alias("weight"))


def w9_chunks(spark, d):
    """Pages of each split in eight chunks of near equal size, in the order of their ids."""
    p = frames.numbered(table(spark, d, "page_metadata").select("record_id", "split"), ["split", "record_id"], "n", 0)
    per = p.groupBy("split").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    chunk = F.floor((F.col("n") - F.col("first")) / F.ceil(F.col("size") / 8)).cast("int")
    return p.join(per, "split").select("record_id", "split", chunk.alias("chunk"))


QUERIES = {f.__name__: f for f in (
    r1_split, r2_split_source, r3_three_way, r4_without_leaks, r4_literal, r6_cap, r7_balanced, r8_plan, r9_silver, r10_augmented, r11_samples, r12_shared, r13_annotators, w9_chunks,
)}

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CROPS = f"c AS (SELECT crop_id, image, coalesce(lower({_TRIM.format('label')}), '') AS label, text, source_split FROM crop_records)"
_PAGES = f"""p AS (SELECT record_id, split, file_name, collection_id, coalesce(lower({_TRIM.format('source')}), 'unknown') AS source,
  list_filter(list_transform(coalesce(regions, []), lambda r: lower({_TRIM.format('r.type')})), lambda t: t IN ('handwritten', 'formula', 'printed', 'annotation', 'table', 'image', 'graph')) AS types FROM page_metadata)"""
_SANE = f"""({_TRIM.format("coalesce(text, '')")} <> '' AND length(coalesce(text, '')) <= 260 AND NOT contains(coalesce(text, ''), chr(65533)) AND NOT coalesce(list_bool_or(list_transform(
  list_distinct(string_split(text, '')), lambda c: contains(text, repeat(c, 11)))), false))"""
_BASE = r"regexp_replace(regexp_extract(replace(file_name, '\', '/'), '([^/]+)/*$', 1), '{}', '', 'g')"
_COUNTED = _PAGES + """, n AS (SELECT *, len(types) AS boxes, """ + ", ".join(f"len(list_filter(types, lambda t: t = '{t}')) AS n_{t}" for t in (*S.HEAD, *S.MID, *S.TAIL)) + """ FROM p),
k AS (SELECT *, n_handwritten + n_formula AS head, n_printed + n_annotation + n_table AS mid, n_image + n_graph AS tail FROM n),
q AS (SELECT *, CASE WHEN boxes > 0 THEN tail / CAST(boxes AS DOUBLE) ELSE 0e0 END AS rare, CASE WHEN boxes > 0 THEN head / CAST(boxes AS DOUBLE) ELSE 0e0 END AS dom,
  instr('0123456789abcdef', right(md5('42:' || record_id), 1)) % 2 = 0 AS odd FROM k),
plan AS (SELECT *, boxes = 0 OR (dom >= 0.8 AND tail <= 1) AS skip, tail * 3e0 + mid * 1.2e0 + rare * 8e0 + n_image * 2e0 + n_graph * 3e0 - dom * 6e0
  - greatest(0, n_handwritten - 20) * 0.15e0 - greatest(0, n_formula - 10) * 0.2e0 AS s FROM q),
done AS (SELECT *, CASE WHEN skip THEN 0 WHEN tail > 0 AND rare >= 0.1 THEN 3 + CAST(odd AS INT) WHEN tail > 0 OR mid > 5 THEN 1 + CAST(odd AS INT) WHEN n_handwritten >= 15 THEN 1 WHEN s > 0 THEN CAST(odd AS INT) ELSE 0 END AS repeats,
  CASE WHEN skip THEN 'aug_light' WHEN tail > 0 THEN 'aug_rare' WHEN mid > 5 OR n_handwritten >= 15 THEN 'aug_dense' ELSE 'aug_light' END AS pipeline FROM plan)"""


def _split(table_, ids, stratum, ratio):
    return f"""r AS (SELECT *, count(*) OVER (PARTITION BY {stratum}) AS n, row_number() OVER (PARTITION BY {stratum} ORDER BY md5('42:' || {ids}), {ids}) AS k FROM {table_})
SELECT {ids}, {stratum}, CASE WHEN n > 1 AND k <= least(n - 1, greatest(1, CAST(round_even(n * {ratio}e0, 0) AS BIGINT))) THEN 'val' ELSE 'train' END AS split FROM r"""


def _leaks(pattern):
    return f"""WITH b AS (SELECT record_id, file_name, {_BASE.format(pattern)} AS base FROM page_metadata),
k AS (SELECT base, row_number() OVER (ORDER BY md5('42:' || base), base) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT base FROM b)),
s AS (SELECT base, CASE WHEN k <= floor(n * 0.85e0 + 1e-9) THEN 'train' ELSE 'val' END AS split FROM k)
SELECT record_id, base, split FROM b JOIN s USING (base) WHERE split = 'train' OR NOT regexp_matches(file_name, '_aug[0-9]+')"""


def _turns(table_, ids, bucket, take):
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {bucket} ORDER BY md5('42:' || {ids}), {ids}) AS k FROM {table_}) ORDER BY k, {bucket} LIMIT {take})"""


SQL = {
    "r1_split": f"WITH {_CROPS}, " + _split("c", "crop_id", "label", "0.1"),
    "r2_split_source": f"WITH {_PAGES}, " + _split("p", "record_id", "source", "0.12"),
    "r3_three_way": f"WITH {_PAGES}, r AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('1089:' || record_id), record_id) AS k FROM p) "
    "SELECT record_id, source, CASE WHEN k <= round_even(n * 0.15e0, 0) THEN 'val' WHEN k <= 2 * round_even(n * 0.15e0, 0) THEN 'test' ELSE 'train' END AS split FROM r",
    "r4_without_leaks": _leaks("(?:_(?:aug_)?(?:light|dense|rare|heavy|mix))?_aug[0-9]+"),
    "r4_literal": _leaks("_aug[0-9]+"),
    "r6_cap": f"WITH {_CROPS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || crop_id), crop_id) AS k FROM c) SELECT crop_id, label FROM r WHERE k <= 300",
    "r7_balanced": f"WITH {_CROPS} SELECT crop_id, source_split, label FROM {_turns('c', 'crop_id', 'source_split, label', 2000)}",
    "r8_plan": f"WITH {_COUNTED} SELECT record_id, repeats, pipeline, CASE WHEN NOT skip THEN round(s, 6) END AS score FROM done",
    "r9_silver": f"WITH {_COUNTED}, v AS (SELECT record_id, n_graph * 5e0 + n_image * 4e0 + n_table * 1.5e0 + n_annotation + rare * 10e0 - dom * 6e0 - greatest(0, n_handwritten - 20) * 0.15e0 - greatest(0, n_formula - 10) * 0.2e0 AS s "
    "FROM plan WHERE split = 'silver' AND NOT skip) SELECT record_id, round(s, 6) AS score FROM v ORDER BY round(s, 6) DESC, record_id LIMIT 300",
    "r10_augmented": f"WITH {_COUNTED}, f AS (SELECT *, regexp_extract(replace(file_name, '\\', '/'), '([^/]+)/*$', 1) AS b, unnest(range(1, repeats + 1)) AS c FROM done) "
    "SELECT record_id, CAST(c AS INT) AS copy, regexp_extract(b, '^(.*?)(\\.[^.]*)?$', 1) || '_' || pipeline || '_aug' || lpad(CAST(c AS VARCHAR), 3, '0') || regexp_extract(b, '(\\.[^.]*)?$', 1) AS new_name FROM f",
    "r12_shared": "SELECT collection_id, count(*) FILTER (split IN ('train', 'silver')) AS train_rows, count(*) FILTER (split NOT IN ('train', 'silver')) AS other_rows FROM page_metadata "
    "WHERE collection_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (split IN ('train', 'silver')) > 0 AND count(*) FILTER (split NOT IN ('train', 'silver')) > 0",
    "r13_annotators": "SELECT coalesce(annotation_source, 'unknown') AS annotation_source, count(*) AS pages, "
    "round(sum(CASE annotation_source WHEN 'annotator' THEN 1e0 WHEN 'volunteer' THEN 0.8e0 ELSE 0.5e0 END), 3) AS weight FROM page_metadata GROUP BY 1",
    "w9_chunks": "SELECT record_id, split, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY record_id) - 1) / ceil(count(*) OVER (PARTITION BY split) / 8e0)) AS INT) AS chunk FROM page_metadata",
    "r11_samples": f"WITH {_CROPS}, {_PAGES}, q AS (SELECT * FROM p WHERE len(types) > 0), ok AS (SELECT * FROM c WHERE {_SANE}) "
    f"SELECT 'page_json' AS task, record_id AS id, source AS bucket FROM {_turns('q', 'record_id', 'source', 200)} UNION ALL SELECT 'crop_ocr', crop_id, label FROM {_turns('ok', 'crop_id', 'label', 500)}",
}
