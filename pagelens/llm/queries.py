"""Queries and SQL of the operators of this subpackage; production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import mixing, overlap, proportions, sentences, tokenizer


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the rounded quotas do not reach."""
    return p1_report(spark, d).where("not met").select("plan_id", "category")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return proportions.report(table(spark, d, "page_metadata"), table(spark, d, "sample_targets"))


def p1_targets(spark: SparkSession, d: str) -> DataFrame:
    """The part of the report that plain SQL can state."""
    return p1_report(spark, d).select("plan_id", "field", "category", "pool", "members", F.round("target", 6).alias("target"), "min_rows", "met")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportions.sample(table(spark, d, "page_metadata"), table(spark, d, "sample_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "page_metadata"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "page_metadata"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """A row a page with text: its class of equal texts and the classes of the other side near it."""
    return overlap.links(table(spark, d, "page_metadata"))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p5_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Decoded again: the texts themselves, null as empty."""
    return tokenizer.decode(tokenizer.encode(table(spark, d, "documents")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.found(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.units(table(spark, d, "documents"))


def p7_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The units with their text, restored."""
    return sentences.sentences(table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Units and their code points by the language named, as delivered."""
    docs = table(spark, d, "documents").select(F.lower("lang").alias("lang"), F.col("text"))
    return sentences.units(docs, "lang").groupBy("lang").agg(
        F.count("*").alias("units"), F.sum(F.col("sent_end") - F.col("sent_start")).alias("code_points")
    )


QUERIES = {f.__name__: f for f in (
    p1_found, p1_report, p1_targets, p1_sample, p3_found, p3_report, p3_links, p5_ids, p5_roundtrip, p6_found, p6_report, p6_mix, p7_found, p7_sentences, p7_report,
)}

_BLANK = r"'^\s+|\s+$', '', 'g'"
_POOLS = f"""
WITH pages AS (SELECT split, file_name, arg_min(coalesce(lower(regexp_replace(source, {_BLANK})), ''), record_id) AS source,
  arg_min(struct_pack(r := regions), record_id).r AS regions FROM page_metadata GROUP BY split, file_name),
pool AS (SELECT 'source' AS field, source AS key FROM pages UNION ALL
  SELECT 'type', coalesce(lower(regexp_replace(r.type, {_BLANK})), '') FROM (SELECT unnest(regions) AS r FROM pages)),
sizes AS (SELECT field, count(*) AS pool FROM pool GROUP BY field),
counts AS (SELECT field, key, count(*) AS members FROM pool GROUP BY field, key),
seen AS (SELECT t.*, s.pool, coalesce(c.members, 0) AS members, t.target_share * t.sample_fraction * s.pool AS target
  FROM sample_targets t JOIN sizes s USING (field)
  LEFT JOIN counts c ON c.field = t.field AND c.key = lower(regexp_replace(t.category, {_BLANK})))
"""

SQL = {
    "p1_found": _POOLS + "SELECT plan_id, category FROM seen WHERE members < target - 1e-9 OR members < min_rows",
    "p1_targets": _POOLS + "SELECT plan_id, field, category, pool, members, round(target, 6) AS target, min_rows, NOT (members < target - 1e-9 OR members < min_rows) AS met FROM seen",
    "p5_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
