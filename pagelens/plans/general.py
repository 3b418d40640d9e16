"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, rejects
from ..session import table


def _nodes(spark: SparkSession, d: str, values: bool = True, rest: bool = False) -> DataFrame:
    pages = nested.label(table(spark, d, "page_metadata"), "page_metadata", "record_id", values=values, rest=rest)
    sent = nested.label(table(spark, d, "sample_submission"), "sample_submission", "row_id", values=values, rest=rest)
    return pages.unionByName(sent)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(_nodes(spark, d, values=False))


def _flat(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat(_nodes(spark, d), kind)

    return query


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    """The rows of both tables as nodes, with their own columns; null where a table has none."""
    pages = nested.pages(table(spark, d, "page_metadata"), "page_metadata", "record_id")
    return pages.unionByName(nested.pages(table(spark, d, "sample_submission"), "sample_submission", "row_id"), allowMissingColumns=True)


def p2_rest(spark: SparkSession, d: str) -> DataFrame:
    """What the tables of the types have no column for, by the labels of its object."""
    return _nodes(spark, d, values=False, rest=True).where("rest IS NOT NULL")


def p2_parents(spark: SparkSession, d: str) -> DataFrame:
    """Nodes below regions, by type of the node and of its region, linked by containment."""
    nodes = _nodes(spark, d, values=False)
    regions = nodes.where("node_type = 'region'")
    inside = nested.below(nodes.where("level > 1"), regions)
    return inside.groupBy("table_name", "node_type", "level").agg(
        F.count("*").alias("nodes"), F.count_distinct("record_id", "ancestor_pre").alias("regions")
    )


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load(table(spark, d, "submission_lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(_loaded(spark, d))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.valid(_loaded(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).groupBy("csv_file", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("records"))


QUERIES = {
    "p2_found": p2_found,
    "p2_pages": p2_pages,
    "p2_regions": _flat("region"),
    "p2_alternatives": _flat("alternative"),
    "p2_marks": _flat("mark"),
    "p2_children": _flat("child"),
    "p2_rest": p2_rest,
    "p2_parents": p2_parents,
    "p4_found": p4_found,
    "p4_loaded": p4_loaded,
    "p4_report": p4_report,
}
_NODES = """
WITH RECURSIVE given AS (
  SELECT 'page_metadata' AS t, record_id AS id, to_json(regions) AS j FROM page_metadata WHERE regions IS NOT NULL
  UNION ALL SELECT 'sample_submission', row_id, CAST(regions AS JSON) FROM sample_submission WHERE regions <> '' AND json_valid(regions)),
places AS (SELECT *, unnest(range(CASE json_type(j) WHEN 'ARRAY' THEN json_array_length(j)::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS i FROM given),
nodes(t, id, path, kind, level, position, above, here, o) AS (
  SELECT t, id, CAST(i AS VARCHAR), 'region', 1, CAST(i AS INT), '', lpad(CAST(i AS VARCHAR), 8, '0'), CASE json_type(j) WHEN 'OBJECT' THEN j ELSE json_extract(j, '$[' || i || ']') END FROM places
  UNION ALL
  SELECT t, id, path || '/' || name || '/' || i, CASE name WHEN 'alternatives' THEN 'alternative' WHEN 'marks' THEN 'mark' ELSE 'child' END,
    level + 1, CAST(i AS INT), here, here || CASE name WHEN 'alternatives' THEN 'a' WHEN 'marks' THEN 'b' ELSE 'c' END || lpad(CAST(i AS VARCHAR), 8, '0'), CASE json_type(x) WHEN 'OBJECT' THEN x ELSE json_extract(x, '$[' || i || ']') END
  FROM (SELECT *, unnest(range(CASE json_type(x) WHEN 'ARRAY' THEN json_array_length(x)::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS i
    FROM (SELECT *, json_extract(o, '$.' || name) AS x FROM (SELECT *, unnest(['alternatives', 'marks', 'children']) AS name FROM nodes WHERE json_type(o) = 'OBJECT')))),
objects AS (SELECT * FROM nodes WHERE json_type(o) = 'OBJECT')
"""
#: Interval labels without a traversal: the k-th node in pre-order at level L is entered at 2k - L.
_LABELLED = _NODES + """, k AS (SELECT *, row_number() OVER (PARTITION BY t, id ORDER BY here) * 2 - level AS pre FROM objects),
d AS (SELECT a.t, a.id, a.here, count(*) - 1 AS n FROM objects a JOIN objects b ON b.t = a.t AND b.id = a.id AND starts_with(b.here, a.here) GROUP BY ALL),
f AS (SELECT k.*, k.pre + 2 * d.n + 1 AS post, coalesce(p.pre, 0) AS parent_pre FROM k JOIN d ON d.t = k.t AND d.id = k.id AND d.here = k.here
  LEFT JOIN k p ON p.t = k.t AND p.id = k.id AND p.here = k.above)
SELECT t AS table_name, id AS record_id, path, CAST(pre AS BIGINT) AS pre, CAST(post AS BIGINT) AS post, CAST(level AS INT) AS level,
  CAST(parent_pre AS BIGINT) AS parent_pre, position, """
_TEXTS = lambda *names: ", ".join(f"json_extract_string(o, '$.{n}') AS {n}" for n in names)
_BOXED = "CAST(json_extract(o, '$.bbox') AS DOUBLE[]) AS bbox, " + _TEXTS("type", "language", "legibility", "text") + ", CAST(json_extract(o, '$.score') AS DOUBLE) AS score FROM f WHERE kind = "
_PAGE = "SELECT '{0}' AS table_name, {1} AS record_id, '' AS path, CAST(0 AS BIGINT) AS pre, CAST(2 * coalesce(n, 0) + 1 AS BIGINT) AS post, CAST(0 AS INT) AS level, " \
    "CAST(NULL AS BIGINT) AS parent_pre, CAST(0 AS INT) AS position, {0}.* EXCLUDE ({1}, regions) FROM {0} LEFT JOIN n ON t = '{0}' AND id = {1}"  # fmt: skip
_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_BARE = lambda k: f"""CASE WHEN starts_with(regexp_extract(r, '(?s)^{_FIELD},{_FIELD}$', {k}), '"') THEN replace(substr(regexp_extract(r, '(?s)^{_FIELD},{_FIELD}$', {k}), 2, length(regexp_extract(r, '(?s)^{_FIELD},{_FIELD}$', {k})) - 2), '""', '"') ELSE regexp_extract(r, '(?s)^{_FIELD},{_FIELD}$', {k}) END"""
#: Strict records by patterns and JSON functions instead of a reader; its JSON takes constants and trailing commas, which are ruled out apart.
_CSV = f"""WITH given AS (SELECT line_id, csv_file, regexp_replace(coalesce(raw, ''), '\\r$', '') AS r FROM submission_lines WHERE line_no <> 1),
parsed AS (SELECT *, NOT regexp_full_match(r, '(?s){_FIELD}(,{_FIELD})*') AS torn, NOT regexp_full_match(r, '(?s){_FIELD},{_FIELD}') AS uneven, {_BARE(1)} AS image, {_BARE(2)} AS regions FROM given),
typed AS (SELECT *, regexp_full_match(image, '(?is).+\\.(jpg|jpeg|png)') AS named, regexp_replace(regions, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g') AS bare, CASE WHEN regions <> '' AND json_valid(regions) AND NOT regexp_matches(bare, '(?i)nan|inf|/|,\\s*[\\]}}]') THEN CAST(regions AS JSON) END AS j FROM parsed),
judged AS (SELECT line_id, csv_file, image, regions, CASE WHEN torn THEN 'quoting' WHEN uneven THEN 'columns' WHEN NOT named OR (regions <> '' AND (j IS NULL OR json_type(j) <> 'ARRAY' OR
  len(list_filter(CAST(CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE '[]' END AS JSON[]), lambda x: coalesce(json_type(x), '') <> 'OBJECT' OR coalesce(json_type(x, '$.bbox'), '') <> 'ARRAY' OR json_array_length(x, '$.bbox') <> 4
    OR len(list_filter(CAST(CASE WHEN json_type(x, '$.bbox') = 'ARRAY' THEN json_extract(x, '$.bbox') ELSE '[]' END AS JSON[]), lambda v: coalesce(json_type(v), '') NOT IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE'))) > 0
    OR (json_type(x, '$.type') IS NOT NULL AND (json_type(x, '$.type') <> 'VARCHAR' OR json_extract_string(x, '$.type') NOT IN ('handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph'))))) > 0)) THEN 'value' END AS reason FROM typed) """
SQL = {
    "p2_pages": _NODES + ", n AS (SELECT t, id, count(*) AS n FROM objects GROUP BY ALL) " + _PAGE.format("page_metadata", "record_id") + " UNION ALL BY NAME " + _PAGE.format("sample_submission", "row_id"),
    "p2_regions": _LABELLED + _BOXED + "'region'",
    "p2_children": _LABELLED + _BOXED + "'child'",
    "p2_alternatives": _LABELLED + _TEXTS("text", "annotation_source") + ", CAST(json_extract(o, '$.score') AS DOUBLE) AS score FROM f WHERE kind = 'alternative'",
    "p2_marks": _LABELLED + _TEXTS("kind") + ", CAST(json_extract(o, '$.pos') AS BIGINT) AS pos, CAST(json_extract(o, '$.len') AS BIGINT) AS len FROM f WHERE f.kind = 'mark'",
    "p2_found": _NODES + "SELECT t AS table_name, id AS record_id, path FROM objects WHERE level > 1",
    "p2_parents": _NODES + "SELECT t AS table_name, kind AS node_type, CAST(level AS INT) AS level, count(*) AS nodes, "
    "count(DISTINCT id || ' ' || split_part(path, '/', 1)) AS regions FROM objects WHERE level > 1 GROUP BY ALL",
    "p4_found": _CSV + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": _CSV + "SELECT line_id, image, regions, CAST(CASE WHEN regions = '' THEN 0 ELSE json_array_length(regions) END AS INT) AS n_regions FROM judged WHERE reason IS NULL",
    "p4_report": _CSV + "SELECT csv_file, coalesce(reason, 'loaded') AS outcome, count(*) AS records FROM judged GROUP BY 1, 2",
}
