"""Queries of whole evaluations, streams and the rest of the reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config
from ..functions import text
from ..operators import frames
from ..operators import quality as Q
from ..operators import runs as R
from ..operators import tables as T
from ..session import shared_folder, table
from ..streaming import ingest
from . import compare, fixture, reports
from .evaluation import _rounded

ORDER = ["full", "routing", "ablation"]


def _evaluated(spark, d):
    scoring = config.from_environment(config.Scoring)
    return R.evaluate(R.solutions(table(spark, d, "page_metadata")), R.predictions(table(spark, d, "sample_submission")), scoring.dialect)


def v1_runs(spark, d):
    """Composite score of every run over all pages with regions."""
    return _rounded(_evaluated(spark, d))


def v1_detection(spark, d):
    """The part of it that needs no text."""
    return _rounded(_evaluated(spark, d)).select("run_id", "det_f1", "det_precision", "det_recall", "class_acc", "matched_regions", "false_positives", "false_negatives")


def v3_table(spark, d):
    return R.formatted(_evaluated(spark, d), table(spark, d, "runs"), ORDER)


def _tables(spark, d):
    pages, sent = table(spark, d, "page_metadata"), table(spark, d, "sample_submission")
    solution = R.solutions(pages)
    groups = {g: g for g in ORDER}
    return T.evaluation(solution, R.predictions(sent), table(spark, d, "runs"), R.errors(sent, solution), groups, "final")


def v3_types(spark, d):
    """Detection of every run by type."""
    solution = R.solutions(table(spark, d, "page_metadata"))
    rows = T.records(solution, R.predictions(table(spark, d, "sample_submission")))
    return _rounded(T.per_type(rows, solution).drop("cer"))


def v3_modules(spark, d):
    """The module table: error rates of the text types and of formulas and tables of one run."""
    return _tables(spark, d)["paper_modules"]


def v4_text(spark, d):
    """Error rates of the text branch of every run as they are printed."""
    return _tables(spark, d)["paper_text"]


def a19_precision(spark, d):
    return _rounded(R.average_precision(fixture.pages(spark, d)))


HINTS = {"dictation": "A dictation.", "archive": "An old document.", "university": "An exam.", "school": "Homework.", "default": "A page."}
PROMPTS = {"formula": "Write down the formula.", "table": "Write down the table, cells parted by bars.", "image": "Say nothing.", "graph": "Say nothing.", "default": "Write down the text."}
RULES = ("Mark what cannot be read.", "Add nothing.")


def t17_prompts(spark, d):
    """Prompts of crops: hint of the source, prompt of the type and rules, a line each."""
    rows = table(spark, d, "crop_records").join(table(spark, d, "collections").select("collection_id", "source"), "collection_id", "left")
    prompt = frames.prompt(F.col("label"), F.col("source"), HINTS, PROMPTS, RULES)
    return rows.groupBy(prompt.alias("prompt")).agg(F.count("*").alias("n"))


def j8_reindexed(spark, d):
    """Every page in the order of its id with what run_01 sent for it, an empty list if nothing."""
    s = Q.keep_last(table(spark, d, "sample_submission").where("run_id = 'run_01' AND image IS NOT NULL").select("image", "submitted_at", "row_id", "regions"), ["image"], ["submitted_at", "row_id"])
    p = table(spark, d, "page_metadata").select("record_id", text.basename(F.col("file_name")).alias("image"))
    return p.join(s, "image", "left").select("record_id", F.coalesce("row_id", F.lit(-1)).alias("row_id"), F.coalesce(F.char_length("regions"), F.lit(2)).alias("chars"))


def j9_open(spark, d):
    """Pages that run_01 has not answered yet."""
    done = table(spark, d, "sample_submission").where("run_id = 'run_01'").select("image")
    p = table(spark, d, "page_metadata").select("record_id", text.basename(F.col("file_name")).alias("image"))
    return p.join(done, "image", "left_anti").select("record_id")


def u4_types(spark, d):
    """Pages whose types meet the structured and visual ones, and how many of them."""
    types = F.array_distinct(F.transform("regions", lambda r: text.normal_type(r["type"])))
    wanted = F.array(*map(F.lit, ("formula", "table", "image", "graph")))
    p = table(spark, d, "page_metadata").select("record_id", types.alias("t")).where(F.arrays_overlap("t", wanted))
    return p.select("record_id", F.size(F.array_intersect("t", wanted)).alias("n"))


def o7_counts(spark, d):
    r = table(spark, d, "page_metadata").select(F.explode("regions").alias("r"))
    return r.groupBy(text.normal_type(F.col("r.type")).alias("type")).agg(F.count("*").alias("n")).orderBy("n", "type")


def _streamed(spark, stream, mode="append"):
    """Run a stream over all that is there; each batch replaces the table it writes to the shared folder."""
    path = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/table")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def _pages_stream(spark, d):
    static = table(spark, d, "page_metadata")
    return spark.readStream.schema(static.schema).parquet(f"{d}/page_metadata*.parquet")


def st_months(spark, d):
    """Pages by month-long windows of their capture, as a stream in complete mode."""
    out = ingest.counts(_pages_stream(spark, d), "captured_at", ["split"], "30 days", "400 days")
    return _streamed(spark, out, "complete").select(F.col("window.start").alias("start"), "split", "rows")


QUERIES = {f.__name__: f for f in (v1_runs, v1_detection, v3_table, v3_types, v3_modules, v4_text, a19_precision, t17_prompts, j8_reindexed, j9_open, u4_types, o7_counts, st_months)}

_NAME = r"regexp_extract(replace(file_name, '\', '/'), '([^/]+)/*$', 1)"
_LAST = "l AS (SELECT run_id, image, max_by(row_id, (submitted_at, row_id)) AS row_id FROM sample_submission WHERE image IS NOT NULL GROUP BY 1, 2)"
_KNOWN = "('handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph')"
_KIND = r"CASE WHEN lower(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')) IN " + _KNOWN + r" THEN lower(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')) ELSE 'handwritten' END"
_DETECTION = f"""WITH RECURSIVE f AS (SELECT {_NAME} AS image, min_by(regions, record_id) AS regions FROM page_metadata WHERE regions IS NOT NULL GROUP BY 1),
g0 AS (SELECT image, unnest(range(len(regions))) AS i, unnest(regions) AS r FROM f),
g AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY i) - 1 AS idx, r.bbox AS b, {_KIND.format('r.type')} AS type FROM g0 WHERE len(list_filter(r.bbox, lambda v: v IS NOT NULL)) = 4),
{_LAST}, s AS (SELECT l.run_id, l.image, CAST(regions AS JSON) AS j FROM l JOIN sample_submission USING (row_id) WHERE json_valid(regions) AND json_type(regions::JSON) = 'ARRAY'),
p0 AS (SELECT run_id, image, i, json_extract(j, '$[' || i || ']') AS r FROM (SELECT *, unnest(range(json_array_length(j)::BIGINT)) AS i FROM s)),
p AS (SELECT run_id, image, row_number() OVER (PARTITION BY run_id, image ORDER BY i) - 1 AS idx, CAST(json_extract(r, '$.bbox') AS DOUBLE[]) AS b, {_KIND.format("json_extract_string(r, '$.type')")} AS type
  FROM p0 WHERE json_type(r, '$.bbox') = 'ARRAY' AND json_array_length(r, '$.bbox') = 4 AND image IN (SELECT image FROM f)),
o AS (SELECT p.run_id, p.image, g.idx AS g, p.idx AS p, g.type = p.type AS hit, greatest(0e0, least(g.b[3], p.b[3]) - greatest(g.b[1], p.b[1])) * greatest(0e0, least(g.b[4], p.b[4]) - greatest(g.b[2], p.b[2])) AS i,
  greatest(0e0, g.b[3] - g.b[1]) * greatest(0e0, g.b[4] - g.b[2]) + greatest(0e0, p.b[3] - p.b[1]) * greatest(0e0, p.b[4] - p.b[2]) AS a FROM g JOIN p ON p.image = g.image),
x AS (SELECT *, row_number() OVER (PARTITION BY run_id, image ORDER BY i / (a - i) DESC, g, p) AS n FROM o WHERE i > 0 AND i / (a - i) >= 0.5e0),
walk AS (SELECT run_id, image, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ps, 0 AS hits FROM (SELECT DISTINCT run_id, image FROM x)
  UNION ALL SELECT w.run_id, w.image, x.n, CASE WHEN list_contains(gs, x.g) OR list_contains(ps, x.p) THEN gs ELSE list_append(gs, x.g) END, CASE WHEN list_contains(gs, x.g) OR list_contains(ps, x.p) THEN ps ELSE list_append(ps, x.p) END,
    CASE WHEN list_contains(gs, x.g) OR list_contains(ps, x.p) OR NOT x.hit THEN hits ELSE hits + 1 END FROM walk w JOIN x ON x.run_id = w.run_id AND x.image = w.image AND x.n = w.n + 1),
e AS (SELECT run_id, image, max_by(len(gs), n) AS tp, max_by(hits, n) AS hits FROM walk GROUP BY 1, 2),
t AS (SELECT run_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(hits) AS BIGINT) AS hits FROM e GROUP BY 1), c AS (SELECT run_id, count(*) AS n FROM p GROUP BY 1),
r AS (SELECT DISTINCT l.run_id FROM l JOIN f USING (image)),
k AS (SELECT run_id, coalesce(tp, 0) AS tp, coalesce(hits, 0) AS hits, coalesce(n, 0) - coalesce(tp, 0) AS fp, (SELECT count(*) FROM g) - coalesce(tp, 0) AS fn FROM r LEFT JOIN t USING (run_id) LEFT JOIN c USING (run_id)),
z AS (SELECT *, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS pr, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS re FROM k)
SELECT run_id, round(2e0 * pr * re / greatest(pr + re, 1e-9), 6) AS det_f1, round(pr, 6) AS det_precision, round(re, 6) AS det_recall, round(hits / CAST(greatest(tp, 1) AS DOUBLE), 6) AS class_acc,
  tp AS matched_regions, fp AS false_positives, fn AS false_negatives FROM z"""

_TYPES = _DETECTION[: _DETECTION.index("e AS (SELECT run_id, image, max_by(len(gs), n)")] + """
e AS (SELECT run_id, image, arg_max(gs, n) AS gs, arg_max(ps, n) AS ps FROM walk GROUP BY 1, 2), m AS (SELECT run_id, image, unnest(gs) AS g, unnest(ps) AS p FROM e),
h AS (SELECT m.run_id, g.type, count(*) AS matched, count(*) FILTER (g.type = p.type) AS hits FROM m JOIN g ON g.image = m.image AND g.idx = m.g JOIN p ON p.run_id = m.run_id AND p.image = m.image AND p.idx = m.p GROUP BY 1, 2),
r AS (SELECT DISTINCT l.run_id FROM l JOIN f USING (image)), k AS (SELECT unnest(['handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph']) AS type),
t AS (SELECT type, count(*) AS n FROM g GROUP BY 1), c AS (SELECT run_id, type, count(*) AS n FROM p GROUP BY 1, 2)
SELECT r.run_id, k.type, coalesce(t.n, 0) AS gt_count, coalesce(c.n, 0) AS pred_count, coalesce(matched, 0) AS matched, round(2e0 * coalesce(matched, 0) / greatest(coalesce(t.n, 0) + coalesce(c.n, 0), 1), 6) AS det_f1,
  CASE WHEN matched > 0 THEN round(hits / CAST(matched AS DOUBLE), 6) END AS class_acc
FROM r JOIN k ON true LEFT JOIN t USING (type) LEFT JOIN c ON c.run_id = r.run_id AND c.type = k.type LEFT JOIN h ON h.run_id = r.run_id AND h.type = k.type"""
SQL = {
    "v1_detection": _DETECTION,
    "v3_types": _TYPES,
    "t17_prompts": f"""WITH r AS (SELECT c.source AS s, {_KIND.format('label')} AS k FROM crop_records LEFT JOIN collections c USING (collection_id)),
p AS (SELECT CASE k WHEN 'formula' THEN 'Write down the formula.' WHEN 'table' THEN 'Write down the table, cells parted by bars.' WHEN 'image' THEN 'Say nothing.' WHEN 'graph' THEN 'Say nothing.' ELSE 'Write down the text.' END AS p, k,
  CASE lower(trim(s)) WHEN 'dictation' THEN 'A dictation.' WHEN 'archive' THEN 'An old document.' WHEN 'university' THEN 'An exam.' WHEN 'school' THEN 'Homework.' ELSE 'A page.' END AS h FROM r)
SELECT CASE WHEN k IN ('image', 'graph') THEN p ELSE h || chr(10) || p || chr(10) || 'Mark what cannot be read.' || chr(10) || 'Add nothing.' END AS prompt, count(*) AS n FROM p GROUP BY 1""",
    "j8_reindexed": f"WITH {_LAST} SELECT p.record_id, coalesce(l.row_id, -1) AS row_id, CAST(coalesce(length(s.regions), 2) AS INT) AS chars FROM (SELECT record_id, {_NAME} AS image FROM page_metadata) p "
    "LEFT JOIN l ON l.image = p.image AND l.run_id = 'run_01' LEFT JOIN sample_submission s ON s.row_id = l.row_id",
    "j9_open": f"SELECT record_id FROM page_metadata WHERE {_NAME} NOT IN (SELECT image FROM sample_submission WHERE run_id = 'run_01' AND image IS NOT NULL)",
    "u4_types": f"WITH e AS (SELECT record_id, unnest(regions) AS r FROM page_metadata), k AS (SELECT DISTINCT record_id, {_KIND.format('r.type')} AS t FROM e) "
    "SELECT record_id, CAST(count(*) AS INT) AS n FROM k WHERE t IN ('formula', 'table', 'image', 'graph') GROUP BY record_id",
    "o7_counts": f"WITH e AS (SELECT unnest(regions) AS r FROM page_metadata) SELECT {_KIND.format('r.type')} AS type, count(*) AS n FROM e GROUP BY 1",
    "st_months": "SELECT CAST(time_bucket(INTERVAL 30 DAYS, captured_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS TIMESTAMPTZ) AS start, split, count(*) AS rows FROM page_metadata WHERE captured_at IS NOT NULL GROUP BY 1, 2",
}

_AT = fixture.WITH_PRED.replace("WITH", "WITH RECURSIVE", 1) + """,
o AS (SELECT g.page, g.idx AS g, p.idx AS p, p.score, greatest(0e0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0e0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i,
  (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS a FROM gt g JOIN pred p ON p.page = g.page AND p.type = g.type),
x AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, i / (a - i) DESC, g, p) AS n FROM o WHERE i > 0 AND i / (a - i) >= 0.5e0),
walk AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS gs, CAST([] AS INT[]) AS ps FROM (SELECT DISTINCT page FROM x)
  UNION ALL SELECT w.page, x.n, CASE WHEN list_contains(gs, x.g) OR list_contains(ps, x.p) THEN gs ELSE list_append(gs, x.g) END, CASE WHEN list_contains(gs, x.g) OR list_contains(ps, x.p) THEN ps ELSE list_append(ps, x.p) END
  FROM walk w JOIN x ON x.page = w.page AND x.n = w.n + 1),
h AS (SELECT page, unnest(arg_max(ps, n)) AS p FROM walk GROUP BY page),
n AS (SELECT type, score, count(h.p) AS tp, count(*) AS n FROM pred LEFT JOIN h ON h.page = pred.page AND h.p = pred.idx GROUP BY 1, 2),
t AS (SELECT type, count(*) AS truths FROM gt GROUP BY 1),
c AS (SELECT n.type, score, sum(tp) OVER w / CAST(truths AS DOUBLE) AS recall, sum(tp) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS precision FROM n JOIN t USING (type) WINDOW w AS (PARTITION BY n.type ORDER BY score DESC)),
s AS (SELECT type, max(precision) OVER (PARTITION BY type ORDER BY score) * (recall - coalesce(lag(recall) OVER (PARTITION BY type ORDER BY score DESC), 0e0)) AS area FROM c)
"""
SQL["a19_precision"] = _AT + "SELECT type, truths, round(coalesce((SELECT sum(area) FROM s WHERE s.type = t.type), 0e0), 6) AS ap FROM t"

_SAID = _TYPES.replace("AS type FROM g0", "AS type, coalesce(r.text, '') AS text, coalesce(r.language, 'uk') AS language, coalesce(r.legibility, 'legible') AS legibility FROM g0").replace(
    " AS type\n  FROM p0", " AS type, coalesce(json_extract_string(r, '$.text'), '') AS text\n  FROM p0"
)
_NORM = lambda c: reports.normalized_sql(c)
SQL["v4_text"] = _SAID[: _SAID.index("h AS (SELECT m.run_id, g.type")] + f"""
d0 AS (SELECT m.run_id, g.type, {_NORM('p.text')} AS a, {_NORM('g.text')} AS b FROM m JOIN g ON g.image = m.image AND g.idx = m.g JOIN p ON p.run_id = m.run_id AND p.image = m.image AND p.idx = m.p
  WHERE g.type IN ('handwritten', 'printed', 'annotation') AND g.language <> 'other' AND g.legibility <> 'illegible'),
d AS (SELECT *, ({compare.chars('a', 'b')}) / CAST(greatest(length(b), 1) AS DOUBLE) AS cer, {compare.wer('a', 'b')} AS wer FROM d0)
SELECT coalesce(any_value(label), run_id) AS label, count(*) AS n, """ + ", ".join(
    f"coalesce(printf('%.4f', {v}), '') AS {c}" for c, v in {
        "overall_cer": "avg(cer)", "handwritten_cer": "avg(cer) FILTER (type = 'handwritten')", "printed_cer": "avg(cer) FILTER (type = 'printed')", "annotation_cer": "avg(cer) FILTER (type = 'annotation')",
        "overall_wer": "avg(wer)", "exact_match": "avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END)",
    }.items()
) + " FROM d LEFT JOIN runs USING (run_id) GROUP BY run_id"
