"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import PAGE

#: Words in a file name that say it is no submission (fixed values).
NOT_SUBMISSIONS = "summary|metrics|per_type|per_source|details"
#: What a CSV reader of data frames takes for a missing value (fixed values).
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def pages(spark: SparkSession, path: str | list[str], strict: bool = True, schema: str = PAGE) -> DataFrame:
    """Pages of JSON lines; blank lines are skipped.

    ``strict`` fails on a broken line; otherwise its text is in ``broken`` and its
    fields are null.  Missing fields are null, extra ones ignored.
    """
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(f"{schema}, broken string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="broken")


def objects(spark: SparkSession, path: str | list[str], schema: str = PAGE) -> DataFrame:
    """Pages of JSON lines, only the lines that are objects."""
    lines = spark.read.text(path).where(F.json_object_keys("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def submissions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``image, regions, path`` of submission CSV files; a missing value of regions is ``[]``.

    Line breaks in quotations and byte order marks are read over.  The two columns are
    found by the header; a file without them fails.  A file is one task's work; very large
    ones are read in splits by :func:`records_of_files` and ``operators.rejects.load``.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", enforceSchema=False)
    named = {c.lstrip("\ufeff").strip('"'): c for c in rows.columns}
    if not {"image", "regions"} <= set(named):
        raise ValueError(f"columns image and regions are wanted, there are {sorted(named)}")
    value = F.col(f"`{named['regions']}`")
    regions = F.when(value.isNull() | value.isin(*MISSING), "[]").otherwise(value)
    return rows.select(F.col(f"`{named['image']}`").alias("image"), regions.alias("regions"), F.col("_metadata.file_path").alias("path"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, name`` of the files below a folder; contents are not read, empty files not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", text.basename(F.col("path")).alias("name"))


def submission_files(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    """CSV files below a folder that are submissions, by name, or ``every`` one; in order of path."""
    files = listing(spark, root, "*.csv").dropDuplicates(["path"])
    if not every:
        files = files.where(F.lower("name").contains("submission") & ~F.lower("name").rlike(NOT_SUBMISSIONS))
    return files.withColumn("run_id", run_id(F.col("path"))).orderBy("path")


def run_id(path: Column) -> Column:
    """Run of a submission file: its stem without suffix, or its folder if that says nothing."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.csv$", "")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return F.when(stem == "submission", folder).otherwise(F.regexp_replace(stem, "_submission$", ""))


def run_label(run: Column, labels: dict[str, str] | None = None) -> Column:
    """Label of a run: one that is given, or the id without leading number, separators as spaces."""
    made = text.strip(F.translate(F.regexp_replace(run, r"^\d+[_-]", ""), "_-", "  "))
    if not labels:
        return made
    return F.coalesce(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[run], made)


def images(spark: SparkSession, root: str, metadata: str = "metadata.jsonl") -> DataFrame:
    """``path, name`` of the images of a folder: those its metadata lists, else the image files below it, in order of path.

    Files are looked for below ``images`` if there is such a folder.
    """
    files = listing(spark, root)
    named = files.where(F.col("name") == metadata).select(F.col("path").alias("at"))
    at = named.where(F.regexp_replace("at", "/[^/]*$", "").endswith(root.rstrip("/"))).first()  # one file or none
    if at:
        listed = objects(spark, at["at"]).select(F.col("file_name").alias("path"))
        if not listed.isEmpty():
            return listed.withColumn("name", text.basename(F.col("path")))
    found = files.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*IMAGES))
    inner = found.where(F.col("path").contains(root.rstrip("/") + "/images/"))
    return (inner if not inner.isEmpty() else found).orderBy("path")


def prompts(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """Prompts by type: the defaults, overridden by the ``crop_prompts`` of a JSON file if there is one."""
    try:
        found = spark.read.text(path, wholetext=True).select(F.from_json("value", "crop_prompts map<string,string>").alias("c")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return dict(defaults)
    return defaults | ((found["c"]["crop_prompts"] if found and found["c"] else None) or {})


def page_regions(pages: DataFrame) -> DataFrame:
    """A row a region: ``image, width, height, source, region_idx, x1, y1, x2, y2, type, text, language, legibility``.

    A page without regions has a row with null values.  Sizes default to 1; boxes are
    cut to the page, widths taken for corners where they are inverted, missing ones
    the unit box; texts are cleaned.
    """
    from ..functions import geometry as G

    image = text.basename(text.first_of(F.col("file_name")))
    size = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(1)).cast("double")
    rows = pages.select(image.alias("image"), size("image_width").alias("width"), size("image_height").alias("height"), F.coalesce("source", F.lit("")).alias("source"), F.posexplode_outer("regions").alias("region_idx", "r"))
    box = F.when(F.size("r.bbox") == 4, F.col("r.bbox")).otherwise(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))
    b = G.clamp_guess(G.from_array(box), F.col("width"), F.col("height"))
    rows = rows.withColumn("b", F.when(F.col("r").isNotNull(), b))
    keep = lambda c, d: F.when(F.col("r").isNotNull(), F.coalesce(f"r.{c}", F.lit(d)))
    return rows.select(
        "image", "width", "height", "source", "region_idx", *(F.col(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")),
        text.strip(keep("type", "")).alias("type"), F.when(F.col("r").isNotNull(), text.clean(F.col("r.text"))).alias("text"),
        keep("language", "uk").alias("language"), keep("legibility", "legible").alias("legibility"),
    )


def resolve(rows: DataFrame, files: DataFrame, key: str, candidates: list[Column]) -> DataFrame:
    """``key, path``: the first candidate that is among the files, else the first of all."""
    tried = rows.select(key, F.posexplode(F.array(*candidates)).alias("rank", "path"))
    known = files.select("path").distinct().withColumn("there", F.lit(True))
    order = F.struct((~F.coalesce("there", F.lit(False))).alias("absent"), "rank")
    return tried.where("path IS NOT NULL").join(known, "path", "left").groupBy(key).agg(F.min_by("path", order).alias("path"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Prepared samples of JSON lines."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def records_of_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``csv_file, line_no, raw`` of raw CSV files, records assembled quote-aware, in splits.

    Where a record ends depends on what stands before it, but only on whether a
    quotation is open: one pass finds for each split how it ends if it begins outside of
    one and inside; the two answers of a file's splits, a row a split, are put together
    in order; a second pass assembles each split from the state it begins in.  Only the
    records at the edges of splits are brought together.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from ..operators.rejects import assemble, ends_inside
    from ..session import materialize

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def runs(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
        """Stretches of one split: its key and its lines."""
        rows = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        at = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][:-1] != rows[at][:-1]:
                yield rows[at][:-1], [r[-1] for r in rows[at:k]]
                at = k

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}  # a partition's splits
        for b in batches:
            for key, values in runs(b, 0, 1, 2):
                state = seen.setdefault(key, [False, True, 0, 0])  # ends and records completed, begun outside and inside
                for v in values:
                    for k in (0, 1):
                        state[k] = ends_inside(v, state[k])
                        state[2 + k] += not state[k]
        if seen:
            cols = list(zip(*((*key, *v) for key, v in seen.items())))
            types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file", "block", "out", "ins", "n_out", "n_ins"])

    splits = lines.mapInArrow(look, "file string, block bigint, out boolean, ins boolean, n_out bigint, n_ins bigint")
    splits = splits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "out", "ins", "n_out", "n_ins"))).alias("s"))

    def step(acc: Column, s: Column) -> Column:
        entry = F.struct(s["block"].alias("block"), acc["inside"].alias("inside"), acc["n"].alias("before"))
        return F.struct(
            F.when(acc["inside"], s["ins"]).otherwise(s["out"]).alias("inside"),
            (acc["n"] + F.when(acc["inside"], s["n_ins"]).otherwise(s["n_out"])).alias("n"), F.array_append(acc["all"], entry).alias("all"),
        )

    none = F.expr("cast(array() as array<struct<block: bigint, inside: boolean, before: bigint>>)")
    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("n"), none.alias("all"))
    states = materialize(splits.select("file", F.inline(F.aggregate("s", begin, step)["all"])))
    known = lines.join(F.broadcast(states), ["file", "block"])  # a row a split: 128 MB of text each

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, list] = {}  # of each split: state, records completed, lines held, whether they begin in another split

        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file", "block", "n", "raw", "torn"])

        for b in batches:
            rows = []
            for (file, block, inside, before), values in runs(b, 0, 1, 3, 4, 2):
                state = open_.setdefault((file, block), [inside, before, [], inside])
                for v in values:
                    state[2].append(v)
                    state[0] = ends_inside(v, state[0])
                    if not state[0]:
                        rows.append((file, block, state[1], "\n".join(state[2]), state[3]))
                        state[1:] = [state[1] + 1, [], False]
                if len(rows) >= 10_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)
        rest = [(file, block, s[1], "\n".join(s[2]), True) for (file, block), s in open_.items() if s[2]]
        if rest:
            yield out(rest)

    pieces = known.select("file", "block", "value", "inside", "before").mapInArrow(cut, "file string, block bigint, n bigint, raw string, torn boolean")
    torn = pieces.where("torn").groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    whole = pieces.where("NOT torn").select("file", "n", "raw").unionByName(torn)
    return whole.select(text.basename(F.col("file")).alias("csv_file"), (F.col("n") + 1).cast("int").alias("line_no"), "raw")
