"""Writers of results; Spark's commit protocol makes each output appear as a whole."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import REGION_TYPES


def submission(df: DataFrame, path: str, one_file: bool = False) -> None:
    """``image, regions`` as CSV; ``regions`` may be nested or text, null is an empty list."""
    value = F.col("regions") if df.schema["regions"].dataType.typeName() == "string" else F.to_json("regions")
    out = df.select("image", F.coalesce(value, F.lit("[]")).alias("regions"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def empty_submission(pages: DataFrame, path: str) -> None:
    submission(pages.select("image", F.lit("[]").alias("regions")), path)


def json_lines(df: DataFrame, path: str) -> None:
    """Nulls are written out."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def report(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """A small table as one readable JSON file on the driver; more than ``rows`` rows fail."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report of more than {rows} rows")
    temporary = f"{path}.part"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump([r.asDict(recursive=True) for r in found], f, ensure_ascii=False, indent=2, default=str)
    os.replace(temporary, path)


def table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def tables(frames: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV and as Markdown, by its name."""
    os.makedirs(folder, exist_ok=True)
    for name, df in frames.items():
        table(df.coalesce(1), f"{folder}/{name}")
        with open(f"{folder}/{name}.md", "w", encoding="utf-8") as f:
            f.write(markdown(df))


def markdown(df: DataFrame, rows: int = 10_000) -> str:
    """A small table as Markdown text; more than ``rows`` rows fail."""
    cols = df.columns
    lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(text.markdown_cell(F.col(c)) for c in cols)), F.lit(" |")).alias("line")).limit(rows + 1).collect()
    if len(lines) > rows:
        raise ValueError(f"a Markdown table of more than {rows} rows")
    if not lines:
        return "_No rows._\n"
    head = ["| " + " | ".join(cols) + " |", "| " + " | ".join("---" for _ in cols) + " |"]
    return "\n".join([*head, *(r["line"] for r in lines)]) + "\n"


def label_files(df: DataFrame, path: str) -> None:
    """``image, line`` as text: a file ``<image stem>.txt`` an image, in the given folder.

    Lines are brought together per image (as many as a page has regions) and written by
    the tasks; a repeated task writes the same file again.
    """
    from collections.abc import Iterator

    stem = F.regexp_replace(text.basename(F.col("image")), r"\.[^.]*$", "")
    pages = df.where("line IS NOT NULL").groupBy(stem.alias("stem")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))

    def save(rows: Iterator) -> None:
        from pyarrow import fs

        target, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        target.create_dir(folder, recursive=True)
        for r in rows:
            with target.open_output_stream(f"{folder}/{r['stem']}.txt") as out:
                out.write((r["body"] + "\n").encode())

    pages.foreachPartition(save)


def classes_yaml(path: str, train: str, val: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"train: {train}\nval: {val}\nnc: {len(REGION_TYPES)}\nnames:\n" + "".join(f"  {i}: {t}\n" for i, t in enumerate(REGION_TYPES)))


def relations(lines: DataFrame, path: str) -> None:
    """Reading-order edges of each page as JSON: ``[from, to, "next"]`` in reading order."""
    edges = lines.where("next_idx IS NOT NULL").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "idx", "next_idx"))).alias("e"))
    as_text = F.transform("e", lambda e: F.array(e["idx"].cast("string"), e["next_idx"].cast("string"), F.lit("next")))
    edges.select("page", as_text.alias("edges")).write.mode("overwrite").json(path)


# Field names of the annotation format and of its extension are fixed values.
def coco_frames(pages: DataFrame, ties: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Images, annotations and categories with running ids.

    ``pages`` has ``image, w, h`` and ``regions`` of ``type, x1, y1, x2, y2``; boxes are
    clamped, sides of one pixel or less dropped.  ``ties`` order pages of one name.
    """
    from ..functions import geometry as G
    from ..operators.frames import numbered
    from ..schema import type_index

    images = numbered(pages.select("image", "w", "h", "regions", *ties), ["image", *ties])
    one = images.select(F.col("id").alias("image_id"), "w", "h", F.posexplode("regions").alias("region_idx", "r"))
    box = G.clamp_coco(G.to_coco(F.col("r")), F.col("w"), F.col("h"))
    corners = F.size(F.array_compact(F.array(*(F.col(f"r.{c}") for c in ("x1", "y1", "x2", "y2")))))  # a missing box is none
    rows = one.select("image_id", "region_idx", type_index(F.col("r.type"), 1).alias("category_id"), box.alias("b"), corners.alias("corners")).where("category_id IS NOT NULL AND b.w > 1 AND b.h > 1 AND corners = 4")
    annotations = numbered(rows, ["image_id", "region_idx"]).select(
        "id", "image_id", "category_id", F.array(*(F.round(F.col(f"b.{c}"), 2) for c in "xywh")).alias("bbox"), F.round(F.col("b.w") * F.col("b.h"), 2).alias("area"),
        F.lit(0).alias("iscrowd"), F.col("region_idx").alias("region_idx_in_image"),
    )
    categories = pages.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(REGION_TYPES)], "id int, name string")
    return {"images": images.select("id", F.col("image").alias("file_name"), F.col("w").alias("width"), F.col("h").alias("height")), "annotations": annotations, "categories": categories}


def coco(pages: DataFrame, path: str) -> dict[str, DataFrame]:
    """:func:`coco_frames`, one JSON folder each."""
    frames = coco_frames(pages)
    for name, df in frames.items():
        json_lines(df, f"{path}/{name}")
    return frames
