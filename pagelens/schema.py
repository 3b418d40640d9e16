"""Fixed vocabulary and schemas of pages and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
REGION_TYPES = ("handwritten", "printed", "formula", "table", "annotation", "image", "graph")
TEXT_TYPES = ("handwritten", "printed", "annotation")
STRUCTURED_TYPES = ("formula", "table")
VISUAL_TYPES = ("image", "graph")
SOURCES = ("dictation", "archive", "university", "school")

PAGE = (
    "file_name string, image_width int, image_height int, source string, annotation_source string, "
    "regions array<struct<bbox: array<double>, type: string, language: string, legibility: string, text: string>>"
)


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


def type_index(c: Column, base: int = 0) -> Column:
    """Class id of a type name: from 0 for label files, from 1 for annotation sets; null if unknown."""
    at = F.array_position(F.array(*map(F.lit, REGION_TYPES)), c)
    return F.when(at > 0, at - 1 + base).cast("int")


def type_name(index: Column, base: int = 0, names: tuple[str, ...] = REGION_TYPES) -> Column:
    """Type of a class id; of an unknown or missing one ``handwritten``."""
    i = index.cast("int") - base
    return F.coalesce(F.when(i >= 0, F.get(F.array(*map(F.lit, names)), i)), F.lit("handwritten"))
