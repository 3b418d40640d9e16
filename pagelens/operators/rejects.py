"""Loading CSV records of submissions, bad ones apart with the reason of failure.

Records are assembled quote-aware, parsed each by the strict reader of Python's
csv module, and only then given to the constructors of the typed fields.
"""

from __future__ import annotations

import csv
import json
import math
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REGION_TYPES
from ..session import dealt

QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"
csv.field_size_limit(sys.maxsize)  # whole fields, however long
_IMAGE = re.compile(r"(?is).+\.(?:jpg|jpeg|png)\Z")


def ends_inside(line: str, inside: bool = False) -> bool:
    """Whether a quotation is open at the end of a line that begins inside of one, or not.

    A quotation opens only at the beginning of a field, as the strict reader has it; the
    search goes from mark to mark.
    """
    at = 0
    while True:
        at = line.find('"', at)
        if at < 0:
            return inside
        if inside:
            if line[at + 1 : at + 2] == '"':
                at += 1
            else:
                inside = False
        elif at == 0 or line[at - 1] == ",":
            inside = True
        at += 1


def assemble(lines: Iterable[str], inside: bool = False) -> Iterator[str]:
    """Records of physical lines: a line break inside an open quotation belongs to it."""
    held: list[str] = []
    for line in lines:
        held.append(line)
        inside = ends_inside(line, inside)
        if not inside:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def fields(raw: str) -> list[str]:
    """The fields of one record; ``csv.Error`` where its quoting is broken.

    The strict reader refuses an open quotation and anything but a comma after a
    closing mark.  It lets a mark stand inside a bare field, and it ends a record at
    a line break outside of quotations; a record here is whole, so the first is
    checked apart and the second is an ordinary character.
    """
    if not raw:
        return []
    bare = raw.replace("\r", " ").replace("\n", " ")
    rows = list(csv.reader([bare], strict=True))
    end = 0  # walk the bare fields: those that do not begin with a mark
    for field in rows[0]:
        if bare[end : end + 1] == '"':
            end += field.count('"') + len(field) + 3
        else:
            if '"' in field:
                raise csv.Error("quotation mark in a bare field")
            end += len(field) + 1
    if "\r" in raw or "\n" in raw:
        out, end = [], 0
        for field in rows[0]:  # same places, with the breaks put back
            if raw[end : end + 1] == '"':
                width = field.count('"') + len(field)
                out.append(raw[end + 1 : end + 1 + width].replace('""', '"'))
                end += width + 3
            else:
                out.append(raw[end : end + len(field)])
                end += len(field) + 1
        return out
    return rows[0]


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON number")


def _integer(digits: str) -> float:
    return float(digits)  # of any length; too large is infinite


def image(value: str) -> str:
    """A file name of an image; ``ValueError`` otherwise."""
    if not _IMAGE.match(value):
        raise ValueError("no image name")
    return value


def regions(value: str) -> list[dict]:
    """The regions of a strict JSON list, empty for an empty value; ``ValueError`` otherwise."""
    if value == "":
        return []
    try:
        found = json.loads(value, parse_constant=_no_constant, parse_int=_integer)
    except RecursionError as e:
        raise ValueError("nested too deeply to be read") from e
    if not isinstance(found, list):
        raise ValueError("no list")
    for r in found:
        if not isinstance(r, dict):
            raise ValueError("no object")
        box = r.get("bbox")
        if not isinstance(box, list) or len(box) != 4 or not all(isinstance(x, float) and math.isfinite(x) for x in box):
            raise ValueError("no bbox of four finite numbers")
        if "type" in r and r["type"] not in REGION_TYPES:
            raise ValueError("unknown type")
    return found


def parse(raw: str | None) -> tuple[str | None, str | None, str | None, int | None]:
    """``(reason, image, regions, how many)`` of a record; the first reason that holds."""
    raw = "" if raw is None else raw[:-1] if raw.endswith("\r") else raw
    try:
        row = fields(raw)
    except csv.Error:
        return QUOTING, None, None, None
    if len(row) != 2:
        return COLUMNS, None, None, None
    try:
        name, n = image(row[0]), len(regions(row[1]))
    except (ValueError, TypeError):
        return VALUE, None, None, None
    return None, name, row[1], n


def load(lines: DataFrame) -> DataFrame:
    """``(line_id, csv_file, line_no, reason, image, regions, n_regions)`` of every record but headers.

    ``reason`` is null for valid rows.  A carriage return at the end belongs to the
    line end.  A null or empty record has no columns (``columns``); repeated rows are
    judged each; an empty table gives none; other columns are not read.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int32())
        for b in batches:
            out = list(zip(*map(parse, b.column(3).to_pylist()))) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *(pa.array(x, t) for x, t in zip(out, types))],
                names=["line_id", "csv_file", "line_no", "reason", "image", "regions", "n_regions"],
            )

    rows = lines.where(~F.col("line_no").eqNullSafe(1)).select(
        F.col("line_id").cast("bigint"), F.col("csv_file").cast("string"), F.col("line_no").cast("int"), F.col("raw").cast("string")
    )
    return dealt(rows).mapInArrow(run, "line_id bigint, csv_file string, line_no int, reason string, image string, regions string, n_regions int")


def rejected(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason IS NOT NULL").select("line_id", "reason")


def valid(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason IS NULL").select("line_id", "image", "regions", "n_regions")
