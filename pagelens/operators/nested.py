"""Deeply nested regions as related flat tables.

A depth-first traversal gives every object of a record an interval label: ``pre``
when it is entered, ``post`` when it is left, from one counter.  A node lies below
another of its record exactly if its interval is contained in the other's; its
parent is the smallest such.  One narrow pass labels all nodes; the table of each
type is a filter on it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dealt

#: Lists that hold objects of their own, by the type of the objects in them.
LISTS = {"alternatives": "alternative", "marks": "mark", "children": "child"}
TYPES = ("page", "region", "alternative", "mark", "child")

_LABELS = "table_name string, record_id bigint, node_type string, path string, pre bigint, post bigint, level int, parent_pre bigint, position int"
_VALUES = "bbox array<double>, type string, language string, legibility string, text string, annotation_source string, score double, kind string, pos bigint, len bigint"
#: Attributes in the order of ``_VALUES``, and what of them belongs to a type.
ATTRIBUTES = {
    "region": ["bbox", "type", "language", "legibility", "text", "score"],
    "child": ["bbox", "type", "language", "legibility", "text", "score"],
    "alternative": ["text", "annotation_source", "score"],
    "mark": ["kind", "pos", "len"],
    "page": [],
}


def traverse(regions, lists=LISTS) -> Iterator[tuple]:
    """``(object, type, path, pre, post, level, parent_pre, position)`` in pre-order.

    ``regions`` is a parsed value; an object where a list is expected is its element
    0; elements that are no objects are no nodes but keep their positions.  The
    stack is explicit, so depth is bounded by memory only.
    """
    rows: list[list] = [[None, "page", "", 0, 0, 0, None, 0]]
    clock = 0

    def entries(value, kind, prefix, parent, level):
        items = [value] if isinstance(value, dict) else value if isinstance(value, list) else ()
        return [(x, kind, f"{prefix}{i}", level, parent, i) for i, x in enumerate(items) if isinstance(x, dict)]

    stack: list = entries(regions, "region", "", 0, 1)[::-1]
    while stack:
        top = stack.pop()
        clock += 1
        if isinstance(top, int):  # all below this row is done
            rows[top][4] = clock
            continue
        x, kind, path, level, parent, i = top
        pre, at = clock, len(rows)
        rows.append([x, kind, path, pre, 0, level, parent, i])
        stack.append(at)
        below: list = []
        for name, inner in lists.items():
            if (value := x.get(name)) is not None:
                below += entries(value, inner, f"{path}/{name}/", pre, level + 1)
        stack += below[::-1]
    rows[0][4] = clock + 1
    return map(tuple, rows)


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


class Digits:
    """An integer of more digits than Python turns into a number; infinite as a double."""

    def __init__(self, text: str):
        self.text = text


def _int(text: str) -> int | Digits:
    try:
        return int(text)
    except ValueError:
        return Digits(text)


def loads(text: str):
    """Parsed JSON of any depth: the library's reader, and a stack where that nests too deeply."""
    try:
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            raise
        except ValueError:  # an integer of too many digits
            return json.loads(text, parse_int=_int)
    except RecursionError:
        return _loads_deep(text)


def _loads_deep(text: str):
    at = _SPACE.match(text).end()
    root: list = []
    stack: list = [root]  # open containers; a key waiting for its value stands on its object
    while True:
        top = stack[-1]
        c = text[at : at + 1]
        if c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in ("[", "{") and c:
            value, at = ([] if c == "[" else {}), at + 1
        elif m := _SCALAR.match(text, at):
            value, at = json.loads(m[0], parse_int=_int), m.end()
        else:
            raise ValueError(f"no value at {at}")
        if isinstance(top, str):
            stack.pop()
            stack[-1][top] = value
        else:
            top.append(value)
        at = _SPACE.match(text, at).end()
        if c in ("[", "{"):
            stack.append(value)
            if text[at : at + 1] == ("]" if c == "[" else "}"):
                stack.pop()
                at = _SPACE.match(text, at + 1).end()
            elif c == "[":
                continue
        while True:  # close what ends here, then go to the next value
            if len(stack) == 1:
                if at != len(text):
                    raise ValueError(f"more text at {at}")
                return root[0]
            top, c = stack[-1], text[at : at + 1]
            first = isinstance(top, dict) and not top
            if not first and c == ("}" if isinstance(top, dict) else "]"):
                stack.pop()
                at = _SPACE.match(text, at + 1).end()
                continue
            if not first:
                if c != ",":
                    raise ValueError(f"no comma at {at}")
                at = _SPACE.match(text, at + 1).end()
            if isinstance(top, dict):
                if text[at : at + 1] != '"':
                    raise ValueError(f"no key at {at}")
                key, at = scanstring(text, at + 1, True)
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError(f"no colon at {at}")
                at = _SPACE.match(text, at + 1).end()
                top.setdefault(key, None)
                stack.append(key)
            break


def _number(x) -> float | None:
    if isinstance(x, Digits):
        return float(x.text)
    try:
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    except OverflowError:  # as the reader takes 1e400
        return float("inf") if x > 0 else float("-inf")


def _integer(x) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63 else None


def dumps(x) -> str:
    """JSON text of a parsed value of any depth; escaped where it holds half a surrogate pair."""
    try:
        text = json.dumps(x, ensure_ascii=False)
    except (RecursionError, TypeError):
        text = _dumps_deep(x)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _dumps_deep(x) -> str:
    out: list[str] = []
    stack: list = [x]  # values to write; a tuple holds text as it is
    while stack:
        v = stack.pop()
        if isinstance(v, tuple):
            out.append(v[0])
        elif isinstance(v, (dict, list)):
            parts: list = [("{" if isinstance(v, dict) else "[",)]
            for i, y in enumerate(v.items() if isinstance(v, dict) else v):
                comma = ", " if i else ""
                parts += [(f"{comma}{json.dumps(y[0], ensure_ascii=False)}: ",), y[1]] if isinstance(v, dict) else [(comma,), y]
            parts.append(("}" if isinstance(v, dict) else "]",))
            stack += parts[::-1]
        else:
            out.append(v.text if isinstance(v, Digits) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _string(x) -> str | None:
    return x if x is None or isinstance(x, str) else dumps(x)


def _values(x: dict | None, kind: str) -> list:
    has = ATTRIBUTES[kind]
    get = (lambda k: x.get(k) if k in has else None) if x else lambda k: None
    box = get("bbox")
    return [
        [_number(v) for v in box] if isinstance(box, list) else None,
        *(_string(get(k)) for k in ("type", "language", "legibility", "text", "annotation_source")),
        _number(get("score")), _string(get("kind")), _integer(get("pos")), _integer(get("len")),
    ]


def _bare(value):
    """What stands in place of a list of objects without being one: null for each object."""
    if isinstance(value, list):
        return [None if isinstance(x, dict) else x for x in value] if any(not isinstance(x, (dict, type(None))) for x in value) else None
    return None if isinstance(value, dict) else value


def _rest(x: dict, kind: str) -> dict:
    """The fields of an object that neither its attributes nor the nodes below it hold."""
    out: dict = {}
    for k, v in x.items():
        if k in LISTS:
            if (left := _bare(v)) is not None:
                out[k] = left
        elif k not in ATTRIBUTES[kind]:
            out[k] = v
        elif v is None:
            continue
        elif k == "bbox":
            if not isinstance(v, list) or any(y is not None and _number(y) is None for y in v):
                out[k] = v
        elif k == "score" and _number(v) is None or k in ("pos", "len") and _integer(v) is None:
            out[k] = v
    return out


def _parsed(text: str | None):
    try:
        return loads(text) if text else None
    except ValueError:
        return text


def _json(df: DataFrame, regions: str) -> Column:
    return F.col(regions) if isinstance(df.schema[regions].dataType, T.StringType) else F.to_json(regions)


def label(df: DataFrame, name: str, key: str = "record_id", regions: str = "regions", values: bool = True, rest: bool = False) -> DataFrame:
    """Labelled nodes of every record: ``table_name, record_id, node_type, path, pre, post, level, parent_pre, position``.

    ``regions`` may be a nested column or a string of JSON.  ``values`` adds the
    attributes of all types (null where a type has none).  ``rest`` adds JSON text of
    what neither they nor the nodes below hold: fields of other names, and values of
    another JSON type than their column (null where nothing is left; at the record,
    what ``regions`` is where it is no list of objects).  The record itself is the
    node of type ``page`` with ``parent_pre`` null.  Null, empty and unreadable
    regions give only that node; repeated keys have theirs each; other columns are
    not read.  No shuffle.
    """
    ddl = ", ".join([_LABELS, *[_VALUES] * values, *["rest string"] * rest])
    schema = T._parse_datatype_string(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        def full(cols: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            chars = 0
            for rid, s in zip(batch.column(0), batch.column(1)):
                parsed = _parsed(s.as_py())
                for x, kind, path, pre, post, level, parent, i in traverse(parsed):
                    row = (name, rid.as_py(), kind, path, pre, post, level, parent, i)
                    if values:
                        row += (*_values(x, kind),)
                    if rest:
                        left = _rest(x, kind) if x is not None else {} if (bare := _bare(parsed)) is None else {regions: bare}
                        row += (dumps(left) if left else None,)
                        chars += len(row[-1] or "")
                    for c, v in zip(cols, row):
                        c.append(v)
                    chars += len(path)
                    if len(cols[0]) > 20_000 or chars > 16_000_000:  # many or deep nodes of one batch
                        yield full(cols)
                        cols, chars = [[] for _ in schema], 0
            if cols[0]:
                yield full(cols)

    rows = dealt(df.select(key, regions))
    return rows.select(F.col(key).cast("bigint").alias("record_id"), _json(df, regions).alias("regions")).mapInArrow(run, ddl)


def pages(df: DataFrame, name: str, key: str = "record_id", regions: str = "regions") -> DataFrame:
    """The table of the records themselves: the labels :func:`label` gives them, and all other columns.

    The columns ride along, so that repeated and null keys keep their own.  No shuffle.
    """
    others = [c for c in df.columns if c not in (key, regions)]
    rows = df.select(F.col(key).cast("bigint").alias("record_id"), *others, _json(df, regions).alias("regions"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("post", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            posts = [next(traverse(_parsed(s.as_py())))[4] for s in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(posts, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema).select(
        F.lit(name).alias("table_name"), "record_id", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("pre"), "post", F.lit(0).alias("level"),
        F.lit(None).cast("bigint").alias("parent_pre"), F.lit(0).alias("position"), *others,
    )


def flat(nodes: DataFrame, kind: str) -> DataFrame:
    """The table of one type: labels, link to the parent, the type's attributes, and the rest where labelled with it."""
    return nodes.where(F.col("node_type") == kind).select(
        "table_name", "record_id", "path", "pre", "post", "level", "parent_pre", "position", *ATTRIBUTES[kind], *(c for c in nodes.columns if c == "rest")
    )


def contains(outer: str = "o", inner: str = "i") -> Column:
    """Whether the node aliased ``inner`` lies below the one aliased ``outer``."""
    o, i = (lambda c: F.col(f"{outer}.{c}")), (lambda c: F.col(f"{inner}.{c}"))
    return (
        (o("table_name") == i("table_name")) & (o("record_id") == i("record_id")) & (o("pre") < i("pre")) & (i("post") < o("post"))
    )


def below(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Nodes with the labels ``(ancestor_pre, ancestor_path)`` of the ancestors they lie in.

    The join is equal on the record and contained in the interval; a record's nodes
    come from one cell of a table, so its pairs are bounded by that cell.
    """
    a = ancestors.select("table_name", "record_id", "pre", "post", "path").alias("o")
    pairs = nodes.alias("i").join(a, contains())
    return pairs.select("i.*", F.col("o.pre").alias("ancestor_pre"), F.col("o.path").alias("ancestor_path"))


def found(nodes: DataFrame) -> DataFrame:
    """``(table_name, record_id, path)`` of the nodes that lie below a region."""
    return nodes.where("level > 1").select("table_name", "record_id", "path")
