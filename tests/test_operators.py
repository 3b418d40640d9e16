"""Matching, scoring, layout, nested records, rejected rows, sampling on small fixtures."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.functions import geometry as G
from pagelens.operators import inference, layout, match, metrics, nested, quality, rejects, sampling

BOX = "struct<idx:int,x1:double,y1:double,x2:double,y2:double,type:string,text:string,language:string,legibility:string>"


def _page(spark, gt, pred):
    def rows(items):
        return [(i, *map(float, b), t, x, "uk", "legible") for i, (b, t, x) in enumerate(items)]

    return spark.createDataFrame([(1, rows(gt), rows(pred) if pred is not None else None)], f"page bigint, gt array<{BOX}>, pred array<{BOX}>")


# The published page of 0.9348.
GT = [((50, 100, 850, 130), "handwritten", "Доброго ранку"), ((50, 150, 870, 180), "handwritten", "Сьогодні гарна погода"), ((50, 250, 650, 270), "printed", "Завдання 1"),
      ((700, 50, 950, 250), "image", ""), ((900, 950, 980, 990), "annotation", "5")]
PRED = [((52, 101, 852, 131), "handwritten", "Доброго ранку"), ((50, 148, 860, 184), "handwritten", "Сьогодні гарна пагода"), ((48, 249, 649, 272), "handwritten", "Завдання 1"),
        ((710, 60, 945, 248), "image", "")]


@pytest.mark.parametrize("dialect", ["v1", "v2"])
def test_golden_score(spark, dialect):
    for pred, want in ((PRED, 0.9348), (GT, 1.0)):
        s = metrics.summary(metrics.per_page(_page(spark, GT, pred), ["page"], dialect), []).first()
        assert round(s["score"], 4) == want


def test_empty_pages(spark):
    s = metrics.summary(metrics.per_page(_page(spark, GT, None), ["page"]), []).first()
    assert (s["matched_regions"], s["false_negatives"], s["region_cer"], s["page_cer"]) == (0, 5, 1.0, 1.0)
    none = metrics.summary(metrics.per_page(_page(spark, [], []).limit(0), ["page"]), []).first()
    assert none["region_cer"] == 1.0 and none["det_f1"] == 0.0
    extra = metrics.records(_page(spark, [], PRED), ["page"]).groupBy("status").count().collect()
    assert [(r["status"], r["count"]) for r in extra] == [("false positive", 4)]


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    i = w * h
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def test_greedy_against_brute_force(spark):
    r = random.Random(5)
    pages, want = [], {}
    for page in range(40):
        make = lambda: [(i, *(lambda x, y: (float(x), float(y), float(x + r.choice([10, 12])), float(y + 10)))(r.randrange(0, 24, 3), r.randrange(0, 24, 3)), "printed", "a", "uk", "legible") for i in range(r.randrange(0, 9))]
        gt, pred = make(), make()
        pages.append((page, gt, pred))
        pairs = sorted((-_iou(g[1:5], p[1:5]), g[0], p[0]) for g in gt for p in pred if _iou(g[1:5], p[1:5]) >= 0.5)
        used_g, used_p, got = set(), set(), set()
        for _, g, p in pairs:
            if g not in used_g and p not in used_p:
                used_g.add(g), used_p.add(p), got.add((g, p))
        want[page] = got
    df = spark.createDataFrame(pages, f"page bigint, gt array<{BOX}>, pred array<{BOX}>")
    fold = metrics.matched(df).select("page", F.inline("m")).collect()
    assert {p: {(x["g"], x["p"]) for x in fold if x["page"] == p} for p in want} == want
    flat = df.select("page", F.inline(match.pairs(F.col("gt"), F.col("pred")))).select("page", "g", "p", (-F.col("order")).alias("iou"))
    rounds = match.mutual_best(flat, ["page"]).collect()
    assert {p: {(x["g"], x["p"]) for x in rounds if x["page"] == p} for p in want} == want


def test_suppress(spark):
    b = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double,label:int>>"
    boxes = [(0.0, 0.0, 10.0, 10.0, 0.5, 1), (0.0, 0.0, 10.0, 10.0, 0.5, 2), (1.0, 0.0, 11.0, 10.0, 0.9, 1), (50.0, 50.0, 60.0, 60.0, 0.1, 1)]
    df = spark.createDataFrame([(boxes,), ([],), (None,)], f"b {b}")
    got = [r["k"] for r in df.select(match.suppress(F.col("b"), 0.6).alias("k")).collect()]
    assert [x["score"] for x in got[0]] == [0.9, 0.1] and got[1] == [] and got[2] is None
    per = df.limit(1).select(match.suppress(F.col("b"), 0.6, per_class=True).alias("k")).first()["k"]
    assert [(x["score"], x["label"]) for x in per] == [(0.9, 1), (0.5, 2), (0.1, 1)]


def test_lines(spark):
    rows = [(1, 0, "printed", 50.0, 0.0, 60.0, 10.0), (1, 1, "printed", 0.0, 2.0, 10.0, 12.0), (1, 2, "image", 0.0, 0.0, 9.0, 9.0), (1, 3, "formula", 0.0, 40.0, 10.0, 50.0)]
    got = layout.lines(spark.createDataFrame(rows, "page int, idx int, type string, x1 double, y1 double, x2 double, y2 double")).orderBy("place").collect()
    assert [(r["idx"], r["line"], r["next_idx"]) for r in got] == [(1, 0, 0), (0, 0, 3), (3, 1, None)]


def test_geometry(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(G.from_array(F.array(F.lit(1.0)))) is None
    assert tuple(one(G.clamp(G.box(10.0, 10.0, 2.5, 3.5), 8, 8))) == (2.0, 4.0, 8.0, 8.0)
    assert one(G.clamp(G.box(1.0, 1.0, 3.0, 9.0), 100, 100)) is None
    assert tuple(one(G.clamp_guess(G.box(10.0, 10.0, 5.0, 5.0), 100, 100))) == (10.0, 10.0, 15.0, 15.0)
    for x in (0.0796875, 0.0640625, 0.5, 1.0, 0.0, 0.1234565, 0.9999995, 2 / 3):
        assert one(G.six_decimals(F.lit(x))) == f"{x:.6f}"


# ------------------------------------------------------------------ nested records
json_value = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["alternatives", "marks", "children", "meta", "text"]), c, max_size=4), max_leaves=25)


def _expected(value):
    out = []

    def walk(v, prefix, level):
        items = [v] if isinstance(v, dict) else v if isinstance(v, list) else []
        for i, x in enumerate(items):
            if isinstance(x, dict):
                out.append((f"{prefix}{i}", level))
                for name in ("alternatives", "marks", "children"):
                    walk(x.get(name), f"{prefix}{i}/{name}/", level + 1)

    walk(value, "", 1)
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(json_value)
def test_traverse(value):
    rows = list(nested.traverse(value))
    assert sorted((r[2], r[5]) for r in rows[1:]) == _expected(value)
    labels = {(r[3], r[4]) for r in rows}
    assert sorted(x for p in labels for x in p) == list(range(2 * len(rows)))
    for r in rows[1:]:  # the parent is the smallest interval around
        around = [o for o in rows if o[3] < r[3] and r[4] < o[4]]
        assert len(around) == r[5] and max(around, key=lambda o: o[3])[3] == r[6]


@settings(max_examples=300, deadline=None)
@given(json_value, st.sampled_from([None, 1]))
def test_deep_reader(value, indent):
    text = json.dumps(value, indent=indent)
    assert nested._loads_deep(text) == value
    for cut in (text[:-1], text + "]", text.replace(":", "", 1), text.replace(",", "", 1)):
        try:
            want = json.loads(cut)
        except ValueError:
            with pytest.raises(ValueError):
                nested._loads_deep(cut)
        else:
            assert nested._loads_deep(cut) == want


def test_deep_records(spark):
    depth = 5_000
    text = '[{"children": ' * depth + "[]" + "}]" * depth
    df = spark.createDataFrame([(1, text[1:-1])], "row_id bigint, regions string")
    nodes = nested.label(df, "t", "row_id", values=False)
    assert nodes.selectExpr("max(level)", "count(*)").first()[:] == (depth, depth + 1)


def test_nested_tables(spark):
    regions = [{"bbox": [1, 2, 3, 4], "type": "printed", "text": "а", "alternatives": {"text": "б", "score": 0.5, "marks": [None, {"kind": "strike", "pos": 1}]}, "children": [{"text": "в"}]}]
    rows = [(1, json.dumps(regions), "x"), (1, json.dumps(regions), "x"), (2, None, "y"), (3, "", None), (4, "{bad", None), (5, "[]", None), (None, "[{}]", None)]
    df = spark.createDataFrame(rows, "row_id bigint, regions string, path string")
    nodes = nested.label(df, "t", "row_id")
    assert sorted((r["record_id"] or 0, r["path"]) for r in nested.found(nodes).collect()) == sorted([(1, "0/alternatives/0"), (1, "0/alternatives/0/marks/1"), (1, "0/children/0")] * 2)
    assert nested.flat(nodes, "page").count() == 7
    mark = nested.flat(nodes, "mark").first()
    assert (mark["kind"], mark["pos"], mark["len"], mark["position"]) == ("strike", 1, None, 1)
    assert nested.label(df.limit(0), "t", "row_id").count() == 0
    one = nodes.where("record_id = 1").dropDuplicates(["path"])
    inside = nested.below(one.where("level > 1"), one.where("node_type = 'region'"))
    assert inside.count() == 3


def test_nested_rest(spark):
    """Every field of an object is in a column, in a node below, or in the rest."""
    meta = {"by": "о", "n": [1, None, {"x": True}]}
    region = {"bbox": [1, "2", 3, 4], "type": "printed", "text": 5, "score": "0.9", "meta": meta, "children": [{"text": "в", "meta": None, "score": 1}], "alternatives": ["а", {"text": "б", "type": "x", "marks": {"pos": "1", "len": 2.0}}]}
    deep = '{"meta": ' + '[{"a": ' * 3_000 + "1" + "}]" * 3_000 + "}"
    rows = [(1, json.dumps([region, 7])), (2, deep), (3, '[{"text": "а", "bbox": [1, null]}, null]'), (4, "{bad"), (5, '[{"x": "\\ud800"}]'), (6, None)]
    df = spark.createDataFrame(rows, "row_id bigint, regions string")
    nodes = nested.label(df, "t", "row_id", rest=True)
    got = {(r["record_id"], r["node_type"]): r["rest"] for r in nodes.collect()}
    assert {k: json.loads(v) for k, v in got.items() if v and k[0] != 2} == {
        (1, "page"): {"regions": [None, 7]}, (1, "region"): {"bbox": [1, "2", 3, 4], "score": "0.9", "meta": meta, "alternatives": ["а", None]},
        (1, "child"): {"meta": None}, (1, "alternative"): {"type": "x"}, (1, "mark"): {"pos": "1", "len": 2.0}, (4, "page"): {"regions": "{bad"}, (5, "region"): {"x": "\ud800"},
    }
    assert got[(2, "region")] == deep and len(got) == 13
    assert nested.flat(nodes, "child").first()["rest"] == '{"meta": null}' and "rest" not in nested.label(df, "t", "row_id").columns


def test_nested_pages(spark):
    """A row a record with its own columns, which the parent_pre of its regions points to."""
    from pagelens.plans import general

    text = '[{"children": [{}, null]}, {}]'
    rows = [(1, text, "a", 5), (1, text, None, None), (2, None, "b", 6), (None, "{bad", "c", None)]
    got = nested.pages(spark.createDataFrame(rows, "row_id bigint, regions string, run_id string, n int"), "t", "row_id")
    assert sorted([tuple(r) for r in got.select("record_id", "pre", "post", "level", "parent_pre", "position", "run_id", "n").collect()], key=str) == sorted(
        [(1, 0, 7, 0, None, 0, "a", 5), (1, 0, 7, 0, None, 0, None, None), (2, 0, 1, 0, None, 0, "b", 6), (None, 0, 1, 0, None, 0, "c", None)], key=str
    )
    assert "p2_pages" in general.QUERIES and "p2_pages" in general.SQL


def test_long_integers(spark):
    """Integers of any number of digits leave the record readable."""
    digits = "-" + "1" * 5_000
    deep = '[{"children": ' * 3_000 + "[]" + ', "n": 1}]' * 2_999 + f', "pos": {digits}' + "}]"
    rows = [(1, f'[{{"score": {digits}, "meta": [{digits}], "text": {digits}, "children": [{{"score": {"1" * 400}}}]}}]'), (2, deep), (3, f"[{digits}, {{]")]
    nodes = nested.label(spark.createDataFrame(rows, "row_id bigint, regions string"), "t", "row_id", rest=True).where("level < 3")
    got = {(r["record_id"], r["path"]): (r["score"], r["text"], r["rest"]) for r in nodes.collect()}
    inf = float("inf")
    assert got[(1, "0")] == (-inf, digits, f'{{"meta": [{digits}]}}') and got[(1, "0/children/0")] == (inf, None, None)
    assert got[(2, "0")] == (None, None, f'{{"pos": {digits}}}') and sorted(k for k in got if k[0] == 3) == [(3, "")]


@settings(max_examples=200, deadline=None)
@given(json_value)
def test_deep_writer(value):
    assert nested._dumps_deep(value) == json.dumps(value, ensure_ascii=False)


def test_nested_column(spark):
    ddl = "record_id bigint, regions array<struct<bbox:array<double>,text:string,alternatives:array<struct<text:string,marks:array<struct<kind:string,pos:int,len:int>>>>>>"
    df = spark.createDataFrame([(7, [(None, None, [None, ("а", [("k", 1, 2), None])]), None])], ddl)
    got = {r["path"] for r in nested.found(nested.label(df, "p", values=False)).collect()}
    assert got == {"0/alternatives/1", "0/alternatives/1/marks/0"}


# ------------------------------------------------------------------ rejected rows
def _slow(raw):
    """The rules, one character at a time."""
    raw = raw[:-1] if raw.endswith("\r") else raw
    state, n, cur, out = "start", 1, "", []
    for c in raw:
        if state == "start" and c == '"':
            state = "in"
        elif state in ("start", "bare"):
            if c == '"':
                return "quoting"
            if c == ",":
                out.append(cur), (cur := "")
                state = "start"
            else:
                cur += c
                state = "bare"
        elif state == "in":
            state = "mark" if c == '"' else "in"
            cur += "" if c == '"' else c
        else:
            if c == '"':
                cur += c
                state = "in"
            elif c == ",":
                out.append(cur), (cur := "")
                state = "start"
            else:
                return "quoting"
    if state == "in":
        return "quoting"
    out.append(cur)
    return out if raw else []


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='a",\n\r b[]', max_size=14))
def test_fields(raw):
    want = _slow(raw)
    reason = rejects.parse(raw)[0]
    if want == "quoting":
        assert reason == "quoting"
    else:
        assert rejects.fields(raw[:-1] if raw.endswith("\r") else raw) == want
        assert (reason == "columns") == (len(want) != 2)


def test_values():
    ok = 'x.JPG,"[{""bbox"": [1, 2.5, -3, 1e3], ""type"": ""table""}]"'
    assert rejects.parse(ok) == (None, "x.JPG", '[{"bbox": [1, 2.5, -3, 1e3], "type": "table"}]', 1)
    assert rejects.parse("x.png,\r")[0] is None and rejects.parse("x.png,[ ]")[3] == 0
    box = '[{"bbox": %s}]'
    bad = [".jpg,[]", "x.gif,[]", ",[]", "x.jpg,{}", "x.jpg,[1]", "x.jpg,null"]
    bad += ['x.jpg,"' + (box % v).replace('"', '""') + '"' for v in ("[1,2,3]", "[1,2,3,true]", "[1,2,3,NaN]", "[1,2,3,1e999]", '[1,2,3,"4"]', "null")]
    bad += ['x.jpg,"[{""bbox"": [1,2,3,4], ""type"": null}]"', 'x.jpg,"[{""bbox"": [1,2,3,4], ""type"": ""Table""}]"', 'x.jpg,"[{""bbox"": [1,2,3,4]},]"', 'x.jpg,"' + "[" * 100_000 + '"']
    assert [rejects.parse(b)[0] for b in bad] == ["value"] * len(bad)
    assert rejects.parse(None)[0] == rejects.parse("")[0] == rejects.parse("\r")[0] == rejects.parse("a.jpg")[0] == "columns"
    assert rejects.parse('x.jpg,"a\nb"')[0] == "value" and rejects.fields('x,"a\r\nb""c"') == ["x", 'a\r\nb"c']
    long = json.dumps([{"bbox": [1, 2, 3, 4], "text": "я" * 500_000}], ensure_ascii=False)
    assert rejects.parse('x.jpg,"' + long.replace('"', '""') + '"')[3] == 1


def test_assemble():
    assert list(rejects.assemble(['a,"b', 'c"', 'x,y"z', 'd,"e""', '"'])) == ['a,"b\nc"', 'x,y"z', 'd,"e""\n"']
    assert list(rejects.assemble(['a,"b'])) == ['a,"b'] and list(rejects.assemble([])) == []


def test_load(spark):
    rows = [(1, "f", 1, "image,regions", "z"), (2, "f", 2, "a.jpg,[]", "z"), (2, "f", 2, "a.jpg,[]", "z"), (3, "f", 3, None, None), (4, None, None, 'a"', None)]
    df = spark.createDataFrame(rows, "line_id bigint, csv_file string, line_no int, raw string, reason string")
    loaded = rejects.load(df)
    assert sorted(map(tuple, rejects.rejected(loaded).collect())) == [(3, "columns"), (4, "quoting")]
    assert rejects.valid(loaded).count() == 2 and rejects.load(df.limit(0)).count() == 0


# ------------------------------------------------------------------ sampling and quality
def test_parts_are_exact(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise("cold").alias("g"))
    got = sampling.stratified(df, ["g"], ["id"], 0.1).groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in got} == {("hot", "val"): 100, ("hot", "train"): 900, ("cold", "val"): 200, ("cold", "train"): 1799, (None, "train"): 1}
    assert sampling.cap(df, ["g"], ["id"], 7).count() == 15 and sampling.cap(df, ["g"], ["id"], 0).count() == 3000
    b = sampling.balanced(df, ["g"], ["id"], 8).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in b} == {None: 1, "cold": 4, "hot": 3}
    assert sampling.balanced(df, ["g"], ["id"], 10_000).count() == 3000
    assert sampling.parts(df.limit(0), ["g"], sampling.random_key(1, "id"), lambda n: [n], ["id"]).count() == 0


def test_anti_leak(spark):
    names = [(i, f"images/{b}{s}.jpg") for b in "abcdefghij" for i, s in enumerate(("", "_aug_light_aug001"))]
    df = spark.createDataFrame(names, "i int, file_name string")
    got = sampling.without_leaks(df, ratio=0.3).collect()
    sides = {}
    for r in got:
        sides.setdefault(r["base"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values()) and sum(s == {"val"} for s in sides.values()) == 3
    assert sum(r["split"] == "val" for r in got) == 3


def test_region_errors(spark):
    rows = [(1, "{"), (2, "{}"), (3, '[1, {}, {"bbox": null}, {"bbox": [1]}, {"bbox": [1,2,3,4], "type": null}, {"bbox": [1,2,3,4]}, {"bbox": [1,2,3,4], "type": "map"}]'), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "k int, regions string")
    got = {(r["k"], r["region_idx"], r["code"]) for r in quality.region_errors(df, ["k"]).collect()}
    assert got == {(1, -1, "bad_json"), (2, -1, "not_a_list"), (3, 0, "not_an_object"), (3, 1, "no_bbox"), (3, 2, "no_bbox"), (3, 3, "bbox_length"), (3, 4, "invalid_type"), (3, 6, "invalid_type")}
    assert (3, 6, "invalid_type") not in {(r["k"], r["region_idx"], r["code"]) for r in quality.region_errors(df, ["k"], submission=False).collect()}
    py = spark.createDataFrame([("[{'text': None, 'bbox': [1, 2, 3, 4]}]",)], "regions string").select(quality.lenient(F.col("regions")).alias("r")).first()["r"]
    assert py[0]["text"] is None and py[0]["bbox"] == [1, 2, 3, 4]


def test_summary_percentiles(spark):
    df = spark.range(10).select(F.lit("a").alias("g"), F.col("id").alias("v"))
    got = {r["g"]: (r["count"], r["min"], r["max"], r["mean"], r["p95"]) for r in quality.numeric_summary(df, ["g"], "v").collect()}
    assert got == {"a": (10, 0, 9, 4.5, 8), "all": (10, 0, 9, 4.5, 8)}


def test_keep_last(spark):
    df = spark.createDataFrame([("r", 1, "a"), ("r", 2, None), ("s", None, "c")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in quality.keep_last(df, ["k"], ["o"]).collect()} == {("r", None), ("s", "c")}


def test_inference(spark):
    def make():
        def predict(rows):
            if any(r["text"] == "bad" for r in rows):
                raise RuntimeError
            return [r["text"].upper() for r in rows]

        return predict

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "i int, text string")
    assert {r["i"]: r["answer"] for r in inference.read(df, make, ["text"]).collect()} == {1: "A", 2: "", 3: "C"}
    m = spark.createDataFrame([(100, 0.2), (200, 0.1), (300, 0.1)], "step int, cer double")
    assert inference.best_checkpoint(m).first()["step"] == 200
    p = spark.createDataFrame([("x/checkpoint-90",), ("x/checkpoint-1000/",), ("x/other",)], "path string")
    assert inference.latest_checkpoint(p).first()["path"] == "x/checkpoint-1000/"


# ------------------------------------------------------------------ breakdowns and examples
def _fixture(spark, seed=3, pages=30):
    r = random.Random(seed)
    kinds = ["handwritten", "printed", "formula", "table", "annotation", "image", "graph"]
    rows = []
    for page in range(pages):
        gt = [(i, 0.0, 40.0 * i, 100.0, 40.0 * i + 30, r.choice(kinds), " ".join(r.choice(["один", "два", "три"]) for _ in range(3)), r.choice(["uk", "uk", "other", None]), "legible") for i in range(r.randrange(0, 7))]
        pred = [(i, g[1], g[2] + r.choice([0, 3, 30]), g[3], g[4] + 3, r.choice([g[5], g[5], "printed"]), g[6].replace("два", r.choice(["два", "даа"])), None, None) for i, g in enumerate(gt) if r.random() < 0.9]
        rows.append((page, ["school", "archive"][page % 2], gt, pred))
    return spark.createDataFrame(rows, f"page bigint, source string, gt array<{BOX}>, pred array<{BOX}>")


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_breakdowns(spark):
    rows = metrics.records(_fixture(spark), ["page", "source"])
    local = [r for r in rows.collect() if r["scored"] and r["gt_type"] in ("handwritten", "printed", "annotation")]
    assert len(local) > 10 and any(r["cer"] for r in local)
    for r in local:
        assert r["cer"] == _edit(r["pred_norm"], r["gt_norm"]) / max(len(r["gt_norm"]), 1)
    words = [(_edit(r["pred_norm"].split(), r["gt_norm"].split()), len(r["gt_norm"].split())) for r in local]
    macro, micro = metrics.macro(rows, []).first(), metrics.micro(rows, []).first()
    mean = lambda xs: sum(xs) / len(xs)
    assert macro["n"] == len(local) and abs(macro["cer"] - mean([r["cer"] for r in local])) < 1e-9
    assert abs(macro["wer"] - mean([d / max(n, 1) for d, n in words])) < 1e-9 and abs(macro["exact"] - mean([r["exact"] for r in local])) < 1e-9
    assert abs(micro["wer"] - sum(d for d, _ in words) / sum(n for _, n in words)) < 1e-9
    assert abs(micro["cer"] - sum(r["distance"] for r in local) / sum(r["gt_length"] for r in local)) < 1e-9
    branch = {(r["type"], r["source"]): r for r in metrics.text_branch(rows).collect()}
    assert branch[("all", "all")]["n"] == len(local) and sum(r["n"] for k, r in branch.items() if k[0] == "all" and k[1] != "all") == len(local)
    types = {r["type"]: r for r in metrics.by_type(rows).collect()}
    every = rows.collect()
    assert len(types) == 7 and sum(t["pred_count"] for t in types.values()) == sum(r["pred_type"] is not None for r in every)
    s = metrics.structured(rows).first()
    assert abs(s["struct_acc"] + s["invalid_rate"] - 1) < 1e-9


def test_examples(spark):
    from pagelens.operators import selection

    rows = metrics.records(_fixture(spark), ["page", "source"])
    rows = rows.withColumns({"shown": selection.status(F.col("scored")), "scorable": F.coalesce(~F.col("gt_type").isin("image", "graph"), F.lit(False))})
    quality_ = selection.crop_quality(F.lit(1000), F.lit(400))
    got = selection.crop_examples(rows, quality_).collect()
    keys = [(r["page"], r["gt_idx"], r["pred_idx"]) for r in got]
    assert len(got) == 12 and len(set(keys)) == 12 and [r["place"] for r in got] == list(range(12))
    # the same by the plain rule: bucket after bucket, the best record not used yet
    marked = rows.select("page", "gt_idx", "pred_idx", *(F.when(F.coalesce(c, F.lit(False)), p.cast("double")).alias(f"b{i}") for i, (_, c, p) in enumerate(selection.buckets(quality_)))).collect()
    used, want = set(), []
    for i, (name, _, _) in enumerate(selection.buckets(quality_)):
        best = sorted((-r[f"b{i}"], r["page"], -1 if r["gt_idx"] is None else r["gt_idx"], -1 if r["pred_idx"] is None else r["pred_idx"], r) for r in marked if r[f"b{i}"] is not None and (r["page"], r["gt_idx"], r["pred_idx"]) not in used)
        if best:
            r = best[0][-1]
            used.add((r["page"], r["gt_idx"], r["pred_idx"])), want.append((name, r["page"], r["gt_idx"], r["pred_idx"]))
    assert [(r["bucket"], r["page"], r["gt_idx"], r["pred_idx"]) for r in got][: len(want)] == want
    assert len(selection.crop_examples(rows, quality_, 4, selection.few_buckets(quality_)).collect()) == 4


# ------------------------------------------------------------------ checks of output
def test_violations(spark):
    good = '[{"bbox": [1, 2, 3, 4], "type": "printed", "text": "а"}]'
    bad = '[{"bbox": [1, 2, 3], "type": "printed", "text": "а"}, {"bbox": [1, 2, 3, 4], "type": "zzz", "text": "а"}, 7, {"bbox": [1, 2, 3, 4]}, {"bbox": [1, 2, 3, 4], "type": null, "text": ""}]'
    df = spark.createDataFrame([(1, good), (2, bad), (3, None), (4, "{}"), (5, "[]"), (6, "[")], "row_id int, regions string")
    got = {tuple(r) for r in quality.violations(df, ["row_id"]).collect()}
    assert got == {(2, 0, "bbox_length"), (2, 1, "type"), (2, 2, "no_object"), (2, 3, "region_keys"), (2, 4, "type"), (3, -1, "no_list"), (4, -1, "no_list"), (6, -1, "no_list")}
    whole = {r["violation"] for r in quality.violations(df.where("row_id = 1"), ["row_id"], columns=("image", "regions"), rows=2).collect()}
    assert whole == {"columns", "row_count"} and quality.violations(df.where("row_id = 1"), ["row_id"], columns=("row_id", "regions"), rows=1).count() == 0
    assert quality.violations(df.limit(0), ["row_id"]).count() == 0


def test_lenient(spark):
    cases = {
        "[{'text': 'a, None, b', 'type': None}]": [("a, None, b", None)], "[{'text': 'it\\'s \"x\" (True)', 'bbox': (1, 2, 3, 4,),}, ]": [('it\'s "x" (True)', [1.0, 2.0, 3.0, 4.0])],
        '[{"text": "a, None, b"}]': [("a, None, b", None)], "nonsense": None, "{'a': 1}": None, "None": None, "": [], None: [], "[{'text': '\\\\'}]": [("\\", None)], "[]": [],
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", quality.lenient(F.col("v")).alias("r")).collect()}
    assert [None if got[i] is None else [(x["text"], x["bbox"]) for x in got[i]] for i in range(len(cases))] == list(cases.values())


def test_load_crops(spark):
    lines = ['{"label": "printed", "image": "a.jpg", "text": " а "}', "{", "[1]", "", '{"type": "printed", "file_name": "b.jpg", "text": "б"}', '{"label": null, "type": "printed", "image": "a", "text": "x"}',
             '{"label": "printed", "image": "", "path": "", "text": "x"}', '{"label": "printed", "image": "a.jpg", "text": "\\u00a0"}', '{"label": "graph", "image": "a.jpg", "text": "x"}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string")
    loaded = quality.load_crops(df, ("printed", "table"), spark.createDataFrame([("d/a.jpg",)], "path string"), "d/")
    got = {r["line_no"]: (r["reason"], r["missing_file"]) for r in loaded.collect()}
    assert got == {0: (None, False), 1: ("bad_json", False), 2: ("bad_json", False), 4: (None, True), 5: ("non_target_label", False), 6: ("missing_image", False), 7: ("empty_text", False), 8: ("non_target_label", False)}
    report = {(r["measure"], r["label"]): r["n"] for r in quality.load_report(loaded, ("printed", "table")).collect()}
    assert report == {("total", ""): 8, ("bad_json", ""): 2, ("kept", ""): 2, ("non_target_label", ""): 2, ("missing_image", ""): 1, ("empty_text", ""): 1, ("missing_file", ""): 1, ("kept_label", "printed"): 2,
                      ("kept_label", "table"): 0, ("raw_label", "printed"): 4, ("raw_label", ""): 1, ("raw_label", "graph"): 1}
    assert [tuple(r) for r in quality.first_missing(loaded).collect()] == [(4, "b.jpg")]
    assert {r["n"] for r in quality.load_report(loaded.limit(0), ("printed",)).collect()} == {0}


def test_patched(spark):
    from pagelens.operators import frames

    def region(b, t, x):
        return {"bbox": b, "type": t, "text": x}

    a = [region([0, 0, 9, 9], "printed", "old"), region([9, 9, 0, 0], "printed", "old"), region([0, 0, 9, 9], "table", "old"), region([0, 0, 9], "printed", "old"), region([0, 0, 9, 9], "printed", "old"), region([50, 50, 90, 90], "printed", "old")]
    sent = spark.createDataFrame([("a", json.dumps(a), 1), ("b", json.dumps(a[:1]), 2), ("c", "{", 3), (None, None, 4)], "image string, regions string, n int")
    answers = spark.createDataFrame([("a", i, "new" if i != 4 else None) for i in range(6)] + [("b", 0, "new"), ("c", 0, "new")], "image string, idx int, text string")
    pages = spark.createDataFrame([("a", 20, 20), ("c", 20, 20)], "image string, w int, h int")
    got = {r["n"]: r["regions"] for r in frames.patched(sent, answers, pages).collect()}
    assert [r["text"] for r in json.loads(got[1])] == ["new", "old", "old", "old", "old", "old"]
    assert got[2] == json.dumps(a[:1]) and got[3] == "{" and got[4] is None


def test_run_errors(spark):
    from pagelens.operators import runs

    sent = spark.createDataFrame([("r", 1, "a", "[7]", None), ("r", 2, "x", "{", None), ("s", 3, "a", "[]", None), ("s", 4, "b", None, None)], "run_id string, row_id int, image string, regions string, submitted_at timestamp")
    solution = spark.createDataFrame([("a",), ("b",)], "image string")
    assert {tuple(r) for r in runs.errors(sent, solution).collect()} == {("r", "not_an_object", 1), ("r", "bad_json", 1), ("r", "missing_image", 1)}


def test_answers_and_prompts(spark):
    from pagelens import schema
    from pagelens.operators import frames

    ddl = "regions array<struct<bbox:array<double>,type:string,text:string>>"
    df = spark.createDataFrame([([([0.0, 50.0, 100.0, 100.0], "Graph", "x"), ([10.0, 0.0, 50.0, 20.0], "table", None), ([0.0, 0.0, 5.0, 5.0], "table", "small"), (None, None, "no box")],)], ddl)
    one = df.select(frames.page_answer(F.col("regions"), F.lit(100), F.lit(100)).alias("a")).first()["a"]
    assert one == '[{"bbox":[100,0,500,200],"type":"table","text":""},{"bbox":[0,500,1000,1000],"type":"graph","text":""}]'
    hints, prompts = {"school": "H.", "default": "D."}, {"table": "T.", "graph": "G.", "default": "X."}
    ask = lambda t, s: spark.range(1).select(frames.prompt(F.lit(t), F.lit(s), hints, prompts, ("R.",)).alias("x")).first()["x"]
    assert (ask("TABLE", " School "), ask("odd", None), ask("graph", "school")) == ("H.\nT.\nR.", "D.\nX.\nR.", "G.")
    names = spark.createDataFrame([(0,), (6,), (7,), (-1,), (None,)], "i int").select(schema.type_name(F.col("i")).alias("n")).collect()
    assert [r["n"] for r in names] == ["handwritten", "graph", "handwritten", "handwritten", "handwritten"]
    again = {m: spark.range(1).select(frames.read_again(F.lit("дім"), m).alias("x")).first()["x"] for m in ("none", "all", "smart")}
    assert again == {"none": False, "all": True, "smart": True}


def test_tables(spark, tmp_path):
    """Every table of an evaluation, of a page sent well, one sent badly and one not sent."""
    from pagelens.operators import runs, tables
    from pagelens.sources import writers

    region = lambda i, t, x: (i, 0.0, 40.0 * i, 100.0, 40.0 * i + 30, t, x, "uk", "legible")
    gt = [region(0, "printed", "один два"), region(1, "formula", "n = 5"), region(2, "handwritten", "три")]
    solution = spark.createDataFrame([(x, "school", gt) for x in "abc"], f"image string, source string, gt array<{BOX}>")
    bad = [region(0, "printed", "один та"), region(1, "formula", "{n}"), region(2, "printed", "три")]
    sent = spark.createDataFrame([("r1", "a", gt), ("r1", "b", gt), ("r1", "c", gt), ("r2", "a", gt), ("r2", "b", bad)], f"run_id string, image string, pred array<{BOX}>")
    known = spark.createDataFrame([("r1", "full", "First"), ("r2", "ablation", "Second")], "run_id string, run_group string, label string")
    errors = spark.createDataFrame([("r2", "missing_image", 1)], "run_id string, code string, n bigint")
    t = tables.evaluation(solution, sent, known, errors, {"full": "full", "structured_ablation": "ablation"}, "r2")
    kinds = {(r["run_id"], r["type"]): r for r in t["per_type_metrics"].collect()}
    assert (kinds[("r2", "printed")]["gt_count"], kinds[("r2", "printed")]["pred_count"], kinds[("r2", "printed")]["matched"]) == (3, 3, 2) and kinds[("r1", "table")]["gt_count"] == 0
    assert {(r["run_id"], r["gt_count"]) for r in t["per_source_metrics"].collect()} == {("r1", 9), ("r2", 9)}
    assert [tuple(r) for r in t["paper_full"].collect()] == [("First", "1.0000", "1.0000", "1.0000", "0.0000", "0.0000")]
    assert [tuple(r)[:2] for r in t["paper_structured_ablation"].collect()] == [("Second", 2)]
    assert [(r["image"], r["invalid_reason"]) for r in t["invalid_examples"].collect()] == [("b", "json_or_list_wrapper")]
    assert t["text_worst"].first()["image"] == "b" and [r["label"] for r in t["paper_text"].collect()] == ["First", "Second"]
    modules = {(r["group"], r["metric"]): (r["n"], r["value"]) for r in t["paper_modules"].collect()}
    assert modules[("annotation", "CER")] == (0, "") and modules[("overall", "WER")] == (4, "0.1250") and modules[("formula", "CER")][0] == 2
    writers.tables({k: t[k] for k in ("paper_full", "evaluation_errors")}, str(tmp_path))
    assert (tmp_path / "paper_full.md").read_text().count("\n") == 3
    empty = tables.evaluation(solution, sent.limit(0), known, errors.limit(0), {"full": "full"}, "r2")
    assert empty["paper_full"].count() == 0 and empty["paper_text"].count() == 0
    assert runs.evaluate(solution.limit(0), sent).count() == 0
