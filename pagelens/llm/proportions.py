"""Samples whose shares of categories match given targets.

Quotas are a two-way table, category by stratum: each category's quota is spread
over the strata as its members are.  The fractional table is made integer by
controlled rounding: a maximum flow with lower bounds gives every cell, row,
column and the total one of its two neighbouring integers.  Each cell then draws
exactly its quota of members with the smallest random keys.  A target is met if
the rounded row of its category reaches it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, small

SEED = 1089
BINS = 4096  # of the random keys: only one bin of a cell is ever ranked
SOURCES = ("dictation", "archive", "university", "school")
SPLITS = ("train", "silver", "val", "test", "private")


def canonical(c: Column) -> Column:
    """A value apart from letter case and surrounding white space; null is the empty value."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), F.lit(""))


def max_flow(n: int, edges: list[tuple[int, int, int]], s: int, t: int) -> list[int]:
    """Flow on each edge ``(from, to, capacity)`` of a maximum flow.

    By blocking flows in the layers of shortest paths; on tables, whose layers are
    few and whose capacities are units, the number of phases hardly grows.
    """
    to, cap, at = [], [], [[] for _ in range(n)]
    for a, b, c in edges:
        at[a].append(len(to)), to.append(b), cap.append(c)
        at[b].append(len(to)), to.append(a), cap.append(0)
    while True:
        level, layer = [-1] * n, [s]
        level[s] = 0
        while layer and level[t] < 0:
            ahead = []
            for x in layer:
                for e in at[x]:
                    if cap[e] and level[to[e]] < 0:
                        level[to[e]] = level[x] + 1
                        ahead.append(to[e])
            layer = ahead
        if level[t] < 0:
            return [cap[2 * k + 1] for k in range(len(edges))]
        nxt, path, x = [0] * n, [], s
        while True:
            if x == t:
                push = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if not cap[e])
                x = to[path[k] ^ 1]
                del path[k:]
            while nxt[x] < len(at[x]):
                e = at[x][nxt[x]]
                if cap[e] and level[to[e]] == level[x] + 1:
                    break
                nxt[x] += 1
            if nxt[x] < len(at[x]):
                path.append(at[x][nxt[x]])
                x = to[path[-1]]
            elif path:  # nothing leads on from x
                x = to[path.pop() ^ 1]
                nxt[x] += 1
            else:
                break


def _bounds(x: float) -> tuple[int, int]:
    near = round(x)
    return (near, near) if abs(x - near) < 1e-6 else (math.floor(x), math.ceil(x))


def controlled_rounding(table: list[list[float]]) -> list[list[int]]:
    """Integers for a non-negative table: cells, margins and total each floor or ceiling.

    The fractions are themselves a feasible flow, so an integer one exists.
    """
    r, c = len(table), len(table[0]) if table else 0
    if not r or not c:
        return [[] for _ in table]
    s, t, source, sink = r + c, r + c + 1, r + c + 2, r + c + 3
    arcs: list[tuple[int, int, int, int]] = []
    arcs += [(s, i, *_bounds(sum(row))) for i, row in enumerate(table)]
    arcs += [(i, r + j, *_bounds(x)) for i, row in enumerate(table) for j, x in enumerate(row)]
    arcs += [(r + j, t, *_bounds(sum(row[j] for row in table))) for j in range(c)]
    total = sum(map(sum, table))
    arcs.append((t, s, round(total), round(total)))
    extra = [0] * (r + c + 2)  # lower bounds that flow in, less those that flow out
    for a, b, low, _ in arcs:
        extra[b] += low
        extra[a] -= low
    edges = [(a, b, high - low) for a, b, low, high in arcs]
    edges += [(source, v, x) for v, x in enumerate(extra) if x > 0]
    edges += [(v, sink, -x) for v, x in enumerate(extra) if x < 0]
    flow = max_flow(r + c + 4, edges, source, sink)
    cells = [low + f for (_, _, low, _), f in zip(arcs, flow)][r : r + r * c]
    return [cells[i * c : (i + 1) * c] for i in range(r)]


def quotas(targets: list[tuple[float, int, list[int]]]) -> tuple[list[list[int]], list[bool]]:
    """Quotas of a plan, categories by strata, and which targets they meet.

    A row is ``(target, min_rows, members by stratum)``.  A category is to get its
    target or its minimum, whichever is more, as far as it has members.  What a
    category lacks is spread over the others in proportion to their targets, as far as
    they have members, so that their shares and the size of the sample hold; minimums
    only add to it.  The row sums are made whole, upwards; controlled rounding makes
    the cells whole and keeps both margins.
    """
    have = [sum(n) for _, _, n in targets]
    aim = [max(t, low) for t, low, _ in targets]
    total = sum(t for t, _, _ in targets)
    room = lambda x: [min(h, max(x * t, a)) for h, a, (t, _, _) in zip(have, aim, targets)]
    low, high = 1.0, 1.0
    if sum(room(1.0)) < total:  # something is lacking: the greatest factor that does not exceed the size
        while sum(room(high)) < total and any(x < h for x, h, (t, _, _) in zip(room(high), have, targets) if t > 0):
            high *= 2
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(room(mid)) <= total else (low, mid)
    take = [min(h, math.ceil(x - 1e-9)) for h, x in zip(have, room(low))]
    cells = controlled_rounding([[x * m / h if h else 0.0 for m in n] for x, h, (_, _, n) in zip(take, have, targets)])
    return cells, [sum(row) >= t - 1e-9 and sum(row) >= least for row, (t, least, _) in zip(cells, targets)]


def members(pages: DataFrame) -> DataFrame:
    """The pools: ``(field, record_id, region_idx, category, stratum)``.

    Of repeated deliveries of a ``split`` and ``file_name`` the one of the smallest id
    counts.  ``source``: pages (region_idx -1), strata are the splits.  ``type``: their
    regions, strata are the sources.  Null values have the category ''.
    """
    row = F.struct(
        F.col("record_id"),
        canonical(F.col("source")).alias("source"),
        F.transform(F.col("regions.type"), canonical).alias("types"),
    )
    one = pages.groupBy("split", "file_name").agg(F.min(row).alias("r")).select("split", "r.*")
    known = lambda c, values: F.when(c.isin(*values), c).otherwise("other")
    entry = lambda field, i, category, stratum: F.struct(F.lit(field).alias("field"), i.cast("int").alias("region_idx"), category.alias("category"), stratum.alias("stratum"))
    page = F.array(entry("source", F.lit(-1), F.col("source"), known(canonical(F.col("split")), SPLITS)))
    regions = F.transform("types", lambda t, i: entry("type", i, t, known(F.col("source"), SOURCES)))
    both = F.when(F.col("types").isNull(), page).otherwise(F.concat(page, regions))
    return one.select("record_id", F.explode(both).alias("e")).select("e.field", "record_id", "e.region_idx", "e.category", "e.stratum")


PLAN = (
    "plan_id string, field string, category string, key string, pool bigint, members bigint, target double, min_rows int, "
    "drawn bigint, share double, met boolean, cells array<struct<stratum: string, quota: bigint>>"
)


def plan(pages: DataFrame, targets: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """A row a target: :data:`PLAN`.  Written once; each plan's flow is one task's work.

    Members are counted by category and stratum ahead of the shuffle; what a task holds
    is the targets of one plan times the strata.  Null shares and fractions count as 0,
    null ``min_rows`` as none, fields other than source and type have no pool.
    ``pool`` is :func:`members` if it is already there.
    """
    counts = materialize((pool or members(pages)).groupBy("field", "category", "stratum").agg(F.count("*").alias("n")))
    pools = counts.groupBy("field").agg(F.sum("n").alias("pool"))
    strata = counts.groupBy("field", F.col("category").alias("key")).agg(F.collect_list(F.struct("stratum", "n")).alias("strata"))  # at most six each
    wanted = targets.select(
        "plan_id", "field", canonical(F.col("category")).alias("key"), "category",
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("target_share", "min_rows", "sample_fraction")),
    )
    rows = wanted.join(pools, "field", "left").join(strata, ["field", "key"], "left").select(
        "plan_id", "field", "category", "key", F.coalesce("pool", F.lit(0)).alias("pool"),
        (F.col("target_share") * F.col("sample_fraction") * F.coalesce("pool", F.lit(0))).alias("target"), F.col("min_rows").cast("int").alias("min_rows"), "strata",
    )
    names = [c.split()[0] for c in PLAN.split("array")[0].split(", ")]

    def run(batches: Iterator[pa.Table] | pa.Table) -> pa.Table:
        given = sorted(batches.to_pylist(), key=lambda r: (r["field"] or "", r["key"], r["category"] or "", r["target"], r["min_rows"]))
        out = []
        for field in sorted({r["field"] or "" for r in given}):
            mine = [r for r in given if (r["field"] or "") == field]
            order = sorted({x["stratum"] for r in mine for x in r["strata"] or []})
            table = []
            for r in mine:
                n = {x["stratum"]: x["n"] for x in r["strata"] or []}
                table.append((r["target"], r["min_rows"], [n.get(s, 0) for s in order]))
            cells, met = quotas(table)
            drawn = sum(map(sum, cells))
            for r, (_, _, n), row, ok in zip(mine, table, cells, met):
                cut = [{"stratum": s, "quota": q} for s, q in zip(order, row) if q]
                values = (*(r[c] for c in names[:5]), sum(n), r["target"], r["min_rows"], sum(row), sum(row) / drawn if drawn else 0.0, ok, cut)
                out.append(dict(zip([*names[:11], "cells"], values)))
        return pa.Table.from_pylist(out, schema=_arrow())

    return materialize(rows.groupBy("plan_id").applyInArrow(run, PLAN))


def _arrow() -> pa.Schema:
    text, whole = pa.string(), pa.int64()
    return pa.schema([
        ("plan_id", text), ("field", text), ("category", text), ("key", text), ("pool", whole), ("members", whole), ("target", pa.float64()), ("min_rows", pa.int32()),
        ("drawn", whole), ("share", pa.float64()), ("met", pa.bool_()), ("cells", pa.list_(pa.struct([("stratum", text), ("quota", whole)]))),
    ])


def report(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a target: pool, members, target, rows drawn, share reached, whether met.

    A target is not met if the rounded quotas of its category stay below the target or
    below ``min_rows``: it has too few members.
    """
    return plan(pages, targets).drop("key", "cells")


def sample(pages: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``(plan_id, record_id, region_idx, category, stratum)``: exact draws of every plan.

    The smallest ``quota`` random keys of each cell.  A histogram of the keys, counted
    ahead of the shuffle, tells the bin in which the quota ends; whole bins below it
    are taken, only that bin (about 1/4096 of a cell) is ranked, so that a category
    with a third of all rows is never in one task.  Ties of the key go by id.  A category
    named twice in a plan is drawn once, to the larger of its quotas.
    """
    pool = materialize(members(pages))  # narrow; read three times
    cells = plan(pages, targets, pool).select("plan_id", "field", F.col("key").alias("category"), F.inline("cells"))
    wanted = materialize(cells.groupBy("plan_id", "field", "category", "stratum").agg(F.max("quota").alias("quota")))
    near = (lambda df: F.broadcast(df)) if small(wanted) else (lambda df: df)  # targets x strata; beyond that a plain join
    key = F.xxhash64(F.lit(seed), "plan_id", "record_id", "region_idx")
    keyed = pool.join(near(wanted), ["field", "category", "stratum"]).withColumns(
        {"key": key, "bin": F.shiftrightunsigned(key, 52).cast("int")}
    )
    cell = ["plan_id", "field", "category", "stratum"]
    order = Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = keyed.groupBy(*cell, "bin").agg(F.count("*").alias("n"), F.first("quota").alias("q")).withColumn(
        "before", F.coalesce(F.sum("n").over(order), F.lit(0))
    ).where("before < q and before + n >= q").select(*cell, F.col("bin").alias("last"), (F.col("q") - F.col("before")).alias("left"))
    marked = keyed.join(near(materialize(ends)), cell)
    in_bin = Window.partitionBy(*cell, "bin").orderBy("key", "record_id", "region_idx")
    part = marked.where("bin = last").withColumn("rank", F.row_number().over(in_bin)).where("rank <= left")
    cols = ["plan_id", "record_id", "region_idx", "category", "stratum"]
    return marked.where("bin < last").select(*cols).unionByName(part.select(*cols))
