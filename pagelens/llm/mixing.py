"""Mixtures of sources with target weights in tokens, by Poisson replication.

Every document is repeated as often as a Poisson distribution says whose mean is
its source's repetition rate: the target in tokens over the tokens there are.  The
distribution is inverted at a hash of seed, mixture and document, so that counts
are reproducible; it is censored at the cap, and its parameter chosen so that the
censored mean is the rate.  The copies are then shuffled globally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small
from . import tokenizer
from .proportions import canonical

SEED = 20_240_607


def _below(lam: float, cap: int) -> list[float]:
    """``P(count < k)`` for k = 1..cap of the Poisson distribution; from logarithms, so that no rate underflows."""
    if lam <= 0:
        return [1.0] * cap
    k = np.arange(cap, dtype=np.float64)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, cap, dtype=np.float64)))))[:cap]
    return np.minimum(1.0, np.cumsum(np.exp(k * math.log(lam) - lam - log_factorial))).tolist()


def thresholds(rate: float, cap: int) -> list[float]:
    """``P(count < k)`` for k = 1..cap of the censored Poisson of mean ``rate``.

    A document with the uniform number u is repeated as often as thresholds are <= u.
    A rate at or beyond the cap repeats all documents that often.
    """
    if cap <= 0 or rate <= 0:
        return [1.0] * max(cap, 0)
    if rate >= cap:
        return [0.0] * cap
    mean = lambda lam: cap - sum(_below(lam, cap))
    low, high = 0.0, max(1.0, 2 * rate)
    while mean(high) < rate:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < rate else (low, mid)
    return _below((low + high) / 2, cap)


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, key, n_tokens)``; ``key`` is the source without case and white space."""
    row = F.struct(F.col("doc_id"), canonical(F.col("source")).alias("key"))
    return tokenizer.count(documents, row, path=path).select("key.*", "n_tokens")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a target: tokens there are, wanted and missing, rate and thresholds; written once.

    ``sizes`` is ``(key, n_tokens)``.  Sources are summed ahead of the shuffle.  Null
    weights, shares and repeats count as 0.  ``mean`` is what replication by the
    thresholds gives on average; a source is short if that stays below its target,
    since its documents are repeated up to the cap.
    """
    per = materialize(sizes.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))  # a row a source
    total = per.agg(F.sum("tokens")).first()[0] or 0  # one number
    wanted = targets.select(
        "mix_id", "source", canonical(F.col("source")).alias("key"),
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("weight", "max_repeats", "budget_share")),
    )
    rows = wanted.join(per, "key", "left").withColumns(
        {"tokens": F.coalesce("tokens", F.lit(0)), "docs": F.coalesce("docs", F.lit(0)), "total": F.lit(total).cast("bigint"), "target": (F.col("weight") * F.col("budget_share") * F.lit(total)).cast("double")}
    )
    rate = F.least(F.col("max_repeats").cast("double"), F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(0.0))
    rows = rows.select("mix_id", "source", "key", "docs", "tokens", "max_repeats", "total", "target", rate.alias("rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = [thresholds(r or 0.0, int(c)) for r, c in zip(b["rate"].to_pylist(), b["max_repeats"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(edges, pa.list_(pa.float64()))], names=[*b.schema.names, "edges"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    solved = rows.mapInArrow(run, f"{ddl}, edges array<double>")  # once a target, not once a document
    copies = F.aggregate("edges", F.lit(0.0), lambda acc, e: acc + 1 - e)
    solved = solved.withColumn("mean", F.col("tokens") * copies)
    return materialize(solved.withColumn("short", F.col("mean") < F.col("target") * (1 - 1e-9)))


def found(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """``(mix_id, source)`` of the targets that replication up to the cap leaves short."""
    return plan(sized(documents, path).select("key", "n_tokens"), targets).where("short").select("mix_id", "source")


def replicate(sizes: DataFrame, plans: DataFrame, seed: int = SEED) -> DataFrame:
    """``(mix_id, doc_id, key, n_tokens, copies)`` of the documents with a copy."""
    wanted = plans.where("size(edges) > 0 and rate > 0").select("mix_id", "key", "edges").dropDuplicates(["mix_id", "key"])
    wanted = F.broadcast(wanted) if small(wanted) else wanted  # else a join by key, which AQE splits
    # u in [0, 1): 53 bits of a hash
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), 11) / float(2**53)
    copies = F.size(F.filter("edges", lambda e: e <= u))
    return sizes.join(wanted, "key").withColumn("copies", copies).where("copies > 0").drop("edges")


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED, path: str | None = None) -> DataFrame:
    """``(mix_id, doc_id, copy, shuffle_key)`` in a global random order.

    The order is that of ``shuffle_key``, ties by mixture, document and copy.  A source
    named twice in a mixture counts once.  Unnamed sources have no copies.
    """
    sizes = materialize(sized(documents, path))
    rows = replicate(sizes, plan(sizes, targets), seed)
    rows = rows.select("mix_id", "doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "mix_id", "doc_id", "copy")).orderBy("shuffle_key", "mix_id", "doc_id", "copy")


def report(documents: DataFrame, targets: DataFrame, seed: int = SEED, path: str | None = None) -> DataFrame:
    """A row a target: tokens wanted and reached, their shares of the mixture, docs used."""
    sizes = materialize(sized(documents, path))
    plans = plan(sizes, targets)
    got = replicate(sizes, plans, seed).groupBy("mix_id", "key").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("reached"), F.count("*").alias("used"), F.max("copies").alias("most"),
    )
    whole = got.groupBy("mix_id").agg(F.sum("reached").alias("mixture"))
    aims = plans.groupBy("mix_id").agg(F.sum("target").alias("aim"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0), 6)
    return plans.join(got, ["mix_id", "key"], "left").join(whole, "mix_id", "left").join(aims, "mix_id").select(
        "mix_id", "source", "tokens", "target", zero("reached"), share("target", "aim").alias("target_share"),
        share("reached", "mixture").alias("actual_share"), "docs", zero("used"), zero("most"), "short",
    )
