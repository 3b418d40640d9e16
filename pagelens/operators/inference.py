"""The place where models plug in: batches of crops in, texts out.

Ships no model.  A predictor is made once per Python worker and called with batches;
a crop that fails keeps an empty text and does not fail its page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def read(crops: DataFrame, make: Callable[[], Callable[[list[dict]], list[str]]], columns: list[str], batch: int = 64) -> DataFrame:
    """``crops`` with ``answer``: what the predictor says to each row's ``columns``, cleaned."""
    names = [f.name for f in crops.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in crops.schema) + ", answer string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        for frame in frames:
            rows, out = frame[columns].to_dict("records"), []
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                try:
                    out += predict(part)
                except Exception:
                    for r in part:  # one by one, so that a single crop fails alone
                        try:
                            out += predict([r])
                        except Exception:
                            out.append("")
            yield frame.assign(answer=out)[[*names, "answer"]]

    return crops.mapInPandas(run, schema).withColumn("answer", text.clean_output(F.col("answer")))


def echo() -> Callable[[list[dict]], list[str]]:
    """A predictor without a model: the text that is there."""
    return lambda rows: [str(r.get("text") or "") for r in rows]


def merged(old: Column, new: Column) -> Column:
    """An empty answer never overwrites a text."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def best_checkpoint(metrics: DataFrame) -> DataFrame:
    """The step of the least error, the earliest of equal ones, and how often each step was seen."""
    once = metrics.groupBy("step").agg(F.min("cer").alias("cer"))
    return once.agg(F.min_by("step", F.struct("cer", "step")).alias("step"), F.min("cer").alias("cer"))


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path with the greatest number at its end."""
    n = F.regexp_extract("path", r"(\d+)/?$", 1)
    return paths.where(n != "").agg(F.max_by("path", F.try_to_number(n, F.lit("999999999999999999"))).alias("path"))
