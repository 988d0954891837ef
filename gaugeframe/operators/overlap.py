"""Scores per position of sequences that are longer than a model's window.

A longer sequence is read by windows from both ends towards the middle, and by
one more in the middle if the last two overlap little.  Each window is scored by
itself, in any task; positions near its ends, where the model sees one side only,
weigh less, and the weighted mean over the windows of a position is its score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1024


def stride_of(size: int) -> int:
    """How far the next window from one end lies: half a window less one."""
    return size // 2 - 1


def window_starts(length: Column, size: int = SIZE) -> Column:
    """Starts (from 0) of the windows of a sequence, in order; one for a short sequence."""
    step = stride_of(size)
    n = length.cast("bigint")
    # windows k steps from both ends, until the left one passes the start of the right one
    last = F.when(n < 2 * size - 1, 0).otherwise(F.floor((n - 2 * size + 1) / (2 * step)) + 1).cast("int")
    from_left = F.transform(F.sequence(F.lit(0), last), lambda k: (k * step).cast("bigint"))
    from_right = F.transform(F.sequence(F.lit(0), last), lambda k: n - size - k * step)
    middle = F.when(2 * size + 2 * step * last - n < step, F.array(F.floor(n / 2) - size // 2)).otherwise(F.array().cast("array<bigint>"))
    every = F.array_sort(F.concat(from_left, from_right, middle))
    return F.when(n <= size, F.array(F.lit(0).cast("bigint"))).otherwise(every)


def weight(at: Column, size: int = SIZE) -> Column:
    """Weight of a position of a window (from 0): logistic over a quarter at both ends, 1 between them and at the two outermost positions."""
    edge = size // 4
    centre, scale = edge / 2, edge / 16
    left = 1 / (1 + F.exp(-(at - centre) / scale))
    right = 1 / (1 + F.exp((at - (size - 2) + centre) / scale))
    return F.when((at >= 1) & (at <= edge), left).when((at >= size - 2 - edge) & (at <= size - 2), right).otherwise(1.0)


def position_scores(rows: DataFrame, key: str, sequence: str, adapter: Callable[[Sequence[str]], Sequence[Sequence[float]]], size: int = SIZE) -> DataFrame:
    """``key, position, score``: the adapter's value of every position (from 0) of every sequence.

    ``adapter`` gets windows of at most ``size`` characters and gives a finite
    number for each character of each.  Windows are scored where they are and
    meet again by position, so one long sequence is many tasks.  Windows that
    come twice, from both ends of an even length, count twice.  Null and empty
    sequences have no rows; a key must not repeat.
    """
    if size < 16:
        raise ValueError("a window has 16 positions at least")
    text = F.col(sequence)
    cut = rows.filter(text.isNotNull() & (text != "")).select(F.col(key).alias("_key"), F.length(text).alias("_n"), text.alias("_s"))
    cut = cut.select("_key", "_n", F.posexplode(window_starts(F.col("_n"), size)).alias("_i", "_start"), "_s").select("_key", "_n", "_start", F.substring("_s", (F.col("_start") + 1).cast("int"), F.lit(size)).alias("_w"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            values = [np.asarray(v, dtype=float) for v in adapter(b["_w"].tolist())]
            if len(values) != len(b) or any(v.shape != (len(w),) or not np.isfinite(v).all() for v, w in zip(values, b["_w"], strict=True)):
                raise ValueError("the adapter must give a finite number for every position of every window")
            yield pd.DataFrame({"_key": b["_key"], "_n": b["_n"], "_start": b["_start"], "_v": [v.tolist() for v in values]})

    kind = rows.schema[key].dataType.simpleString()
    # windows are dealt evenly, as one sequence may have most of them
    scored = cut.repartition(F.col("_key"), F.col("_start")).mapInPandas(run, f"_key {kind}, _n int, _start bigint, _v array<double>")
    cells = scored.select("_key", "_n", "_start", F.posexplode("_v").alias("_at", "_x"))
    w = F.when(F.col("_n") <= size, 1.0).otherwise(weight(F.col("_at"), size))
    cells = cells.select("_key", (F.col("_start") + F.col("_at")).alias("position"), (w * F.col("_x")).alias("_wx"), w.alias("_w"))
    return cells.groupBy("_key", "position").agg((F.sum("_wx") / F.sum("_w")).alias("score")).select(F.col("_key").alias(key), "position", "score")
