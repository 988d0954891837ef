"""Point-in-interval joins by binning, and checks of neighbouring intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered


def point_in_interval(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, by: Sequence[str] = (), width: int = 1000) -> DataFrame:
    """Every point with every closed interval that holds it, on equal ``by`` columns.

    An interval is a row per bin of ``width`` that it touches, so the join is an
    equi-join that shuffles, or broadcasts what is small, instead of a nested
    loop.  A point is in one bin, so no pair is found twice.
    """
    p = points.withColumn("_bin", F.floor(F.col(point) / width))
    i = intervals.filter(F.col(start) <= F.col(stop)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    return p.join(i, [*by, "_bin"]).filter((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(stop))).drop("_bin")


def overlaps_before(intervals: DataFrame, by: str, start: str, stop: str, key: str) -> DataFrame:
    """Rows with ``overlaps``: whether an interval starts before the end of the one before it in its group (by start, end and key)."""
    n = numbered(intervals, [F.col(start), F.col(stop), F.col(key)], "_place", [by])
    before = n.select(F.col(by).alias("_by"), (F.col("_place") + 1).alias("_at"), F.col(stop).alias("_end"))
    joined = n.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_place") == F.col("_at")), "left")
    return joined.withColumn("overlaps", F.coalesce(F.col(start) <= F.col("_end"), F.lit(False))).drop("_place", "_by", "_at", "_end")


def envelopes(intervals: DataFrame, by: str, start: str, stop: str) -> DataFrame:
    """``by, start, stop, n`` of each group's hull."""
    return intervals.groupBy(by).agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.count("*").alias("n"))


def distance_band(position, start, stop, edges: Sequence[tuple[int, str]] = ((2, "canonical"), (10, "near"), (50, "proximal")), otherwise: str = "distal"):
    """Band of the distance to the nearer border of an interval."""
    d = F.least(F.abs(position - start), F.abs(position - stop))
    out = None
    for most, name in edges:
        out = F.when(d <= most, name) if out is None else out.when(d <= most, name)
    return out.otherwise(otherwise)
