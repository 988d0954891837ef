"""Ranks and running totals that do not need one task per group.

``running`` first sums rows of equal value, then splits the value range into
buckets at approximate quantiles.  Totals run within a bucket, and the totals
of earlier buckets, a small table, are added.  A group with a third of all rows
is so spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Distinct values of a bucket of the value range, about, and buckets at most.
BUCKET_VALUES, MOST_BUCKETS = 100_000, 1024
#: Places whose discounts are summed in one row.
PLACES = 10_000


def _measure(df: DataFrame, value: str) -> Column:
    """A double in the order of the values; of a text its first bytes, so that equal doubles may stand for several texts."""
    if df.schema[value].dataType.simpleString() != "string":
        return F.col(value).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.col(value).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def running(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column], descending: bool = True, buckets: int | None = None) -> DataFrame:
    """One row per group and distinct value: each sum, ``before_<sum>`` of better values and ``total_<sum>`` of the group.

    Rows with a null value are left out.  The number of buckets follows the
    distinct values, if it is not given.
    """
    df = df.filter(F.col(value).isNotNull())
    if buckets is None:
        distinct = df.agg(F.approx_count_distinct(F.xxhash64(*by, value))).first()[0] or 0
        buckets = min(MOST_BUCKETS, math.ceil(distinct / BUCKET_VALUES))
    cuts = []
    if buckets > 1:
        cuts = sorted({float(c) for c in (df.agg(F.approx_percentile(_measure(df, value), [i / buckets for i in range(1, buckets)], F.lit(1000)).alias("q")).first()["q"] or [])})
    cells = df.groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()])
    # deterministic in the value, so equal values share a bucket
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < _measure(df, value)))
    cells = cells.withColumn("_bucket", -bucket if descending else bucket)
    order = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = cells.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(f"_s_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(*by, "_bucket", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.sum(f"_s_{n}").over(whole).alias(f"total_{n}") for n in sums])
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*by, "_bucket"]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    local = cells.select(*by, value, "_bucket", *sums, *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_b_{n}") for n in sums])
    joined = local.alias("c").join(offsets.alias("o"), condition)
    return joined.select(*[F.col(f"c.{k}").alias(k) for k in [*by, value]], *sums, *[(F.col(f"_b_{n}") + F.col(f"_o_{n}")).alias(f"before_{n}") for n in sums], *[f"total_{n}" for n in sums])


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with its rows numbered from 1 in a total order, or within each group of ``by``.

    Rows are dealt by ranges of the order and numbered there; the small table of
    the ranges' earlier counts is added.  A group is as many ranges as it needs.
    """
    full = [*[F.col(c) for c in by], *order]
    at = F.monotonically_increasing_id()  # the range in the high bits, the row in it in the low ones
    ranged = df.repartitionByRange(*full).sortWithinPartitions(*full).withColumns({"_range": F.shiftright(at, 33), "_row": at.bitwiseAND((1 << 33) - 1)})
    ranged = materialise(ranged)  # the same ranges below
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    out = ranged.join(counts.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_range", "_row", "_before")
    if by:
        first = out.groupBy(*by).agg(F.min(name).alias("_first")).select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], "_first")
        condition = F.col(by[0]).eqNullSafe(F.col("_by_0"))
        for i, c in enumerate(by[1:], 1):
            condition = condition & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
        out = out.join(first, condition).withColumn(name, F.col(name) - F.col("_first") + 1)
    return out.select(*[f"`{c}`" for c in df.columns], name)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the average rank of each value within its group (1 is the smallest; ties share the mean of their ranks).

    For groups that fit a task; larger ones use ``running``.
    """
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, name: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in an order that must be total."""
    at = name or "_rank"
    out = df.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(at) <= n)
    return out if name else out.drop(at)


def stratified_hash_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each stratum, those with the smallest sha256 of "seed:key"."""
    return first_per_group(df, [stratum], [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256), F.col(key)], n)


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with a column of each share's quantile, interpolated between the two values next to its place; no task holds a group."""
    r = running(df, by, value, {"n": F.count("*")}, descending=False)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col(value).cast("double")))

    place = {name: F.lit(q) * (F.col("total_n") - 1) for name, q in shares.items()}
    ends = r.groupBy(*by).agg(*[at(f(p)).alias(f"_{side}_{name}") for name, p in place.items() for side, f in (("l", F.floor), ("h", F.ceil))], F.max("total_n").alias("total_n"))
    return ends.select(*by, *[(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * (p - F.floor(p))).alias(n) for n, p in place.items()])


def discounts(cells: DataFrame, first: str, count: str, name: str) -> DataFrame:
    """``cells`` with ``name``: the sum of 1 / log2(place + 1) over ``count`` places after ``first`` of them; many places are summed in parts."""
    parts = cells.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.col(count), F.lit(1)) - 1) / PLACES).cast("int"))))
    low = F.col(first) + F.col("_part") * PLACES + 1
    high = F.least(F.col(first) + F.col(count), low + PLACES - 1)
    some = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return parts.withColumn(name, F.when(F.col(count) > 0, some).otherwise(0.0)).drop("_part")
