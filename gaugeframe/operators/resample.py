"""Group bootstrap: groups are drawn with replacement and keep all their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unit_hash
from .joins import with_row
from .metrics import ranking_metrics
from .ranking import numbered, running

#: Strata up to which their sizes are broadcast.
STRATA = 100_000


def _pick(seed: str, slot: Column, n: Column) -> Column:
    """A number from 0 to n - 1 by sha256("seed:slot")."""
    word = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), slot).cast("binary"), 256), 1, 12)
    return F.pmod(F.conv(word, 16, 10).cast("bigint"), n)


def group_draws(rows: DataFrame, group: str, draws: int, seed: str = "0") -> DataFrame:
    """``draw, slot, group``: as many groups as there are, for each draw; a slot's group comes from sha256("seed:draw:slot").

    Groups are numbered in their own order; the table has draws times groups rows.
    """
    g = running(rows.select(group).distinct().withColumn("_all", F.lit(0)), ["_all"], group, {"n": F.count("*")}, descending=False).select(group, F.col("before_n").alias("_i"))
    n = g.agg(F.count("*").alias("_n"))
    slots = with_row(g.select(F.col("_i").alias("slot")), n).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = slots.withColumn("_i", _pick(seed, F.concat_ws(":", F.col("draw").cast("string"), F.col("slot").cast("string")), F.col("_n")))
    return picked.join(g, "_i").select("draw", "slot", group)


def weighted_draws(rows: DataFrame, group: str, columns: Sequence[str], draws: int, seed: str = "0") -> DataFrame:
    """``draw, weight`` and the columns: each draw's rows, equal ones as one with their number.

    Rows are summed per group and the drawn groups counted before the two meet,
    so no row is copied for a group that is drawn several times.
    """
    counts = group_draws(rows, group, draws, seed).groupBy("draw", group).agg(F.count("*").alias("_times"))
    sums = rows.groupBy(group, *columns).agg(F.count("*").alias("_rows"))
    return counts.join(sums, group).groupBy("draw", *columns).agg(F.sum(F.col("_times") * F.col("_rows")).alias("weight"))


def paired_bootstrap(rows: DataFrame, group: str, label: str, first: str, second: str, draws: int, metric: str = "auroc", seed: str = "0", most_skipped: float = 0.05) -> DataFrame:
    """One row of ``observed, low, high, used, skipped, refused``: the difference of a metric of two scores, with its 95 % interval over draws.

    A group that is drawn twice counts twice.  Draws of a single class are
    skipped; more than ``most_skipped`` of them refuse the interval.
    """
    both = [ranking_metrics(weighted_draws(rows, group, [label, s], draws, seed), label, s, ["draw"], weight="weight").select("draw", F.col(metric).alias(f"m{i}")) for i, s in enumerate((first, second))]
    per = both[0].join(both[1], "draw").select((F.col("m1") - F.col("m0")).alias("delta"))
    interval = per.agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("delta").alias("used"))  # one row per draw
    a, b = (ranking_metrics(rows, label, s).select(F.col(metric).alias(f"m{i}")) for i, s in enumerate((first, second)))
    observed = with_row(a, b).select((F.col("m1") - F.col("m0")).alias("observed"))
    out = with_row(observed, interval).withColumn("skipped", F.lit(draws) - F.col("used"))
    refused = F.col("skipped") > draws * most_skipped
    return out.select("observed", F.when(~refused, F.col("q")[0]).alias("low"), F.when(~refused, F.col("q")[1]).alias("high"), "used", "skipped", refused.alias("refused"))


def bootstrap_error(rows: DataFrame, key: str, value: str, draws: int, seed: str = "0", stratum: str | None = None) -> DataFrame:
    """One row of ``standard_error``: the sample deviation of the mean over draws of rows with replacement.

    With a ``stratum`` rows are drawn within each of its values, and a draw's
    mean is the mean of theirs.
    """
    by = [stratum] if stratum else []
    counted = numbered(rows.select(*by, key, value), [F.col(key)], "_i", by).withColumn("_i", F.col("_i") - 1)
    sizes = counted.groupBy(*by).agg(F.count("*").alias("_n"))
    slots = counted.select(*by, F.col("_i").alias("slot"))
    slots = (slots.join(F.broadcast(sizes) if sizes.count() <= STRATA else sizes, by) if by else with_row(slots, sizes)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = slots.withColumn("_i", _pick(seed, F.concat_ws(":", F.col("draw").cast("string"), *[F.col(c).cast("string") for c in by], F.col("slot").cast("string")), F.col("_n")))
    # how often each row is drawn meets its value once per draw
    times = picked.groupBy("draw", *by, "_i").agg(F.count("*").alias("_times"))
    known = counted.filter(F.col(value).isNotNull()).select(*by, "_i", F.col(value).cast("double").alias("_v"))
    means = times.join(known, [*by, "_i"]).groupBy("draw", *by).agg((F.sum(F.col("_times") * F.col("_v")) / F.sum("_times")).alias("m"))
    if by:
        means = means.groupBy("draw").agg(F.avg("m").alias("m"))
    return means.agg(F.stddev_samp("m").alias("standard_error"))


def sample_rows(rows: DataFrame, n: int, how: str, key: str, seed: str = "0", ordinal: str | None = None, weight: str | None = None, keep: str | None = None) -> DataFrame:
    """``n`` rows of a table, as ``slot`` from 0 and its columns.

    ``first`` takes those of the smallest ordinal; ``random`` those of the
    smallest sha256 of "seed:key"; ``weighted`` draws with replacement in
    proportion to the weight, after the row whose key is ``keep``, which is
    always there and never drawn.
    """
    if how == "first":
        return rows.orderBy(ordinal, key).limit(n).withColumn("slot", F.row_number().over(Window.orderBy(ordinal, key)) - 1)  # n rows
    if how == "random":
        order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256), F.col(key)]
        return rows.orderBy(*order).limit(n).withColumn("slot", F.row_number().over(Window.orderBy(*order)) - 1)  # n rows
    others = rows.filter(~F.col(key).eqNullSafe(F.lit(keep)) & (F.col(weight) > 0))
    r = running(others.withColumn("_all", F.lit(0)), ["_all"], key, {"w": F.sum(F.col(weight).cast("double"))}, descending=False)
    spans = r.select(key, F.col("before_w").alias("_low"), (F.col("before_w") + F.col("w")).alias("_high"), "total_w")
    kept = 0 if keep is None else 1
    spark = rows.sparkSession
    slots = spark.range(kept, n).select(F.col("id").alias("slot"))
    total = spans.agg(F.max("total_w").alias("_t")).first()["_t"]
    if total is None:
        drawn = others.limit(0).withColumn("slot", F.lit(0).cast("bigint"))
    else:
        at = slots.withColumn("_at", unit_hash(seed, F.col("slot").cast("string")) * total)
        # n draws fall into bins of the weights' sum, an equi-join; a row of several bins is in each
        bins = max(1, n)
        width = total / bins
        held = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
        hit = at.withColumn("_bin", F.floor(F.col("_at") / width)).join(held, "_bin").filter((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high")))
        drawn = hit.select("slot", key).join(others, key).select(*rows.columns, "slot")
    if keep is None:
        return drawn
    return rows.filter(F.col(key) == keep).withColumn("slot", F.lit(0).cast("bigint")).unionByName(drawn)


def scaled_capacity(capacity: int, n, total):
    """The capacity in proportion to a part of the list, one at least; halves round to even."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(capacity)) * n / total, 0).cast("int"))


def band_metrics(rows: DataFrame, bands: str, label: str, score: str, key: str, capacity: int, by: Sequence[str] = ()) -> DataFrame:
    """Per band: ranking metrics, its share of all positives, and its capacity in proportion to its size."""
    m = ranking_metrics(rows, label, score, [bands])
    whole = Window.partitionBy()  # one row per band
    return m.withColumns({"share_of_positives": F.try_divide(F.col("positives").cast("double"), F.sum("positives").over(whole).cast("double")), "capacity": scaled_capacity(capacity, F.col("n"), F.sum("n").over(whole))})
