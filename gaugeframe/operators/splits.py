"""Leak-free splits: whole groups are held out, in an order drawn by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import with_row


def holdout_groups(rows: DataFrame, group: str, label: str, share: float = 0.3, restarts: int = 50, seed: str = "0") -> DataFrame:
    """``group, split``: of ``restarts`` shuffles of the groups, the one whose test prevalence is nearest to the overall.

    A shuffle takes groups in the order of sha256("seed:restart:group") while
    fewer than ``share`` of all rows are taken.  Group sums are computed once;
    restarts are rows of a table of groups.
    """
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    total = rows.agg(F.count("*").alias("n_all"), F.sum(F.col(label).cast("bigint")).alias("p_all"))
    runs = g.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("restart").cast("string"), F.col(group).cast("string")).cast("binary"), 256)
    w = Window.partitionBy("restart").orderBy(order, group)
    taken = runs.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = with_row(taken, total).withColumn("test", F.col("before") < F.col("n_all") * share)
    per = taken.filter("test").groupBy("restart").agg(F.abs(F.try_divide(F.sum("p").cast("double"), F.sum("n").cast("double")) - F.first(F.try_divide(F.col("p_all").cast("double"), F.col("n_all").cast("double")))).alias("off"))
    best = per.orderBy("off", "restart").limit(1).select("restart")  # one row
    return taken.join(F.broadcast(best), "restart", "left_semi").select(group, F.when(F.col("test"), "test").otherwise("train").alias("split"))


def arms(rows: DataFrame, group: str, label: str) -> DataFrame:
    """``split, n, positives, prevalence, groups`` per arm."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"), F.round(F.avg(F.col(label).cast("double")), 5).alias("prevalence"), F.count_distinct(group).alias("groups"))


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    """One row of ``groups, largest, singletons, upper_median`` of the group sizes."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("m"))
    w = Window.orderBy("size")  # one row per distinct size
    ranked = sizes.withColumn("upto", F.sum("m").over(w)).withColumn("all", F.sum("m").over(Window.partitionBy()))
    return ranked.agg(F.sum("m").alias("groups"), F.max("size").alias("largest"), F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("m"))), F.lit(0)).alias("singletons"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("size"))).alias("upper_median"))


def leaks(rows: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def first_of_split(rows: DataFrame, split: str, ordinal: str, n: int) -> DataFrame:
    """The first ``n`` rows of each split in source order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(split).orderBy(ordinal))).filter(F.col("_r") <= n).drop("_r")


def hashed_split(key: Column, seed: str, test: int = 30) -> Column:
    """train or test by sha256 of "seed:key": ``test`` of 100 parts are test."""
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("bigint")
    return F.when(F.pmod(part, F.lit(100)) < test, "test").otherwise("train")
