"""Joins that keep the original denominator, and comparisons of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row, which is broadcast."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def annotate(rows: DataFrame, annotation: DataFrame, key: str, order: Column, fill: str = "NA") -> DataFrame:
    """Left join with one annotation row per key, the last by ``order``; missing text is ``fill``."""
    last = annotation.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).filter("_r = 1").drop("_r")
    columns = [c for c in annotation.columns if c != key]
    return rows.join(last, key, "left").fillna(fill, columns)


def scored_rows(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """All rows with ``score`` and ``reason``: a missing prediction is unscored for that reason, never a negative."""
    p = predictions.select(key, "score", F.col("reason").alias("reason") if "reason" in predictions.columns else F.lit(None).cast("string").alias("reason"), F.lit(True).alias("_p"))
    out = rows.join(p, key, "left")
    reason = F.when(F.col("_p").isNull(), "missing_prediction").when(F.col("score").isNull(), F.coalesce("reason", F.lit("no_reason")))
    return out.withColumn("reason", reason).drop("_p")


def coverage(scored: DataFrame) -> DataFrame:
    """One row of ``denominator, scored, unscored``, which reconcile."""
    return scored.agg(F.count("*").alias("denominator"), F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("unscored"))


def reasons(scored: DataFrame) -> DataFrame:
    return scored.filter("score IS NULL").groupBy("reason").agg(F.count("*").alias("n"))


def unknown(predictions: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Predictions for ids that are not in the rows."""
    return predictions.join(rows.select(key), key, "left_anti")


def common(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    return reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), tables[1:], tables[0].select(key).distinct())


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row of ``common, only_first, only_second``."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))


def differences(expected: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status``: missing, extra or changed, for keys whose values are not the same (nulls are equal)."""
    j = expected.select(key, F.col(value).alias("e"), F.lit(1).alias("_e")).join(observed.select(key, F.col(value).alias("o"), F.lit(1).alias("_o")), key, "full_outer")
    status = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~F.col("e").eqNullSafe(F.col("o")), "changed")
    return j.select(key, status.alias("status")).filter("status IS NOT NULL")


def multiset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of ``only_first, only_second``: rows, with repetitions, that the other side lacks."""
    # sums per distinct row combine before the shuffle, unlike exceptAll
    one, minus = F.lit(1).alias("_n"), F.lit(-1).alias("_n")
    net = a.select("*", one).unionByName(b.select("*", minus)).groupBy(*a.columns).agg(F.sum("_n").alias("_n"))
    return net.agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(-F.sum(F.least("_n", F.lit(0))), F.lit(0)).alias("only_second"))


def expected_checks(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """``metric, expected, observed, ok``: published values against observed ones within each tolerance; a missing one fails."""
    j = expected.join(observed.select("metric", F.col("value").alias("observed")), "metric", "left")
    return j.select("metric", "expected", "observed", F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= F.col("tolerance"), F.lit(False)).alias("ok"))


def population_digest(rows: DataFrame, key: str) -> DataFrame:
    """One row of ``n, digest``: an order-independent digest of the keys, summed over 128-bit halves of their sha256, with partial sums per task."""
    h = F.sha2(F.col(key).cast("string").cast("binary"), 256)
    part = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(2)]
    return rows.agg(F.count("*").alias("n"), F.concat_ws(":", F.sum(part[0]).cast("string"), F.sum(part[1]).cast("string")).alias("digest"))


def violations(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """``rule, n, example`` of all rules in one pass; the example is the smallest key."""
    aggs = [x for name, c in rules.items() for x in (F.count_if(c).alias(f"{name}__n"), F.min(F.when(c, F.col(key))).alias(f"{name}__k"))]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}__n").alias("n"), F.col(f"{n}__k").alias("example")) for n in rules])).alias("r")).select("r.*")


def check(rows: DataFrame, rules: dict[str, Column], key: str) -> None:
    """Refuse a table that breaks a rule."""
    broken = violations(rows, rules, key).filter("n > 0").collect()  # one row per rule
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} rows, for example {r['example']}" for r in broken))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values of several rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables that must hold the same keys, each once; anything else is refused."""
    sides = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = sides.groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    bad = counts.agg(F.count_if((F.col("_a") == 0) | (F.col("_b") == 0) | F.col(key).isNull()).alias("alone"), F.count_if((F.col("_a") > 1) | (F.col("_b") > 1)).alias("twice")).first()
    if bad["alone"] or bad["twice"]:
        raise ValueError(f"{bad['alone']} keys are on one side alone or null, {bad['twice']} repeat")
    return a.join(b, key)


def contract_violations(reported: DataFrame, contract: DataFrame) -> DataFrame:
    """``metric, value, problem`` of what a report breaks: each metric must come once, and no other, with a finite value in its bounds.

    ``reported`` has ``metric, value``; ``contract`` has ``metric, low, high,
    whole``; a null bound is none.  A metric with several problems has the first
    of missing, unknown, repeated, not finite, out of bounds, not whole.
    """
    counts = reported.groupBy("metric").agg(F.count("*").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"), F.count("value").alias("_known"))
    j = counts.withColumn("_in", F.lit(True)).join(contract.select("metric", "low", "high", "whole", F.lit(True).alias("_asked")), "metric", "full_outer")
    v = F.col("_low")
    infinite = F.isnan(v) | (F.abs(v) == float("inf"))
    problem = (
        F.when(F.col("_in").isNull(), "missing").when(F.col("_asked").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when((F.col("_known") == 0) | infinite, "not finite")
        .when((v < F.col("low")) | (v > F.col("high")), "out of bounds").when(F.col("whole") & (v != F.floor(v)), "not whole")
    )
    return j.select("metric", F.when(F.col("_n") == 1, v).alias("value"), problem.alias("problem")).filter("problem IS NOT NULL")
