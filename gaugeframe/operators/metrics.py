"""Metrics of scores against labels.

Each function takes ``by``, the columns of which every combination gets its own
row, so that one pass serves many strata.  A metric that a stratum does not
define (a single class, constant values) is null, never 0 or NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, round_even
from .joins import with_row
from .ranking import discounts, first_per_group, quantiles, running


def _by(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """``n, positives, prevalence, auroc, average_precision`` of binary labels (0/1) and scores.

    AUROC counts ties as half; average precision is not interpolated and ties
    enter together.  Both are null for a single class.  Rows without a label or
    score are left out.  A row of a whole ``weight`` counts so many times.
    """
    df, keys = _by(df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()), by)
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    r = running(df, keys, score, {"n": F.sum(w), "p": F.sum(F.col(label).cast("bigint") * w)}, buckets=buckets)
    negatives_below = (F.col("total_n") - F.col("total_p")) - (F.col("before_n") - F.col("before_p")) - (F.col("n") - F.col("p"))
    wins = F.sum(F.col("p") * (negatives_below + (F.col("n") - F.col("p")) / 2.0))
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))
    pos, n = F.max("total_p"), F.max("total_n")
    out = r.groupBy(*keys).agg(
        n.alias("n"),
        pos.alias("positives"),
        ratio(pos, n).alias("prevalence"),
        ratio(wins, pos.cast("double") * (n - pos)).alias("auroc"),
        F.when(n > pos, ratio(F.sum(F.col("p") * precision), pos)).alias("average_precision"),
    )
    return out.drop("_all")


def at_capacity(df: DataFrame, label: str, score: str, key: str, capacity: int, by: Sequence[str] = ()) -> DataFrame:
    """``precision_at, recall_at`` of the ``capacity`` best scores; ties at the cut are drawn by sha256 of the key."""
    df, keys = _by(df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()), by)
    totals = df.groupBy(*keys).agg(F.sum(F.col(label).cast("bigint")).alias("_p"))
    top = first_per_group(df, keys, [F.desc(score), F.sha2(F.col(key).cast("string").cast("binary"), 256)], capacity)
    hits = top.groupBy(*keys).agg(F.sum(F.col(label).cast("bigint")).alias("_h"), F.count("*").alias("_n"))
    out = hits.join(totals, keys).select(*keys, ratio(F.col("_h"), F.col("_n")).alias("precision_at"), ratio(F.col("_h"), F.col("_p")).alias("recall_at"))
    return out.drop("_all")


def point_metrics(df: DataFrame, label: str, score: str, key: str, capacity: int) -> DataFrame:
    """One row: ranking metrics, metrics at capacity, and coverage against all rows of ``df``."""
    coverage = df.agg(F.count("*").alias("denominator"), F.count_if(F.col(label).isNotNull() & F.col(score).isNotNull()).alias("scored"))
    coverage = coverage.withColumn("unscored", F.col("denominator") - F.col("scored"))
    return with_row(with_row(ranking_metrics(df, label, score), at_capacity(df, label, score, key, capacity)), coverage)


def regression_metrics(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, mse, mae, pearson`` per group; the correlation of a constant is null."""
    df, keys = _by(df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()), by)
    e = F.col(guess) - F.col(truth)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), pearson(truth, guess).alias("pearson")).drop("_all")


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate; null for a constant side, where corr() would raise."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``spearman`` per group: the correlation of average ranks."""
    df, keys = _by(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b), by)

    def ranks(side: str) -> DataFrame:
        r = running(df, keys, side, {"n": F.count("*")}, descending=False)
        return r.select(*keys, side, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(f"_r_{side}"))

    ranked = df.join(ranks(a), [*keys, a]).join(ranks(b), [*keys, b])
    return ranked.groupBy(*keys).agg(pearson(f"_r_{a}", f"_r_{b}").alias("spearman")).drop("_all")


def mcc_at_median(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``mcc`` of calling positive what scores the group's median or more; 0 when a margin is empty."""
    df, keys = _by(df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()), by)
    cut = quantiles(df, keys, score, {"_cut": 0.5})
    called, y = F.col(score) >= F.col("_cut"), F.col(label) > 0
    c = df.join(cut, keys).groupBy(*keys).agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", called & y), ("fp", called & ~y), ("fn", ~called & y), ("tn", ~called & ~y))])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    value = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(*keys, F.coalesce(value, F.lit(0.0)).alias("mcc")).drop("_all")


def confusion(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """``truth, guess, n`` per group."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def binary_f1(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, accuracy, f1`` of the class 1 per group; an empty denominator counts as 0."""
    df, keys = _by(df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()), by)
    y, g = F.col(truth) == 1, F.col(guess) == 1
    f1 = F.coalesce(ratio(2 * F.count_if(y & g), F.count_if(y) + F.count_if(g)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), ratio(F.count_if(F.col(truth) == F.col(guess)), F.count("*")).alias("accuracy"), f1.alias("f1")).drop("_all")


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: ``n, accuracy, f1_macro, f1_weighted`` over the classes of either column; an empty denominator counts as 0."""
    cells = confusion(df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()), truth, guess)
    sides = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("guess").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hit")))).alias("s")).select("s.*")
    per_class = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    f1 = F.coalesce(ratio(2 * F.col("hit"), F.col("support") + F.col("called")), F.lit(0.0))
    n = F.sum("support")
    return per_class.agg(n.alias("n"), ratio(F.sum("hit"), n).alias("accuracy"), F.avg(f1).alias("f1_macro"), ratio(F.sum(f1 * F.col("support")), n).alias("f1_weighted"))


def ndcg_full(df: DataFrame, gain: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``ndcg`` over the whole list: gains above the group's minimum, linear, averaged over tied scores; null without any gain."""
    df, keys = _by(df.filter(F.col(gain).isNotNull() & F.col(score).isNotNull()), by)
    low = df.groupBy(*keys).agg(F.min(gain).cast("double").alias("_low"))

    def part(order: str, name: str) -> DataFrame:
        # the mean gain of tied scores may be summed over their places in any order
        cells = running(df, keys, order, {"n": F.count("*"), "g": F.sum(F.col(gain).cast("double"))})
        placed = discounts(cells, "before_n", "n", "_d").join(low, keys)
        return placed.groupBy(*keys).agg(F.sum((F.col("g") / F.col("n") - F.col("_low")) * F.col("_d")).alias(name))

    return part(score, "_a").join(part(gain, "_i"), keys).select(*keys, F.try_divide(F.col("_a"), F.col("_i")).alias("ndcg")).drop("_all")


def ndcg_top(df: DataFrame, gain: str, score: str, key: str, share: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """``ndcg_top`` of the best ``floor(share * n)`` scores (ties by key), with gains scaled to [0, 1]; null without an ideal gain."""
    df, keys = _by(df.filter(F.col(gain).isNotNull() & F.col(score).isNotNull()), by)
    g = F.col(gain).cast("double")
    ends = df.groupBy(*keys).agg(F.min(g).alias("_low"), F.max(g).alias("_high"), F.floor(F.count("*") * share).alias("_k"))
    scaled = F.coalesce(F.try_divide(g - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    # only scores that begin within the best are ranked row by row, among equal ones by key
    best = running(df, keys, score, {"n": F.count("*")}).join(ends, keys).filter(F.col("before_n") < F.col("_k")).select(*keys, score, "before_n", "_low", "_high", "_k")
    tie = Window.partitionBy(*keys, score).orderBy(key)
    got = df.join(best, [*keys, score]).withColumn("_r", F.col("before_n") + F.row_number().over(tie)).filter(F.col("_r") <= F.col("_k"))
    got = got.groupBy(*keys).agg(F.sum(scaled / F.log2(F.col("_r") + 1)).alias("_a"))
    ideal = running(df, keys, gain, {"n": F.count("*")}).join(ends, keys).withColumn("_m", F.least(F.col("n"), F.greatest(F.lit(0), F.col("_k") - F.col("before_n"))))
    ideal = discounts(ideal.filter("_m > 0"), "before_n", "_m", "_d").groupBy(*keys).agg(F.sum(scaled * F.col("_d")).alias("_i"))
    return ends.join(got, keys, "left").join(ideal, keys, "left").select(*keys, F.try_divide(F.coalesce("_a", F.lit(0.0)), F.coalesce("_i", F.lit(0.0))).alias("ndcg_top")).drop("_all")


def top_recall(df: DataFrame, truth: str, score: str, quantile: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """``top_recall``: the share of rows at or above the truth's quantile that are so by the score too."""
    df, keys = _by(df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()), by)
    cuts = quantiles(df, keys, truth, {"_t": quantile}).join(quantiles(df, keys, score, {"_s": quantile}), keys)
    top = F.col(truth) >= F.col("_t")
    return df.join(cuts, keys).groupBy(*keys).agg(ratio(F.count_if(top & (F.col(score) >= F.col("_s"))), F.count_if(top)).alias("top_recall")).drop("_all")


def paired_differences(df: DataFrame, pair: str, role: str, value: str, first: str, second: str) -> DataFrame:
    """``pair, d``: the value of the first role less that of the second, for pairs that have both."""
    wide = df.groupBy(pair).agg(F.max(F.when(F.col(role) == first, F.col(value))).alias("a"), F.max(F.when(F.col(role) == second, F.col(value))).alias("b"))
    return wide.filter("a IS NOT NULL AND b IS NOT NULL").select(pair, (F.col("a") - F.col("b")).cast("double").alias("d"))


def difference_stats(pairs: DataFrame) -> DataFrame:
    """One row of ``n, mean, median, p05, p25, p75, p95, sign_accuracy, tied``; a tie counts as wrong."""
    ends = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    q = quantiles(pairs.withColumn("_all", F.lit(0)), ["_all"], "d", ends).agg(*[F.max(n).alias(n) for n in ends])
    out = pairs.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.avg((F.col("d") > 0).cast("double")).alias("sign_accuracy"), F.count_if(F.col("d") == 0).alias("tied"))
    return with_row(out, q).select("n", "mean", "median", "p05", "p25", "p75", "p95", "sign_accuracy", "tied")


def wilcoxon_terms(pairs: DataFrame) -> DataFrame:
    """One row of ``n, zeros, statistic, mean, variance``: the signed-rank statistic of positive differences, zeros left out, with the tie-corrected moments of its normal limit."""
    d = pairs.filter("d <> 0").withColumn("_abs", F.abs("d"))
    r = running(d.withColumn("_all", F.lit(0)), ["_all"], "_abs", {"n": F.count("*"), "up": F.count_if(F.col("d") > 0)}, descending=False)
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    n = F.sum("n").cast("double")
    tied = F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n"))
    terms = r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(rank * F.col("up")).alias("statistic"), (n * (n + 1) / 4).alias("mean"), (n * (n + 1) * (2 * n + 1) / 24 - tied / 48).alias("variance"))
    zeros = pairs.agg(F.count_if(F.col("d") == 0).alias("zeros"))
    return with_row(terms, zeros).select("n", "zeros", "statistic", "mean", "variance")


def signed_rank_p(statistic: Column, n: Column, mean: Column, variance: Column, exact_below: int = 50) -> Column:
    """Upper tail of the signed-rank statistic: exact up to ``exact_below`` untied differences, normal beyond.

    The exact distribution counts subsets of 1..n by their sum with array functions.
    """
    z = F.try_divide(statistic - mean, F.sqrt(variance))
    # Spark has no erfc; the UDF sees one row per group
    normal = _upper_tail(z)
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        F.array(F.lit(1.0)),
        lambda acc, k: F.zip_with(F.concat(acc, F.array_repeat(F.lit(0.0), k)), F.concat(F.array_repeat(F.lit(0.0), k), acc), lambda a, b: a + b),
    )
    tail = F.aggregate(F.slice(counts, F.floor(statistic).cast("int") + 1, F.size(counts)), F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n)
    return F.when((n > 0) & (n <= exact_below), tail).otherwise(normal)


def _upper_tail(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: None if pd.isna(x) else 0.5 * erfc(x / sqrt(2)))

    return tail(z)


def nested_mean(df: DataFrame, value: str, levels: Sequence[Sequence[str]], digits: int = 3) -> DataFrame:
    """Means of means: the value is rounded, averaged within the first level's keys, those means within the second's, and so on; the last is rounded. Nulls are skipped."""
    out = df.withColumn(value, round_even(F.col(value), digits))
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg(value).alias(value))
    return out.withColumn(value, round_even(F.col(value), digits))


def complete_only(df: DataFrame, group: str, complete: str) -> DataFrame:
    """Groups of which every row is complete."""
    whole = df.groupBy(group).agg(F.bool_and(complete).alias("_c")).filter("_c").select(group)
    return df.join(whole, group, "left_semi")


def tie_summary(df: DataFrame, score: str, capacity: int, by: Sequence[str] = ()) -> DataFrame:
    """``cutoff, above, tied, filled_from_ties`` of the ``capacity`` best scores."""
    df, keys = _by(df.filter(F.col(score).isNotNull()), by)
    r = running(df, keys, score, {"n": F.count("*")})
    cut = r.filter((F.col("before_n") < capacity) & (F.col("before_n") + F.col("n") >= F.least(F.lit(capacity), F.col("total_n"))))
    return cut.select(*keys, F.col(score).alias("cutoff"), F.col("before_n").alias("above"), F.col("n").alias("tied"), (F.least(F.lit(capacity), F.col("total_n")) - F.col("before_n")).alias("filled_from_ties")).drop("_all")


def leaderboard(results: DataFrame, system: str, value: str, ascending: bool = False) -> DataFrame:
    """``results`` with ``place`` from 1, best value first; equal values share the best place of theirs, and rows without a value have none."""
    r = running(results.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(0)), ["_all"], value, {"n": F.count("*")}, descending=not ascending)
    return results.join(r.select(value, (F.col("before_n") + 1).alias("place")), value, "left").select(*results.columns, "place")


def wide_metrics(results: DataFrame, row: str, metric: str, value: str, metrics: Sequence[str], lookups: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """One row per ``row`` with a column of each metric, then the columns of each lookup (a table and its key) by left joins that keep every row; of a metric that comes twice the largest value."""
    out = results.groupBy(row).pivot(metric, list(metrics)).agg(F.max(value))
    for table, key in lookups:
        out = out.join(table, out[row] == table[key], "left").drop(table[key]) if key != row else out.join(table, row, "left")
    return out
