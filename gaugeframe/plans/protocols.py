"""Evaluation protocols: prepare a table of rows, then score predictions against it.

A prepared row has ``id, split, inputs (struct), target`` and what the protocol
adds.  Prepared tables hold targets; adapters get ``id`` and ``inputs`` only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, opaque_id, parse_flag, parse_number, round_even
from ..functions.sequence import in_alphabet, substitutions, substitutions_fit
from ..operators import joins, metrics
from ..operators.splits import first_of_split

AMINO, BASES = "ACDEFGHIKLMNPQRSTVWY", "ACGT"


@dataclass(frozen=True)
class Prepared:
    """Rows of a protocol; ``scope`` is full, subset or smoke, and ``denominator`` the number of test rows before any limit."""

    protocol: str
    rows: DataFrame
    scope: str = "full"

    @property
    def inputs(self) -> DataFrame:
        """What adapters may see."""
        return self.rows.select("id", "inputs.*")

    def limited(self, n: int) -> Prepared:
        """The first rows of each split by id; such a run is a smoke run."""
        return Prepared(self.protocol, first_of_split(self.rows, "split", "id", n), "smoke")

    def scored(self, predictions: DataFrame) -> DataFrame:
        """Test rows with scores and reasons; predictions for other ids are refused."""
        test = self.rows.filter("split = 'test'")
        if not joins.unknown(predictions, test, "id").isEmpty():
            raise ValueError("predictions for unknown ids")
        if not joins.duplicates(predictions, "id").isEmpty():
            raise ValueError("repeated ids in predictions")
        if not predictions.filter(F.col("score").isNotNull() & ~finite(F.col("score"))).isEmpty():
            raise ValueError("scores must be finite")
        return joins.scored_rows(test, predictions, "id")


def _validated(rows: DataFrame, rules: dict) -> DataFrame:
    joins.check(rows, rules, "id")
    if not joins.duplicates(rows, "id").isEmpty():
        raise ValueError("ids repeat")
    return rows


def prepare_fitness_split(table: DataFrame, salt: str) -> Prepared:
    """From strings ``sequence, target, set, validation``: training rows flagged for validation form a split of their own."""
    flag = parse_flag(F.col("validation"))
    split = F.when((F.col("set") == "train") & flag, "validation").when((F.col("set") == "train") & ~flag, "train").when((F.col("set") == "test") & ~flag, "test")
    rows = table.select(opaque_id(salt, "set", "validation", "sequence", "target").alias("id"), split.alias("split"), F.struct("sequence").alias("inputs"), parse_number(F.col("target")).alias("target"))
    return Prepared("fitness-split", _validated(rows, {"split": F.col("split").isNull(), "target": F.col("target").isNull(), "sequence": ~in_alphabet(F.col("inputs.sequence"), AMINO)}))


def score_fitness_split(scored: DataFrame) -> DataFrame:
    """``spearman, ndcg`` and coverage."""
    s = scored.filter("score IS NOT NULL")
    return joins.with_row(joins.with_row(metrics.spearman(s, "target", "score"), metrics.ndcg_full(s, "target", "score")), joins.coverage(scored))


def prepare_regression(table: DataFrame, target: str, salt: str, ordinal: str = "ordinal", seed: str = "0") -> tuple[Prepared, DataFrame]:
    """Rows with a target, split 70/15/15 by the hash of their ordinal; and the excluded ones, with the reason."""
    part = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ordinal).cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("bigint"), F.lit(100))
    split = F.when(part < 70, "train").when(part < 85, "validation").otherwise("test")
    has = table.filter(F.col(target).isNotNull())
    rows = has.select(opaque_id(salt, F.col(ordinal).cast("string")).alias("id"), split.alias("split"), F.struct("sequence").alias("inputs"), F.col(target).cast("double").alias("target"), F.col(ordinal).cast("bigint").alias("source_index"))
    excluded = table.filter(F.col(target).isNull()).select(F.col(ordinal).alias("source_index"), F.lit("missing_target").alias("reason"))
    return Prepared("regression", _validated(rows, {"target": ~finite(F.col("target")), "sequence": ~in_alphabet(F.col("inputs.sequence"), BASES)})), excluded


def score_regression(scored: DataFrame) -> DataFrame:
    s = scored.filter("score IS NOT NULL")
    return joins.with_row(joins.with_row(metrics.regression_metrics(s, "target", "score"), metrics.spearman(s, "target", "score")), joins.coverage(scored))


def prepare_small_molecules(train: DataFrame, test: DataFrame) -> Prepared:
    """From strings ``Drug_ID, Drug, Y`` of both files; ids are the split and the drug's id."""
    rows = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    rows = rows.select(F.concat_ws("::", "split", "Drug_ID").alias("id"), "split", F.struct(F.col("Drug").alias("smiles")).alias("inputs"), parse_number(F.col("Y")).alias("target"))
    return Prepared("small-molecules", _validated(rows, {"target": F.col("target").isNull(), "smiles": F.coalesce(F.trim("inputs.smiles") == "", F.lit(True))}))


def score_small_molecules(scored: DataFrame, metric: str) -> DataFrame:
    """One of ``mae, spearman, auroc, average_precision``, with coverage."""
    s = scored.filter("score IS NOT NULL")
    value = {
        "mae": lambda: metrics.regression_metrics(s, "target", "score").select(F.col("mae").alias("value")),
        "spearman": lambda: metrics.spearman(s, "target", "score").select(F.col("spearman").alias("value")),
        "auroc": lambda: metrics.ranking_metrics(s, "target", "score").select(F.col("auroc").alias("value")),
        "average_precision": lambda: metrics.ranking_metrics(s, "target", "score").select(F.col("average_precision").alias("value")),
    }[metric]()
    return joins.with_row(value.withColumn("metric", F.lit(metric)), joins.coverage(scored))


def prepare_sequence_classes(files: DataFrame, salt: str) -> Prepared:
    """From ``split, class, name, sequence``; classes are numbered in their order."""
    classes = [r["class"] for r in files.select("class").distinct().orderBy("class").collect()]  # a handful
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")) - 1
    rows = files.select(opaque_id(salt, "split", "class", "name").alias("id"), "split", F.struct("sequence").alias("inputs"), number.cast("double").alias("target"))
    return Prepared("sequence-classes", _validated(rows, {"sequence": ~in_alphabet(F.upper("inputs.sequence"), "ACGTN"), "split": ~F.col("split").isin("train", "test")}))


def predicted_class(score, classes: int):
    """A class from a score: with two classes a probability above a half, else a class number; null outside."""
    if classes == 2:
        return F.when((score >= 0) & (score <= 1), (score > 0.5).cast("double"))
    return F.when((score == F.floor(score)) & (score >= 0) & (score < classes), score)


def score_sequence_classes(scored: DataFrame, classes: int) -> DataFrame:
    s = scored.filter("score IS NOT NULL").withColumn("called", predicted_class(F.col("score"), classes))
    return joins.with_row(metrics.class_metrics(s, "target", "called"), joins.coverage(scored))


def prepare_variant_assays(table: DataFrame, reference: DataFrame) -> Prepared:
    """From ``assay_id, mutant, mutated_sequence, DMS_score, DMS_score_bin`` and a reference with ``assay_id, wild_type_sequence, group, selection_type``."""
    t = table.join(reference, "assay_id", "left").withColumn("_subs", substitutions(F.col("mutant")))
    rows = t.select(
        F.concat_ws("::", "assay_id", "mutant").alias("id"), F.lit("test").alias("split"),
        F.struct("assay_id", "wild_type_sequence", "mutant", "mutated_sequence").alias("inputs"),
        parse_number(F.col("DMS_score")).alias("target"), F.col("DMS_score_bin").try_cast("int").alias("target_binary"), "assay_id", "group", "selection_type",
        (F.col("_subs").isNotNull() & substitutions_fit(F.col("_subs"), F.col("wild_type_sequence"))).alias("_fits"),
    )
    return Prepared("variant-assays", _validated(rows, {"reference": F.col("inputs.wild_type_sequence").isNull(), "mutant": ~F.coalesce("_fits", F.lit(False)), "target": F.col("target").isNull(), "binary": ~F.coalesce(F.col("target_binary").isin(0, 1), F.lit(False))}).drop("_fits"))


def score_variant_assays(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per assay metrics of complete assays; and their equal-weight means: assays within (protein, category), those within category, those overall."""
    s = metrics.complete_only(scored.withColumn("_c", F.col("score").isNotNull()), "assay_id", "_c").drop("_c")
    per = metrics.spearman(s, "target", "score", ["assay_id"])
    per = per.join(metrics.ranking_metrics(s, "target_binary", "score", ["assay_id"]).select("assay_id", "auroc"), "assay_id")
    per = per.join(metrics.mcc_at_median(s, "target_binary", "score", ["assay_id"]), "assay_id").join(metrics.ndcg_top(s, "target", "score", "id", by=["assay_id"]), "assay_id").join(metrics.top_recall(s, "target", "score", by=["assay_id"]), "assay_id")
    facts = s.select("assay_id", "group", "selection_type").distinct()
    names = ["spearman", "auroc", "mcc", "ndcg_top", "top_recall"]
    long = per.join(facts, "assay_id").select("assay_id", "group", "selection_type", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), round_even(F.col(n)).alias("value")) for n in names])).alias("m")).select("assay_id", "group", "selection_type", "m.*")
    return per, metrics.nested_mean(long, "value", [["metric", "group", "selection_type"], ["metric", "selection_type"], ["metric"]])


def prepare_pairs(table: DataFrame, salt: str) -> Prepared:
    """From ``source_index, sequence, control``: each pair is two rows, element and control."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("sequence"), F.lit(y).alias("target")) for r, c, y in (("element", "sequence", 1.0), ("control", "control", 0.0))])
    t = table.select("source_index", F.explode(roles).alias("r")).select("source_index", "r.*")
    rows = t.select(opaque_id(salt, F.col("source_index").cast("string"), "role").alias("id"), F.lit("test").alias("split"), F.struct("sequence").alias("inputs"), "target", opaque_id(salt, F.lit("pair"), F.col("source_index").cast("string")).alias("pair_id"), F.col("role").alias("pair_role"), F.col("source_index").cast("bigint").alias("source_index"))
    return Prepared("pairs", _validated(rows, {"sequence": ~in_alphabet(F.col("inputs.sequence"), "ACGTN")}))


def score_pairs(scored: DataFrame) -> DataFrame:
    """Statistics of element less control, with the signed-rank tail, and coverage of pairs and rows; a tie counts as wrong."""
    d = metrics.paired_differences(scored, "pair_id", "pair_role", "score", "element", "control")
    terms = metrics.wilcoxon_terms(d).withColumn("p_value", metrics.signed_rank_p(F.floor("statistic"), F.col("n"), F.col("mean"), F.col("variance"))).select("statistic", "p_value")
    pairs = scored.agg(F.count_distinct("pair_id").alias("pairs"))
    return joins.with_row(joins.with_row(joins.with_row(metrics.difference_stats(d), terms), pairs), joins.coverage(scored))


def prepare_grouped_binary(table: DataFrame, split: DataFrame, inputs: Sequence[str]) -> Prepared:
    """From a cohort with ``id, group, label`` and a split table; both must have the same ids, and no group may be in two splits."""
    o = joins.overlap_counts(table, split, "id").first()
    if o["only_first"] or o["only_second"]:
        raise ValueError(f"{o['only_first']} ids without a split, {o['only_second']} splits without a row")
    rows = table.join(split.select("id", "split"), "id").select("id", "split", F.struct(*inputs).alias("inputs"), F.col("label").cast("double").alias("target"), "group")
    from ..operators.splits import leaks

    if not leaks(rows, "group").isEmpty():
        raise ValueError("a group is in two splits")
    return Prepared("grouped-binary", _validated(rows, {"target": ~F.coalesce(F.col("target").isin(0.0, 1.0), F.lit(False))}))


def score_grouped_binary(scored: DataFrame, capacity: int) -> DataFrame:
    return metrics.point_metrics(scored, "target", "score", "id", capacity)
