"""Corpus pipeline: five stages that turn raw documents into packed training sequences.

Each stage takes the documents that its predecessor kept, written as Parquet
and read again, and all but the last return the columns of ``documents``:
documents of low quality go; boilerplate lines are cut; one document of each
near-duplicate class stays; documents that hold benchmark items go; the rest is
packed.

Every stage takes rows with nulls in any column, empty and very long texts,
repeated rows and empty tables, and leaves columns that it does not use as they
are, whatever their names; its docstring says what becomes of odd rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import decontaminate, line_dedup, ngram_join, packing, quality
from gaugeframe.llm.columns import shielded
from gaugeframe.llm.storage import shared_folder, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ordinal model rejects; it is fit on the labelled documents of this stage's input.

    Null and empty texts are judged as texts without words, repeated rows alike; without labels all rows stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that stand on many sites; a document that loses every line goes.

    Null and empty texts stay; a null source is a site of its own; rows with a null id lose boilerplate like others.
    """

    def cut(d: DataFrame) -> DataFrame:
        lines = line_dedup.cut_lines(d)
        emptied = (F.col("n_cut") > 0) & (F.col("n_cut") == F.col("n_lines"))
        kept = lines.filter(~emptied)
        if "n_chars" in d.columns:
            kept = kept.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return kept.select(d.columns)

    return shielded(docs, ["doc_id", "text", "source", "n_chars"], cut)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each class of near duplicates.

    Wordless texts are classes of their own; of rows that repeat an id one stays; rows with a null id all stay.
    """
    return ngram_join.keep_one_per_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none, and rows with a null id stay."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences; a null text is empty, and every row is packed."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages are a fitted model, min-hashes and byte-pair ids, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
