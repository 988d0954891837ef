"""Writers that never replace what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import joined_ends
from ..functions.scalars import finite

#: Columns that an aggregate export may hold.
PUBLIC = ("protocol", "dataset", "scope", "metric", "value", "n", "denominator", "scored", "unscored")


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.format(kind).mode("errorifexists").save(path)


def check_run(scored: DataFrame) -> None:
    """Refuse rows with a repeated or null id, a score that is not finite, or neither a score nor a reason."""
    ok = finite(F.col("score"))
    bad = scored.agg((F.count("*") - F.count_distinct("id")).alias("ids"), F.count_if(F.col("score").isNotNull() & ~ok).alias("scores"), F.count_if(F.col("score").isNull() & F.col("reason").isNull()).alias("reasons")).first()
    if bad["ids"] or bad["scores"] or bad["reasons"]:
        raise ValueError(f"{bad['ids']} ids repeat or are null, {bad['scores']} scores are not finite, {bad['reasons']} rows have neither a score nor a reason")


def write_run(folder: str, report: DataFrame, scored: DataFrame) -> None:
    """Report, predictions and unscored rows of a run, as three new tables; nothing is written if a row is wrong."""
    check_run(scored)
    write_new(report, f"{folder}/report", "json")
    write_new(scored.filter("score IS NOT NULL").select("id", "score"), f"{folder}/predictions")
    write_new(scored.filter("score IS NULL").select("id", "reason"), f"{folder}/unscored")


def write_predictions(scored: DataFrame, path: str, digits: int = 4) -> None:
    """Tab-separated ``id, score`` with fixed decimals; a blank score is unscored."""
    text = F.when(F.col("score").isNotNull(), F.format_string(f"%.{digits}f", F.col("score"))).otherwise("")
    scored.select("id", text.alias("score")).write.option("header", True).option("sep", "\t").option("emptyValue", "").mode("errorifexists").csv(path)


def export(report: DataFrame, path: str) -> None:
    """The public columns of a full run; smoke runs are refused."""
    if not report.filter("scope <> 'full'").isEmpty():
        raise ValueError("only full runs are exported")
    write_new(report.select(*[c for c in PUBLIC if c in report.columns]), path, "json")


def manifest(digests: DataFrame, folder: str) -> DataFrame:
    """Lines of a checksum file, by path."""
    return digests.select(F.concat_ws("  ", "sha256", F.regexp_replace("path", f"^.*{folder}/", "")).alias("value")).orderBy("value")


def write_annotation(transcripts: DataFrame, path: str) -> None:
    """Tab-separated gene table of splice predictors: starts from 0, ends as they are, a comma after every exon's.

    ``transcripts`` has ``gene, contig, strand, start, stop, exons`` (structs of
    ``start, stop``).
    """
    t = transcripts.select(
        F.col("gene").alias("#NAME"), F.col("contig").alias("CHROM"), F.col("strand").alias("STRAND"), (F.col("start") - 1).alias("TX_START"), F.col("stop").alias("TX_END"),
        joined_ends(F.col("exons"), "start", -1).alias("EXON_START"), joined_ends(F.col("exons"), "stop").alias("EXON_END"),
    )
    # the first name starts with the writer's usual sign of a comment, which would be quoted
    t.write.option("header", True).option("sep", "\t").option("comment", "\u0001").mode("errorifexists").csv(path)


def write_cohort(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated rows in the given columns with CRLF line ends; a tab or line break in a value is refused."""
    bad = rows.agg(F.count_if(F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda v: v.rlike("[\t\r\n]"))).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} rows hold a tab or a line break")
    text = F.concat(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit("\r"))
    rows.select(text.alias("value")).write.mode("errorifexists").text(path)


def gene_span_lines(lines: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``gene, kind, start, value``: gene-table lines of the chosen transcripts.

    ``lines`` has the lines as ``value``; ``transcripts`` has ``gene,
    transcript, start, stop``.  The line of a gene gets the span of its
    transcript; lines of the transcript and its exons stay as they are.
    """
    c = F.split("value", "\t")

    def attribute(name: str):
        return F.regexp_extract(F.get(c, F.lit(8)), rf'\b{name} "([^"]*)"', 1)

    rows = lines.filter(~F.col("value").startswith("#")).select("value", F.get(c, F.lit(2)).alias("kind"), F.get(c, F.lit(3)).try_cast("int").alias("at"), attribute("gene_id").alias("gene"), attribute("transcript_id").alias("of")).filter(F.col("kind").isin("gene", "transcript", "exon"))
    j = rows.join(transcripts.select("gene", "transcript", "start", "stop"), "gene").filter((F.col("kind") == "gene") | (F.col("of") == F.col("transcript")))
    spanned = F.concat_ws("\t", F.slice(c, 1, 3), F.col("start").cast("string"), F.col("stop").cast("string"), F.slice(c, 6, 1 << 30))
    return j.select("gene", "kind", F.col("at").alias("start"), F.when(F.col("kind") == "gene", spanned).otherwise(F.col("value")).alias("value"))


def write_gene_spans(lines: DataFrame, transcripts: DataFrame, path: str) -> None:
    """These lines by gene, each gene before its transcript and that before its exons, as text parts in order."""
    rank = F.when(F.col("kind") == "gene", 0).when(F.col("kind") == "transcript", 1).otherwise(2)
    gene_span_lines(lines, transcripts).orderBy("gene", rank, "start", "value").select("value").write.mode("errorifexists").text(path)
