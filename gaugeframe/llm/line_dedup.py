"""Removal of lines that repeat across sites.

The distinct sites of every line are estimated by HyperLogLog sketches, one per
line hash, merged by the aggregation.  Lines whose estimate is near the
threshold get an exact distinct count.  Lines on enough sites are boilerplate
and are cut from the documents, but for the first document that holds them.

Lines travel as 16-byte hashes; texts are read again for the cut and never
shuffled while the table of boilerplate lines is of a bounded size.  A hot line
is one row per task after the partial aggregation.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .storage import in_batches, materialise, table

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 6
#: Estimates within this share of the threshold are counted exactly.
MARGIN = 0.25
#: log2 of the sketch's registers; its relative error is about 1.04 / sqrt(2 ** LG_K), 6.5 %.
LG_K = 8
#: Boilerplate lines up to which their hashes are broadcast (about 100 bytes each in a Python set).
BROADCAST_LINES = 250_000


def _normal(line: str) -> str:
    """What makes two lines the same: lower case, and runs of white space as one space."""
    return " ".join(line.lower().split())


def _hash(normal: str) -> bytes:
    return hashlib.md5(normal.encode(), usedforsecurity=False).digest()


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, row, site, pos, line`` of each non-empty line: its position from 0 and 128-bit hash.

    ``row`` is a hash of the text, which tells rows of one id (or none) apart; a
    null source is a site of its own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches):
            row, pos, line = array("q"), array("i"), []
            for i, text in enumerate(batch.column(3)):
                for k, x in enumerate((text.as_py() or "").split("\n")):
                    if normal := _normal(x):
                        row.append(i)
                        pos.append(k)
                        line.append(_hash(normal))
            of = pa.array(np.frombuffer(row, np.int64) if len(row) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(of) for c in range(3)], pa.array(np.frombuffer(pos, np.int32) if len(pos) else np.zeros(0, np.int32)), pa.array(line, pa.binary())],
                names=["doc_id", "row", "site", "pos", "line"],
            )

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.col("text").cast("string").alias("text"))
    return in_batches(wanted).mapInArrow(run, "doc_id bigint, row bigint, site string, pos int, line binary")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """``line, n_sites, n_lines, first_doc`` of the lines on ``min_sites`` sites or more."""
    rows = line_rows(docs)
    sketched = rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n_lines"), F.min("doc_id").alias("first_doc"), F.min("site").alias("low"), F.max("site").alias("high"))
    # a line of a single site needs no estimate
    sketched = sketched.filter("low <> high").withColumn("estimate", F.hll_sketch_estimate("sketch"))
    likely = materialise(sketched.filter(F.col("estimate") >= min_sites * (1 - margin)).select("line", "estimate", "n_lines", "first_doc"))
    near = likely.filter(F.col("estimate") < min_sites * (1 + margin)).select("line")
    # found where they are read while they are few, so that a hot line is a few rows per task from there on
    near = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    exact = rows.select("line", "site").join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count_distinct("site").alias("exact"))
    counted = likely.join(exact, "line", "left").withColumn("n_sites", F.coalesce("exact", "estimate"))
    return counted.filter(F.col("n_sites") >= min_sites).select("line", "n_sites", "n_lines", "first_doc")


def cut_lines(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with boilerplate cut from ``text``, and ``n_lines, n_cut`` (non-empty lines, and how many went).

    A line is boilerplate if equal lines (lower case, runs of white space as one
    space) stand on at least ``min_sites`` distinct values of ``source``.  It
    stays in the document of the smallest id that has it, so that one copy of
    every passage is kept; there too only repeats within the document go.
    Empty lines never go; null and empty texts stay as they are.  Rows with a
    null id count for the sites and lose boilerplate like others; as no copy is
    kept in them, a line that only such rows have goes everywhere.  Repeated
    rows of an id are treated alike.  Whole texts are read, however long.  An
    empty table has no rows.  Other columns stay, whatever their names, but
    ``n_lines`` and ``n_cut`` of the caller are replaced.
    """
    lines = materialise(boilerplate(docs, min_sites).select("line", "first_doc"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_cut")]
    docs = docs.select(*[f"`{c}`" for c in kept])
    if lines.count() <= broadcast_lines:
        return _cut_by_lookup(docs, lines)
    return _cut_by_join(docs, lines)


def _cut_by_lookup(docs: DataFrame, lines: DataFrame) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast({bytes(r["line"]): r["first_doc"] for r in lines.toLocalIterator()})
    kept = docs.columns
    at, of = kept.index("text"), kept.index("doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches):
            texts, total, cut = [], [], []
            for doc_id, text in zip(batch.column(of), batch.column(at), strict=True):
                t, n, k = _cut(text.as_py(), doc_id.as_py(), known.value)
                texts.append(t)
                total.append(n)
                cut.append(k)
            columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :], pa.array(total, pa.int32()), pa.array(cut, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_lines", "n_cut"])

    return in_batches(docs).mapInArrow(run, docs.withColumns({"n_lines": F.lit(0), "n_cut": F.lit(0)}).schema)


def _cut(text: str | None, doc_id: int | None, known: dict[bytes, int | None]) -> tuple[str | None, int, int]:
    """The text without its boilerplate, its number of non-empty lines and how many of them went."""
    if text is None:
        return None, 0, 0
    out, seen, n, cut = [], set(), 0, 0
    for line in text.split("\n"):
        if normal := _normal(line):
            n += 1
            key = _hash(normal)
            if key in known:
                if doc_id is None or known[key] != doc_id or key in seen:
                    cut += 1
                    continue
                seen.add(key)
        out.append(line)
    return "\n".join(out), n, cut


def _cut_by_join(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The same without a bound on the lines: positions to cut are found by a join on the line and meet the texts on the document."""
    rows = line_rows(docs)
    found = rows.join(lines, "line").select("doc_id", "row", "line", "first_doc", "pos").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id", "row", "line").orderBy("pos"))  # of a document's own repeats of a line
    gone = found.withColumn("_rank", rank).filter((F.col("_rank") > 1) | ~F.coalesce(F.col("first_doc") == F.col("doc_id"), F.lit(False)))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("pos").alias("_gone"))  # at most a document's lines
    split = F.split("text", "\n", -1)
    joined = _with_n_lines(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left").withColumn("_split", split)
    kept = F.filter("_split", lambda x, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False)))
    cut = F.coalesce(F.size(F.filter("_gone", lambda p: p < F.size("_split"))), F.lit(0))
    return joined.withColumns({"n_cut": F.when(F.col("text").isNull(), 0).otherwise(cut), "text": F.array_join(kept, "\n")}).select(*docs.columns, "n_lines", "n_cut")


def _with_n_lines(docs: DataFrame) -> DataFrame:
    """``docs`` and its numbers of non-empty lines, by what makes a line empty everywhere here."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches):
            total = [sum(1 for x in (text.as_py() or "").split("\n") if _normal(x)) for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.int32())], names=[*names, "n_lines"])

    return in_batches(docs).mapInArrow(run, docs.withColumn("n_lines", F.lit(0)).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after the cut."""
    return cut_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_cut")


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS k FROM l
), b AS (
  SELECT k, min(doc_id) AS first_doc FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 6
), m AS (
  SELECT k.*, b.k IS NOT NULL AND (first_doc <> doc_id OR row_number() OVER (PARTITION BY doc_id, k.k ORDER BY pos) > 1) AS cut FROM k LEFT JOIN b ON b.k = k.k
)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '') AS text, sum((k <> '')::INT)::INT AS n_lines, sum(cut::INT)::INT AS n_cut FROM m GROUP BY doc_id
"""
