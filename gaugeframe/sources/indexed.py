"""Sequences by byte offsets: only the touched ranges of a file are read.

An index has one row per contig with its file, length, offset of the first base,
bases per line and bytes per line.  A request becomes the byte range that holds
its bases, in pieces of bounded size; the pieces are dealt by file and stretch of
the file and sorted, so that a task opens a file once and reads forward, pieces
that lie close together in one go.

Tasks open files with ``pyarrow.fs``, by path or URI (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases that one piece of a request has at most.
PIECE = 1 << 20
#: Bytes of a file that are dealt together.
STRETCH = 1 << 24
#: Bytes between two pieces that are read rather than sought over, and bytes of one read at most.
GAP, READ = 1 << 16, 1 << 23

INDEX = "contig string, length bigint, offset bigint, bases int, width int"
#: Reasons why a request has no bases.
UNKNOWN, OUTSIDE = "unknown_contig", "outside_contig"


def read_index(spark: SparkSession, path: str, sequences: str | None = None) -> DataFrame:
    """``contig, length, offset, bases, width, path`` of an index file, for the sequence file ``sequences`` (the index path without ``.fai``)."""
    rows = spark.read.schema(INDEX).option("sep", "\t").option("mode", "FAILFAST").option("quote", "").csv(path)
    return rows.withColumn("path", F.lit(sequences or re.sub(r"\.fai$", "", path)))


def opened(path: str) -> pa.NativeFile:
    """A file that can be read at any offset."""
    from pyarrow import fs

    if re.match(r"^file:/+", path):
        path = "/" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _index_of(file: pa.NativeFile, chunk: int) -> Iterator[tuple[str, int, int, int, int]]:
    """Index rows of a sequence file, read forward in chunks; a contig whose lines differ in length (but the last) is refused."""
    name, length, first, bases, width, ended = None, 0, 0, 0, 0, False
    at, rest = 0, b""
    while True:
        block = file.read(chunk)
        lines = (rest + block).split(b"\n")
        rest = lines.pop() if block else b""
        if not block and lines and not lines[-1]:
            lines.pop()
        for line in lines:
            size, text = len(line) + 1, line.rstrip(b"\r")
            if text.startswith(b">"):
                if name is not None:
                    yield name, length, first, bases, width
                name, length, first, bases, width, ended = text[1:].split()[0].decode() if text[1:].split() else "", 0, at + size, 0, 0, False
            elif name is not None:
                if ended and text:
                    raise ValueError(f"lines of {name} differ in length")
                if not bases:
                    bases, width = len(text), size
                elif len(text) > bases or (len(text) == bases and size != width and block):
                    raise ValueError(f"lines of {name} differ in length")
                ended = len(text) < bases
                length += len(text)
            at += size
        if not block:
            break
    if name is not None:
        yield name, length, first, bases, width


def build_index(spark: SparkSession, paths: str, chunk: int = 1 << 20) -> DataFrame:
    """The index of every sequence file that ``paths`` leads to, one task per file, in bounded memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as f:
                    rows = list(_index_of(f, chunk))  # one row per contig of a file
                columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array([path] * len(rows), pa.string())], names=["contig", "length", "offset", "bases", "width", "path"])

    files = spark.read.format("binaryFile").load(paths).select("path")  # the contents are not read
    return files.repartition("path").mapInArrow(run, f"{INDEX}, path string")


def _pieces_read(path: str, first: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
    """The bytes of ranges of one file that are sorted by their start, each without line ends."""
    with opened(path) as f:
        i = 0
        while i < len(first):
            # further ranges that start within the gap are read along
            j, end = i + 1, last[i]
            while j < len(first) and first[j] <= end + GAP and max(end, last[j]) - first[i] < READ:
                end = max(end, last[j])
                j += 1
            f.seek(int(first[i]))
            data = f.read(int(end - first[i] + 1))
            for k in range(i, j):
                yield data[first[k] - first[i] : last[k] - first[i] + 1].translate(None, b"\r\n")
            i = j


def fetch_ranges(index: DataFrame, wanted: DataFrame, piece: int = PIECE) -> DataFrame:
    """``wanted`` (``id, contig, start, stop``, from 1, closed) with ``bases`` and ``reason``.

    A contig that the index lacks, and positions out of it, have a reason and no
    bases, as have nulls.  A range in the file that holds another number of bases
    than the index says is refused.  Ids that repeat are answered each.
    """
    asked = wanted.select("id", "contig", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop")).join(index, "contig", "left")
    inside = (F.col("start") >= 1) & (F.col("start") <= F.col("stop")) & (F.col("stop") <= F.col("length"))
    reason = F.when(F.col("path").isNull(), UNKNOWN).when(~F.coalesce(inside, F.lit(False)), OUTSIDE)
    asked = asked.withColumn("reason", reason)
    good = asked.filter("reason IS NULL").withColumn("from", F.explode(F.sequence(F.col("start"), F.col("stop"), F.lit(piece)))).withColumn("to", F.least(F.col("stop"), F.col("from") + piece - 1))

    def place(position: str):
        p = F.col(position) - 1
        return F.col("offset") + F.floor(p / F.col("bases")) * F.col("width") + p % F.col("bases")

    parts = good.select("id", "contig", "start", "stop", "path", "from", "to", place("from").alias("first"), place("to").alias("last"))
    dealt = parts.repartition("path", F.floor(F.col("first") / STRETCH)).sortWithinPartitions("path", "first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = np.array(batch.column(4).to_pylist(), dtype=object)
            edges = np.flatnonzero(paths[1:] != paths[:-1]) + 1 if len(paths) else []
            for a, b in zip([0, *edges], [*edges, len(paths)], strict=True) if len(paths) else []:
                part = batch.slice(a, b - a)
                sizes = (part.column(6).to_numpy() - part.column(5).to_numpy() + 1).tolist()
                found = []
                for size, raw in zip(sizes, _pieces_read(paths[a], part.column(7).to_numpy(), part.column(8).to_numpy()), strict=True):
                    if len(raw) != size:
                        raise ValueError(f"{paths[a]} does not fit its index")
                    found.append(raw.decode("ascii"))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], part.column(5), pa.array(found, pa.string())], names=[*part.schema.names[:4], "from", "piece"])

    schema = dealt.schema
    read = dealt.mapInArrow(run, f"id {schema['id'].dataType.simpleString()}, contig string, start bigint, stop bigint, from bigint, piece string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "piece"))), lambda p: p["piece"]), "")
    # the pieces of one request are one row in the end
    bases = read.groupBy("id", "contig", "start", "stop").agg(whole.alias("bases"))
    asked = asked.select("id", "contig", "start", "stop", "reason")
    return asked.filter("reason IS NOT NULL").withColumn("bases", F.lit(None).cast("string")).unionByName(asked.filter("reason IS NULL").join(bases, ["id", "contig", "start", "stop"]))


def missing_contigs(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """The contigs of ``wanted`` that the index lacks."""
    return wanted.select("contig").distinct().join(index, "contig", "left_anti")


def write_sequences(rows: DataFrame, path: str, width: int = 60) -> None:
    """``contig, sequence`` as sequence files in lines of ``width`` bases, one file per partition; nothing is replaced."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), F.col("contig"), F.when(F.length("sequence") > 0, F.concat(F.lit("\n"), lines)).otherwise("")).alias("value")).write.mode("errorifexists").text(path)
