"""Readers with explicit schemas; nothing is inferred, and a wrong header is refused."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import finite, parse_number


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names in the first line; gzip is recognised by the suffix."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_table(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", exact: bool = True) -> DataFrame:
    """Delimited text as strings, with exactly these columns in any order, or with ``exact=False`` at least these."""
    found = header_of(spark, path, sep)
    missing, extra = set(columns) - set(found), set(found) - set(columns)
    if missing or (exact and extra) or len(set(found)) != len(found):
        raise ValueError(f"wrong columns: missing {sorted(missing)}, unexpected {sorted(extra) if exact else []}")
    schema = StructType([StructField(c, StringType()) for c in found])
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path).select(*columns)


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet columns; only these are read."""
    return spark.read.parquet(path).select(*columns)


def read_predictions(spark: SparkSession, path: str, sep: str = "\t", key: str = "id") -> DataFrame:
    """``key, score, reason`` from ``key, score`` text; a blank or NA score is unscored. Repeated ids are refused."""
    t = read_table(spark, path, [key, "score"], sep)
    score = parse_number(F.col("score"))
    blank = F.coalesce(F.trim("score").isin("", "NA"), F.lit(True))
    bad = t.agg(F.count_if(~blank & score.isNull()).alias("bad"), (F.count("*") - F.count_distinct(key)).alias("twice")).first()
    if bad["bad"] or bad["twice"]:
        raise ValueError(f"{bad['bad']} scores are no finite numbers, {bad['twice']} ids repeat")
    return t.select(key, score.alias("score"), F.when(blank, "unscored_in_file").alias("reason"))


def read_prediction_document(spark: SparkSession, path: str) -> DataFrame:
    """``id, score, reason`` from JSON documents that map ids to a number, or to an object with ``score`` or ``reason``.

    A repeated id, a key that a value repeats and a value of neither form are refused.  A document is one row
    of one task.
    """
    t = spark.read.text(path, wholetext=True)
    keys = F.json_object_keys("value")
    twice = t.agg(F.sum(F.size(keys) - F.size(F.array_distinct(keys))).alias("n"), F.count_if(keys.isNull()).alias("broken")).first()
    if twice["n"] or twice["broken"]:
        raise ValueError(f"{twice['n']} ids repeat, {twice['broken']} files hold no object")
    rows = t.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "v"))
    inner = F.json_object_keys("v")
    again = rows.agg(F.count_if(F.size(inner) > F.size(F.array_distinct(inner))).alias("n")).first()["n"]
    if again:
        raise ValueError(f"the keys of {again} values repeat")
    whole = F.get_json_object("v", "$.score")
    score = F.coalesce(F.col("v").try_cast("double"), whole.try_cast("double"))
    out = rows.select("id", F.when(finite(score), score).alias("score"), F.get_json_object("v", "$.reason").alias("reason"))
    bad = out.agg(F.count_if(F.col("score").isNull() & F.col("reason").isNull()).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} ids have neither a finite score nor a reason")
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, value`` of text files, gzipped or plain by their first two bytes, whatever their names; one task per file, line by line."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import io

        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                held: list[str] = []
                first = 0
                for line in io.TextIOWrapper(stream, encoding="utf-8", newline="\n"):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 10_000:
                        yield pd.DataFrame({"path": name, "line": range(first, first + len(held)), "value": held})
                        first, held = first + len(held), []
                if held:
                    yield pd.DataFrame({"path": name, "line": range(first, first + len(held)), "value": held})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line bigint, value string")


def read_sequence_folders(spark: SparkSession, folder: str) -> DataFrame:
    """``split, class, name, sequence`` from files ``<folder>/<split>/<class>/<name>.txt``."""
    t = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).withColumn("_path", F.col("_metadata.file_path"))
    part = r"([^/]+)/([^/]+)/([^/]+)\.txt$"
    return t.select(F.regexp_extract("_path", part, 1).alias("split"), F.regexp_extract("_path", part, 2).alias("class"), F.regexp_extract("_path", part, 3).alias("name"), F.btrim("value", F.lit(" \t\r\n")).alias("sequence"))


def read_many(spark: SparkSession, folder: str, reference: DataFrame, id_column: str, file_column: str, columns: Sequence[str]) -> DataFrame:
    """One table from the files that a reference table names, with the id of each; a missing file fails the read."""
    files = [r[file_column] for r in reference.select(file_column).distinct().collect()]  # one row per file
    if any("/" in f or f.startswith(".") for f in files):
        raise ValueError("file names must stay in the folder")
    schema = StructType([StructField(c, StringType()) for c in header_of(spark, f"{folder}/{files[0]}")])
    t = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv([f"{folder}/{f}" for f in files])
    t = t.select(*columns, F.col("_metadata.file_name").alias("_file"))
    return t.join(reference.select(id_column, F.col(file_column).alias("_file")), "_file").drop("_file")


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Positions from 0 in a stored order, without gathering rows in one task: per range of the order, then across ranges."""
    from ..operators.ranking import running

    value = order[0]
    r = running(df.withColumn("_all", F.lit(0)), ["_all"], value, {"n": F.count("*")}, descending=False)
    from pyspark.sql import Window

    tie = Window.partitionBy(value).orderBy(*(order[1:] or [value]))
    return df.join(r.select(value, "before_n"), value).withColumn(name, F.col("before_n") + F.row_number().over(tie) - 1).drop("before_n")


def read_json_lines(spark: SparkSession, path: str, schema: StructType, keep: Column | None = None) -> DataFrame:
    """JSON lines by a schema; ``keep``, a condition on the raw ``value``, is applied before any parsing."""
    t = spark.read.text(path)
    if keep is not None:
        t = t.filter(keep)
    return t.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Columns of GTF lines (column ``value``), with ``attributes`` as a map of names to arrays of values."""
    c = F.split("value", "\t")
    t = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    t = t.select(*[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("contig", "source", "feature", "start", "stop", "score", "strand", "frame", "attribute_text"))], F.size(c).alias("_n"))
    names, values = F.regexp_extract_all("attribute_text", F.lit(r'(\w+) "([^"]*)"'), F.lit(1)), F.regexp_extract_all("attribute_text", F.lit(r'(\w+) "([^"]*)"'), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    keys = F.array_distinct(names)
    attributes = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))
    ok = F.col("_n") == 9
    return t.select("contig", "source", "feature", F.when(ok, F.col("start").try_cast("int")).alias("start"), F.when(ok, F.col("stop").try_cast("int")).alias("stop"), "strand", attributes.alias("attributes"), ok.alias("well_formed"))


def canonical_transcripts(gtf: DataFrame, tag: str) -> DataFrame:
    """``gene, transcript, contig, strand, start, stop, exons`` of transcripts with a tag; exons sorted, one transcript per gene, the smallest id of several."""
    a = F.col("attributes")
    rows = gtf.filter("well_formed").select(F.element_at(a["gene_id"], 1).alias("gene"), F.element_at(a["transcript_id"], 1).alias("transcript"), "contig", "strand", "feature", "start", "stop", F.coalesce(F.array_contains(a["tag"], tag), F.lit(False)).alias("tagged"))
    chosen = rows.filter("feature = 'transcript' AND tagged").groupBy("gene").agg(F.min("transcript").alias("transcript"))
    exons = rows.filter("feature = 'exon'").join(chosen, ["gene", "transcript"], "left_semi").groupBy("gene", "transcript", "contig", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("exons"))
    return exons.withColumns({"start": F.array_min("exons.start"), "stop": F.array_max("exons.stop")})


def parse_fasta(lines: DataFrame, ordinal: str = "ordinal", block: int = 65536, stretch: int = 1 << 18) -> DataFrame:
    """``contig, block, offset, sequence, size``: a FASTA file in pieces, from lines with their ordinals.

    Lines belong to the last header before them; each block holds lines that
    start in it, with ``offset``, the position of its first base.  Headers and
    positions run within stretches of the ordinals, and small tables of the
    stretches' last headers and lengths are added, so that no task holds a
    contig or the file.
    """
    from pyspark.sql import Window

    head = F.col("value").startswith(">")
    t = lines.select("value", F.col(ordinal).alias("_at"), F.floor(F.col(ordinal) / stretch).alias("_s"), F.when(head, F.col(ordinal)).alias("_head"))
    inside = Window.partitionBy("_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    last = t.groupBy("_s").agg(F.max("_head").alias("_last"))
    earlier = last.select("_s", F.max("_last").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # one row per stretch
    owned = t.withColumn("_own", F.max("_head").over(inside)).join(earlier, "_s").withColumn("_own", F.coalesce("_own", "_before"))
    names = t.filter(head).select(F.col("_at").alias("_own"), F.regexp_extract("value", r"^>(\S+)", 1).alias("contig"))
    body = owned.filter(~head & F.col("_own").isNotNull()).join(names, "_own").select("contig", "value", "_at", "_s", F.length("value").cast("bigint").alias("_n"))
    local = Window.partitionBy("contig", "_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = body.groupBy("contig", "_s").agg(F.sum("_n").alias("_n"))
    start = sums.select("contig", "_s", F.coalesce(F.sum("_n").over(Window.partitionBy("contig").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = body.withColumn("_o", F.coalesce(F.sum("_n").over(local), F.lit(0))).join(start, ["contig", "_s"]).withColumn("offset", F.col("_o") + F.col("_start"))
    placed = placed.withColumn("block", F.floor(F.col("offset") / block))
    parts = placed.groupBy("contig", "block").agg(F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("p"))
    return parts.select("contig", "block", "offset", F.array_join("p.value", "").alias("sequence"), F.lit(block).alias("size"))


def fetch(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``contig, start, stop``, from 1, closed, with an ``id``) with ``bases``, joined from the blocks that they touch.

    A request is a row per block that may hold its bases: as a block's last line
    may reach beyond it, the one before the first is among them.
    """
    block = (blocks.select("size").first() or [1])[0]
    b = blocks.withColumn("last", F.col("offset") + F.length("sequence"))
    first, final = F.greatest(F.lit(0), F.floor((F.col("start") - 1) / block) - 1), F.floor((F.col("stop") - 1) / block)
    asked = wanted.filter(F.col("stop") >= F.col("start")).withColumn("block", F.explode(F.sequence(F.least(first, final), final)))
    j = asked.join(b, ["contig", "block"]).filter((F.col("start") <= F.col("last")) & (F.col("stop") > F.col("offset")))
    low, high = F.greatest(F.col("start") - 1, F.col("offset")), F.least(F.col("stop"), F.col("last"))
    part = j.withColumn("_s", F.substring("sequence", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")))
    return part.groupBy("id", "contig", "start", "stop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "_s"))), lambda x: x["_s"]), "").alias("bases"))


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """``motif, width`` of a motif file."""
    t = spark.read.text(path, wholetext=True)
    pattern = r"MOTIF\s+(\S+)[\s\S]*?w=\s*(\d+)"
    z = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("motif"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("width"))
    return t.select(F.explode(z).alias("m")).select("m.motif", F.col("m.width").cast("int").alias("width"))


def decode_one_hot(df: DataFrame, column: str, length: int, alphabet: str = "ACGT") -> DataFrame:
    """``sequence`` of a binary column of length x 4 bytes; a position without a base is N, one with several is refused."""
    import numpy as np

    @F.pandas_udf("string")
    def decode(b: pd.Series) -> pd.Series:
        letters = np.array([*alphabet, "N"])

        def one(raw: bytes) -> str:
            m = np.frombuffer(raw, np.uint8).reshape(length, len(alphabet))
            n = m.sum(axis=1)
            if ((m > 1).any()) or (n > 1).any():
                raise ValueError("not one-hot")
            return "".join(letters[np.where(n == 0, len(alphabet), m.argmax(axis=1))])

        return b.map(lambda x: None if x is None else one(x))

    return df.withColumn("sequence", decode(column))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, sha256`` of every file of a folder, each read by a task."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return t.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_npz(spark: SparkSession, paths: str) -> DataFrame:
    """``id, embedding`` from archives with arrays ``ids`` and ``embeddings`` only, one task per file, without pickles."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for b in batches:
            for raw in b["content"]:
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    if set(z.files) != {"ids", "embeddings"} or len(z["ids"]) != len(z["embeddings"]):
                        raise ValueError("the archive must hold ids and embeddings of equal length")
                    yield pd.DataFrame({"id": [str(i) for i in z["ids"]], "embedding": [e.astype(float).tolist() for e in z["embeddings"]]})

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, "id string, embedding array<double>")


def pinned(spark: SparkSession, folder: str, expected: Mapping[str, str]) -> DataFrame:
    """The digests of a folder's files, which must be exactly those that ``expected`` names (path below the folder: sha256)."""
    found = digests(spark, folder)
    root = F.lit("/" + folder.removeprefix("file:").strip("/") + "/")
    named = found.withColumn("name", F.when(F.startswith("path", root), F.substr("path", F.length(root) + 1)).otherwise(F.col("path")))
    want = spark.createDataFrame(list(expected.items()), "name string, expected string")
    wrong = named.join(want, "name", "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("expected")))
    bad = wrong.select("name", F.when(F.col("expected").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").otherwise("changed").alias("how")).orderBy("name").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['name']} is {r['how']}" for r in bad))
    return named.select("path", "size", "sha256")


def complete_embeddings(rows: DataFrame, embeddings: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``embeddings``, if they have exactly the keys of ``rows``, each once, and vectors of one dimension with finite numbers only; else refused."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sides = rows.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(embeddings.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = sides.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("missing"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("unknown"), F.count_if(F.col("b") > 1).alias("twice")).first()
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))
    q = embeddings.agg(F.count_if(~fine).alias("bad"), F.min(F.size(v)).alias("least"), F.max(F.size(v)).alias("most")).first()
    if n["missing"] or n["unknown"] or n["twice"] or q["bad"] or q["least"] != q["most"]:
        raise ValueError(f"{n['missing']} ids without a vector, {n['unknown']} vectors of unknown ids, {n['twice']} ids repeat, {q['bad']} vectors are empty or not finite, dimensions from {q['least']} to {q['most']}")
    return embeddings
