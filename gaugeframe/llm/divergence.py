"""Audit of how far the sources of a language diverge in their use of words.

A byte-level tokenizer reads the UTF-8 buffers of many texts at once: a lookup
table tells the bytes of terms, and numpy finds where terms begin and end.
xxhash groups the slices, and the bytes of every slice are compared with those
of its group's first, so that a collision makes a group of its own.  Counts per
(language, source, term) and the number of documents are summed inside the
batch, then by Spark.

The divergence of two sources is a sum over all kept terms of the language,
most of which a source never uses.  With the share of an absent term, which is
one number per source, the sum becomes (terms) x (both absent), which is closed,
and an excess over it where one of the two uses the term.  The excesses come
from CSR matrices of sources by terms: one for each pair of source tiles and
block of terms, which bounds their size whatever the number of sources and
terms; ``np.add.reduceat`` sums a matrix row in each.  All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .storage import table, written

#: Documents of a language in which a kept term occurs at least.
LEAST_DOCUMENTS = 10
#: Terms listed per group.
TOP = 10
UNIT = 1_000_000_000
#: Bytes of text that are tokenized at once.
CHUNK_BYTES = 1 << 21
#: Sources of a tile, and entries of a block of two tiles, about.
TILE_SOURCES, BLOCK_ENTRIES = 128, 250_000

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z lower-cased, start and end of every term in them, and the text of each term."""
    data, offsets = hashing.text_bytes(texts, lower=False)
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # no term goes on from one text to the next
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _FOLD[data], starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all bytes of slices, one slice after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[memoryview], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of equal bytes of every slice, and the position of a slice of each group among the slices."""
    view = memoryview(np.ascontiguousarray(data))
    hashes = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    _, example, group = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    same = lengths == lengths[example][group]
    candidates = np.flatnonzero(same)
    # some bytes at a time, as a text may be long
    parts = np.searchsorted(np.cumsum(lengths[candidates]), np.arange(CHUNK_BYTES, int(lengths.sum()) + CHUNK_BYTES, CHUNK_BYTES), side="right")
    for a, b in zip([0, *parts], [*parts, len(candidates)], strict=True):
        at = candidates[a:b]
        if len(at):
            equal = data[_positions(starts[at], lengths[at])] == data[_positions(starts[example][group[at]], lengths[at])]
            same[at] = np.logical_and.reduceat(equal, np.cumsum(lengths[at]) - lengths[at])
    if not same.all():  # slices that share a hash with other bytes
        more: dict[bytes, int] = {}
        added = []
        for i in np.flatnonzero(~same):
            key = bytes(view[starts[i] : ends[i]])
            if key not in more:
                more[key] = len(example) + len(added)
                added.append(i)
            group[i] = more[key]
        example = np.concatenate([example, np.array(added, dtype=example.dtype)])
    return group, example


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[_positions(starts, lengths)]))])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, documents``: occurrences and documents of every term of every group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in hashing.chunks(batch.column(2), CHUNK_BYTES):
                langs, sources = (batch.column(i).slice(at, len(texts)).dictionary_encode() for i in (0, 1))
                owners, owner = np.unique(langs.indices.to_numpy() * np.int64(len(sources.dictionary)) + sources.indices.to_numpy(), return_inverse=True)
                data, starts, ends, text = boundaries(texts)
                if not len(starts):
                    continue
                term, example = grouped(data, starts, ends)
                in_text, n = np.unique(text * np.int64(len(example)) + term, return_counts=True)
                key = owner[in_text // len(example)] * np.int64(len(example)) + in_text % len(example)
                order = np.argsort(key, kind="stable")
                found, first, documents = np.unique(key[order], return_index=True, return_counts=True)
                group, term = owners[found // len(example)], example[found % len(example)]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(group // len(sources.dictionary))),
                        sources.dictionary.take(pa.array(group % len(sources.dictionary))),
                        _slices(data, starts[term], ends[term]),
                        pa.array(np.add.reduceat(n[order], first)),
                        pa.array(documents),
                    ],
                    names=["lang", "source", "term", "n", "documents"],
                )

    made = docs.mapInArrow(run, "lang string, source string, term string, n bigint, documents bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exactly; null without terms."""
    below = (total + 2 * terms).cast("decimal(20,0)")
    above = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", above, F.when(below > 0, below)) + 1)


def excesses(sources: int, entry_source: np.ndarray, entry_term: np.ndarray, share: np.ndarray, absent: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each source in ``left`` the sources in ``right``, and the excess of each over two sources without any of the block's terms.

    ``entry_*`` and ``share`` are the entries of the matrix, ``absent`` the
    share of an absent term by source.
    """
    order = np.lexsort((entry_term, entry_source))
    column, share = entry_term[order], share[order]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(entry_source, minlength=sources))])
    row = np.repeat(np.arange(sources), np.diff(indptr))
    filled = np.flatnonzero(np.diff(indptr))
    width = int(column.max(initial=-1)) + 1

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def summed(x: np.ndarray) -> np.ndarray:
        out = np.zeros(sources, dtype=np.int64)
        if len(x):
            out[filled] = np.add.reduceat(x, indptr[:-1][filled])
        return out

    for g in left:
        mine = slice(indptr[g], indptr[g + 1])
        dense, has = np.full(width, absent[g]), np.zeros(width, dtype=bool)
        dense[column[mine]], has[column[mine]] = share[mine], True
        both = f(absent[g], absent)
        # terms of the other source, whether this one has them or not
        total = summed(f(share, dense[column]) - both[row])
        # terms of this source, less those that the other one has too
        value, times = np.unique(share[mine], return_counts=True)
        total += (f(value[:, None], absent[None, :]) * times[:, None]).sum(axis=0) - both * (indptr[g + 1] - indptr[g])
        total -= summed(np.where(has[column], f(dense[column], absent[row]) - both[row], 0))
        yield g, right, total[right]


def _pairs_of_block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums of one block for every pair of a source of tile ``i`` and one of tile ``j``."""
    lang, i, j, block = (k.as_py() for k in key)
    of_source = pc.is_null(rows["term"])
    heads, entries = rows.filter(of_source), rows.filter(pc.invert(of_source))
    names, tile, absent, terms = heads["source"].combine_chunks(), heads["tile"].to_numpy(), heads["share"].to_numpy(zero_copy_only=False), heads["terms"].to_numpy()
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if terms[0] == 0:  # a language without kept terms: all sums are 0
        found = ((g, right, np.zeros(len(right), dtype=np.int64)) for g in left)
        both = np.zeros((len(names), len(names)), dtype=np.int64)
    else:
        absent = absent.astype(np.int64)
        term = entries["term"].combine_chunks().dictionary_encode().indices.to_numpy() if len(entries) else np.zeros(0, np.int64)
        source = pc.index_in(entries["source"], value_set=names).to_numpy() if len(entries) else np.zeros(0, np.int64)
        found = excesses(len(names), source.astype(np.int64), term.astype(np.int64), entries["share"].to_numpy().astype(np.int64), absent, left, right)
        both = (absent[:, None] - absent[None, :]) ** 2 // (absent[:, None] + absent[None, :]) * terms[0]
    for g, others, value in found:
        kept = others > g if i == j else np.ones(len(others), dtype=bool)
        others, value = others[kept], value[kept]
        out.append((np.full(len(others), g), others, value + (both[g, others] if block == 0 else 0)))
    g, h, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "a": names.take(pa.array(g)), "b": names.take(pa.array(h)), "value": pa.array(value.astype(np.int64))})


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, tile_sources: int = TILE_SOURCES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every group its divergence from each other source of the language, and its strongest terms.

    Part ``pair`` has the other sources, all of them, part ``term`` the terms
    that the group uses more than the language does, ``top`` at most; ranks
    start at 1, larger values first, then the smaller item.  Null texts,
    languages and sources count as empty; every row is a document, repeated
    rows and null ids too.  A group without terms is compared as one that has
    none; in a language without kept terms all pairs have 0.  Whole texts are
    read, however long; an empty table has no rows.  Other columns of ``docs``
    are not used, whatever their names.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"in_lang": F.sum("documents").over(of_term), "lang_n": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    kept = written(counted.filter(F.col("in_lang") >= least).select("lang", "source", "term", "n", "lang_n", "first"))

    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("bigint")).alias("terms"), F.sum("n").alias("lang_total"), F.count("*").alias("entries"))
    groups = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").join(groups.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "terms", "lang_total", "entries")})
    groups = groups.withColumn("tiles", F.ceil(F.col("sources") / tile_sources).cast("int"))
    by_entries = F.ceil(2 * F.col("entries") / (F.col("tiles") * block_entries))
    by_size = F.ceil(F.least("sources", F.lit(2 * tile_sources)) * F.col("terms") / (4 * block_entries))
    groups = groups.withColumns({"blocks": F.greatest(F.lit(1), by_entries, by_size).cast("int"), "tile": F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")})
    groups = written(groups.select("lang", "source", "total", "terms", "lang_total", "tiles", "tile", "blocks"))

    entries = kept.join(groups, ["lang", "source"]).withColumn("share", _share(F.col("n"), F.col("total"), F.col("terms")))
    lang_share = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    value = F.call_function("div", (F.col("share") - F.col("q")) * (F.col("share") - F.col("q")), F.col("share") + F.col("q"))
    strong = entries.withColumn("q", lang_share).filter("share > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    terms = strong.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), _share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")).alias("share"), "terms", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = entries.select("lang", "source", "term", "share", "terms", "tile", "tiles", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    rows = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "block", "source", "term", "share", "terms", "tile")
    sums = rows.groupBy("lang", "i", "j", "block").applyInArrow(_pairs_of_block, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value")
    pairs = both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_F = "((p - q) * (p - q) // (p + q))"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p, 1 + {UNIT}::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {_F}::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM z)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {TOP}"""
