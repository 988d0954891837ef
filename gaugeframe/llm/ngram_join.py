"""Self-join of documents on the Jaccard similarity of their word 5-grams.

1.  Every text becomes min-hashes; ``bands`` groups of ``rows`` of them are
    hashed.  ``choose_banding`` picks the numbers for a target recall.
2.  Texts with equal n-gram sets are one *representative* with a number of
    copies; only representatives go on.
3.  Representatives are shuffled on band hashes.  A bucket of one is dropped.
    Larger ones are dealt in blocks; the task of a pair of blocks compares
    min-hashes and keeps the members that have a likely partner there.  A pair
    belongs to the first band that it shares, so that it is seen once.
4.  The n-gram sets of those members meet in the same blocks, and every pair is
    verified on the full sets.  A task returns, per member, its number of links
    and one node of its local component; pairs are never rows.
5.  Components of those rows are the classes.

A bucket of any size is verified in whole: the number of tasks of a bucket
grows with its blocks, never the memory of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import hashing
from .columns import shielded
from .groups import complete_groups
from .storage import in_batches, materialise, table

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Members of a block of a bucket, and bytes of their n-gram sets, about.
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Ids up to which the documents to re-read are found by a broadcast (8 bytes each).
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        """Probability that two texts of that similarity share a band."""
        return 1 - (1 - similarity**self.rows) ** self.bands

    def least_agreement(self, similarity: float, miss: float = 1e-6) -> int:
        """Fewest equal min-hashes of a pair of that similarity, but for a probability ``miss``."""
        n, p = self.bands * self.rows, similarity
        total, k = 0.0, 0
        while k <= n:
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if total > miss:
                return k
            k += 1
        return n


def choose_banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = 96) -> Banding:
    """The most selective banding (most rows a band) that finds pairs at the threshold with the target recall."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = Banding(bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within max_hashes")
    return best


def _set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of an n-gram set, given sorted and distinct."""
    with np.errstate(over="ignore"):
        return (
            int(np.sum(hashing.mix64(shingles + np.uint64(1)), dtype=np.uint64).astype(np.int64)),
            int(np.sum(hashing.mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).astype(np.int64)),
        )


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_SIGNATURE = "doc_id bigint, k1 bigint, k2 bigint, n_shingles int, bands array<bigint>, mh binary"


def signatures(docs: DataFrame, banding: Banding, n: int = SHINGLE) -> DataFrame:
    """One row per document with an id: n-gram set keys, band hashes and one byte of each min-hash."""
    k = banding.bands * banding.rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in hashing.chunks(batch.column(1)):
                words, offsets = hashing.word_hashes(texts)
                shingles, offsets = hashing.shingle_hashes(words, offsets, n)
                mh = hashing.minhashes(shingles, offsets, k)
                bands = np.zeros((len(texts), banding.bands), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(banding.rows):
                        bands = hashing.mix64(bands * np.uint64(31) + mh[:, r :: banding.rows].astype(np.uint64) + np.uint64(1))
                sets = [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                keys = [_set_keys(s) for s in sets]
                low = np.ascontiguousarray(mh.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(texts)),
                        pa.array([x[0] for x in keys], pa.int64()),
                        pa.array([x[1] for x in keys], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.ListArray.from_arrays(np.arange(0, bands.size + 1, banding.bands, dtype=np.int32), pa.array(_signed(bands.ravel()))),
                        pa.array([row.tobytes() for row in low], pa.binary()),
                    ],
                    names=["doc_id", "k1", "k2", "n_shingles", "bands", "mh"],
                )

    return in_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")).mapInArrow(run, _SIGNATURE)


def shingle_sets(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``rep, k1, k2, shingles``: the sorted 64-bit n-gram hashes of each document as binary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in hashing.chunks(batch.column(1)):
                words, offsets = hashing.word_hashes(texts)
                shingles, offsets = hashing.shingle_hashes(words, offsets, n)
                sets = [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                keys = [_set_keys(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["rep", "k1", "k2", "shingles"],
                )

    return in_batches(docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string"))).mapInArrow(run, "rep bigint, k1 bigint, k2 bigint, shingles binary")


_CELL = ["band", "h", "bi", "bj"]


def _pairs(reps: np.ndarray, blocks: np.ndarray, bands: np.ndarray, band: int, bi: int, bj: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell of different representatives: across its two blocks, that share no band before ``band``."""
    n = len(reps)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    left = np.arange(n) if bi == bj else np.flatnonzero(blocks == bi)
    right_all = np.arange(n) if bi == bj else np.flatnonzero(blocks == bj)
    for i in left:
        right = right_all[right_all > i] if bi == bj else right_all
        right = right[reps[right] != reps[i]]
        if band and len(right):
            right = right[~(bands[right, :band] == bands[i, :band]).any(axis=1)]
        if len(right):
            out.append((np.full(len(right), i), right))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _likely(cells: DataFrame, banding: Banding, threshold: float) -> DataFrame:
    """Members of cells that have a partner there whose min-hashes allow the threshold."""
    least, k = banding.least_agreement(threshold), banding.bands * banding.rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, offsets in complete_groups(batches, _CELL):
            reps, blocks, band, bi, bj = (t[c].to_numpy() for c in ("rep", "block", "band", "bi", "bj"))
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, banding.bands)
            mh = _matrix(t["mh"], np.uint8, k)
            keep = np.zeros(t.num_rows, dtype=bool)
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if b - a < 2:
                    continue
                i, j = _pairs(reps[a:b], blocks[a:b], bands[a:b], int(band[a]), int(bi[a]), int(bj[a]))
                for s in range(0, len(i), 1 << 16):
                    x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    good = (mh[a:b][x] == mh[a:b][y]).sum(axis=1) >= least
                    keep[a + x[good]] = True
                    keep[a + y[good]] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).drop_columns(["mh"]).to_batches()

    return in_batches(cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "rep")).mapInArrow(run, "band int, h bigint, bi int, bj int, block int, rep bigint, k1 bigint, k2 bigint, copies bigint, bands array<bigint>")


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(i) <= 48:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=np.int64)
    lengths = np.array([len(s) for s in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    shared = counts[ids] > 1
    ids, owner = ids[shared], owner[shared]
    _, ids = np.unique(ids, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = 4096
    for s in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
        a, b = np.searchsorted(ids, [s, s + step])
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[owner[a:b], ids[a:b] - s] = 1
        total += m @ m.T  # counts below 2**24 are exact
    return total[i, j].astype(np.int64)


def _verify(cells: DataFrame, banding: Banding, threshold: float) -> DataFrame:
    """Per member of a cell: linked documents there, and the smallest node of its component of the cell's links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, offsets in complete_groups(batches, _CELL):
            reps, blocks, band, bi, bj, copies = (t[c].to_numpy() for c in ("rep", "block", "band", "bi", "bj", "copies"))
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, banding.bands)
            column = t["shingles"].combine_chunks()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                i, j = _pairs(reps[a:b], blocks[a:b], bands[a:b], int(band[a]), int(bi[a]), int(bj[a])) if b - a > 1 else ((), ())
                if not len(i):
                    continue
                sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column.slice(a, b - a)]
                lengths = np.array([len(s) for s in sets])
                common = _overlaps(sets, i, j)
                linked = common >= threshold * (lengths[i] + lengths[j] - common) - 1e-9
                i, j = i[linked], j[linked]
                if not len(i):
                    continue
                links = np.bincount(i, copies[a:b][j], b - a) + np.bincount(j, copies[a:b][i], b - a)
                root = reps[a:b].copy()
                while True:  # labels only fall, so this ends
                    before = root.copy()
                    np.minimum.at(root, i, before[j])
                    np.minimum.at(root, j, before[i])
                    if (root == before).all():
                        break
                has = links > 0
                out.append((reps[a:b][has], root[has], links[has].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in range(3)], names=["rep", "root", "links"])

    return in_batches(cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "rep")).mapInArrow(run, "rep bigint, root bigint, links bigint")


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row with an id.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least ``threshold``.  ``n_links`` counts the other documents
    (rows) linked to a row, copies included; ``class_id`` is the smallest id of
    its connected component.  Texts are compared as lower-cased words; a text
    of fewer than n words has its whole word sequence as its only n-gram.
    Null, empty and wordless texts have no n-grams, hence no links and a class
    of their own.  Rows with a null id are left out.  Repeated rows are copies
    of each other and are returned as often as they come; an id that comes with
    several texts is one node of the links.  Whole texts are compared, however
    long; an empty table has no rows.  Other columns are not returned, whatever
    their names.
    """
    banding = choose_banding(threshold, recall)
    # the band hashes are needed once per representative, the keys once per document
    every = materialise(signatures(docs, banding, n))
    reps = materialise(
        every.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("mh").alias("mh"))
    )
    rows = reps.select("rep", "k1", "k2", "n_shingles", F.posexplode("bands").alias("band", "h"))
    crowded = rows.groupBy("band", "h").agg(F.count("*").alias("n"), (8 * F.sum("n_shingles")).alias("bytes")).filter("n > 1")
    # a block has few members if these are long
    members = rows.join(crowded, ["band", "h"]).withColumn("_blocks", F.least("n", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / BLOCK_BYTES))).cast("int")).drop("n_shingles")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep", "k1", "k2"), F.col("_blocks")).cast("int"))
    members = members.join(reps.select("rep", "k1", "k2", "copies", "bands", "mh"), ["rep", "k1", "k2"])
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = members.select("band", "h", F.least("block", "_other").alias("bi"), F.greatest("block", "_other").alias("bj"), "block", "rep", "k1", "k2", "copies", "bands", "mh")
    likely = materialise(_likely(cells, banding, threshold))

    wanted = likely.select("rep").distinct()
    if likely.agg(F.count_distinct("rep")).first()[0] <= broadcast_ids:
        wanted = F.broadcast(wanted)
    chosen = docs.filter("doc_id IS NOT NULL").join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = shingle_sets(chosen, n).dropDuplicates(["rep", "k1", "k2"])
    links = materialise(_verify(likely.join(sets, ["rep", "k1", "k2"]), banding, threshold))

    classes = connected_components(links, "rep", "root")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("k1", "k2", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    some = F.col("n_shingles") > 0
    linked = every.filter(some).select("doc_id", "k1", "k2").join(known, ["k1", "k2"], "left").select("doc_id", "class_id", "n_links")
    # texts without n-grams share one key, so they stay out of the join
    return linked.unionByName(every.filter(~some).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, of the smallest id; rows with a null id stay, and columns of any name."""
    classes = materialise(similarity_classes(docs.select("doc_id", "text"), **options))
    copies = classes.filter("doc_id <> class_id").select("doc_id").distinct()
    n = classes.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count(F.when(F.col("doc_id") != F.col("class_id"), 1)).alias("copies")).first()

    def one_each(d: DataFrame) -> DataFrame:
        kept = d.join(F.broadcast(copies) if n["copies"] <= BROADCAST_IDS else copies, "doc_id", "left_anti").select(d.columns)
        if n["rows"] != n["ids"]:  # rows that repeat an id
            kept = kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))
        return kept

    return shielded(docs, ["doc_id"], one_each)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


#: All pairs that share an n-gram, exactly; meant for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(t) >= 5 THEN [array_to_string(t[i : i + 4], ' ') for i in range(1, len(t) - 3)] WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE c >= 0.8e0 * (x.n + y.n - c) - 1e-9
), d AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.id
)
SELECT id AS doc_id, min(c) AS class_id, (SELECT count(*) FROM d WHERE d.a = r.id) AS n_links FROM r GROUP BY id
"""
