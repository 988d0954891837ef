"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs of learned rotations of their principal
components (iterative quantisation).  A code is split into substrings, each
indexed by its value.  A query probes in every substring all values within
``reach`` bits of its own.  By the pigeonhole principle this retrieves every code
within ``guaranteed`` bits of the query's, (reach + 1) * substrings - 1, and many
of those beyond; codes within ``radius`` go on, and their vectors are ranked by
exact distances.

Vectors are dealt over shards, a fixed number whatever their count.  A shard
indexes its vectors in pieces of bounded size and looks up the probes of all
queries of a block there, so that probes, hits and codes are numbers inside a task
and never rows: a shard gives at most k + 1 rows a query, and the best of all
shards are chosen by a window.

``fit`` chooses the width of the substrings by the number of vectors, and their
number, the reach and the radius by the neighbours within a sample, so that the
wanted share of them is found with the fewest rows.  Queries for which too few
codes lie within the radius are compared with all vectors, in blocks.

Equal vectors are one row of the index, however often they come: the k + 1
smallest of their ids are all that any query can need of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialise, table, written

#: Vectors that the rotations and the radius are fit on (those with the smallest hashes).
SAMPLE = 4096
#: Share of the sample's true neighbours that the probes, and then the radius, must cover.
RECALL = (0.97, 0.99)
#: Rotations that are learned at most, each of as many bits as there are dimensions.
ROTATIONS = 16
#: Vectors that are indexed at once in a task at most, and their components.
PIECE, PIECE_COMPONENTS = 1 << 17, 1 << 23
#: Bits of a substring: the logarithm of the number of vectors, of a piece at most, within these bounds.
WIDTHS = (6, 20)
#: Shards of the vectors for each core of the session.
SHARDS_PER_CORE = 2
#: Queries whose vectors and codes are broadcast at once (about 1 kB each).
BLOCK_QUERIES = 32_768
#: Numbers that a task computes at once: components of distances, or marks of pairs of queries and vectors.
BLOCK_PAIRS = 1 << 21


@dataclass(frozen=True)
class CodeModel:
    mean: np.ndarray
    rotations: np.ndarray
    #: Bits of a substring, and substrings.
    width: int
    count: int
    #: Bits in which a probed value may differ from the query's.
    reach: int
    radius: int
    #: Share of the sample's other vectors that the probes of a vector retrieve, and that the radius leaves.
    probed: float = 1.0
    ranked: float = 1.0

    @property
    def bits(self) -> int:
        return self.width * self.count

    @property
    def guaranteed(self) -> int:
        """Every code within so many bits is retrieved."""
        return (self.reach + 1) * self.count - 1

    def bits_of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.rotations > 0

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 64-bit words."""
        b = np.packbits(self.bits_of(x), axis=1)
        return np.ascontiguousarray(np.pad(b, ((0, 0), (0, -b.shape[1] % 8)))).view(np.int64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Of each substring its position and value, in one number."""
        return _values(self.bits_of(x), self.width) + (np.arange(self.count, dtype=np.int64) << self.width)

    def near_values(self) -> np.ndarray:
        """What is XORed to a value to probe all values within reach."""
        out = level = np.zeros(1, dtype=np.int64)
        for _ in range(self.reach):
            level = np.unique(level[:, None] ^ (1 << np.arange(self.width, dtype=np.int64))[None, :])
            out = np.union1d(out, level)
        return out


def _values(bits: np.ndarray, width: int) -> np.ndarray:
    """The substrings of rows of bits as numbers."""
    return bits.reshape(len(bits), -1, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T


def _piece(dimension: int) -> int:
    """Vectors of a piece at most."""
    return max(1, min(PIECE, PIECE_COMPONENTS // dimension))


def _rotations(centred: np.ndarray, copies: int, rounds: int = 5) -> np.ndarray:
    rng = np.random.default_rng(7)
    d = centred.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(centred)))
    projected = centred @ axes
    parts = []
    for _ in range(copies):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ v).T
        parts.append(axes @ turn)
    return np.concatenate(parts, axis=1)


def fit(x: np.ndarray, k: int, size: int, recall: tuple[float, float] = RECALL, copies: int = ROTATIONS, queries: int = 512) -> CodeModel:
    """Model for ``size`` vectors from a sample of them, which costs the fewest rows of the index and of the probes.

    Neighbours in the sample are farther than in the whole: as many of each
    vector count as a sample of this size holds of its k nearest, one at least.
    """
    mean, d = x.mean(axis=0), x.shape[1]
    width = int(min(max(math.log2(max(2, min(size, _piece(d)))), WIDTHS[0]), WIDTHS[1], d * copies))
    most = d * copies // width
    rotations = _rotations(x - mean, copies)[:, : most * width]
    if len(x) <= k + 1:
        return CodeModel(mean, rotations[:, :width], width, 1, width, width)
    at = np.arange(min(len(x), queries))
    apart = _distances(x[at], x)
    apart[at, at] = np.inf
    k = min(k, max(1, math.ceil(k * len(x) / size)))
    nearest = np.argpartition(apart, k, axis=1)[:, :k]
    bits = (x - mean) @ rotations > 0
    value = _values(bits, width)
    share = [math.comb(width, e) for e in range(width + 1)]
    volume = np.cumsum(share)
    # least distance of each pair over the substrings so far
    differ = np.bitwise_count(value[at][:, None, :] ^ value[nearest]).astype(np.int8)
    least = np.minimum.accumulate(differ, axis=2)
    best = None
    for reach in range(width + 1):
        found = (least <= reach).mean(axis=(0, 1))
        enough = np.flatnonzero(found >= recall[0])
        if not len(enough):
            continue
        count = int(enough[0]) + 1
        met = sum((np.bitwise_count(value[at, j][:, None] ^ value[None, :, j]) <= reach).mean() for j in range(count))
        cost = count * float(volume[reach]) + met * size
        if best is None or cost < best[0]:
            best = (cost, reach, count)
    _, reach, count = best if best is not None else (0, width, 1)
    model = CodeModel(mean, rotations[:, : count * width], width, count, reach, count * width)
    code = model.codes(x)
    radius = int(np.quantile(hamming(code[at][:, None, :], code[nearest]), recall[1], method="higher"))
    met = np.zeros((len(at), len(x)), dtype=bool)
    for j in range(count):
        met |= np.bitwise_count(value[at, j][:, None] ^ value[None, :, j]) <= reach
    met[at, at] = False
    ranked = met & (np.stack([hamming(code[i], code) for i in at]) <= radius)
    return CodeModel(mean, model.rotations, width, count, reach, radius, float(met.sum() / met.size), float(ranked.sum() / met.size))


def _usable(vectors: DataFrame, dimension: int) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part, one row an id."""
    e = F.col("embedding").cast("array<double>")
    big = F.lit(float("inf"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size(e) == dimension) & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query."""
    order = np.lexsort((ids, score, query))
    query = query[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return order[place < k]


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, block_queries: int = BLOCK_QUERIES, model: CodeModel | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each vector for which ``is_query`` (a condition) holds.

    Nearness is the smallest Euclidean distance of the original vectors in
    double precision, ties to the smaller id.  Candidates are all other ids;
    vectors that are null or zero, hold nulls or non-finite numbers, or have
    another length than most take no part, nor do null ids.  Repeated rows of
    an id count once, with the smallest of their vectors, if these differ.  With
    fewer than ``k`` candidates all are returned; an empty table has no results.
    Other columns are not returned, whatever their names.
    """
    spark = vectors.sparkSession
    length = vectors.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if length is None or length["n"] == 0:
        return spark.createDataFrame([], schema)
    usable = _usable(vectors, length["n"])
    # one row of each vector: its smallest id stands for it, and the k + 1 smallest ids are what others may find
    keyed = usable.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    one = keyed.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("vec_id", "h.*")
    one = materialise(one.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))))
    copies = one.filter(F.col("place") <= k + 1)
    first = one.filter("place = 1").select(F.col("vec_id").alias("rep"), "h1", "h2")
    shards = max(1, SHARDS_PER_CORE * spark.sparkContext.defaultParallelism)
    index = written(keyed.join(first.select(F.col("rep").alias("vec_id"), "h1", "h2"), ["vec_id", "h1", "h2"]).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("rep"), "embedding").repartition(shards, "rep"))
    size = index.count()
    if size == 0:
        return spark.createDataFrame([], schema)
    if model is None:
        rows = index.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
        model = fit(_matrix(rows["embedding"]), k, size)
    shared = spark.sparkContext.broadcast(model)

    asked = one.filter(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").join(first, ["h1", "h2"]).select("query_id", "rep")
    asked = materialise(asked)
    # queries in blocks by a hash; equal vectors ask once
    blocks = max(1, math.ceil(asked.agg(F.count_distinct("rep")).first()[0] / block_queries))
    queries = materialise(index.join(asked.select("rep").distinct(), "rep", "left_semi").withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")))

    found = []
    for b in range(blocks):
        block = queries.filter(F.col("block") == b).select("rep", "embedding")
        asks = block.toArrow()  # at most about block_queries rows
        of_block = spark.sparkContext.broadcast((asks["rep"].to_numpy(), _matrix(asks["embedding"]) if len(asks) else np.zeros((0, length["n"]))))
        scored = materialise(_top(index.coalesce(shards).mapInArrow(_probed(shared, of_block, k), "query bigint, rep bigint, score double"), k))
        # a query needs k + 1 vectors (its own among them), or as many as there are
        short = block.select("rep").join(scored.groupBy(F.col("query").alias("rep")).count().filter(F.col("count") >= min(k + 1, size)), "rep", "left_anti")
        rest = [r["rep"] for r in short.collect()]  # queries of one block
        if rest:
            every = index.coalesce(shards).mapInArrow(_score_all(of_block, rest, k), "query bigint, rep bigint, score double")
            scored = scored.join(F.broadcast(short.select(F.col("rep").alias("query"))), "query", "left_anti").unionByName(_top(every, k))
        found.append(scored)
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    # back from vectors to ids
    members = copies.join(first, ["h1", "h2"]).select("rep", "vec_id")
    out = asked.select("query_id", F.col("rep").alias("query")).join(best, "query").join(members, "rep").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` best of each query: its own vector may be among them."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))
    return scored.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1).drop("_rank")


def _rows(query: np.ndarray, rep: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(rep), pa.array(score)], names=["query", "rep", "score"])


def _pieces(batches: Iterable[pa.RecordBatch], dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a shard in pieces of bounded size."""
    most = _piece(dimension)
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            if held and sum(b.num_rows for b in held) + part.num_rows > most:
                t = pa.Table.from_batches(held)
                yield t["rep"].to_numpy(), _matrix(t["embedding"])
                held = []
            held.append(part)
    if any(b.num_rows for b in held):
        t = pa.Table.from_batches(held)
        yield t["rep"].to_numpy(), _matrix(t["embedding"])


def _coded(m: CodeModel, x: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Codes and keys of vectors, some at a time, as the bits of all would take much room."""
    parts = [x[at : at + rows] for at in range(0, max(1, len(x)), rows)]
    return np.concatenate([m.codes(p) for p in parts]).view(np.uint64), np.concatenate([m.keys(p).astype(np.int32) for p in parts])


def _index(m: CodeModel, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of every key: they stand in ``order`` from ``start[key]`` up to ``start[key + 1]``."""
    start = np.zeros((m.count << m.width) + 1, np.int32 if keys.size < 1 << 31 else np.int64)
    order = np.empty(keys.size, np.int32)
    for j in range(m.count):
        first, last = j << m.width, (j + 1) << m.width
        order[j * len(keys) : (j + 1) * len(keys)] = np.argsort(keys[:, j], kind="stable")
        start[first + 1 : last + 1] = j * len(keys) + np.cumsum(np.bincount(keys[:, j] - first, minlength=1 << m.width))
    return start, order


def _retrieved(keys: np.ndarray, near: np.ndarray, start: np.ndarray, order: np.ndarray, vectors: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of queries and vectors, once each, of which a key of the vector is within reach of the query's."""
    seen = np.zeros((len(keys), vectors), bool)
    for j in range(keys.shape[1]):
        probes = keys[:, j][:, None] ^ near
        begin = start[probes]
        count = start[probes + 1] - begin
        query, at = np.nonzero(count)
        begin, count = begin[query, at].astype(np.int64), count[query, at]
        ends = np.cumsum(count, dtype=np.int64)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)
        seen[np.repeat(query, count), order[place]] = True
    return np.nonzero(seen)


def _probed(shared, of_block, k: int):
    """Of the vectors of a shard that the probes of a query retrieve and the radius leaves, the best of each query by exact distance."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ids, x = of_block.value
        if not len(ids):
            return
        near = m.near_values().astype(np.int32)
        asked, probed = _coded(m, x)
        query, rep, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for of, y in _pieces(batches, x.shape[1]):
            codes, keys = _coded(m, y)
            start, order = _index(m, keys)
            found = [(query, rep, score)]
            step = max(1, BLOCK_PAIRS // max(len(y), len(near)))
            for at in range(0, len(ids), step):
                q, v = _retrieved(probed[at : at + step], near, start, order, len(y))
                q += at
                some = max(1, BLOCK_PAIRS // max(codes.shape[1], y.shape[1]))
                for a in range(0, len(q), some):
                    of_q, of_v = q[a : a + some], v[a : a + some]
                    within = np.bitwise_count(codes[of_v] ^ asked[of_q]).sum(axis=1, dtype=np.int64) <= m.radius
                    of_q, of_v = of_q[within], of_v[within]
                    apart = np.sqrt(((y[of_v] - x[of_q]) ** 2).sum(axis=1))
                    keep = _best(of_q, of[of_v], apart, k + 1)
                    found.append((ids[of_q[keep]], of[of_v[keep]], apart[keep]))
            query, rep, score = (np.concatenate(c) for c in zip(*found, strict=True))
            keep = _best(query, rep, score, k + 1)
            query, rep, score = query[keep], rep[keep], score[keep]
        yield _rows(query, rep, score)

    return run


def _score_all(of_block, rest: list[int], k: int):
    """Exact distances of some queries from all vectors, the best of each query within a shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = of_block.value
        own = np.flatnonzero(np.isin(ids, rest))
        found = _rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, y = batch.column(0).to_numpy(), _matrix(batch.column(1))
            step = max(1, BLOCK_PAIRS // max(1, len(rep) * y.shape[1]))
            parts = [[c.to_numpy() for c in found.columns]]
            for at in range(0, len(own), step):
                q = own[at : at + step]
                score = np.sqrt(((y[None, :, :] - x[q][:, None, :]) ** 2).sum(axis=2)).ravel()
                query, of = np.repeat(ids[q], len(rep)), np.tile(rep, len(q))
                keep = _best(query, of, score, k + 1)
                parts.append([query[keep], of[keep], score[keep]])
            query, of, score = (np.concatenate(c) for c in zip(*parts, strict=True))
            keep = _best(query, of, score, k + 1)
            found = _rows(query[keep], of[keep], score[keep])
        yield found

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
