"""Centroid clustering of integer vectors with Hamerly's bounds.

A table of states has one row per vector: its components as integers, its
cluster, an upper bound of the distance to its centroid and a lower bound of
the distance to every other centroid.  When the centroids move, the upper bound
grows by the drift of the own centroid and the lower one shrinks by the largest
drift of the others.  While the upper bound stays below the lower one, or below
half the distance from the own centroid to the next, the vector cannot have
changed its cluster and no distance is computed.  Otherwise the distance to the
own centroid is computed, and if that does not decide, those to all centroids.

Distances are exact integers and decide ties (the smaller number wins); bounds
are doubles, rounded outwards, and decide only where they are strictly apart.

Each round reads the states once and writes the next ones to the shared folder;
the round before goes when they stand.  A task adds one row with what it changed
in the sums of the clusters, in a column that is null elsewhere, so that the new
centroids come from a scan of that column alone, and a task that runs again
replaces its row.  The driver holds k centroids and k * (components + 1) sums.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .storage import discard, shared_folder, table, written

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Rows that are worked on at once.
ROWS = 4096
#: Largest components with exact sums of products in doubles, and in 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 1 << 22, 1 << 27
#: Components from here on have distances that no long holds.
TOO_LARGE = 1 << 31
#: Relative width of the outward rounding; conversion, root and product err by less.
OUTWARD = 2.0**-50

_VECTORS = "vec_id bigint, vector binary"
_STATES = f"{_VECTORS}, cluster int, upper double, lower double, changes binary"
_ASSIGNED = "vec_id bigint, cluster int, distance bigint"


def integers(column: pa.Array, components: int = COMPONENTS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list array have ``components`` finite numbers, and floor(scale * x) of these as a matrix."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), components), False)
    at = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)
    finite = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(x[finite] * scale)
    if scaled.size and np.abs(scaled).max() >= TOO_LARGE:
        raise ValueError("a component is so large that squared distances do not fit a long")
    return at[finite], scaled.astype(np.int64)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes, in two bytes a component where they fit, else in four."""
    kind = "<i2" if not x.size or (x.min() >= -(1 << 15) and x.max() < 1 << 15) else "<i4"
    raw = np.ascontiguousarray(x.astype(kind))
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _unpacked(column: pa.Array, components: int) -> np.ndarray:
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), components), dtype=np.int64)
    for width, kind in ((2, "<i2"), (4, "<i4")):
        at = np.flatnonzero(sizes == width * components)
        if len(at):
            raw = column if len(at) == len(column) else column.take(pa.array(at))
            _, offsets, data = raw.buffers()
            first = np.frombuffer(offsets, np.int32)[raw.offset]
            out[at] = np.frombuffer(data, kind, count=len(at) * components, offset=int(first)).reshape(-1, components)
    return out


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most <= EXACT_DOUBLE:  # all sums stay below 2**53
        a, b = x.astype(np.float64), centroids.astype(np.float64)
    elif most <= EXACT_LONG:
        a, b = x, centroids
    else:
        a, b = x.astype(object), centroids.astype(object)
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    if d.dtype == object and d.size and d.max() >= 1 << 63:
        raise ValueError("a squared distance does not fit a long")
    return d.astype(np.int64)


def squared_to_own(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row to the centroid of its cluster."""
    d = x - centroids[cluster]
    if int(np.abs(d).max(initial=0)) > 2 * EXACT_LONG:
        d = d.astype(object)
    out = (d * d).sum(axis=1)
    if out.dtype == object and out.size and out.max() >= 1 << 63:
        raise ValueError("a squared distance does not fit a long")
    return out.astype(np.int64)


def _above(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + OUTWARD)


def _below(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 - OUTWARD)


class Centroids:
    """Where the centroids are, how far each has drifted, and half its distance to the next one."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        moved = np.zeros(k) if before is None else _above(squared_to_own(at, before, np.arange(k)))
        order = np.argsort(moved)
        # the drift of the own centroid, and the largest of the others
        self.own = moved
        self.others = np.full(k, moved[order[-1]] if k else 0.0)
        if k:
            self.others[order[-1]] = moved[order[-2]] if k > 1 else 0.0
        apart = _below(squared(at, at))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 if k else np.zeros(0)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, squared distance, upper and lower bound of rows, from the distances to all centroids."""
        d = squared(x, self.at)
        cluster = d.argmin(axis=1)  # the first of equals
        rows = np.arange(len(x))
        nearest = d[rows, cluster]
        lower = np.full(len(x), np.inf)
        if d.shape[1] > 1:
            d[rows, cluster] = np.iinfo(np.int64).max
            lower = _below(d.min(axis=1))
        return cluster, nearest, _above(nearest), lower

    def follow(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, squared distance (if ``exact``, else unset), bounds and the number of full scans, from the bounds before the drift."""
        cluster = cluster.copy()
        upper = np.nextafter(upper + self.own[cluster], np.inf)
        lower = np.nextafter(lower - self.others[cluster], -np.inf)
        bar = np.maximum(lower, self.half[cluster])
        distance = np.zeros(len(x), dtype=np.int64)
        open_ = np.arange(len(x)) if exact else np.flatnonzero(upper >= bar)
        if len(open_):
            distance[open_] = squared_to_own(x[open_], self.at, cluster[open_])
            upper[open_] = _above(distance[open_])
            open_ = open_[upper[open_] >= bar[open_]]
        if len(open_):
            cluster[open_], distance[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return cluster, distance, upper, lower, len(open_)


class _Changes:
    """Sums of components and counts (last column) that vectors bring to clusters and take from them."""

    def __init__(self, k: int, components: int):
        self.sums = np.zeros((k, components + 1), dtype=np.int64)

    def add(self, x: np.ndarray, cluster: np.ndarray, sign: int) -> None:
        if len(x):
            order = np.argsort(cluster, kind="stable")
            found, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
            self.sums[found, :-1] += sign * np.add.reduceat(x[order], first, axis=0)
            self.sums[found, -1] += sign * n


def vectors(df: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector`` of the rows that take part, with the components as packed integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches, ROWS):
            at, x = integers(batch.column(1), components, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _packed(x)], names=["vec_id", "vector"])

    return df.select(F.col("vec_id").cast("bigint"), F.col(f"`{column}`").cast("array<double>")).mapInArrow(run, _VECTORS)


def _assign(states: DataFrame, centroids: Centroids, components: int, first: bool) -> DataFrame:
    """States after one assignment, with the rows of changes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = _Changes(len(centroids.at), components)
        for batch in hashing.slices(batches, ROWS):
            x = _unpacked(batch.column(1), components)
            if first:
                cluster, _, upper, lower = centroids.scan(x)
                changes.add(x, cluster, 1)
            else:
                was, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                cluster, _, upper, lower, _ = centroids.follow(x, was, upper, lower)
                moved = np.flatnonzero(cluster != was)
                changes.add(x[moved], was[moved], -1)
                changes.add(x[moved], cluster[moved], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.nulls(len(x), pa.binary())], names=["vec_id", "vector", "cluster", "upper", "lower", "changes"])
        if changes.sums.any():
            row = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*row, pa.array([changes.sums.tobytes()], pa.binary())], names=["vec_id", "vector", "cluster", "upper", "lower", "changes"])

    return states.mapInArrow(run, _STATES)


def _collected(states: DataFrame, k: int, components: int) -> list[list[int]]:
    """All changes of one round, as k rows of sums with the count last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, components + 1), dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py(), np.int64).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "amount"])

    out = [[0] * (components + 1) for _ in range(k)]
    amounts = states.filter("changes IS NOT NULL").select("changes").mapInArrow(run, "at int, amount bigint").groupBy("at").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    for r in amounts.collect():  # at most k * (components + 1) rows
        out[r["at"] // (components + 1)][r["at"] % (components + 1)] = int(r["amount"])
    return out


def cluster(df: DataFrame, column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Takes part what has exactly ``components`` numbers, none null or non-finite;
    other rows are left out, and so are other columns, whatever their names.
    The centroids start as the k vectors with the smallest sha256 of
    ``seed:vec_id`` (of rows that repeat an id, the smaller packed vector comes
    first; rows with a null id start none, but are clustered).  Fewer vectors
    make fewer clusters.  Repeated rows are clustered each.  An empty table has
    no rows.  Numbers from 2**31 / scale on, whose squared distances no long
    holds, raise an error.
    """
    spark = df.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    taking_part = vectors(df, column, components, scale)
    starts = taking_part.filter("vec_id IS NOT NULL").select("vector", digest.alias("digest")).orderBy("digest", "vector").limit(k).collect()  # k rows
    at = _unpacked(pa.array([bytes(r["vector"]) for r in starts], pa.binary()), components)
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    centroids, states, sums = Centroids(at), None, [[0] * (components + 1) for _ in at]
    if not len(at):
        schema = f"{_ASSIGNED}, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    for i in range(rounds):
        source = taking_part if states is None else states.filter("changes IS NULL").drop("changes")
        new = written(_assign(source, centroids, components, first=states is None), f"{folder}/{i}")
        if i:
            discard(spark, f"{folder}/{i - 1}")
        states = new
        for row, changed in zip(sums, _collected(states, len(at), components), strict=True):
            row[:] = [a + b for a, b in zip(row, changed, strict=True)]
        # Python's // is the exact floor, also below zero
        new_at = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else list(c) for row, c in zip(sums, centroids.at, strict=True)], dtype=np.int64)
        centroids = Centroids(new_at, centroids.at)

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches, ROWS):
            x = _unpacked(batch.column(1), components)
            if batch.num_columns == 2:
                found, distance, _, _ = centroids.scan(x)
            else:
                found, distance, *_ = centroids.follow(x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)), exact=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    source = taking_part if states is None else states.filter("changes IS NULL").drop("changes")
    assigned = written(source.mapInArrow(last, _ASSIGNED), f"{folder}/assigned")
    if rounds:
        discard(spark, f"{folder}/{rounds - 1}")
    inertias = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.at.tolist()]
    of_cluster = spark.createDataFrame([(c, total, sum(inertias.values()), digests[c]) for c, total in inertias.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # at most k rows
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _nearest_sql(i: int) -> str:
    """Rows of vectors with their nearest centroid of round ``i``: the least distance, then the least number."""
    apart = "list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (SELECT v.r, m.k, {apart} AS d FROM v CROSS JOIN m{i} m) GROUP BY r"


def _round_sql(i: int) -> str:
    return f"""a{i} AS ({_nearest_sql(i)}),
s{i} AS (SELECT a.best.k AS k, u.i, sum(v.x[u.i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} a JOIN v ON v.r = a.r CROSS JOIN range(1, {COMPONENTS + 1}) u(i) GROUP BY 1, 2),
f{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM s{i} GROUP BY k),
m{i + 1} AS (SELECT old.k, coalesce(f.x, old.x) AS x FROM m{i} old LEFT JOIN f{i} f ON f.k = old.k),
"""


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {COMPONENTS}),
o AS (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {CLUSTERS}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM o),
{"".join(_round_sql(i) for i in range(ROUNDS))}l AS ({_nearest_sql(ROUNDS)})
SELECT v.vec_id, l.best.k::INT AS cluster, l.best.d AS distance, (sum(l.best.d) OVER (PARTITION BY l.best.k))::BIGINT AS cluster_inertia, (sum(l.best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM l JOIN v ON v.r = l.r JOIN m{ROUNDS} m ON m.k = l.best.k"""
