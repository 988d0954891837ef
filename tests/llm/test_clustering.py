"""Clusters against plain rounds over all centroids in integers of Python."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from testpaths import SMALL

from gaugeframe.llm import clustering

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, vector int, `a.b` int"


def plain(rows, k=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        assigned = [nearest(v)[1] for _, v in kept]
        at = [[sum(x) // len(x) for x in zip(*members, strict=True)] if (members := [v for (_, v), a in zip(kept, assigned, strict=True) if a == j]) else c for j, c in enumerate(at)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept] if at else []
    totals = {j: sum(d for _, a, d in out if a == j) for j in range(len(at))}
    return sorted((str(i), j, d, totals[j], sum(totals.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in out)


def got(df):
    return sorted((str(r["vec_id"]), *tuple(r)[1:]) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(300)]
    assert got(clustering.cluster(make(spark, rows), k=9)) == plain(rows, 9)


def test_odd_rows(spark):
    rng = random.Random(6)
    some = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(some)] + [(3, some[3]), (3, some[4]), (None, some[5]), (40, None), (41, some[0][:63]), (42, [*some[0], 0.0]), (43, [None, *some[0][1:]]), (44, [math.nan, *some[0][1:]]), (45, [-math.inf, *some[0][1:]]), (46, []), (47, [5000.0] * 64), (48, [-300_000.25] * 64), (49, [0.0] * 64)]
    assert got(clustering.cluster(make(spark, rows))) == plain(rows)
    # equal vectors: ties go to the smaller number, clusters stay empty
    rows = [(i, [float(i % 2)] * 64) for i in range(50)]
    assert got(clustering.cluster(make(spark, rows), k=5)) == plain(rows, 5)
    # fewer vectors than clusters
    assert got(clustering.cluster(make(spark, rows[:3]))) == plain(rows[:3])
    assert got(clustering.cluster(make(spark, rows[:1]))) == plain(rows[:1])
    assert clustering.cluster(make(spark, rows).limit(0)).count() == 0
    with pytest.raises(Exception, match="so large"):
        clustering.cluster(make(spark, [(1, [1e9] * 64)])).collect()


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (12, 16))
    x = np.concatenate([c + rng.integers(-60, 60, (200, 16)) for c in centres])
    at = x[rng.choice(len(x), 12, replace=False)]
    centroids = clustering.Centroids(at)
    cluster, _, upper, lower = centroids.scan(x)
    scanned = 0
    for _ in range(8):
        new = np.array([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else at[j] for j in range(12)])
        centroids, at = clustering.Centroids(new, at), new
        cluster, distance, upper, lower, n = centroids.follow(x, cluster, upper, lower, exact=True)
        scanned += n
        d = ((x[:, None] - at[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert (upper >= np.sqrt(d.min(axis=1))).all()
        d[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(d.min(axis=1))).all()
    assert scanned < 0.5 * 8 * len(x)


def test_distances_are_exact_at_every_size():
    rng = np.random.default_rng(4)
    for most in (1 << 21, 1 << 26, (1 << 29) - 1):
        x, c = rng.integers(-most, most, (5, 4)), rng.integers(-most, most, (3, 4))
        plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert clustering.squared(x, c).tolist() == plain
        assert clustering.squared_to_own(x, c, np.array([0, 1, 2, 0, 1])).tolist() == [plain[i][j] for i, j in enumerate([0, 1, 2, 0, 1])]


def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    q = clustering.query(spark, SMALL).select(*columns.split(", "))
    assert sorted(map(tuple, q.collect())) == sorted(c.execute(f"SELECT {columns} FROM ({clustering.ORACLE_SQL})").fetchall())
