from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from testpaths import SMALL
from pyspark.sql import functions as F

from gaugeframe.llm import neighbours as N


def brute(ids, x, k=10):
    out = {}
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        out[int(i)] = [int(j) for j in ids[np.lexsort((ids, d))] if j != i][:k]
    return out


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_recall_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = d["vec_id"].to_numpy(), np.stack(d["embedding"]).astype(float)
    want, got = brute(ids, x), rows(N.query(spark, "/root/testdata/sf0.1"))
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    for q, rs in got.items():
        assert [r["rank"] for r in rs] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in rs] == sorted((r["score"], r["vec_id"]) for r in rs)
        assert rs[0]["score"] == float(np.sqrt(((x[ids == q][0] - x[ids == rs[0]["vec_id"]][0]) ** 2).sum()))


def test_probes_retrieve_every_code_within_the_guaranteed_distance():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 20)), rng.normal(size=(1, 20)) + rng.normal(size=(200, 20)) * 0.02])
    m = N.fit(x, 5, len(x))
    m = N.CodeModel(m.mean, np.concatenate([m.rotations] * 9, axis=1)[:, : 6 * 9], 6, 9, 1, 30)
    keys, codes, near = m.keys(x), m.codes(x), m.near_values()
    assert sorted(near) == sorted({0} | {1 << i for i in range(6)})
    bits = m.bits_of(x)
    some = 0
    for q in range(0, 700, 35):
        far = (bits != bits[q]).sum(1)
        assert (far == N.hamming(codes, codes[q])).all()
        found = {int(i) for j in range(m.count) for i in np.flatnonzero(np.isin(keys[:, j], keys[q, j] ^ near))}
        within = set(np.flatnonzero(far <= m.guaranteed))
        some += len(within)
        assert found >= within
    assert some > 100 and len({k >> m.width for k in keys.ravel().tolist()}) == m.count


def test_index_selects_on_clustered_vectors(spark):
    """High recall from a small share of the vectors; a query far from all others is compared with every vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(120, 32)) * 3
    x = (centres[rng.integers(0, 120, 6000)] + rng.normal(size=(6000, 32)) * 0.3).astype(np.float32).astype(float)
    x[300] = -50.0
    x[1000:1400] = x[1000]  # more equal vectors than a query returns
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").cache()
    m = N.fit(x[rng.permutation(6000)[:4096]], 10, 6000)
    assert m.probed < 0.1 and m.ranked <= m.probed
    ids = np.arange(6000)
    want, got = brute(ids, x), rows(N.nearest_neighbours(df, F.col("vec_id") % 100 == 0))
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q in (300, 1000, 1100):
        assert [r["vec_id"] for r in got[q]] == want[q]


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (8, [1.0]), (200, None), (300, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id bigint, embedding array<float>, vb int, query int")
    for blocks in ({}, {"block_queries": 1}):
        got = {q: [(r["vec_id"], r["score"]) for r in rs] for q, rs in rows(N.nearest_neighbours(df, F.col("vec_id") % 100 == 0, **blocks)).items()}
        assert got == {0: [(1, 0.0), (2, 0.0), (100, 2**0.5)], 100: [(0, 2**0.5), (1, 2**0.5), (2, 2**0.5)]}
    assert N.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert N.nearest_neighbours(df.filter("vec_id = 4"), F.col("vec_id") % 4 == 0).count() == 0


def test_blocks_do_not_change_the_result(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    a = rows(N.nearest_neighbours(e, F.col("vec_id") % 10 == 0))
    assert a == rows(N.nearest_neighbours(e, F.col("vec_id") % 10 == 0, block_queries=3))


def test_rows_of_one_id_that_differ(spark):
    """One of its vectors stands for the id, the same in any order of the rows."""
    data = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (3, [0.5, 0.6])]
    got = [rows(N.nearest_neighbours(spark.createDataFrame(d, "vec_id bigint, embedding array<double>").repartition(n), F.col("vec_id") == 0)) for d, n in ((data, 1), (data[::-1], 3))]
    assert got[0] == got[1] and [r["vec_id"] for r in got[0][0]] in ([1, 3, 2], [2, 3, 1])


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_grow_no_faster_than_the_vectors(spark):
    """Probes and hits are no rows: on vectors without clusters, four times the vectors make some four times the rows."""
    rng = np.random.default_rng(5)
    made = []
    for n in (1500, 6000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 24)))], "vec_id bigint, embedding array<double>")
        before = shuffled_rows(spark)
        assert N.nearest_neighbours(df, F.col("vec_id") % 100 == 0).count() == n // 100 * 10
        made.append(shuffled_rows(spark) - before)
    assert made[0] < 20 * 1500 and made[1] < 5 * made[0]


def test_pieces_and_batches_do_not_change_what_a_shard_finds(monkeypatch):
    """The rows of a shard are those of a plain search in its keys and codes, the best of each query in one set."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    ids, rep = np.arange(0, 700, 35), np.arange(700)
    m = N.fit(x, 5, len(x))
    keys, near, codes = m.keys(x), m.near_values(), m.codes(x)
    want = []
    for q in ids:
        met = np.zeros(700, bool)
        for j in range(m.count):
            met |= np.isin(keys[:, j], keys[q, j] ^ near)
        v = np.flatnonzero(met & (N.hamming(codes, codes[q]) <= m.radius))
        d = np.sqrt(((x[v] - x[q]) ** 2).sum(1))
        want += [(int(q), int(v[i]), float(d[i])) for i in np.lexsort((v, d))[:6]]
    shared, block = SimpleNamespace(value=m), SimpleNamespace(value=(ids, x[ids]))
    for piece, pairs, batch in ((1 << 17, 1 << 21, 700), (64, 1 << 21, 100), (50, 300, 7), (700, 1, 699)):
        monkeypatch.setattr(N, "PIECE", piece)
        monkeypatch.setattr(N, "BLOCK_PAIRS", pairs)
        parts = [pa.RecordBatch.from_arrays([pa.array(rep[a : a + batch]), pa.array(x[a : a + batch].tolist())], names=["rep", "embedding"]) for a in range(0, 700, batch)]
        out = [r for b in N._probed(shared, block, 5)(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(out) == sorted(want)
        every = [r for b in N._score_all(block, [35, 70], 5)(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(every) == sorted((int(q), int(v), float(d[v])) for q in (35, 70) for d in [np.sqrt(((x - x[q]) ** 2).sum(1))] for v in np.lexsort((rep, d))[:6])
    assert [b.num_rows for b in N._probed(shared, block, 5)(iter([]))] == [0]
