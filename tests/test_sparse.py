"""Heads with table coefficients against dense fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import heads, sparse


def data(seed, n=60, d=20, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.random((n, d)) * (rng.random((n, d)) < 0.3)
    x[5] = 0
    w = rng.normal(size=(d, classes)) * 3
    return x, (x @ w + rng.normal(size=(n, classes))).argmax(axis=1).astype(float)


def tables(spark, x, y):
    entries = [(int(i), f"k{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(entries, "row long, key string, x double").repartition(3), spark.createDataFrame(list(enumerate(y.tolist())), "row long, y double")


def dense(x, y, classes, penalty):
    """Newton steps on the whole objective."""
    n, d = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    k = classes if classes > 2 else 1
    w = np.zeros((d + 1, k))
    ridge = np.diag([penalty] * d + [1e-10])
    for _ in range(60):
        m = z @ w
        if k == 1:
            p = 1 / (1 + np.exp(-m))
            g, h = z.T @ (p - y[:, None]) + ridge @ w, z.T @ (z * (p * (1 - p))) + ridge
            w = w - np.linalg.solve(h, g)
        else:
            e = np.exp(m - m.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            g = (z.T @ (p - np.eye(k)[y.astype(int)]) + ridge @ w).T.ravel()
            h = np.block([[z.T @ (z * (p[:, [a]] * ((a == c) - p[:, [c]]))) + (a == c) * ridge for c in range(k)] for a in range(k)])
            w = w - np.linalg.lstsq(h, g, rcond=None)[0].reshape(k, -1).T
    return z @ w


@pytest.mark.parametrize("classes,bound", [(2, 500_000), (3, 0)])
def test_classes_equal_a_dense_fit(spark, monkeypatch, classes, bound):
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", bound)
    x, y = data(classes, classes=classes)
    entries, targets = tables(spark, x, y)
    model = sparse.fit(entries, targets, penalty=2.0, iterations=40, tolerance=1e-3)
    margins = dense(x, y, classes, 2.0)
    got = {r["row"]: r["score"] for r in sparse.scores(entries, targets.union(spark.createDataFrame([(99, 0.0)], "row long, y double")), model).collect()}
    if classes == 2:
        assert [got[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-margins[:, 0]))).tolist(), abs=5e-3)
        assert got[99] == pytest.approx(1 / (1 + np.exp(-model.intercepts[0])))
    else:
        sure = [i for i in range(len(y)) if np.diff(np.sort(margins[i])[-2:])[0] > 0.05]
        assert [got[i] for i in sure] == [float(margins[i].argmax()) for i in sure] and len(sure) > 45


def test_values_equal_ridge(spark):
    x, _ = data(9)
    y = x @ np.arange(20) / 10 + 2
    entries, targets = tables(spark, x, y)
    model = sparse.fit(entries, targets, "value", penalty=1.0, tolerance=1e-5)
    c = x - x.mean(axis=0)
    w = np.linalg.solve(c.T @ c + np.eye(20), c.T @ (y - y.mean()))
    got = {r["row"]: r["score"] for r in sparse.scores(entries, targets, model).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx((c @ w + y.mean()).tolist(), abs=5e-3)


def test_refusals(spark):
    e, t = tables(spark, np.eye(3), np.zeros(3))
    with pytest.raises(ValueError):
        sparse.fit(e, t)
    with pytest.raises(ValueError):
        sparse.fit(e, t.limit(0), "value")


def test_ngram_head_beyond_its_driver_bound(spark):
    words = {0: "ACGTACGGT", 1: "TTTTGATTA", 2: "CCCGCCGCC"}
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list(words[i % 3])) for _ in range(8)), i % 3, float(i % 3)) for i in range(36)]
    df = spark.createDataFrame(rows, "id long, s string, y int, v double")
    train, test = df.filter("id < 27"), df.filter("id >= 27")

    def got(target, bound, **kwargs):
        made = [d.withColumn("y", target) for d in (train, test)]
        return {r["id"]: r["score"] for r in heads.ngram_head(*made, "s", "y", driver_bound=bound, **kwargs).collect()}

    # a ridge by hand: Spark's own penalty depends on the unit of the labels
    grams = [[s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1)] for _, s, _, _ in rows]
    names = sorted({g for x in grams[:27] for g in x})
    x = np.array([[t.count(g) for g in names] for t in grams], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r[3] for r in rows])
    c = x[:27] - x[:27].mean(axis=0)
    w = np.linalg.solve(c.T @ c + np.eye(len(names)), c.T @ (y[:27] - y[:27].mean()))
    want = ((x[27:] - x[:27].mean(axis=0)) @ w + y[:27].mean()).tolist()
    for bound in (1 << 18, 0):
        found = got(F.col("v"), bound, classes=False)
        assert [found[i] for i in range(27, 36)] == pytest.approx(want, abs=1e-3)
    two = [got(F.when(F.col("y") == 1, 1).otherwise(0), bound) for bound in (1 << 18, 0)]
    assert [two[1][i] for i in range(27, 36)] == pytest.approx([two[0][i] for i in range(27, 36)], abs=2e-3)
    many = got(F.col("y"), 1 << 18)
    assert np.mean([many[i] == i % 3 for i in many]) > 0.7
