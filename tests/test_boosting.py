"""Boosted trees against a booster that looks at all rows for every split."""

import numpy as np
import pytest

from gaugeframe.operators import boosting as B


def plain(x, y, trees, rate, leaves, l2, least):
    """Scores, and the splits of every tree, by growing one split at a time over all rows."""
    unit = 2**30
    raw = np.full(len(y), np.log(y.sum() / (len(y) - y.sum())))
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.rint((p - y) * unit).astype(int), np.rint(p * (1 - p) * unit).astype(int)

        def best(rows):
            out = None
            total = g[rows].sum() / unit, h[rows].sum() / unit
            for f in range(x.shape[1]):
                v = x[rows, f]
                for missing_left in (False, True):
                    if missing_left and not np.isnan(v).any():
                        continue
                    for cut in np.unique(v[~np.isnan(v)]):
                        left = np.where(np.isnan(v), missing_left, v <= cut)
                        if min(left.sum(), (~left).sum()) < least:
                            continue
                        a, b = (g[rows[left]].sum() / unit, h[rows[left]].sum() / unit), (g[rows[~left]].sum() / unit, h[rows[~left]].sum() / unit)
                        gain = a[0] ** 2 / (a[1] + l2) + b[0] ** 2 / (b[1] + l2) - total[0] ** 2 / (total[1] + l2)
                        if min(a[1], b[1]) >= 1e-3 and gain > 0 and (out is None or gain > out[0]):
                            out = (gain, f, cut, rows[left], rows[~left])
            return out

        ends, splits = [np.arange(len(y))], []
        open_ = [best(ends[0])]
        while len(ends) < leaves and any(open_):
            i = max((i for i in range(len(open_)) if open_[i]), key=lambda i: open_[i][0])
            _, f, cut, a, b = open_[i]
            splits.append((f, float(cut), len(a), len(b)))
            ends[i : i + 1], open_[i : i + 1] = [a, b], [best(a), best(b)]
        for rows in ends:
            raw[rows] += -rate * (g[rows].sum() / unit) / (h[rows].sum() / unit + l2)
        grown.append(sorted(splits))
    return 1 / (1 + np.exp(-raw)), grown


def splits_of(tree, model, x):
    at = {0: np.arange(len(x))}
    bins, out = model.bins(x), []
    for n in range(len(tree.feature)):
        if tree.feature[n] < 0 or n not in at:
            continue
        b = bins[at[n], tree.feature[n]]
        left = np.where(b == B.MISSING, tree.missing_left[n], b <= tree.bin[n])
        at[tree.left[n]], at[tree.right[n]] = at[n][left], at[n][~left]
        v = x[at[n], tree.feature[n]]
        cut = np.nanmax(v[(b != B.MISSING) & (b <= tree.bin[n])])
        out.append((int(tree.feature[n]), float(cut), int(left.sum()), int((~left).sum())))
    return sorted(out)


def data(seed, n, missing=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.5 > 0.3).astype(float)
    if missing:
        x[rng.random(n) < 0.2, 1] = np.nan
        x[(y == 1) & (rng.random(n) < 0.5), 3] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").repartition(3)


@pytest.mark.parametrize("leaves,trees", [(2, 2), (6, 3)])
def test_trees_equal_the_plain_booster(spark, leaves, trees):
    x, y = data(leaves, 300)
    df = frame(spark, x, y)
    model = B.fit(df, "x", "y", trees=trees, rate=0.3, leaves=leaves, least=10)
    scores, grown = plain(x, y, trees, 0.3, leaves, 1.0, 10)
    assert [splits_of(t, model, x) for t in model.trees] == grown
    got = {r["id"]: r["score"] for r in B.predict(df, model, "x").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(scores.tolist())


def test_scores_are_written_again_between_trees(spark, monkeypatch):
    x, y = data(5, 200, missing=False)
    df = frame(spark, x, y)
    one = B.fit(df, "x", "y", trees=3, rate=0.5, leaves=3, least=10)
    monkeypatch.setattr(B, "REFRESH", 2)
    two = B.fit(df.repartition(5), "x", "y", trees=3, rate=0.5, leaves=3, least=10)
    assert all(np.array_equal(getattr(a, f), getattr(b, f)) for a, b in zip(one.trees, two.trees, strict=True) for f in ("feature", "bin", "left", "right", "value"))


def test_held_out_accuracy_and_stopping(spark):
    x, y = data(8, 1500)
    df = frame(spark, x, y)
    model = B.fit(df.filter("id < 1000"), "x", "y", trees=12, rate=0.3, leaves=8, stop_after=2)
    rows = B.predict(df.filter("id >= 1000"), model, "x").collect()
    assert np.mean([(r["score"] > 0.5) == (r["y"] == 1) for r in rows]) > 0.78
    rng = np.random.default_rng(1)
    noise = B.fit(frame(spark, np.round(rng.normal(size=(400, 2)), 1), (rng.random(400) < 0.5).astype(float)), "x", "y", trees=12, rate=1.0, leaves=8, stop_after=1)
    assert len(noise.trees) < 12


def test_limits_and_odd_rows(spark):
    wide = spark.createDataFrame([([float(i), float(i % 3), None, 1.0],) for i in range(2000)], "x array<double>")
    limits = B.bin_limits(wide, "x", 255)
    assert len(limits[0]) == 254 and limits[1].tolist() == [0.5, 1.5] and len(limits[2]) == 0 and len(limits[3]) == 0
    rows = [([1.0, None], 1.0), ([2.0, float("nan")], 0.0), (None, 1.0), ([1.0, 1.0], None)]
    df = spark.createDataFrame(rows * 3, "x array<double>, y double")
    model = B.fit(df, "x", "y", trees=2, leaves=2, least=1)
    scored = B.predict(df, model, "x")
    assert [r["score"] is None for r in scored.collect()] == [False, False, True, False] * 3
    same = B.fit(spark.createDataFrame([([1.0], 0.0), ([1.0], 1.0)] * 30, "x array<double>, y double"), "x", "y")
    assert len(same.trees) == 1 and B.predict(spark.createDataFrame([([5.0],)], "x array<double>"), same, "x").first()["score"] == pytest.approx(0.5)
    for bad in ([([1.0], 1.0)], [([1.0], 2.0), ([1.0], 0.0)], []):
        with pytest.raises(ValueError):
            B.fit(spark.createDataFrame(bad, "x array<double>, y double"), "x", "y")
