"""Overlapping windows against a loop from both ends."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import overlap


def plain_starts(n, size):
    if n <= size:
        return [0]
    step = size // 2 - 1
    left, right, out = 0, n - size, []
    while True:
        out += [left, right]
        if left + size - 1 > right:
            break
        left, right = left + step, right - step
    if left + size - 1 - right + 1 < step:
        out.append(n // 2 - size // 2)
    return sorted(out)


def plain_weights(size):
    w = [1.0] * size
    edge = size // 4
    for i in range(1, edge + 1):
        w[i] = 1 / (1 + math.exp(-(i - edge / 2) / (edge / 16)))
    for i in range(size - 2 - edge, size - 1):
        w[i] = 1 / (1 + math.exp((i - (size - 2) + edge / 2) / (edge / 16)))
    return w


@pytest.mark.parametrize("size", [32, 64])
def test_positions_equal_a_loop(spark, size):
    def adapter(windows):
        return [[ord(c) + i % 7 for i, c in enumerate(w)] for w in windows]

    rng = random.Random(size)
    texts = ["".join(rng.choice("ACDEFGH") for _ in range(n)) for n in [1, size - 1, size, size + 1, 2 * size - 2, 2 * size - 1, 2 * size, 5 * size, 700, *range(3 * size - 8, 3 * size + 8)]]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "id int, s string").repartition(3)
    w = plain_weights(size)
    want = {}
    for k, t in enumerate(texts):
        total, weights = [0.0] * len(t), [0.0] * len(t)
        for a in plain_starts(len(t), size):
            for i, v in enumerate(adapter([t[a : a + size]])[0]):
                x = w[i] if len(t) > size else 1.0
                total[a + i] += x * v
                weights[a + i] += x
        want |= {(k, p): x / y for p, (x, y) in enumerate(zip(total, weights, strict=True))}
    got = {(r["id"], r["position"]): r["score"] for r in overlap.position_scores(df, "id", "s", adapter, size).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_windows_of_the_usual_size(spark):
    lengths = [1024, 1025, 2046, 2047, 2048, 2560, 3068, 3069, 4000, 10_000]
    rows = spark.createDataFrame([(n,) for n in lengths], "n int").select("n", overlap.window_starts(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == {n: plain_starts(n, 1024) for n in lengths}
    got = spark.range(1024).select(overlap.weight(F.col("id"), 1024).alias("w")).collect()
    assert [r["w"] for r in got] == pytest.approx(plain_weights(1024))


def test_wrong_adapters_are_refused(spark):
    df = spark.createDataFrame([(1, "ABC")], "id int, s string")
    for bad in (lambda ws: [[1.0]] * len(ws), lambda ws: [], lambda ws: [[1.0, float("nan"), 2.0]] * len(ws)):
        with pytest.raises(Exception, match="finite number"):
            overlap.position_scores(df, "id", "s", bad, 16).collect()
