"""Operators on small hand-made tables: ties, nulls, single classes, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import scalars, sequence
from gaugeframe.operators import graph, heads, intervals, joins, metrics, ranking, records, resample, splits


def one(df):
    return df.first().asDict()


def brute_auroc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1, 5])
def test_ranking_metrics_with_ties(spark, buckets):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 1), float(rng.randint(0, 6))) for g in "ab" for _ in range(60)]
    got = {r["g"]: r for r in metrics.ranking_metrics(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", ["g"], buckets=buckets).collect()}
    for g in "ab":
        y, s = [r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g]
        assert got[g]["auroc"] == pytest.approx(brute_auroc(y, s))
        ap = np.mean([sum(a for a, b in zip(y, s) if b >= c) / sum(b >= c for b in s) for a0, c in zip(y, s) if a0])
        assert got[g]["average_precision"] == pytest.approx(ap)


def test_single_class_and_empty(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7), (None, 1.0), (1, None)], "y int, s double")
    r = one(metrics.ranking_metrics(df, "y", "s"))
    assert (r["n"], r["auroc"], r["average_precision"]) == (2, None, None)
    assert metrics.ranking_metrics(df.limit(0), "y", "s").count() == 0


def test_spearman_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (9.0, 4.0)], "a double, b double")
    ra, rb = np.array([1, 2, 3, 4]), np.array([1.5, 1.5, 4, 3])
    assert one(metrics.spearman(df, "a", "b"))["spearman"] == pytest.approx(np.corrcoef(ra, rb)[0, 1])
    assert one(metrics.spearman(df.withColumn("b", F.lit(1.0)), "a", "b"))["spearman"] is None


def test_signed_rank_exact(spark):
    d = [1.0, -2.0, 3.0, 4.0, -5.0, 6.0, 7.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(d)], "i int, d double")
    t = metrics.wilcoxon_terms(df).withColumn("p", metrics.signed_rank_p(F.col("statistic"), F.col("n"), F.col("mean"), F.col("variance")))
    n, w = 7, sum(i + 1 for i, x in enumerate(d) if x > 0)
    ways = sum(sum(k + 1 for k in range(n) if m >> k & 1) >= w for m in range(2**n))
    assert one(t)["p"] == pytest.approx(ways / 2**n)


def test_nested_mean_rounds_half_even(spark):
    df = spark.createDataFrame([("a", 0.0005), ("b", 0.0015), ("b", None)], "g string, v double")
    assert one(metrics.nested_mean(df, "v", [["g"], []]))["v"] == pytest.approx(0.001)


def test_coverage_and_reasons(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id int")
    p = spark.createDataFrame([(0, 1.0, None), (1, None, "too_long"), (2, None, None)], "id int, score double, reason string")
    s = joins.scored_rows(rows, p, "id")
    assert one(joins.coverage(s)) == {"denominator": 5, "scored": 1, "unscored": 4}
    assert {r["reason"]: r["n"] for r in joins.reasons(s).collect()} == {"too_long": 1, "no_reason": 1, "missing_prediction": 2}
    with pytest.raises(ValueError, match="negative"):
        joins.check(rows, {"negative": F.col("id") > 3}, "id")


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(None, 3), (100, 101), (101, 102), (102, 100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}


def test_missing_keys_never_link(spark):
    df = spark.createDataFrame([("1", "p", "x"), ("2", "p", "NA"), ("3", None, "NA"), ("4", "q", "y"), ("5", "", "y")], "id string, patient string, gene string")
    got = {r["id"]: r["component"] for r in graph.key_groups(df, "id", ["patient", "gene"]).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "4", "5": "4"}
    names = {r["component"]: r["group"] for r in graph.numbered(graph.key_groups(df, "id", ["patient", "gene"]), "component").collect()}
    assert names == {"1": "g0001", "3": "g0002", "4": "g0003"}


def test_closure_and_chains(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r["root"], r["node"]): r["depth"] for r in graph.closure(e, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("a", "d"): 3}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, next string")
    assert {r["id"]: r["resolved"] for r in graph.resolve_chain(links).collect()} == {"a": "c", "b": "c", "c": "c", "x": "x", "y": "x", "z": "gone"}


def test_interval_join_equals_nested_loop(spark):
    rng = random.Random(9)
    points = [(i, rng.randint(0, 500)) for i in range(80)]
    spans = [(i, s := rng.randint(0, 480), s + rng.choice([0, 3, 60, 300])) for i in range(40)] + [(99, 10, 5)]
    got = intervals.point_in_interval(spark.createDataFrame(points, "p int, x int"), spark.createDataFrame(spans, "i int, a int, b int"), "x", "a", "b", width=50)
    assert sorted((r["p"], r["i"]) for r in got.collect()) == sorted((p, i) for p, x in points for i, a, b in spans if a <= x <= b)


def test_bootstrap_refuses_single_class_draws(spark):
    rows = spark.createDataFrame([(i % 2, i % 2, float(i), float(-i)) for i in range(10)], "g int, y int, a double, b double")
    r = one(resample.paired_bootstrap(rows, "g", "y", "a", "b", 40))
    assert r["refused"] and r["low"] is None and r["used"] + r["skipped"] == 40


def test_holdout_has_no_leak(spark):
    rows = spark.createDataFrame([(i, i % 7, int(i % 3 == 0)) for i in range(70)], "id int, g int, y int")
    s = splits.holdout_groups(rows, "g", "y", 0.3, 10)
    assert s.count() == 7 and {r["split"] for r in s.collect()} == {"train", "test"}
    assert splits.leaks(rows.join(s, "g"), "g").count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN", "A1C:G3T"), ("AC", "A1A"), ("", "bad")], "s string, m string")
    x = sequence.substitutions(F.col("m"))
    r = df.select(sequence.reverse_complement(F.col("s")).alias("rc"), sequence.windows(F.col("s"), 3).alias("w"), sequence.substitutions_fit(x, F.col("s")).alias("fit"), F.when(sequence.substitutions_fit(x, F.col("s")), sequence.substituted(x, F.col("s"))).alias("mut"), sequence.valid_windows(F.col("s"), "ACGT", 2).alias("vw")).collect()
    assert [x["rc"] for x in r] == ["NACGT", "GT", ""]
    assert [x["w"] for x in r] == [["ACG", "CGT", "GTN"], [], []]
    assert [x["fit"] for x in r] == [True, False, False]
    assert r[0]["mut"] == "CCTTN" and [x["vw"] for x in r] == [3, 1, 0]


def test_scalars(spark):
    df = spark.createDataFrame([("NA",), ("1.5",), ("inf",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(scalars.parse_number(F.col("c"))).collect()] == [None, 1.5, None, None, None]
    import hashlib

    h = int.from_bytes(hashlib.sha256(b"7:42").digest()[:8], "big") / 2**64
    assert spark.range(1).select(scalars.unit_hash("7", F.lit("42"))).first()[0] == h


def test_ridge_and_leave_one_out(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(60, 4)), np.array([1.0, -2.0, 0.5, 0.0])
    y = x @ w + 3 + 0.1 * rng.normal(size=60)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)
    got, b = heads.ridge(heads.moments(df, "x", "y"), 2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(4), xc.T @ yc)
    assert np.allclose(got, want) and b == pytest.approx(y.mean() - x.mean(0) @ want)
    loo = {r["alpha"]: r["mse"] for r in heads.ridge_leave_one_out(df, "x", "y", [0.1, 5.0])}
    errors = []
    for i in range(60):
        k = np.arange(60) != i
        xi, yi = x[k] - x[k].mean(0), y[k] - y[k].mean()
        wi = np.linalg.solve(xi.T @ xi + 5 * np.eye(4), xi.T @ yi)
        errors.append((y[i] - y[k].mean() - (x[i] - x[k].mean(0)) @ wi) ** 2)
    assert loo[5.0] == pytest.approx(np.mean(errors), rel=1e-6)


def test_records(spark):
    r = spark.createDataFrame([("a", [("of", "b"), ("of", "c")]), ("b", [("of", "c")])], "id string, links array<struct<relation:string,target_id:string>>")
    m = {x["dst"]: (x["n"], x["sources"]) for x in records.members(records.edges(r), "of").collect()}
    assert m == {"b": (1, ["a"]), "c": (2, ["a", "b"])}
    assert ranking.stratified_hash_sample(spark.range(20).withColumn("s", F.col("id") % 2), "s", "id", 3, "0").count() == 6
