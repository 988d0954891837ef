"""Runs from tables to reports, and what readers refuse."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import joins
from gaugeframe.plans import runs
from gaugeframe.sources import readers, sinks


def cohort(spark):
    rows = [(f"r{i}", f"g{i // 2}", i % 2, "ACGT"[i % 4] * 5) for i in range(40)]
    split = [(f"r{i}", "train" if i // 2 < 10 else "test") for i in range(40)]
    return spark.createDataFrame(rows, "id string, group string, label int, sequence string"), spark.createDataFrame(split, "id string, split string")


def test_run_writes_what_it_scores(spark, tmp_path):
    seen = []

    def adapter(batch):
        assert list(batch.columns) == ["id", "sequence"]
        return [(k, None, "odd") if k == "r39" else (k, float("ACGT".index(s[0]) % 2), None) for k, s in zip(batch["id"], batch["sequence"], strict=True)]

    def fit(train):
        seen.append({r["split"] for r in train.collect()})
        assert train.columns == ["id", "split", "target", "sequence"]
        return adapter

    got = runs.run("grouped-binary", cohort(spark), None, {"inputs": ["sequence"]}, {"capacity": 5}, fit=fit, folder=str(tmp_path / "run"))
    value = {r["metric"]: r["value"] for r in got.report.collect()}
    assert value["auroc"] == 1.0 and value["scored"] == 19 and value["denominator"] == 20 and seen == [{"train"}]
    assert spark.read.parquet(str(tmp_path / "run/predictions")).count() == 19 and spark.read.parquet(str(tmp_path / "run/unscored")).first()["reason"] == "odd"
    with pytest.raises(Exception, match="(?i)exists"):
        runs.run("grouped-binary", cohort(spark), adapter, {"inputs": ["sequence"]}, {"capacity": 5}, folder=str(tmp_path / "run"))
    smoke = runs.run("grouped-binary", cohort(spark), adapter, {"inputs": ["sequence"]}, {"capacity": 5}, limit=4)
    assert {r["scope"] for r in smoke.report.collect()} == {"smoke"} and smoke.scored.count() == 4


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown protocol"):
        runs.run("nothing", [], None)
    with pytest.raises(ValueError, match="already"):
        runs.register("pairs", None, None)
    assert "variant-assays" in runs.registered()
    with pytest.raises(Exception, match="out of its batch"):
        runs.run("grouped-binary", cohort(spark), lambda b: [("zz", 1.0, None)], {"inputs": ["sequence"]}, {"capacity": 5})


def test_regression_run_returns_the_excluded(spark):
    rows = [(i, "ACGT" * (i % 5 + 1), None if i % 10 == 0 else float(i)) for i in range(60)]
    got = runs.run("regression", [spark.createDataFrame(rows, "ordinal long, sequence string, y double")], lambda b: [(k, float(len(s)), None) for k, s in zip(b["id"], b["sequence"], strict=True)], {"target": "y", "salt": "s"})
    assert got.excluded.count() == 6 and "mae" in {r["metric"] for r in got.report.collect()}


def test_pinned_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_bytes(b"one")
    (tmp_path / "y.txt").write_bytes(b"two")
    good = {"a/x.txt": hashlib.sha256(b"one").hexdigest(), "y.txt": hashlib.sha256(b"two").hexdigest()}
    assert readers.pinned(spark, str(tmp_path), good).count() == 2
    for bad, how in (({**good, "y.txt": "0"}, "changed"), ({**good, "z": "0"}, "missing"), ({"y.txt": good["y.txt"]}, "unexpected")):
        with pytest.raises(ValueError, match=how):
            readers.pinned(spark, str(tmp_path), bad)


def test_complete_embeddings(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")

    def made(*pairs):
        return spark.createDataFrame(list(pairs), "id string, embedding array<double>")

    assert readers.complete_embeddings(rows, made(("a", [1.0]), ("b", [2.0]))).count() == 2
    for bad in ([("a", [1.0])], [("a", [1.0]), ("b", [1.0]), ("c", [1.0])], [("a", [1.0]), ("a", [1.0]), ("b", [1.0])], [("a", [1.0]), ("b", [1.0, 2.0])], [("a", [1.0]), ("b", [float("nan")])], [("a", []), ("b", [])], [("a", [1.0]), ("b", None)], [("a", [1.0]), ("b", [None])]):
        with pytest.raises(ValueError):
            readers.complete_embeddings(rows, made(*bad))


def test_one_to_one_refuses(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.one_to_one(a, b, "k").count() == 2
    for left, right in ((a.union(a), b), (a, b.limit(1)), (a, b.union(b)), (a.withColumn("k", F.lit(None).cast("int")), b)):
        with pytest.raises(ValueError):
            joins.one_to_one(left, right, "k")


def test_gene_spans(spark, tmp_path):
    def line(kind, a, b, extra, gene="G1"):
        return "\t".join(["chr1", "src", kind, str(a), str(b), ".", "+", ".", f'gene_id "{gene}"; {extra}'])

    lines = ["#head", line("gene", 1, 900, 'gene_name "N";'), line("transcript", 5, 700, 'transcript_id "T1";'), line("exon", 600, 700, 'transcript_id "T1";'), line("exon", 5, 20, 'transcript_id "T1";'), line("transcript", 1, 900, 'transcript_id "T2";'), line("gene", 50, 60, "x;", "G0"), line("transcript", 50, 60, 'transcript_id "T0";', "G0"), line("gene", 1, 2, "x;", "G9")]
    t = spark.createDataFrame([("G1", "T1", 5, 700), ("G0", "T0", 50, 60)], "gene string, transcript string, start int, stop int")
    sinks.write_gene_spans(spark.createDataFrame([(x,) for x in lines], "value string").repartition(3), t, str(tmp_path / "g"))
    got = [x for f in sorted((tmp_path / "g").glob("part-*")) for x in f.read_text().splitlines()]
    assert got == [lines[6], lines[7], lines[1].replace("\t1\t900", "\t5\t700"), lines[2], lines[4], lines[3]]
