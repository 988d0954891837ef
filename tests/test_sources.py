"""Readers, writers, protocols and streams on files made here."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import joins
from gaugeframe.plans import protocols
from gaugeframe.sources import readers, sinks
from gaugeframe.streaming import events


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sequence,set,validation,target\nACD,train,False,1.5\n")
    assert readers.read_table(spark, str(tmp_path / "a.csv"), ["target", "sequence", "set", "validation"]).first()["target"] == "1.5"
    with pytest.raises(ValueError, match="unexpected"):
        readers.read_table(spark, str(tmp_path / "a.csv"), ["sequence"])
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("x\n1\n")
    assert readers.read_table(spark, str(tmp_path / "b.csv.gz"), ["x"]).count() == 1


def test_predictions(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("id\tscore\na\t0.5\nb\tNA\nc\t\n")
    assert {r["id"]: (r["score"], r["reason"]) for r in readers.read_predictions(spark, str(p)).collect()} == {"a": (0.5, None), "b": (None, "unscored_in_file"), "c": (None, "unscored_in_file")}
    p.write_text("id\tscore\na\t0.5\na\tinf\n")
    with pytest.raises(ValueError):
        readers.read_predictions(spark, str(p))


def test_folders_gtf_fasta_meme_npz(spark, tmp_path):
    for s in ("train", "test"):
        for c in ("neg", "pos"):
            (tmp_path / "g" / s / c).mkdir(parents=True)
            (tmp_path / "g" / s / c / "1.txt").write_text("ACGT\n")
    f = readers.read_sequence_folders(spark, str(tmp_path / "g"))
    assert sorted((r["split"], r["class"], r["sequence"]) for r in f.collect())[0] == ("test", "neg", "ACGT")
    prepared = protocols.prepare_sequence_classes(f, "salt")
    scored = prepared.scored(prepared.rows.filter("split = 'test'").select("id", F.col("target").alias("score")))
    assert protocols.score_sequence_classes(scored, 2).first()["accuracy"] == 1.0

    a = 'gene_id "g1"; transcript_id "t1"; tag "basic"; tag "canon";'
    lines = ["#c", f"1\ts\ttranscript\t5\t90\t.\t+\t.\t{a}", f"1\ts\texon\t60\t90\t.\t+\t.\t{a}", f"1\ts\texon\t5\t20\t.\t+\t.\t{a}", "broken"]
    g = readers.parse_gtf(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert g.filter("NOT well_formed").count() == 1
    t = readers.canonical_transcripts(g, "canon").first()
    assert (t["start"], t["stop"], [tuple(e) for e in t["exons"]]) == (5, 90, [(5, 20), (60, 90)])

    fasta = [">c1 x", "ACGTACGTAC", "GGGGCCCC", ">c2", "TTTT"]
    blocks = readers.parse_fasta(spark.createDataFrame(list(enumerate(fasta)), "ordinal int, value string"), block=10)
    w = spark.createDataFrame([(1, "c1", 9, 12), (2, "c2", 1, 4), (3, "c1", 1, 18)], "id int, contig string, start int, stop int")
    assert {r["id"]: r["bases"] for r in readers.fetch(blocks, w).collect()} == {1: "ACGG", 2: "TTTT", 3: "ACGTACGTACGGGGCCCC"}

    (tmp_path / "m.meme").write_text("MEME\nMOTIF A1 x\nletter-probability matrix: alength= 4 w= 7\n0\nMOTIF B\nmatrix: w= 12\n")
    assert [tuple(r) for r in readers.read_meme(spark, str(tmp_path / "m.meme")).collect()] == [("A1", 7), ("B", 12)]
    np.savez(tmp_path / "e.npz", ids=np.array(["a", "b"]), embeddings=np.eye(2))
    assert {r["id"]: r["embedding"] for r in readers.read_npz(spark, str(tmp_path / "e.npz")).collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}


def test_one_hot_and_ordinal(spark):
    m = np.zeros((3, 4), np.uint8)
    m[0, 1] = m[2, 3] = 1
    df = spark.createDataFrame([(bytearray(m.tobytes()),)], "b binary")
    assert readers.decode_one_hot(df, "b", 3).first()["sequence"] == "CNT"
    o = readers.with_ordinal(spark.createDataFrame([(3, "x"), (1, "y"), (3, "a")], "k int, v string"), "k", "v")
    assert sorted((r["ordinal"], r["v"]) for r in o.collect()) == [(0, "y"), (1, "a"), (2, "x")]


def test_sinks_never_replace(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.12345, None), ("b", None, "why")], "id string, score double, reason string")
    sinks.write_run(str(tmp_path / "run"), spark.createDataFrame([("x", "full", 1.0)], "metric string, scope string, value double"), df)
    with pytest.raises(Exception, match="exist"):
        sinks.write_new(df, str(tmp_path / "run/unscored"))
    sinks.write_predictions(df, str(tmp_path / "tsv"))
    assert readers.read_predictions(spark, str(tmp_path / "tsv")).filter("id = 'a'").first()["score"] == 0.1235
    with pytest.raises(ValueError):
        sinks.export(spark.createDataFrame([("smoke",)], "scope string"), str(tmp_path / "no"))
    assert readers.digests(spark, str(tmp_path / "run")).count() >= 3


def test_fitness_split_and_pairs(spark):
    rows = [("ACD", "1.0", "train", "False"), ("ACE", "2.0", "train", "True"), ("ACF", "3.0", "test", "False"), ("ACG", "1.5", "test", "False"), ("ACH", "0.5", "test", "False")]
    p = protocols.prepare_fitness_split(spark.createDataFrame(rows, "sequence string, target string, set string, validation string"), "s")
    assert p.inputs.columns == ["id", "sequence"]
    test = p.rows.filter("split = 'test'")
    r = protocols.score_fitness_split(p.scored(test.select("id", F.col("target").alias("score")))).first()
    assert (r["spearman"], r["ndcg"], r["denominator"]) == (pytest.approx(1.0), pytest.approx(1.0), 3)
    with pytest.raises(ValueError, match="unknown"):
        p.scored(spark.createDataFrame([("nobody", 1.0)], "id string, score double"))
    with pytest.raises(ValueError, match="split"):
        protocols.prepare_fitness_split(spark.createDataFrame([("ACD", "1.0", "test", "True")], "sequence string, target string, set string, validation string"), "s")

    pairs = protocols.prepare_pairs(spark.createDataFrame([(i, "ACGT", "TTTT") for i in range(6)], "source_index int, sequence string, control string"), "s")
    scores = pairs.rows.select("id", F.when((F.col("pair_role") == "element") & (F.col("source_index") > 0), F.col("source_index") + 1.0).otherwise(1.0).alias("score"))
    s = protocols.score_pairs(pairs.scored(scores)).first()
    assert (s["n"], s["tied"], s["sign_accuracy"], s["pairs"]) == (6, 1, pytest.approx(5 / 6), 6)


def test_variant_assays(spark):
    ref = spark.createDataFrame([("A", "ACDEF", "P1", "activity"), ("B", "ACDEF", "P2", "binding")], "assay_id string, wild_type_sequence string, group string, selection_type string")
    residues = "GHIKLMNPQRSTVW"
    rows = [(a, f"A1{r}", f"{r}CDEF", str(i / 10), str(int(i > 6))) for a in "AB" for i, r in enumerate(residues)]
    t = spark.createDataFrame(rows, "assay_id string, mutant string, mutated_sequence string, DMS_score string, DMS_score_bin string")
    p = protocols.prepare_variant_assays(t, ref)
    per, mean = protocols.score_variant_assays(p.scored(p.rows.filter("assay_id = 'A' OR target > 0").select("id", F.col("target").alias("score"))))
    assert [r["assay_id"] for r in per.collect()] == ["A"]
    assert {r["metric"]: r["value"] for r in mean.collect()}["spearman"] == 1.0
    with pytest.raises(ValueError, match="mutant"):
        protocols.prepare_variant_assays(spark.createDataFrame([("A", "C1G", "x", "1", "0")], t.schema), ref)


def test_stream_equals_table(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    s = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), src.schema))
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.windowed_counts(src)
    assert joins.multiset_differences(spark.table("w").select("start", "event_type", "n"), want.select("start", "event_type", "n")).first() == (0, 0)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ids = events.read_events(spark, str(tmp_path / "in"), src.schema).select("event_id", "value")
    events.append_once(ids, out, ck, "event_id").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(out).count() == src.select("event_id").distinct().count()


def test_new_readers(spark, tmp_path):
    """Gzip told by its bytes, JSON predictions, long files of sequences, and the two exact text sinks."""
    import gzip
    import json

    import pytest

    from gaugeframe.functions import detectors

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dat").write_bytes(gzip.compress(b"one\r\ntwo\n"))
    (tmp_path / "in" / "b.dat").write_bytes(b"three\n\nfour")
    got = {(r["path"][-5:], r["line"], r["value"]) for r in readers.read_lines(spark, str(tmp_path / "in")).collect()}
    assert got == {("a.dat", 0, "one"), ("a.dat", 1, "two"), ("b.dat", 0, "three"), ("b.dat", 1, ""), ("b.dat", 2, "four")}

    p = tmp_path / "p.json"
    p.write_text(json.dumps({"a": 0.5, "b": {"score": 2}, "c": {"reason": "no model"}}))
    assert {r["id"]: (r["score"], r["reason"]) for r in readers.read_prediction_document(spark, str(p)).collect()} == {"a": (0.5, None), "b": (2.0, None), "c": (None, "no model")}
    for bad in ('{"a": 1, "a": 2}', '{"a": {"score": 1, "score": 2}}', '{"a": null}', '{"a": "x"}', "[1]"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            readers.read_prediction_document(spark, str(p)).collect()

    import random

    rng = random.Random(2)
    whole = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 400))) for i in range(9)}
    lines = []
    for name, seq in whole.items():
        lines += [f">{name} x"] + [seq[i : i + 17] for i in range(0, len(seq), 17)]
    blocks = readers.parse_fasta(spark.createDataFrame(list(enumerate(lines)), "ordinal bigint, value string").repartition(3), block=50, stretch=7)
    asked = []
    for k in range(60):
        name = rng.choice(list(whole))
        a = rng.randint(1, len(whole[name]))
        asked.append((k, name, a, rng.randint(a, len(whole[name]))))
    found = {r["id"]: r["bases"] for r in readers.fetch(blocks, spark.createDataFrame(asked, "id int, contig string, start int, stop int")).collect()}
    assert found == {k: whole[c][a - 1 : b] for k, c, a, b in asked}

    t = spark.createDataFrame([("g1", "1", "+", 11, 40, [(11, 20), (31, 40)])], "gene string, contig string, strand string, start int, stop int, exons array<struct<start:int,stop:int>>")
    sinks.write_annotation(t.coalesce(1), str(tmp_path / "ann"))
    text = "".join(f.read_text() for f in (tmp_path / "ann").glob("part-*"))
    assert text == "#NAME\tCHROM\tSTRAND\tTX_START\tTX_END\tEXON_START\tEXON_END\ng1\t1\t+\t10\t40\t10,30,\t20,40,\n"
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "ann")).select(detectors.spans_of(F.col("EXON_START"), F.col("EXON_END"), 1).alias("x")).first()["x"]
    assert [tuple(x) for x in back] == [(11, 20), (31, 40)]
    sinks.write_cohort(spark.createDataFrame([(1, "a"), (2, None)], "i int, s string").coalesce(1), str(tmp_path / "cohort"), ["i", "s"])
    assert b"".join(f.read_bytes() for f in (tmp_path / "cohort").glob("part-*")) == b"1\ta\r\n2\t\r\n"
    with pytest.raises(ValueError):
        sinks.write_cohort(spark.createDataFrame([("a\tb",)], "s string"), str(tmp_path / "bad"), ["s"])
    with pytest.raises(ValueError):
        sinks.write_run(str(tmp_path / "run"), t, spark.createDataFrame([("a", float("nan"), None)], "id string, score double, reason string"))
    assert not (tmp_path / "run").exists()


def test_files_named_by_a_table(spark, tmp_path):
    """One table from the files of a reference; a name that leaves the folder is refused, and JSON lines are filtered before they are parsed."""
    import pytest
    from pyspark.sql.types import StringType, StructField, StructType

    for n, rows in (("x.csv", "m,v\nA1C,0.5\n"), ("y.csv", "m,v\nA2C,1\nA3C,2\n")):
        (tmp_path / n).write_text(rows)
    ref = spark.createDataFrame([("ax", "x.csv"), ("ay", "y.csv")], "assay string, file string")
    got = readers.read_many(spark, str(tmp_path), ref, "assay", "file", ["m", "v"])
    assert {(r["assay"], r["m"], r["v"]) for r in got.collect()} == {("ax", "A1C", "0.5"), ("ay", "A2C", "1"), ("ay", "A3C", "2")}
    with pytest.raises(ValueError):
        readers.read_many(spark, str(tmp_path), spark.createDataFrame([("a", "../x.csv")], "assay string, file string"), "assay", "file", ["m"])
    (tmp_path / "r.jsonl").write_text('{"kind": "a", "v": "1"}\nnot json, kind b\n')
    rows = readers.read_json_lines(spark, str(tmp_path / "r.jsonl"), StructType([StructField("kind", StringType()), StructField("v", StringType())]), F.col("value").contains('"a"'))
    assert [tuple(r) for r in rows.collect()] == [("a", "1")]
