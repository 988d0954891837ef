"""Byte ranges of sequence files against slices of the sequences."""

import random

import pytest

from gaugeframe.sources import indexed, readers


def write(path, contigs, width, end):
    index = []
    with open(path, "wb") as f:
        for name, s in contigs.items():
            f.write(b">" + name.encode() + b" some words" + end)
            index.append((name, len(s), f.tell(), width, width + len(end)))
            for i in range(0, len(s), width):
                f.write(s[i : i + width].encode() + end)
    with open(f"{path}.fai", "w") as f:
        f.writelines("\t".join(map(str, r)) + "\n" for r in index)
    return index


@pytest.fixture(params=[b"\n", b"\r\n"])
def sequences(tmp_path, request):
    rng = random.Random(4)
    contigs = {f"chr{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 59, 60, 61, 5000, 120))}
    index = write(tmp_path / "s.fa", contigs, 60, request.param)
    return str(tmp_path / "s.fa"), contigs, index


def requests(contigs, n):
    rng = random.Random(5)
    out = []
    for i in range(n):
        c = rng.choice(list(contigs))
        a = rng.randint(1, len(contigs[c]))
        out.append((i, c, a, rng.randint(a, len(contigs[c]))))
    return out


def test_ranges_equal_slices(spark, sequences, monkeypatch):
    path, contigs, _ = sequences
    index = indexed.read_index(spark, f"{path}.fai")
    asked = requests(contigs, 120) + [(200, "chr4", 1, 5000), (0, "chr0", 1, 1)]
    wanted = spark.createDataFrame(asked, "id int, contig string, start int, stop int").repartition(3)
    want = sorted((i, a, b, contigs[c][a - 1 : b], None) for i, c, a, b in asked)
    for piece, gap in ((indexed.PIECE, 1 << 16), (7, 0), (100, 10)):
        monkeypatch.setattr(indexed, "GAP", gap)
        got = indexed.fetch_ranges(index, wanted, piece).collect()
        assert sorted((r["id"], r["start"], r["stop"], r["bases"], r["reason"]) for r in got) == want
    blocks = readers.parse_fasta(readers.read_lines(spark, path), "line", block=100)
    good = spark.createDataFrame(asked[:50], "id int, contig string, start int, stop int")
    assert sorted(map(str, readers.fetch(blocks, good).select("id", "bases").collect())) == sorted(map(str, indexed.fetch_ranges(index, good).select("id", "bases").collect()))


def test_only_touched_ranges_are_read(tmp_path, monkeypatch):
    s = "ACGT" * 250_000
    write(tmp_path / "big.fa", {"a": s}, 50, b"\n")
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    monkeypatch.setattr(indexed, "opened", lambda p: Counted(open(p, "rb")))
    import numpy as np

    first = np.array([100, 150, 900_000])
    assert [len(x) for x in indexed._pieces_read(str(tmp_path / "big.fa"), first, first + 50)] == [50, 50, 50]
    assert len(read) == 2 and sum(read) < 300


def test_wrong_requests_and_files(spark, sequences, tmp_path):
    path, contigs, _ = sequences
    index = indexed.read_index(spark, f"{path}.fai")
    asked = [(1, "chr9", 1, 2), (2, "chr1", 0, 2), (3, "chr1", 5, 4), (4, "chr1", 1, 60), (5, None, 1, 2), (6, "chr1", None, 2), (7, "chr1", 2, 3)]
    wanted = spark.createDataFrame(asked, "id int, contig string, start int, stop int")
    got = {r["id"]: (r["reason"], r["bases"]) for r in indexed.fetch_ranges(index, wanted).collect()}
    assert got == {1: (indexed.UNKNOWN, None), 2: (indexed.OUTSIDE, None), 3: (indexed.OUTSIDE, None), 4: (indexed.OUTSIDE, None), 5: (indexed.UNKNOWN, None), 6: (indexed.OUTSIDE, None), 7: (None, contigs["chr1"][1:3])}
    assert {r["contig"] for r in indexed.missing_contigs(wanted.filter("contig IS NOT NULL"), index).collect()} == {"chr9"}
    wrong = index.withColumn("offset", index["offset"] + 1)
    with pytest.raises(Exception, match="does not fit"):
        indexed.fetch_ranges(wrong, wanted.limit(7).filter("id = 7").selectExpr("id", "'chr4' AS contig", "1 AS start", "5000 AS stop")).collect()
    assert indexed.fetch_ranges(index, wanted.limit(0)).count() == 0


def test_built_index_equals_the_written_one(spark, sequences, tmp_path):
    path, contigs, index = sequences
    for chunk in (1 << 20, 13):
        built = indexed.build_index(spark, path, chunk)
        got = sorted((r["contig"], r["length"], r["offset"]) for r in built.collect())
        assert got == sorted(r[:3] for r in index)
        # lines of contigs of one line tell no more than their own length
        assert {(r["contig"], r["bases"], r["width"]) for r in built.collect() if r["length"] > 60} == {(r[0], r[3], r[4]) for r in index if r[1] > 60}
    rows = spark.createDataFrame([*contigs.items(), ("empty", "")], "contig string, sequence string").repartition(3)
    indexed.write_sequences(rows, str(tmp_path / "out"), 25)
    written = indexed.build_index(spark, str(tmp_path / "out"))
    asked = requests(contigs, 60)
    got = indexed.fetch_ranges(written, spark.createDataFrame(asked, "id int, contig string, start int, stop int")).collect()
    assert sorted((r["id"], r["bases"]) for r in got) == sorted((i, contigs[c][a - 1 : b]) for i, c, a, b in asked)
    assert {r["contig"]: r["length"] for r in written.collect()} == {**{c: len(s) for c, s in contigs.items()}, "empty": 0}
    (tmp_path / "bad.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="differ in length"):
        indexed.build_index(spark, str(tmp_path / "bad.fa")).collect()
