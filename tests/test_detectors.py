"""Statements of free text, one rule at a time."""

from pyspark.sql import functions as F
from testpaths import SMALL

from gaugeframe import registry
from gaugeframe.functions import detectors as D


def test_stray_numbers(spark):
    names = ["ESM-2 (650M)", "Study of 2019, GRCh38", "Seven Bridges", "ESM-2"]
    cases = {
        "ESM-2 (650M) beats ESM-2 in 2019": [],
        "The two systems differ, both two tools too; a two-study view": [],
        "ESM-20 and xESM-2 and 650M of 20190": ["20", "20190"],
        "GRCh38 has 38 parts, 1.5 and 2,5": ["38", "1.5", "2,5"],
        "Seven Bridges and two more": ["Seven", "two"],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", D.stray_numbers(F.col("t"), F.array(*[F.lit(n) for n in names])).alias("s")).collect()}
    assert got == {**cases, "ESM-20 and xESM-2 and 650M of 20190": got["ESM-20 and xESM-2 and 650M of 20190"]}
    # a whole name goes wherever it stands, a word of it only as a whole word
    assert "20190" in got["ESM-20 and xESM-2 and 650M of 20190"]


def test_tidy_and_sentences(spark):
    text = "  <!-- a\ncomment -->@anna wrote x@y.z \u2014 1\u20132 `@b`  "
    r = spark.createDataFrame([(text, "# One. Two is not public; three\nfour")], "t string, s string").select(D.tidy(F.col("t")).alias("t"), D.sentences(F.col("s")).alias("s"), D.sentence_with(F.col("s"), "public").alias("p"), D.sentence_with(F.col("s"), "public", "data").alias("n")).first()
    assert r["t"] == "anna wrote x@y.z, 1-2 `@b`"
    assert r["s"] == ["One.", "Two is not public;", "three", "four"] and r["p"] == "Two is not public;" and r["n"] is None
    long = spark.createDataFrame([("x" * 300,)], "s string").select(D.sentence_with(F.col("s"), "x").alias("s")).first()["s"]
    assert len(long) == 240 and long.endswith("x...")


def test_reported_changes_of_odd_texts(spark):
    raws = {"g|-12:0.5|3:-0.7|Warnings:x:9": 0.7, "a|1:2,b|2:-3|4: 1 ": 3.0, "g|1:x|2:4": 4.0, "g|1:x": None, "g": None, "": None, ",|": None, "g|1:NaN|2:3": None, "g|1:-Infinity|2:3": None, "g|1:0": 0.0, "Warnings:5,7:6": 6.0, "g|a:b:4|2:1": 1.0, None: None}
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    assert {r["r"]: r["x"] for r in df.select("r", D.largest_change(F.col("r")).alias("x")).collect()} == raws
    entries = [(["A|g|0.1|0.0|0.4|0.2|5"], 0.4), (["A|g|-1|-2|-3|-4"], 0.0), (["A|g|1|2|3|4", "B|h|5|6|7|8"], 8.0), (["A|g|1|2|3"], None), (["A|g|1|2|3|4", "B"], None), (["A|g|1|x|3|4"], None), (["A|g|1|NaN|3|4"], None), (["A|g|1|-Infinity|3|4"], None), (["A|g|1|Infinity|3|4"], None), ([], None), (None, None), (["A|g|1|2|3|4", None], None), (["A|g|1||3|4"], None)]
    df = spark.createDataFrame([(i, e) for i, (e, _) in enumerate(entries)], "i int, e array<string>")
    assert [r["x"] for r in df.orderBy("i").select(D.best_delta(F.col("e")).alias("x")).collect()] == [x for _, x in entries]


def test_reported_values_are_parsed_once_and_groups_are_hashed(spark):
    """A text is cut once a row however often its numbers are needed, and the query's groups need no sort."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    df = spark.createDataFrame([("g|1:2", ["A|g|1|2|3|4"])], "r string, e array<string>").repartition(2)
    assert plan(df.select(D.largest_change(F.col("r")).alias("x"))).count("split(") == 1
    assert plan(df.select(D.best_delta(F.col("e")).alias("x"))).count("split(") == 1
    assert "SortAggregate" not in plan(registry.QUERIES["reported_changes"](spark, SMALL))
