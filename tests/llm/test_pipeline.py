"""Each stage against brute force on the input that it got."""

import importlib.util
import sys
from pathlib import Path

import pytest
from testpaths import SMALL

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no corpus_pipeline.py")
    import corpus_pipeline as P

    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_rows(stages):
    for s in stages[1:-1]:
        assert s.dtypes == stages[0].dtypes and s.count() == len(ids(s)) > 0
    assert ids(stages[-1]) == ids(stages[-2])


def test_each_stage(stages, spark):
    from test_decontaminate import D
    from test_ngram_join import brute
    from test_secrets_urls_lines import plain_cut

    from gaugeframe.llm import line_dedup, quality

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = quality.grade(stages[0], quality.train(stages[0], labels)).filter(f"p_good >= {quality.KEEP_AT}")
    assert ids(stages[1]) == ids(good)
    cut = plain_cut([(r["doc_id"], r["text"], r["source"]) for r in stages[1].collect()], line_dedup.MIN_SITES)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[2].collect()} == {i: (t, len(t)) for i, t, n, k in cut if not (k and k == n)}
    assert ids(stages[3]) == {c for _, c, _ in brute([(r["doc_id"], r["text"]) for r in stages[2].collect()])}
    leaking = ids(D.find_leaks(stages[3], spark.read.parquet(f"{SMALL}/benchmark.parquet")))
    assert leaking and ids(stages[4]) == ids(stages[3]) - leaking


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline as P

    got = P.run(spark, SMALL)
    assert sorted(map(tuple, got.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, stages[-1].select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_stages_on_odd_and_empty_documents(spark, odd, empty):
    import corpus_pipeline as P

    for name, f in P.STAGES:
        out = f(spark, odd, SMALL)
        assert out.count() > 0, name
        assert f(spark, empty, SMALL).count() == 0, name
        if name != "packing":
            assert out.columns == odd.columns, name


def test_stages_leave_clashing_columns_alone(spark, odd):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    extra = {"a.b": F.lit(77), "n_lines": F.lit(77), "n_cut": F.lit(77), "p_good": F.lit(77.5), "expected_grade": F.lit(7), "_row": F.lit(7), "class_id": F.col("doc_id"), "A`c": F.lit("x")}
    docs = odd.withColumns(extra)
    for name, f in P.STAGES:
        out = f(spark, docs, SMALL)
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == docs.columns, name
            assert out.filter("`a.b` <> 77 OR n_lines <> 77 OR n_cut <> 77 OR p_good <> 77.5 OR expected_grade <> 7").count() == 0, name
            assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, (r["doc_id"] for r in f(spark, odd, SMALL).collect()))), name


def test_arrow_batches_are_bounded_in_bytes(spark):
    """One partition of 24 MB of texts in 3,000 rows, which Spark's own bound of 10,000 rows gives to Python at once."""
    import corpus_pipeline as P
    import pyarrow as pa
    from pyspark.sql import functions as F

    docs = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.expr("repeat(md5(cast(id AS string)), 250)").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(8000).alias("n_chars"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    for name, f in P.STAGES:
        if name == "decontamination":  # without Python
            continue
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        f(spark, docs.limit(10), SMALL)
        got = docs.mapInArrow(sizes, "n bigint, bytes bigint").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["bytes"] for r in got) < 4_000_000, name


def test_a_bound_of_the_user_stays(spark, odd):
    from gaugeframe.llm import packing

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    try:
        packing.pieces(odd)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
