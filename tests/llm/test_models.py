"""Quality and toxicity: held-out accuracy, and defined results for odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import quality as Q
from gaugeframe.llm import toxicity as T

MID = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def mid(spark):
    return {n: spark.read.parquet(f"{MID}/{n}.parquet") for n in ("documents", "labels")}


def test_quality_held_out(spark, mid):
    model = Q.train(mid["documents"], mid["labels"], hold_out=True)
    test = mid["labels"].filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    got = Q.grade(mid["documents"].select("doc_id", "text"), model).join(test, "doc_id").toPandas()
    assert ((got["p_good"] >= Q.KEEP_AT) == (got["quality"] == 1)).mean() >= 0.95


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    texts, grades = [], []
    for _ in range(400):
        g = rng.integers(0, 4)
        texts.append(" ".join(["good"] * (2 * g + rng.integers(0, 2)) + ["bad"] * (8 - 2 * g)))
        grades.append(float(g))
    x = Q.featurise(pa.array(texts))
    m = Q.fit(x, np.array(grades))
    assert (np.diff(m.thresholds) > 0).all()
    expected = m.grades[0] + m.tails(x) @ np.diff(m.grades)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95


def test_quality_odd(spark, odd, empty, mid):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (8, None), (9, 0)], "doc_id bigint, quality int")
    m = Q.train(odd, labels)
    g = Q.grade(odd.withColumn("p_good", F.lit("clash")), m)
    assert g.count() == odd.count() and g.filter("p_good IS NULL OR isnan(p_good)").count() == 0
    assert Q.grade(empty, m).count() == 0
    assert Q.keep_good(odd, labels.limit(0)).count() == odd.count()
    one = Q.train(odd, labels.filter("quality = 1 AND doc_id = 1"))
    assert Q.grade(odd, one).filter("expected_grade <> 1").count() == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = T.toxicity(docs, T.train(docs, labels)).filter("held_out").join(labels, "doc_id").toPandas()
    y, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    assert auc(y, s) >= 0.93  # some 2,100 labelled documents stand behind the counts here
    called = got["predicted"] == 1
    assert (y[called] == 1).mean() >= 0.9 and called[y == 1].mean() >= 0.6
    assert ((s >= 0) & (s <= 1)).all()


def test_toxicity_labels_of_the_held_out_are_not_used(spark, mid):
    held = T.fold(F.col("doc_id")) == 1
    flipped = mid["labels"].withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = mid["documents"].limit(300)
    a, b = (sorted((r["doc_id"], r["score"]) for r in T.toxicity(docs, T.train(docs, x)).collect()) for x in (mid["labels"], flipped))
    assert a == b


def test_toxicity_odd(spark, odd, empty, mid):
    m = T.train(mid["documents"], mid["labels"])
    got = T.toxicity(odd, m)
    assert got.count() == odd.count() and got.filter("score IS NULL OR isnan(score) OR score < 0 OR score > 1").count() == 0
    assert got.filter("doc_id IS NULL AND held_out").count() == 0
    assert T.toxicity(empty, m).count() == 0
    none = T.train(mid["documents"], mid["labels"].limit(0))
    assert T.toxicity(odd, none).filter("score > 0.001").count() == 0
    nulls = mid["labels"].unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], mid["labels"].schema))
    assert T.train(mid["documents"], nulls).prior == m.prior


def test_toxicity_keeps_every_word(spark):
    """A toxic word whose hash agrees with a far commoner word's in the low bits, and a bigram seen once, count; joins and arrays agree."""
    from gaugeframe.llm import hashing

    def ids(words):
        return hashing.word_hashes(pa.array(words))[0] % np.uint64(T.VOCABULARY - 1) + np.uint64(1)

    some = [f"q{i}" for i in range(1_500_000)]
    rare = some[int(np.flatnonzero(ids(some) % np.uint64(1 << 18) == ids(["the"])[0] % np.uint64(1 << 18))[0])]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = [f"w{rng.integers(40)}" if k % 2 else "the" for k in range(30)]
        if i % 3 == 0:
            words[11] = rare
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    rows += [(600, None, 0), (601, "!", 1), (602, rows[0][1], 1), (602, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").cache()
    got = []
    for bound in (T.BROADCAST_ROWS, 0):
        m = T.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), bound)
        assert (m.arrays is None) == (bound == 0)
        got.append(sorted(((r["doc_id"], r["evidence"], r["run_evidence"], r["score"]) for r in T.toxicity(df, m).collect()), key=str))
    assert len(got[0]) == len(rows) and all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9, nan_ok=True) if a[1] is not None else a == b for a, b in zip(*got, strict=True))
    toxic = {i for i, _, y in rows[:600] if y}
    assert min(r[2] for r in got[0] if r[0] in toxic) > max(r[2] for r in got[0] if r[0] < 600 and r[0] not in toxic) + 0.5


def test_toxicity_counts_texts_and_estimates_discounts(spark):
    """Copies and repeats raise no count, and a toxic expression of ordinary words, seen a few times, is evidence."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = [f"w{rng.integers(12)}" for _ in range(24)]
        # "red" and "fish" are ordinary words; only toxic texts have one right before the other
        words[6:9] = ["red", "fish", "w1"] if i % 4 == 0 else ["red", "w1", "fish"]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    copies = docs.union(docs.selectExpr("doc_id + 100000", "text", "toxic"))
    counts = [{r["pair"]: (r["n0"], r["n1"]) for r in T.bigram_counts(T._once(x)).collect()} for x in (docs, copies)]
    assert counts[0] == counts[1] and max(n0 for n0, _ in counts[0].values()) <= 300
    assert 0 < T.discount(90, 10) < 1
    m = T.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = T.toxicity(docs, m).filter("held_out").toPandas().merge(docs.toPandas(), on="doc_id")
    assert auc(got["toxic"].to_numpy(), got["run_evidence"].to_numpy()) >= 0.95


def brute_kneser_ney(rows):
    """Log ratios by the formulas, over dictionaries of words; ``rows`` are distinct (text, class)."""
    import collections
    import re

    def words(t):
        w = re.findall(r"\w+", t.lower())
        return list(zip(["<s>", *w], w))

    n = [collections.Counter(), collections.Counter()]
    for t, c in rows:
        n[c].update(set(words(t)))
    scale = [min(sum(x.values()) for x in n) / sum(x.values()) for x in n]
    often = [collections.Counter(x.values()) for x in n]
    d = [o[1] / (o[1] + 2 * o[2]) if o[1] and o[2] else 0.75 for o in often]
    d.append(max(d))
    types = [len(x) for x in n]
    every = set(n[0]) | set(n[1])
    k = [collections.Counter(w for _, w in x) for x in n]
    k_both = collections.Counter(w for _, w in every)
    rarer = [min(types) / x for x in types]
    mass = len(every) + len(k_both) + 1
    share = [sum(min(k[c][w] * rarer[c], 0.75) for w in k_both) / min(types) for c in (0, 1)]

    def lower(c, w):
        return max(k[c][w] * rarer[c] - 0.75, 0) / min(types) + (k_both.get(w, 1) + 1) * share[c] / mass

    def interpolated(v, w, count, discount, rest):
        total = sum(count(b) for b in every if b[0] == v)
        if total == 0:
            return rest
        free = 1 - sum(max(count(b) - discount, 0) for b in every if b[0] == v) / total
        return max(count((v, w)) - discount, 0) / total + max(free, 1e-4) * rest

    def ratio(v, w):
        p = [interpolated(v, w, lambda b: n[c][b] * scale[c], d[c], interpolated(v, w, lambda b: n[0][b] * scale[0] + n[1][b] * scale[1], d[2], lower(c, w))) for c in (0, 1)]
        return np.log(p[1] / p[0])

    return lambda t: [ratio(*b) for b in words(t)]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_toxicity_equals_brute_force(spark, bound):
    """Means over all words and over the three strongest, from every bigram counted, singletons too; by arrays and by joins."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(70):
        words = [f"w{min(rng.geometric(0.2), 30)}" for _ in range(rng.integers(1, 25))] + ([f"bad{rng.integers(3)}"] if i % 5 == 0 else [])
        rows.append((" ".join(words), int(i % 5 == 0)))
    rows = list(dict(rows).items())
    ratios = brute_kneser_ney(rows)
    m = T.build(T.written(T.bigram_and_context_counts(spark.createDataFrame(rows, "text string, toxic int"))), bound)
    assert (m.arrays is None) == (bound == 0)
    texts = [(i, t) for i, (t, _) in enumerate(rows)] + [(1000, "w1 never seen words w2"), (1001, "bad1"), (1002, "w3 w3 w3 w3 bad0 bad0")]
    got = {r["i"]: (r["evidence"], r["run_evidence"]) for r in m.evidence(spark.createDataFrame(texts, "i int, text string")).collect()}
    for i, t in texts:
        x = sorted(ratios(t), reverse=True)
        assert got[i] == pytest.approx((np.mean(x), np.mean(x[: T.EXPRESSIONS])), rel=1e-9, abs=1e-9)


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm, java = spark._jvm, spark.sparkContext._jsc.sc()
    java.listenerBus().waitUntilEmpty()
    stages = java.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_toxicity_of_a_large_model_shuffles_what_its_head_leaves_open(spark):
    """A model above the bound gives the same means, also of copies in many tasks, and bigrams that it does not have or that are frequent are no rows."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(1500):
        words = [f"w{min(rng.geometric(0.3), 12)}" for _ in range(60)] + [f"new{i}"]
        if i % 6 == 0:
            words[7:9] = ["vile", f"bad{rng.integers(60)}"]
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "!"), (5003, "vile vile bad1 bad1 vile"), (5004, "nowhere"), (None, rows[0][1])], "doc_id bigint, text string")
    texts = docs.select("doc_id", "text").union(docs.filter("doc_id % 300 = 0").crossJoin(spark.range(40)).selectExpr("doc_id + 10000 * (1 + id)", "text")).union(odd).repartition(8).cache()
    bigrams = sum(len(set(zip(["", *t], t, strict=False))) for t in (r[1].split() for r in rows))
    got = []
    for bound in (T.BROADCAST_ROWS, 300, 40):
        m = T.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), bound)
        assert (m.arrays is None) == (bound < T.BROADCAST_ROWS)
        before = shuffled(spark)
        got.append(sorted(((r["doc_id"], r["evidence"], r["run_evidence"], r["score"]) for r in T.toxicity(texts, m).collect()), key=str))
        if bound == 300:
            assert shuffled(spark) - before < bigrams / 4
    assert len(got[0]) == texts.count()
    for other in got[1:]:
        assert all(a[0] == b[0] and (a[1] is None) == (b[1] is None) and (a[1] is None or a[1:] == pytest.approx(b[1:], rel=1e-9, abs=1e-12)) for a, b in zip(got[0], other, strict=True))


def test_quality_sample_is_of_the_documents(spark, mid):
    """Labels of other documents take no places in the sample, and repeated rows add none."""
    docs = mid["documents"].select("doc_id", "text").limit(200).cache()
    other = spark.range(10**6, 10**6 + 5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    own = mid["labels"].select("doc_id", "quality").join(docs, "doc_id", "left_semi")
    a = Q.train(docs, own, max_rated=60)
    b = Q.train(docs.union(docs), own.unionByName(other.select("doc_id", F.col("quality").cast(own.schema["quality"].dataType))), max_rated=60)
    assert a is not None and (a.words == b.words).all() and (a.thresholds == b.thresholds).all()


def test_quality_equals_brute_force(spark):
    """Grades by plain loops over words and characters, and a fit that no small change of a parameter betters."""
    import collections
    import math
    import re

    rng = np.random.default_rng(4)
    rows = [(i, " ".join([f"w{rng.integers(30)}" for _ in range(rng.integers(0, 20))] + ["Fine!"] * int(rng.integers(0, 2 + i % 3)) + ["???"] * int(rng.integers(0, 3))), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    m = Q.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))

    def bucket(w):
        from gaugeframe.llm import hashing

        return int(hashing.word_hashes(pa.array([w]))[0][0] % np.uint64(Q.BUCKETS))

    def form(t):
        w = re.findall(r"\w+", t.lower())
        n, size = max(1, len(w)), max(1, len(t))
        share = lambda f: sum(map(f, t)) / size
        c = collections.Counter(bucket(x) for x in w)
        ordinary = ".,;:?!'\"-()"
        return [0.0] * 10 if not t else [share(str.isalpha), share(str.isdigit), share(str.isupper), share(lambda x: x in ordinary), share(lambda x: not x.isalnum() and not x.isspace() and x not in ordinary), len(c) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, max(c.values(), default=0) / n, min(4, size / n / 8), math.log1p(len(w)) / 10]

    def tails(t, words, form_weights, cuts):
        c = collections.Counter(bucket(x) for x in re.findall(r"\w+", t.lower()))
        norm = math.sqrt(sum((1 + math.log(k)) ** 2 for k in c.values()))
        s = sum(words[b] * (1 + math.log(k)) / norm for b, k in c.items()) + sum((x - a) / d * f for x, a, d, f in zip(form(t), m.mean, m.scale, form_weights, strict=True))
        return [1 / (1 + math.exp(-(s - cut))) for cut in cuts]

    got = {r["doc_id"]: r for r in Q.grade(df, m).collect()}
    for i, t, _ in rows:
        p = tails(t, m.words, m.form, m.thresholds)
        assert (got[i]["expected_grade"], got[i]["p_good"]) == pytest.approx((sum(p), p[1]), abs=1e-6)

    def loss(words, form_weights, cuts):
        out = 0.0
        for _, t, y in rows:
            p = [1.0, *tails(t, words, form_weights, cuts), 0.0]
            out -= math.log(max(p[y] - p[y + 1], 1e-12)) / len(rows)
        return out + 1e-4 / 2 * float((words**2).sum() + (form_weights**2).sum())

    best = loss(m.words, m.form, m.thresholds)
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(m.words, m.form, m.thresholds + step * (np.arange(2) == k)) > best - 1e-3
    for k in range(0, 10, 3):
        for step in (-0.05, 0.05):
            assert loss(m.words, m.form + step * (np.arange(10) == k), m.thresholds) > best - 1e-3
