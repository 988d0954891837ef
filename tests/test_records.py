"""The record graph on a release made here."""

from gaugeframe.operators import records


def test_release_and_rankings(spark):
    tags = spark.createDataFrame([("serving/1", 5), ("kg/1", 6), ("kg/2", 9), ("serving/0", 1), ("kg/0", 1), ("other/2", 9)], "name string, created int")
    assert [tuple(r) for r in records.newest_release(tags, ["serving", "kg"]).collect()] == [("1", 6)]
    m = spark.createDataFrame([("u1", 1, "active", "direct", ["a", "b"]), ("u2", 1, "active", "proxy", ["a", "b"]), ("u3", 1, "active", "direct", ["a", "c"]), ("u4", 2, "active", "direct", ["a", "b"])], "use_case string, tier int, status string, directness string, evaluation_ids array<string>")
    e = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s1")], "id string, system string")
    assert [tuple(r) for r in records.rankings(m, e).collect()] == [("u1", 2)]


def test_runs_and_estimates(spark):
    recipes = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "id string")
    parts = spark.createDataFrame([("r1", "x"), ("x", "y"), ("r2", "z")], "src string, dst string")
    runs = spark.createDataFrame([("y",), ("r3",)], "id string")
    assert [r["id"] for r in records.never_executed(recipes, parts, runs).collect()] == ["r2"]
    gaps = spark.createDataFrame([("g1", ["a", "b", "a"], ["p"]), ("g2", ["c"], ["p", "q"])], "gap string, systems array<string>, protocols array<string>")
    times = spark.createDataFrame([(1, "a", "p", 2.0, 4), (2, "a", "p", 99.0, 1), (3, "b", "p", 0.5, None), (4, "b", "q", 7.0, 1)], "ordinal int, system string, protocol string, hours double, gpus int")
    assert {r["gap"]: tuple(r)[1:] for r in records.estimates(gaps, times).collect()} == {"g1": (2, 2, 8.5, False), "g2": (2, 0, None, True)}


def test_datasets_and_issues(spark):
    e = spark.createDataFrame([("m1", "uses", "d1"), ("m1", "cites", "d9"), ("d2", "same_data_as", "d1"), ("m2", "trained_on", "d3")], "src string, relation string, dst string")
    gaps = spark.createDataFrame([("g", "m1"), ("h", "m2")], "gap string, member string")
    assert sorted(tuple(r) for r in records.linked_datasets(e, gaps, ["uses", "trained_on"]).collect()) == [("g", "d1"), ("g", "d2"), ("h", "d3")]
    p = spark.createDataFrame([("k1", None, "Run ESM2 on assay 7"), ("k2", ["old2"], "Compare AUROC bands"), ("k3", [], "Unheard of")], "key string, aliases array<string>, name string")
    i = spark.createDataFrame([(1, "Please run ESM2 on assay 7 soon", "x <!-- key: k9 -->"), (2, "ESM2 elsewhere", "<!-- key: old2 -->"), (3, "nothing", None)], "issue int, title string, body string")
    assert sorted(r["key"] for r in records.unfiled(p, i).collect()) == ["k1", "k3"]
    assert [tuple(r) for r in records.best_cover(p, i).collect()] == [("k1", 1, 100)]


def test_best_cover_equals_all_pairs(spark):
    import random
    import re

    rng = random.Random(3)
    common, rare = ["model", "the", "score", "WGS", "SNV"], ["ESM2", "GPT4", "ClinVar2", "PP3", "BP4", "XGB", "DNABERT", "assay", "panel", "splice"]
    names = [" ".join(rng.choice(common + rare * 2) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["", "model", "PP3"]
    texts = [", ".join(rng.choice(common * 3 + rare) for _ in range(rng.randint(1, 9))).swapcase() for _ in range(80)] + [names[0], names[5] + "!", ""]

    def normal(t):
        return re.sub("[^a-z0-9]+", " ", t.lower()).strip()

    def holds(text, words):
        return len(normal(words)) >= 3 and f" {normal(words)} " in f" {text} "

    def score(text, name):
        tokens = list(dict.fromkeys(w for w in re.split("[^A-Za-z0-9]+", name) if len(w) >= 3 and (re.search("[0-9]", w) or re.search("[A-Z].*[A-Z]", w))))
        specific = [w for w in tokens if w.upper() not in ("WGS", "SNV")]
        hits = sum(holds(text, w) for w in specific)
        if holds(text, name):
            return 100
        return 10 * hits + sum(holds(text, w) for w in tokens if w not in specific) if specific and hits >= min(2, len(specific)) else 0

    want = {}
    for k, name in enumerate(names):
        best = max(((score(normal(t), name), -i) for i, t in enumerate(texts)), default=(0, 0))
        if best[0]:
            want[k] = (-best[1], best[0])
    p = spark.createDataFrame([*enumerate(names), (900, None), (None, "PP3 BP4")], "key int, name string").repartition(3)
    i = spark.createDataFrame([*enumerate(texts), (900, None), (None, "PP3 BP4")], "issue int, title string").repartition(3)
    assert {r["key"]: (r["issue"], r["score"]) for r in records.best_cover(p, i).collect()} == want and len(want) > 30


def test_members_as_bitmaps(spark):
    from gaugeframe.operators import membership

    rng = __import__("random").Random(6)
    edges = [("hot", f"m{j:06d}") for j in range(70_000)] + [(f"k{rng.randrange(8)}", f"m{rng.randrange(90_000):06d}") for _ in range(600)] + [("k1", None), (None, "m000001")] * 2
    df = spark.createDataFrame(edges, "k string, m string").repartition(4)
    numbers = membership.dictionary(df, "m")
    maps = membership.bitmaps(df, ["k"], "m", numbers)
    want = {}
    for k, m in edges:
        if m is not None:
            want.setdefault(k, set()).add(m)
    assert {r["k"]: r["n"] for r in membership.sizes(maps, ["k"]).collect()} == {k: len(v) for k, v in want.items()}
    assert maps.filter("k = 'hot'").count() >= 2
    grouped = maps.withColumn("g", maps["k"].startswith("k")).filter("k IS NOT NULL")
    assert {r["g"]: r["n"] for r in membership.sizes(membership.unions(grouped, ["g"]), ["g"]).collect()} == {True: len(set().union(*(v for k, v in want.items() if k and k != "hot"))), False: 70_000}
    few = grouped.filter("k IN ('k1', 'hot')").drop("g").selectExpr("1 AS g", "k", "bucket", "bits")
    both = membership.shared(few, ["g"])
    assert {r["m"] for r in membership.listed(both, ["g"], numbers, "m").collect()} == want["k1"] & want["hot"]
    assert {(r["k"], r["m"]) for r in membership.listed(maps.filter("k LIKE 'k%'"), ["k"], numbers, "m").collect()} == {(k, m) for k, v in want.items() if k and k != "hot" for m in v}


def test_verification_gaps(spark):
    evidence = [("u1", "A", "s1", "paper"), ("u1", "A", "s1", "paper"), ("u1", "B", "s1", "own"), ("u1", "C", "s1", "third"), ("u1", "C", "s2", "third"), ("u2", "A", "s3", "paper"), ("u2", "A", "s4", "third"), ("u3", "A", "s5", "paper"), ("u3", "A", "s6", None)]
    rankings = [("u1", "p1", "A"), ("u1", "p2", "A"), ("u1", "p3", "A"), ("u1", "p4", "A"), ("u1", "p1", "B"), ("u1", "p1", "C"), ("u3", "p3", "A"), ("u2", "p2", "A")]
    got = records.verification_gaps(
        spark.createDataFrame(evidence, "use_case string, system string, study string, origin string"), spark.createDataFrame(rankings, "use_case string, protocol string, system string"),
        spark.createDataFrame([("p1", "b2"), ("p2", "b2"), ("p3", "b1"), ("p4", "b1")], "protocol string, benchmark string"), "own", ["third"],
    )
    assert {(r["system"], r["benchmark"]): tuple(r)[2:] for r in got.collect()} == {
        ("A", "b1"): (["u1", "u3"], ["single-study", "no-independent"], 3, ["p3", "p4"], 3),
        ("B", "b2"): (["u1"], ["no-independent"], 1, ["p1"], 1),
    }


def test_obtainable_data(spark):
    gaps = [("g1", "d1", True), ("g1", "p", False), ("g2", "d2", True), ("g2", "d3", True), ("g3", "d4", True), ("g4", "p", False), ("g5", "d2", True), ("g5", "d4", True), ("g6", "d5", True)]
    said = [("d1", "data on request", None), ("d2", "https://example.org/x", None), ("d6", "Zenodo", None), ("d4", "somewhere", None), ("p", None, "The code is not public. Fine."), ("d5", "GSE123", "The reads are not publicly available.")]
    got = records.obtainable_data(
        spark.createDataFrame(gaps, "gap string, record string, is_data boolean"), spark.createDataFrame(said, "record string, access string, notes string"),
        spark.createDataFrame([("g3", True), ("g1", True), ("g5", False)], "gap string, ready boolean"), spark.createDataFrame([("d6", "d3")], "src string, dst string"),
    )
    assert {r["gap"]: (r["state"], r["record"]) for r in got.collect()} == {"g1": ("closed", "d1"), "g2": ("open", "d2"), "g3": ("recipe", None), "g4": ("unknown", None), "g5": ("unknown", "d4"), "g6": ("closed", "d5")}


def test_successors(spark):
    systems = [("a", "Rhapsody", None), ("b", "Rhapsody 2", None), ("c", "Old One", "d"), ("d", "X", None), ("e", "AI", None), ("f", "Lone", None)]
    text = [("b", "The successor to the Rhapsody, with more."), ("z", "It supersedes Rhapsody 2 and others; successor of Old One."), ("a", "Rhapsody is a successor of Rhapsody"), ("y", "supersedes Rhapsody-like tools"), ("x", "supersedes loneliness"), ("w", None), ("v", "successor to AI")]
    got = records.successors(spark.createDataFrame(systems, "id string, name string, superseded_by string"), spark.createDataFrame(text, "id string, text string"))
    assert {r["id"]: (r["successor"], r["how"]) for r in got.collect()} == {"a": ("b", "text"), "b": ("z", "text"), "c": ("d", "attribute")}


def test_contracts(spark):
    from gaugeframe.operators import joins

    reported = [("a", 0.5), ("b", 2.0), ("c", 1.5), ("d", None), ("e", 1.0), ("e", 1.0), ("x", 1.0), ("f", float("nan")), ("g", -5.0), ("h", 3.0)]
    contract = [("a", 0.0, 1.0, False), ("b", 0.0, 1.0, False), ("c", None, None, True), ("d", 0.0, 1.0, False), ("e", 0.0, 1.0, False), ("f", None, None, False), ("g", None, 0.0, True), ("h", 3.0, 3.0, True), ("m", None, None, False)]
    got = joins.contract_violations(spark.createDataFrame(reported, "metric string, value double"), spark.createDataFrame(contract, "metric string, low double, high double, whole boolean"))
    assert {r["metric"]: r["problem"] for r in got.collect()} == {"b": "out of bounds", "c": "not whole", "d": "not finite", "e": "repeated", "f": "not finite", "m": "missing", "x": "unknown"}
