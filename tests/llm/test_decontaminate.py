import pytest
from testpaths import SMALL

from gaugeframe.llm import decontaminate as D

ITEM = "A train leaves the old station at 9 and travels 120 km with Anna before it stops near the wide river bank"
SHORT = "seven small words stand here"
FILL = "some quite ordinary filling text that has nothing to do with any question at all in here "


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, SHORT), (3, "too few words"), (4, None), (None, ITEM), (5, ""), (1, ITEM)], "item_id bigint, text string")


def cases():
    again = ITEM.replace("9", "7").replace("120 km", "300 miles").replace("Anna", "Boris")
    half = " ".join(ITEM.split()[:14])
    return [
        (1, FILL + ITEM + " " + FILL), (2, FILL + again), (3, FILL), (4, FILL + half), (5, SHORT.upper()), (6, None), (7, ""), (8, FILL + " ".join(ITEM.split()[:9])), (None, ITEM), (1, FILL + ITEM + " " + FILL),
        (9, again + " " + FILL + ITEM), (10, " ".join(reversed(ITEM.split()))),
    ]


@pytest.mark.parametrize("bound", [200_000, 0])
def test_cases(spark, bench, bound):
    docs = spark.createDataFrame([(*c, 7) for c in cases()], "doc_id bigint, text string, h int")
    found = {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(docs, bench, bound).collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 1), (5, 2), (9, 1)}
    assert found[(2, 1)]["n_slots"] >= 3 and found[(1, 1)]["coverage"] == 1.0
    kept = D.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "3", "6", "7", "8", "None"]


def test_slots_must_be_consistent(spark):
    item = "give 5 red apples to the boy and 5 green apples to the girl who waits outside the old school"
    ask = [(1, item.replace("5", "8")), (2, item.replace("5 red", "8 red")), (3, item.replace("5 red", "6 red").replace("5 green", "7 green"))]
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    found = {r["doc_id"]: r for r in D.find_leaks(spark.createDataFrame(ask, "doc_id bigint, text string"), b).collect()}
    # document 2 keeps 18 words as they are, which is a leak by itself; in document 3 only the end is copied
    assert set(found) == {1, 2} and found[1]["coverage"] == 1.0 and found[2]["matched_windows"] == 11


def test_copied_windows_count_beside_a_clash(spark):
    item = "of the 5 tall trees in the quiet park behind the town hall only 5 were planted by the old gardener last spring"
    end = item.rsplit(" 5 ", 1)
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = [(1, " 8 ".join(end)), (2, item), (3, " ".join(item.split()[:9]).replace("5", "8") + " 7 " + end[1]), (4, FILL)]
    assert {r["doc_id"] for r in D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), b).collect()} == {1, 2}


def test_odd_and_empty(spark, odd, empty, bench):
    assert D.find_leaks(odd, bench).count() == 0 and D.find_leaks(empty, bench).count() == 0 and D.find_leaks(odd, bench.limit(0)).count() == 0
    text = odd.filter("doc_id = 1").select(odd.doc_id.alias("item_id"), "text")
    assert {r["doc_id"] for r in D.find_leaks(odd, text).collect()} >= {1, 2, 12}


def test_small_table_finds_every_whole_item(spark, small):
    import re

    def words(t):
        return " ".join(re.findall(r"[^\W\d_]+|[0-9]+", t.lower()))

    docs = [(r["doc_id"], words(r["text"])) for r in small["documents"].select("doc_id", "text").collect()]
    items = [(r["item_id"], words(r["text"])) for r in small["benchmark"].collect()]
    want = {(d, i) for d, t in docs for i, x in items if f" {x} " in f" {t} "}
    assert {(r["doc_id"], r["item_id"]) for r in D.query(spark, SMALL).collect()} == want and want


@pytest.mark.parametrize("bound", [200_000, 0])
def test_items_of_few_plain_words(spark, bound):
    """Number-heavy, short and unspaced items are found when copied, and not when their values differ."""
    sums = "12 + 7 = 19 and 30 kg + 4 kg = 34 kg or 5 km + 8 km = 13 km"
    cjk = "昨日の夜に東京で大きな地震がありました"
    b = spark.createDataFrame([(1, sums), (2, "What is 9?"), (3, cjk)], "item_id bigint, text string")
    docs = [(1, FILL + sums + " " + FILL), (2, FILL + "What is 9? " + FILL), (3, "私は" + cjk + "と聞いた"), (4, FILL + sums.replace("7", "6").replace("30", "31").replace("8", "2").replace("34", "35").replace("13", "14")), (5, FILL + "What is 8?"), (6, FILL)]
    found = {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), b, bound).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 3)}
    assert all(r["coverage"] == 1.0 for r in found.values())


ALICE = "Alice buys 5 apples. Alice sells 3 apples. Each apple costs 2 dollars. How many apples does Alice keep at home?"


def test_names_at_the_start_of_sentences(spark):
    b = spark.createDataFrame([(1, ALICE)], "item_id bigint, text string")
    docs = [(1, ALICE.replace("Alice", "Robert").replace("5", "9").replace("3", "4")), (2, FILL + ALICE.replace("Alice", "Zoë")), (3, ALICE.replace("Alice sells", "Robert sells")), (4, FILL)]
    # document 3 copies the item from its second sentence on but for the name
    assert {r["doc_id"] for r in D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), b).collect()} == {1, 2, 3}


def test_texts_of_one_id_are_judged_alone(spark, bench):
    again = [ITEM.replace("9", x).replace("120 km", y).replace("Anna", z) for x, y, z in (("7", "300 miles", "Boris"), ("4", "80 miles", "Clara"))]
    docs = [(1, again[0]), (1, again[1]), (1, FILL), (1, again[0])]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)] and got[0]["matched_windows"] >= 12


def plain_tokens(text):
    """Marked tokens by plain loops: (kind, value)."""
    import re

    out = []
    for m in re.finditer(r"[^\W\d_]+|[0-9]+(?:[.,:/][0-9]+)*", text):
        word, before = m[0], text[: m.start()]
        if word[0].isdigit():
            out.append(("number", word))
            continue
        starts = before == "" or before[-1] in '\n"(' or (len(before) > 1 and before[-1] == " " and (before[-2] in ".!?,;:" or before[-2].isdigit() or before[-2].islower()))
        name = len(word) > 1 and word[0].isupper() and word[1].islower() and starts and word not in D._NO_NAMES.split("|")
        unit = re.search(r"[0-9] ?$", before) and re.fullmatch(D._UNITS, word, re.I)
        out.append(("unit" if unit else "name" if name else "word", word.lower()))
    return out


def plain_leak(text, item):
    """Whether ``text`` holds ``item``, by comparing all pairs of windows."""
    d, b = plain_tokens(text), plain_tokens(item)
    n = min(len(b), D.WINDOW)
    if n == 0:
        return False
    exact = {i: sum(k == "word" for k, _ in b[i : i + n]) < D.MIN_LITERALS for i in range(len(b) - n + 1)}
    sure, shifts = set(), {}
    for i in exact:
        for j in range(len(d) - n + 1):
            x, y = b[i : i + n], d[j : j + n]
            if exact[i]:
                if [v for _, v in x] == [v for _, v in y]:
                    sure.add(i)
            elif all(p[0] == q[0] and (p[0] != "word" or p[1] == q[1]) for p, q in zip(x, y, strict=True)):
                shifts.setdefault(j - i, set()).add(i)
    literal = set()
    for shift, at in shifts.items():
        pairs = {(b[k][0], b[k][1], d[k + shift][1]) for i in at for k in range(i, i + n) if b[k][0] != "word"}
        if len({p[:2] for p in pairs}) == len(pairs) == len({(p[0], p[2]) for p in pairs}):
            literal |= at
        literal |= {i for i in at if [v for _, v in b[i : i + n]] == [v for _, v in d[i + shift : i + shift + n]]}
    n_literal = sum(not e for e in exact.values())
    return len(sure | literal) >= min(D.MIN_WINDOWS, len(exact)) or (n_literal > 0 and len(literal) >= min(D.MIN_WINDOWS, n_literal))


@pytest.mark.parametrize("bound", [(200_000, 1 << 23), (0, 1 << 10)])
def test_equals_a_plain_matcher(spark, bound):
    """Renamed and renumbered items, whole, in part and with slots that clash; with a broadcast table and with joins and a small filter."""
    import random

    rng = random.Random(31)
    common = ["river", "train", "boy", "old", "green", "walks", "takes", "from", "shop", "with", "bread", "house", "near", "sells", "small", "and"]
    names, units = ["Alice", "Bob", "Clara", "Dora"], ["km", "kg", "hours", "dollars"]

    def sentence():
        return " ".join(rng.choice([rng.choice(common)] * 5 + [str(rng.randint(1, 40)) + rng.choice(["", " " + rng.choice(units)]), rng.choice(names)]) for _ in range(rng.randint(3, 12)))

    items = [(i, ". ".join([rng.choice([s, s.capitalize()]) for s in (sentence() for _ in range(rng.randint(1, 4)))])) for i in range(40)]
    docs = []
    for i in range(160):
        text = items[rng.randrange(40)][1]
        if rng.random() < 0.5:
            for a in names:
                text = text.replace(a, rng.choice(["Emil", "Fritz", a]))
        if rng.random() < 0.5:
            for a in set(text.split()):
                if a.isdigit() and rng.random() < 0.5:
                    text = text.replace(f" {a} ", f" {rng.randint(50, 90)} ", rng.choice([1, -1]))
        words = text.split(" ")
        if rng.random() < 0.4:
            words = words[rng.randrange(4) : len(words) - rng.randrange(6)]
        docs.append((i, " ".join([sentence(), *words, sentence()])))
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), *bound)
    want = {(d, i) for d, t in docs for i, x in items if plain_leak(t, x)}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and 40 < len(want)
