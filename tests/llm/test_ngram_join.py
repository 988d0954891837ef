import random
import re

import pytest
from testpaths import SMALL

from gaugeframe.llm import ngram_join as J


def shingles(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """Links and classes by comparing all pairs."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    parent, links = {i: i for i, _ in rows}, [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            (i, x), (j, y) = rows[a], rows[b]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted((i, find(i), n) for (i, _), n in zip(rows, links))


def got(df):
    return sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect())


def test_banding_reaches_its_recall():
    b = J.choose_banding(0.8, 0.9999)
    assert b.recall(0.8) >= 0.9999 and b.bands * b.rows <= 96
    assert sum(1 for _ in range(1)) and b.least_agreement(0.8) < 0.8 * b.bands * b.rows


def test_odd_documents(odd, odd_rows):
    assert got(J.similarity_classes(odd)) == brute([r[:2] for r in odd_rows])


@pytest.mark.parametrize("block", [512, 3])
def test_group_of_near_copies_in_blocks(spark, block):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):
        w = list(words)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(90)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(J.similarity_classes(df, block=block)) == brute(rows)


def test_small_table_and_other_ways(spark, small):
    docs = small["documents"]
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert got(J.query(spark, SMALL)) == want
    assert got(J.similarity_classes(docs, broadcast_ids=-1)) == want


def test_empty_and_keep_one(empty, odd, odd_rows):
    assert J.similarity_classes(empty).count() == 0
    kept = J.keep_one_per_class(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({c for _, c, _ in brute([r[:2] for r in odd_rows])})
    assert kept.filter("doc_id IS NULL").count() == 2
