import random

import pytest
from testpaths import SMALL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep string, band int, score double, line string, toxic int"


def sentence(rng, n):
    out = []
    for k in range(n):
        w = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
        out.append(w + (str(k % 7) if k % 50 == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts and sources, empty and very long texts, repeated rows, and columns with names that operators use."""
    rng = random.Random(11)
    base = sentence(rng, 120)
    words = base.split()
    rows = [
        (1, base, "en", "a"), (2, base, None, "b"), (2, base, None, "b"), (3, None, "en", "c"), (4, "", "en", None), (None, base, "en", "d"), (None, None, None, None),
        (5, "one two", "en", "e"), (6, "one two", "en", "f"), (7, " \n\t ", "en", "a"), (8, sentence(rng, 30_000), "en", "b"), (9, "x" * 200_000, "en", "c"), (10, "日本語 テキスト です " * 5, "ja", "d"),
        (11, " ".join(words[:60] + ["inserted"] + words[60:]), "en", "e"), (12, base.upper() + "!!", "en", "f"), (13, "!!! ... ???", "en", "a"),
    ]
    return [(*r, len(r[1] or ""), "x", 3, 0.5, "l", 1) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return {n: spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels", "pages", "embeddings", "benchmark")}
