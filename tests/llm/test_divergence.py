"""Divergences against dictionaries and integers of Python."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from testpaths import SMALL

from gaugeframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [w.translate(LOWER) for w in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {k for k, _ in counts}:
        sources = sorted((s for k, s in counts if k == lang), key=str.encode)
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        share = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            p = share[s]
            pairs = [(sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), x) for x, q in share.items() if x != s]
            terms = [((p[t] - whole[t]) ** 2 // (p[t] + whole[t]), t) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string, n bigint, term string").repartition(3)


def corpus(seed, sources, docs, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["w" + chr(97 + i % 26) + chr(97 + i // 26) + ("é" if i % 5 == 0 else "") for i in range(words)]
    rows = []
    for _ in range(docs):
        s = int(rng.integers(0, sources)) if rng.random() < 0.6 else 0
        some = rng.choice(vocabulary[: 10 + s * 3 % words], size=int(rng.integers(0, 30)))
        rows.append(("de" if rng.random() < 0.3 else "en", f"s{s}", ", ".join(w.upper() if rng.random() < 0.2 else w for w in some)))
    return rows


def test_audit_equals_the_plain_version(spark):
    rows = corpus(1, 12, 300)
    docs = make(spark, rows)
    assert got(divergence.audit(docs, 5)) == plain(rows, 5)
    # several tiles of sources and blocks of terms
    assert got(divergence.audit(docs, 5, tile_sources=4, block_entries=20)) == plain(rows, 5)


def test_odd_rows(spark, odd, odd_rows, empty):
    assert got(divergence.audit(odd, 2)) == plain([(r[2], r[3], r[1]) for r in odd_rows], 2)
    assert got(divergence.audit(odd, 1000)) == plain([(r[2], r[3], r[1]) for r in odd_rows], 1000)  # no kept terms
    assert got(divergence.audit(empty)) == []
    rows = [("en", "a", "x y z"), ("en", "b", None), ("en", None, "--- 123 ---"), (None, "a", "x")] * 12 + [("fr", "only", "le la " * 50_000)] * 10
    assert got(divergence.audit(make(spark, rows))) == plain(rows)


def test_slices_of_one_hash_are_told_apart():
    texts = pa.array(["one two Three", "three two oneone", "", None, "zwölf one"])
    data, starts, ends, text = divergence.boundaries(texts)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["one", "two", "three", "three", "two", "oneone", "zwölf", "one"] and text.tolist() == [0, 0, 0, 1, 1, 1, 4, 4]
    for digest in (lambda x: 7, lambda x: len(x), lambda x: x[0]):
        group, example = divergence.grouped(data, starts, ends, digest)
        assert [words[example[g]] for g in group] == words
        assert len(set(group.tolist())) == len(set(words))


def test_long_texts_are_compared_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abc"), size=int(rng.integers(1, 9)))) for _ in range(3000)] + ["z" * 5000]
    data, starts, ends, _ = divergence.boundaries(pa.array([" ".join(words)]))
    for size in (1 << 21, 100, 7):
        monkeypatch.setattr(divergence, "CHUNK_BYTES", size)
        group, example = divergence.grouped(data, starts, ends, len)
        assert [words[example[g]] for g in group] == words and len(example) == len(set(words))


def test_terms_end_with_their_text():
    data, starts, ends, text = divergence.boundaries(pa.array(["ab", "cd", "", "e"]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"e"] and text.tolist() == [0, 1, 3]


def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    q = divergence.query(spark, SMALL)
    assert got(q) == sorted(c.execute(divergence.ORACLE_SQL).fetchall())
