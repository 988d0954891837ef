import collections
import hashlib
import random
import re

import pytest
from testpaths import SMALL
from pyspark.sql import functions as F

from gaugeframe.llm import line_dedup as L
from gaugeframe.llm import secret_scan as S
from gaugeframe.llm import url_filter as U


# secrets


def plain_spans(text):
    """The base spans as the patterns are worded, with no shortcuts."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def check_scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = S.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t in rows if i == r["doc_id"])
        assert [(s["start"], S.KINDS.index(s["kind"]), s["end"]) for s in r["base_spans"]] == plain_spans(text)
    return {r["doc_id"]: r for r in got}


def test_base_spans_and_digest(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small["documents"].select("doc_id", "text").collect()]
    check_scan(spark, rows)
    for r in spark.createDataFrame(rows, "doc_id bigint, text string").limit(0).union(S.query(spark, SMALL).select("doc_id", "base_sha256")).collect():
        spans = plain_spans(dict(rows)[r["doc_id"]] or "")
        assert r["text"] == hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_nested_and_short_assignments(spark):
    rows = [(1, "token=secret:abcdefgh1"), (2, 'PASSWORD" : "abc'), (3, "é token = 'abcdefgh' Token:12345678"), (4, "ſecret=abcdefgh12"), (5, "AKIA" + "A" * 11), (6, "xAKIA" + "B9" * 6 + "é"), (7, "0" * 31 + " " + "a" * 32), (8, None), (9, ""), (10, "api_key=apikey:abcdefgh")]
    check_scan(spark, rows)


def test_random_strings_are_added(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiou") + rng.choice("tnrsl") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    rows, secret = [], {}
    for i in range(200):
        text = " ".join(rng.choice(words) for _ in range(80))
        if i % 4 == 0:
            key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
            text = f"{text} {key} and more"
            secret[i] = key
        elif i % 4 == 1:
            text += " aAbB1aAbB1aAbB1aAbB1aAbB1aAbB1 thisIsAVeryLongCamelCaseIdentifierName2 " + "tosa" * 12
        rows.append((i, text))
    got = check_scan(spark, rows)
    added = {i: [dict(rows)[i][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random"] for i, r in got.items()}
    assert sum(added[i] == [k] for i, k in secret.items()) >= 0.95 * len(secret)
    assert sum(len(v) for i, v in added.items() if i not in secret) <= 3


def plain_battery(run, alphabet):
    """The three p-values from their definitions, without arrays."""
    import math

    n, size = len(run), len(alphabet)
    ranks = [alphabet.index(c) for c in run]
    k = max(2, min(size, n // 4))
    counts, share = [0] * k, [0.0] * k
    for r in ranks:
        counts[r * k // size] += 1
    for r in range(size):
        share[r * k // size] += 1 / size
    x = sum((c - n * q) ** 2 / (n * q) for c, q in zip(counts, share, strict=True))
    f = k - 1
    uniform = 0.5 * math.erfc(((x / f) ** (1 / 3) - 1 + 2 / (9 * f)) / (2 * math.sqrt(1 / (9 * f)))) if x > 0 else 1.0
    sides = [r >= size / 2 for r in ranks]
    up, down = sum(sides), n - sum(sides)
    runs = 0.0
    if up and down:
        mean = 2 * up * down / n + 1
        var = 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
        runs = math.erfc(abs(1 + sum(a != b for a, b in zip(sides, sides[1:], strict=False)) - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    middle = (size - 1) / 2
    var = sum((r - middle) ** 2 for r in range(size)) / size
    serial = math.erfc(abs(sum((a - middle) * (b - middle) for a, b in zip(ranks, ranks[1:], strict=False))) / (var * math.sqrt(2 * (n - 1))))
    return uniform, runs, serial


def test_battery_and_control_equal_brute_force():
    rng = random.Random(12)
    r = []
    for name, alphabet in S.ENCODINGS:
        for n in (16, 17, 24, 40, 64, 200):
            for _ in range(12):
                run = "".join(rng.choice(alphabet) for _ in range(n))
                ranks = [alphabet.index(c) for c in run]
                got = S.battery(ranks, len(alphabet))
                assert got == pytest.approx(plain_battery(run, alphabet), abs=1e-9), name
                r.append(S.combined(got))
    # p-values of random strings are about even, so the mean of their weights is about 1
    assert 0.85 < sum(2 * x if x >= S.REJECT_RANDOM else 0 for x in r) / len(r) < 1.1
    some = [S.combined([rng.random() for _ in range(3)]) for _ in range(20_000)]
    assert all(abs(sum(x < t for x in some) / len(some) - t) < 0.02 for t in (0.01, 0.1, 0.5, 0.9))
    for _ in range(200):
        p = [rng.choice([0, -rng.randint(0, 160)]) for _ in range(rng.randint(1, 60))]
        values = sorted(2 ** (q / S.P_STEPS) for q in p)
        k = max((i for i, v in enumerate(values, 1) if v <= 0.05 * i / len(values)), default=0)
        cut = S.accept(collections.Counter(p), 0.05)
        assert sum(q <= cut for q in p) == k


@pytest.mark.parametrize("length", [24, 32, 48, 64])
def test_keys_by_length_and_encoding(spark, length):
    """Most keys of every encoding are found once they are long enough for it, and no word or number of ordinary text."""
    rng = random.Random(length)
    words = ["".join(rng.choice("aeiou") + rng.choice("tnrsl") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    encodings = [e for e in S.ENCODINGS if e[0] not in ("hex", "digits")]
    rows, secret = [], {}
    for i in range(40 * len(encodings)):
        name, alphabet = encodings[i // 4 % len(encodings)]
        text = " ".join([rng.choice(words), str(rng.randint(0, 10**6)), rng.choice(words).title()][rng.randrange(3)] for _ in range(60)) + " " + "".join(rng.choice(words) for _ in range(3))
        if i % 4 == 0:
            secret[i] = (name, "".join(rng.choice(alphabet) for _ in range(length)))
            text += f" {secret[i][1]} end"
        rows.append((i, text))
    got = check_scan(spark, rows)
    added = {i: "".join(dict(rows)[i][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random") for i, r in got.items()}
    assert sum(bool(v) for i, v in added.items() if i not in secret) <= 2
    if length >= 32:
        for name, _ in encodings:
            keys = [(i, k) for i, (n, k) in secret.items() if n == name]
            assert sum(len(added[i]) >= 0.6 * length for i, k in keys) >= 0.8 * len(keys), name


@pytest.mark.parametrize("make", ["order 20240101{:08d}", "Log entry at 17041829{:08d}", "call +49-170-{:07d}-22 or 0049170{:07d}", "card 4929-1173-{0:04d}-{1:04d} or 49291173{0:04d}{1:04d}", "at 20240101T{:06d}Z", "ref {:032d}", "{:040d}"])
def test_ordinary_numbers_stay(spark, make):
    """Order numbers, timestamps, telephone and card numbers are no secrets, and keys beside them are found."""
    rng = random.Random(make)
    words = ["".join(rng.choice("aeiou") + rng.choice("tnrsl") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    rows, keys = [], {}
    for i in range(200):
        numbers = [rng.randrange(10**4 if "1:04d" in make else 10**6 if "06d" in make else 10**7) for _ in range(2)]
        text = f"{' '.join(rng.choice(words) for _ in range(12))} {make.format(*numbers)} {rng.choice(words)}."
        if i % 10 == 0:
            keys[i] = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
            text += f" {keys[i]} end"
        rows.append((i, text))
    got = check_scan(spark, rows)
    added = {i: [dict(rows)[i][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random"] for i, r in got.items()}
    assert sum(added[i] == [k] for i, k in keys.items()) >= 0.8 * len(keys)
    assert sum(len(v) for i, v in added.items() if i not in keys) <= 2


def test_random_strings_within_mixed_runs(spark):
    """Tokens of one alphabet in a path or behind a prefix of another, and beside a base span."""
    rng = random.Random(9)
    base = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["".join(rng.choice("aeiou") + rng.choice("tnrsl") for _ in range(rng.randint(1, 5))) for _ in range(300)]

    def key(more):
        return "".join(rng.choice(base + more * 3) for _ in range(47)) + "Z"

    rows, secret = [], {}
    for i in range(240):
        text, k = " ".join(rng.choice(words) for _ in range(80)), None
        if i % 8 == 0:
            k = key("-_")
            text += f" https://site.com/v1/{k}/tail "
        elif i % 8 == 2:
            k = key("+/")
            text += f" sk_live_{k} "
        elif i % 8 == 4:
            k = key("")
            text += f" {k}/{'0123456789abcdef' * 2}/x "
        elif i % 8 == 6:
            text += " https://site.com/" + "/".join("-".join(rng.choice(words) for _ in range(4)) for _ in range(3)) + "/Page_2 "
        if k:
            secret[i] = k
        rows.append((i, text))
    got = check_scan(spark, rows)
    added = {i: [dict(rows)[i][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random"] for i, r in got.items()}
    for rest in (0, 2, 4):
        of = [i for i in secret if i % 8 == rest]
        assert sum(any(secret[i][4:-4] in x or (len(x) >= 16 and x in secret[i]) for x in added[i]) for i in of) >= 0.9 * len(of)
    assert sum(len(v) for i, v in added.items() if i not in secret) <= 3
    for r in got.values():
        spans = sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random")
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_secret_odd(odd, empty, odd_rows):
    assert S.scan(odd).count() == len(odd_rows) and S.scan(empty).count() == 0
    assert S.accept({}, 0.01) < S.P_LEAST * S.P_STEPS + 1
    assert S.accept({-60: 5, 0: 95}, 0.01) == -60


# urls

CASES = [
    (1, "https://A.Example.ORG/es/1?x"), (2, "http://example.org/en/12"), (3, "http://notexample.org/es/1"), (4, "ftp://x.com/fr/"), (5, "http://com/de/9#f"), (6, "http://x.net/9"), (7, None), (8, "no scheme"), (9, "://"), (10, "http://x.net/9?q=1"),
    (11, "http://example.org"), (12, "HTTP://ÀB.com?/de/"), (13, "a://b://c/d"), (13, "a://b://c/d"), (None, "http://x.net/9#a"),
]


def plain_judge(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "block" if host + path in listed else "allow"


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_urls(spark, bits):
    pages = spark.createDataFrame([(*c, "h", 5) for c in CASES], "page_id bigint, url string, host string, key int")
    blocked = spark.createDataFrame([("q://x.net/9",), (None,), ("http://elsewhere.net/",), ("q://X.NET/9",)], "url string")
    got = U.judge_urls(pages, blocked, max_bits=bits).collect()
    listed = {"x.net/9", "elsewhere.net/"}
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(map(str, ((i, *plain_judge(u, listed)) for i, u in CASES)))
    assert all(r["key"] == 5 for r in got)
    assert U.judge_urls(pages.limit(0), blocked).count() == 0
    assert U.judge_urls(pages, blocked.limit(0)).filter("listed").count() == 0


@pytest.mark.parametrize("bits", [1 << 23, 512])
def test_cascade_is_exact(spark, bits):
    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = keys.filter("hash(key) % 10 = 0")
    c = U.build_cascade(keys, listed, bits)
    got = c.listed(keys, F.col("key"), "listed")
    assert got.filter("listed").exceptAll(listed.withColumn("listed", F.lit(True))).count() == 0 and got.filter("listed").count() == listed.count()
    assert (c.shards > 1) == (bits == 512) and len(c.shapes) > 2


# lines


def plain_cut(rows, min_sites):
    norm = lambda x: " ".join(x.lower().split())
    sites, first = collections.defaultdict(set), {}
    for i, text, site in rows:
        for x in (text or "").split("\n"):
            if norm(x):
                sites[norm(x)].add(site or "")
                if i is not None:
                    first[norm(x)] = min(i, first.get(norm(x), i))
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        kept, seen, n, cut = [], set(), 0, 0
        for x in text.split("\n"):
            k = norm(x)
            n += bool(k)
            if k and len(sites[k]) >= min_sites:
                if i is None or first.get(k) != i or k in seen:
                    cut += 1
                    continue
                seen.add(k)
            kept.append(x)
        out.append((i, "\n".join(kept), n, cut))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1_000_000, -1])
def test_lines(spark, bound):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        lines = [rng.choice(["All rights reserved.", "ALL  rights reserved. ", "Home | About", "", f"only here {i}", f"site line {i % 7}", "near"]) for _ in range(rng.randrange(8))]
        rows.append((i if i % 17 else None, None if i % 31 == 0 else "\n".join(lines), None if i % 13 == 0 else f"s{i % (3 if 'near' in lines else 9)}"))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n_cut int").repartition(3)
    got = L.cut_lines(df, 5, bound)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_cut"]) for r in got.collect()), key=str) == plain_cut(rows, 5)


@pytest.mark.parametrize("bound", [1_000_000, -1])
def test_lines_of_other_white_space(spark, bound):
    texts = ["All rights reserved.\r\n\r\n\t\n", "\r\n\u00a0\n\x0b\x0c", "own\r\n \t\r\nALL rights\treserved.\r\n", "", None]
    rows = [(i, texts[i % 5], f"s{i % 9}") for i in range(45)]
    got = L.cut_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 5, bound)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_cut"]) for r in got.collect()), key=str) == plain_cut(rows, 5)


def test_lines_of_the_small_table(spark, small, odd, empty, odd_rows):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in small["documents"].collect()]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_cut"]) for r in L.query(spark, SMALL).collect()), key=str)
    assert got == plain_cut(rows, L.MIN_SITES) and sum(r[3] for r in got) > 0
    assert L.cut_lines(odd).count() == len(odd_rows) and L.cut_lines(empty).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, -1])
def test_lines_of_rows_without_ids(spark, bound):
    rows = [(None, f"Subscribe now\nown {i}", f"s{i}") for i in range(8)]
    for more in ([], [(3, "Subscribe now\nmine", "s1")]):
        got = L.cut_lines(spark.createDataFrame(rows + more, "doc_id bigint, text string, source string"), 6, bound)
        found = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_cut"]) for r in got.collect()), key=str)
        assert found == plain_cut(rows + more, 6) and all("Subscribe" not in r[1] for r in found if r[0] is None)
