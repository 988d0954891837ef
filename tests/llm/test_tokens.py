"""Packing and edit-aware counts: exact round trips."""

import collections
import random
import zlib

import numpy as np
import pytest
from testpaths import SMALL
from tokenizers import Tokenizer

from gaugeframe.llm import packing as P
from gaugeframe.llm import token_tree as E

ODD = [
    "", " ", "a", "  \n\n x  y", "don't we'll 're" * 9, "x" * 4000, "日本 語 " * 200, "1 2\n\n\nword  \n  ok " * 20, "<|endoftext|> a", "é🙂 \u00a0 \u2028z",
    "a <|endoftext|> b<|endoftext|><|endoftext|>", "x|<|endoftext|>|y" * 30, "日本語、テキスト。" * 60, "if(x1==y2){return'a'+b|c;}\x1c\x1d!" * 40, "a1b2'c'3 4'll" * 50, "e\u0301a\u0301" * 300,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.vocabulary())


def test_encoder_gives_the_tokenizers_ids(small, tokenizer):
    texts = ODD + [r["text"] for r in small["documents"].select("text").collect()]
    assert P.encoder(P.vocabulary())(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_long_runs(tokenizer):
    """Texts of millions of equal characters have the ids of an unmodified tokenizer and do not end the task."""
    spaces = " " * 3_000_000
    for text in (spaces, "a" + spaces + "b", "\n" * 1_200_000 + " x", "ab" * 100_000):
        assert P.encoder(P.vocabulary())([text]) == [tokenizer.encode(text, add_special_tokens=False).ids]
    assert E.TokenTree("a" + spaces + "b", P.encoder(P.vocabulary())).n_tokens == len(tokenizer.encode("a" + spaces + "b", add_special_tokens=False).ids)


def test_text_without_letters_beside_spaces_has_leaves():
    for text in ("日本語、テキスト。" * 600, "if(x1==y2){return'a'+b;}" * 300, "12 345,6 7" * 900):
        leaves = E.split(text)
        assert "".join(leaves) == text and max(map(len, leaves)) < 2 * E.LEAF


def lower_bound_best_fit(lengths, capacity=1024):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, b in enumerate(bins) if b + n <= capacity]
        if fit:
            i = max(fit, key=lambda i: bins[i])
            bins[i] += n
        else:
            bins.append(n)
    return len(bins)


def check_rows(rows, texts, tokenizer):
    """Every row's pieces and their places, against ids from the other library."""
    want = collections.Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, (a, b) in enumerate([(0, first)] + [(s, s + 1024) for s in range(first, len(ids), 1024)]):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


def test_small_table(spark, small, tokenizer):
    rows = P.query(spark, SMALL).collect()
    n = check_rows(rows, [(r["doc_id"], r["text"]) for r in small["documents"].select("doc_id", "text").collect()], tokenizer)
    assert n <= 1.02 * lower_bound_best_fit([r["length"] for r in rows]) + 1


def test_odd(odd, odd_rows, empty, tokenizer):
    check_rows(P.pack(odd).collect(), [r[:2] for r in odd_rows], tokenizer)
    assert P.pack(empty).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "small", "large", "few", "same"])
def test_plans(kind):
    rng = random.Random(kind)
    draw = {"uniform": lambda: rng.randint(1, 1024), "small": lambda: rng.randint(1, 60), "large": lambda: rng.randint(500, 1024), "few": lambda: rng.choice([512, 341, 1024, 1]), "same": lambda: 400}[kind]
    lengths = [draw() for _ in range(3000)]
    counts = collections.Counter(lengths)
    p = P.make_plan(dict(counts))
    fill = collections.defaultdict(list)
    for n, c in counts.items():
        s, o = p.place(np.full(c, n), np.arange(c))
        for a, b in zip(s.tolist(), o.tolist()):
            fill[a].append((b, n))
    assert len(fill) == p.sequences
    for x in fill.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    assert p.sequences <= 1.003 * lower_bound_best_fit(lengths) + 1


def test_edits_equal_encoding_again(small):
    encode, rng = P.encoder(P.vocabulary()), random.Random(4)
    bits = ["a", " ", "\n", " the", "'s", "  \n", "é", "1", "word", "'", "\n\nfoo", "日", "|", "<|", "<|endoftext|>", "endoftext", "\x1c", "!", "\u0301"]
    for text in ODD + [r["text"] for r in small["documents"].select("text").limit(60).collect()]:
        tree, now = E.TokenTree(text, encode, 64), text
        assert tree.n_tokens == len(encode([now])[0])
        for _ in range(8):
            a = rng.randint(0, len(now))
            b = min(len(now), a + rng.choice([0, 0, 1, 3, 40, 500]))
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 200])))
            tree.replace(a, b, new)
            now = now[:a] + new + now[b:]
            assert (tree.text, tree.n_chars, tree.n_tokens) == (now, len(now), len(encode([now])[0]))


def test_an_edit_reads_little(small):
    text = max((r["text"] for r in small["documents"].select("text").collect()), key=len)
    tree = E.TokenTree(text, P.encoder(P.vocabulary()))
    before = tree.encoded_chars
    tree.replace(len(text) // 2, len(text) // 2 + 5, "edited")
    assert before == len(text) and tree.encoded_chars - before < 2000


def test_count_edits(spark, odd, odd_rows, empty):
    encode = P.encoder(P.vocabulary())
    rows = E.query(spark, SMALL).collect()
    edited = {r["doc_id"]: r for r in E.query_edits(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    for r in rows[:80]:
        t = edited[r["doc_id"]]["text"] or ""
        assert r["n_tokens"] == len(encode([t])[0])
        for e in edited[r["doc_id"]]["edits"]:
            t = t[: e["start"]] + e["text"] + t[e["stop"] :]
        assert (r["n_tokens_after"], r["n_chars_after"]) == (len(encode([t])[0]), len(t))
    edits = spark.createDataFrame([(1, 2, 0, 3, ""), (1, 1, 5, 5, "new "), (3, 1, None, None, None), (4, 1, 9, 99, "text")], "doc_id bigint, seq int, start bigint, stop bigint, text string")
    got = E.count_edits(E.with_edits(odd, edits)).collect()
    assert len(got) == len(odd_rows)
    one = next(r for r in got if r["doc_id"] == 1)
    t = next(r[1] for r in odd_rows if r[0] == 1)
    t = t[:5] + "new " + t[5:]
    assert (one["n_edits"], one["n_tokens_after"]) == (2, len(encode([t[3:]])[0]))
    assert next(r for r in got if r["doc_id"] == 4)["n_chars_after"] == 4
    assert E.count_edits(E.with_edits(empty, edits)).count() == 0


def test_encoder_loads_tokenizers_only_for_long_white_runs():
    """A worker that encodes with tiktoken holds no second vocabulary."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; from gaugeframe.llm import packing as P; e = P.encoder(P.vocabulary()); e(['a <|endoftext|> b']); assert 'tokenizers' not in sys.modules; e([' ' * P._WHITE_RUN]); assert 'tokenizers' in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])
