"""Secret scan: fixed patterns, and a battery of randomness tests.

The patterns give the base spans.  The battery looks at every other run of
token characters: its encoding is inferred from its alphabet, and three tests
ask whether its symbols are random there: chi-squared uniformity, runs about the
median symbol, and serial correlation of neighbours.  The least of the three
makes one p-value r.

That a run looks random says little if it is short, as ordinary text then often
does too.  So the control is over the hypothesis that a run is ordinary text.
Against it stands a random string whose r is weighed by 2 r (and by 0 below
REJECT_RANDOM), as r is even over 0 to 1 for random strings.  The ratio of the
two probabilities of the run, under a byte-pair model of the whole corpus for
ordinary text, has a mean of at most 1 over ordinary text, so its inverse is a
p-value; it falls with the length, and with every test that the run passes well.
Benjamini-Hochberg control over all runs of the corpus sets the cut; with such
ratios it holds whatever the runs have to do with each other.

Runs of digits alone are ordinary text and are not tested: nothing in their
characters tells a random identifier from a random secret.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .storage import materialise, table

#: Fixed patterns, by kind in the order of the digest.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_HINT = re.compile(r"[:=]")

#: Runs of token characters that the battery tests.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Encodings by alphabet, the smallest first.
ENCODINGS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("LETTERS", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "abcdefghijklmnopqrstuvwxyz234567"),
    ("BASE32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_RANK = [(name, {c: i for i, c in enumerate(alphabet)}) for name, alphabet in ENCODINGS]

#: The encoding that is not tested: order numbers, timestamps, telephone and card numbers are as random as a secret of digits.
NUMBERS = "digits"
#: A run is not random if the battery rejects randomness at this level.
REJECT_RANDOM = 0.001
#: Fewest characters of a part of a run that is tested.
LEAST_PART = 16
#: Where a run that fits no single encoding is split: what is left fits base64url, base64 and base62.
SPLITS = tuple(re.compile(p) for p in (r"[^/+]+", r"[^_-]+", r"[^/+_-]+"))
#: Share of ordinary text among the added spans that the control allows.
FALSE_DISCOVERY = 0.01
#: p-values are rounded up to powers of two with these steps, so that their histogram is bounded.
P_STEPS, P_LEAST = 4, -400


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: kind, start and end in code points."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a greedy match is a maximal run, so asking for 32 characters at once finds the same spans
    out += [("hex", m.start(), m.end()) for m in _HEX_RUN.finditer(text)]
    return out


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution (Wilson-Hilferty)."""
    if x <= 0:
        return 1.0
    return 0.5 * math.erfc(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)) / math.sqrt(2))


def infer_encoding(run: str) -> tuple[str, list[int], int] | None:
    """Name, symbol ranks and alphabet size of the smallest encoding that has all characters; None if none has."""
    body = run.rstrip("=")
    for name, rank in _RANK:
        if all(c in rank for c in body):
            return name, [rank[c] for c in body], len(rank)
    return None


def battery(ranks: list[int], size: int) -> tuple[float, float, float]:
    """p-values of the chi-squared, runs and serial-correlation tests, under randomness over ``size`` symbols."""
    n = len(ranks)
    x = np.array(ranks, dtype=float)
    # chi-squared over as many equal classes of the alphabet as give four or more expected symbols
    classes = max(2, min(size, n // 4))
    counts = np.bincount((x * classes // size).astype(int), minlength=classes)
    share = np.bincount((np.arange(size) * classes // size), minlength=classes) / size
    uniform = _chi2_tail(float(((counts - n * share) ** 2 / (n * share)).sum()), classes - 1)
    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a == 0 or b == 0:
        runs = 0.0
    else:
        expected = 1 + 2 * a * b / n
        variance = (expected - 1) * (expected - 2) / (n - 1)
        runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - expected) / math.sqrt(variance)) if variance > 0 else 1.0
    c = x - (size - 1) / 2
    serial = _two_sided(float((c[1:] * c[:-1]).sum()) / ((size * size - 1) / 12 * math.sqrt(n - 1)))
    return uniform, runs, serial


def combined(tests: Sequence[float]) -> float:
    """One p-value of independent tests from the least of theirs (Sidak): a random string fails none of them."""
    return 1 - (1 - min(tests)) ** len(tests)


def log2_weight(r: float) -> float:
    """log2 of the weight of random strings of the battery's p-value ``r``, whose mean over random strings is at most 1."""
    return math.log2(2 * r) if r >= REJECT_RANDOM else -math.inf


def _parts(text: str, start: int, end: int) -> tuple[list[tuple[int, int, tuple[str, list[int], int]]], int]:
    """What is tested of a run, with its encoding, and in how many ways the run was read.

    That is the whole run if one encoding has all its characters, else the parts
    of every way to split it, which may overlap.
    """
    found = infer_encoding(text[start:end])
    if found is not None:
        return ([(start, end, found)] if found[0] != NUMBERS else []), 1
    parts = {(start + m.start(), start + m.end()) for split in SPLITS for m in split.finditer(text[start:end]) if m.end() - m.start() >= LEAST_PART and m.end() - m.start() < end - start}
    coded = [(s, e, infer_encoding(text[s:e])) for s, e in sorted(parts)]
    return [x for x in coded if x[2] is not None and x[2][0] != NUMBERS], len(SPLITS)


def _unless_coded(m: re.Match) -> str:
    out = m[0]
    for s, e, _ in _parts(m[0], 0, len(m[0]))[0]:
        if not m[0][s:e].islower() or any(c.isdigit() for c in m[0][s:e]):  # long words are ordinary text
            out = out[:s] + " " * (e - s) + out[e:]
    return out if out.strip() else " "


def _outside(start: int, end: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the base spans leave of a run, in pieces of LEAST_PART or more."""
    out = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if s < end and start < e:
            out.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if e - s >= LEAST_PART]


def byte_pairs(docs: DataFrame) -> np.ndarray:
    """Counts of neighbouring bytes of all ordinary text (128 x 128, other bytes as 0); each task returns its sums.

    Runs that are tested are left out, or random strings would make themselves
    ordinary, but for those of lower-case letters alone: long words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128 * 128, dtype=np.int64)
        for batch in hashing.slices(batches):
            ordinary = pa.array([TOKEN.sub(_unless_coded, t.as_py() or "") for t in batch.column(0)], pa.string())
            for _, texts in hashing.chunks(ordinary):
                b, _ = hashing.text_bytes(texts, lower=False)
                b = np.where(b < 128, b, 0).astype(np.int32)
                if len(b) > 1:
                    total += np.bincount(b[:-1] * 128 + b[1:], minlength=128 * 128)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    out = np.zeros(128 * 128)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 16,384 rows
        out[r["pair"]] = r["n"]
    return out.reshape(128, 128)


def ordinary_model(counts: np.ndarray) -> np.ndarray:
    """log2 P(next byte | byte), smoothed by the single bytes and a little of the uniform distribution."""
    single = (counts.sum(axis=0) + 0.5) / (counts.sum() + 64)
    return np.log2(0.98 * (counts + 2 * single[None, :]) / (counts.sum(axis=1, keepdims=True) + 2) + 0.02 / 128)


def _added(text: str, base: list[tuple[str, int, int]], model: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs, and parts of them, outside the base spans that the battery does not reject: start, end and step of the p-value.

    Of parts that overlap the least likely as ordinary text stays; its p-value is
    multiplied by the number of ways to read the run.
    """
    out = []
    for m in TOKEN.finditer(text):
        for start, end in _outside(m.start(), m.end(), base):
            parts, ways = _parts(text, start, end)
            passed = []
            for s, e, (_, ranks, size) in parts:
                weight = log2_weight(combined(battery(ranks, size)))
                b = np.frombuffer(text[s:e].encode(), np.uint8)
                log_p = float(model[b[:-1], b[1:]].sum()) + (len(b) - 1) * math.log2(size) + math.log2(ways) - weight
                passed.append((max(P_LEAST * P_STEPS, min(0, math.ceil(min(log_p, 0.0) * P_STEPS))), s, e))
            taken: list[tuple[int, int, int]] = []
            for step, s, e in sorted(passed):
                if all(e <= x or y <= s for x, y, _ in taken):
                    taken.append((s, e, step))
            out += taken
    return out


def scan(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """``doc_id, base_spans, spans`` of every row: the spans of the patterns, and these with the accepted runs.

    Both are arrays of structs ``kind, start, end, p, step``, sorted by start and
    then kind; base spans have a null p.  Null and empty texts have none.  Whole
    texts are read, however long.  Every row is returned, repeated rows and null
    ids too; repeated runs count as often as they come.  An empty table has no
    rows.  Other columns of ``docs`` are not returned, whatever their names.
    """
    model = ordinary_model(byte_pairs(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tested_schema = "doc_id bigint, kinds array<string>, starts array<bigint>, ends array<bigint>, steps array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches):
            kinds, starts, ends, steps = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = [(s, KINDS.index(k), e, None) for k, s, e in base] + [(s, 3, e, p) for s, e, p in _added(text, base, shared.value)]
                spans.sort(key=lambda x: x[:3])
                kinds.append([KINDS[x[1]] for x in spans])
                starts.append([x[0] for x in spans])
                ends.append([x[2] for x in spans])
                steps.append([x[3] for x in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(steps, pa.list_(pa.int32()))],
                names=["doc_id", "kinds", "starts", "ends", "steps"],
            )

    tested = materialise(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, tested_schema))
    steps = tested.select(F.explode("steps").alias("step")).filter("step IS NOT NULL").groupBy("step").count().collect()  # at most -P_LEAST * P_STEPS + 1 rows
    cut = accept(dict((r["step"], r["count"]) for r in steps), false_discovery)
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends", "steps"), lambda z: F.struct(z["kinds"].alias("kind"), z["starts"].alias("start"), z["ends"].alias("end"), F.pow(F.lit(2.0), z["steps"] / F.lit(float(P_STEPS))).alias("p"), z["steps"].alias("step")))
    return tested.select("doc_id", F.filter(spans, lambda s: s["step"].isNull()).alias("base_spans"), F.filter(spans, lambda s: s["step"].isNull() | (s["step"] <= cut)).alias("spans"))


def accept(steps: dict[int, int], false_discovery: float) -> int:
    """Benjamini-Hochberg: the largest accepted step of the p-values (below all of them, if none is accepted)."""
    total, below, best = sum(steps.values()), 0, P_LEAST * P_STEPS - 1
    for step in sorted(steps):
        below += steps[step]
        if 2 ** (step / P_STEPS) <= false_discovery * below / total:
            best = step
    return best


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))
