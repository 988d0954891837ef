"""License scan: ordered signatures behind a keyword prefilter.

A text becomes its words with single spaces between.  One Aho-Corasick pass
finds which keywords it has; only the signatures of these are tried, so most
texts meet no regular expression at all.  What the signatures find overlaps
("lesser general public license 2.1" holds "general public license"): a
detection is suppressed if one of higher priority, or a longer one of the same
priority, contains its interval.  Detections that overlap without containment
both stay, and so do those of the fixed phrases.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .license_rules import KINDS, PHRASES, SIGNATURES
from .storage import table

#: A-Z become lower case, and bytes that are in no word become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACES = re.compile(rb" {2,}")
#: Rank of the fixed phrases: below every signature, which they never suppress.
_PHRASE = len(KINDS)


def normalised(text: str | None) -> str:
    """The words of a text, each with a space before and the last with one behind; a space alone without words.

    Non-ASCII characters come as their UTF-8 bytes, one character each, which
    keeps words apart as they are.
    """
    return _SPACES.sub(b" ", b" " + (text or "").encode().translate(_WORDS) + b" ").decode("latin-1")


class Scanner:
    """Signatures, compiled once in a worker."""

    def __init__(self, signatures: Sequence[tuple[str, str, str, str]], phrases: Sequence[tuple[str, str]]):
        kinds = list(KINDS)
        self.rules = [(label, kinds.index(kind), KINDS[kind], re.compile(f"(?<= )(?:{pattern})(?= )")) for label, kind, _, pattern in signatures]
        self.phrases = [(f" {phrase} ", label) for phrase, label in phrases]
        self.automaton = ahocorasick.Automaton()
        behind: dict[str, list[int]] = {}
        for i, signature in enumerate(signatures):
            for keyword in signature[2].split("|"):
                behind.setdefault(keyword, []).append(i)
        for keyword, rules in behind.items():
            self.automaton.add_word(f" {keyword} ", tuple(rules))
        for phrase, _ in self.phrases:
            if phrase not in self.automaton:
                self.automaton.add_word(phrase, ())
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, str, float]]]:
        """Number of words, and the detections that stay: first word, end word, rank of the kind, label, confidence; sorted."""
        words = normalised(text)
        keyed, any_key = set(), False
        for _, rules in self.automaton.iter(words):
            any_key = True
            keyed.update(rules)
        count = words.count(" ") - 1
        if not any_key:
            return count, []
        found = []
        for phrase, label in self.phrases:
            at = words.find(phrase)
            while at >= 0:
                found.append((at + 1, at + len(phrase) - 1, _PHRASE, label, KINDS["notice"]))
                at = words.find(phrase, at + 1)
        rules = []
        for i in sorted(keyed):
            label, rank, confidence, pattern = self.rules[i]
            rules += [(m.start(), m.end(), rank, label, confidence) for m in pattern.finditer(words)]
        return count, _in_words(words, found + uncontained(rules))


def uncontained(found: Sequence[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Intervals (start, end, rank, ...) that no interval of a smaller rank, or longer one of their rank, contains; of equal ones the first."""
    # tree[i] holds the furthest end over the kept intervals of the starts that node i stands for
    starts = sorted({x[0] for x in found})
    tree = [-1] * (len(starts) + 1)
    kept = []
    for x in sorted(found, key=lambda x: (x[2], x[0] - x[1])):
        at = i = bisect.bisect_right(starts, x[0])
        furthest = -1
        while i > 0:
            furthest = max(furthest, tree[i])
            i -= i & -i
        if furthest < x[1]:
            kept.append(x)
            while at < len(tree):
                tree[at] = max(tree[at], x[1])
                at += at & -at
    return kept


def _in_words(words: str, found: Sequence[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Intervals of characters as intervals of words, sorted; the text is read once."""
    out, at, before = [], 0, 0
    for start, end, *rest in sorted(found):
        before += words.count(" ", at, start)
        at = start
        out.append((before - 1, before + words.count(" ", start, end), *rest))
    return out


_DETECTION = "struct<label: string, kind: string, first: bigint, end: bigint, confidence: double>"


def scan(docs: DataFrame, signatures: Sequence[tuple[str, str, str, str]] = SIGNATURES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``doc_id, n_words, base, detections`` of every row.

    ``base`` has all places of the fixed phrases, ``detections`` these and what
    stays of the signatures: arrays of ``label, kind, first, end, confidence``
    with the words from ``first`` to before ``end``, sorted; the kind of a fixed
    phrase is ``phrase``.  Null and empty texts have none.  Whole texts are read,
    however long.  Every row is returned, repeated rows and null ids too; an
    empty table has no rows.  Other columns of ``docs`` are not returned,
    whatever their names.
    """
    signatures, phrases = tuple(signatures), tuple(phrases)
    kinds = [*KINDS, "phrase"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(signatures, phrases)
        for batch in hashing.slices(batches):
            counts, all_found = [], []
            for text in batch.column(1):
                n, found = scanner.scan(text.as_py())
                counts.append(n)
                all_found.append([{"label": label, "kind": kinds[rank], "first": first, "end": end, "confidence": confidence} for first, end, rank, label, confidence in found])
            kind = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(all_found, kind)], names=["doc_id", "n_words", "detections"])

    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, f"doc_id bigint, n_words bigint, detections array<{_DETECTION}>")
    return found.select("doc_id", "n_words", F.filter("detections", lambda d: d["kind"] == "phrase").alias("base"), "detections")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def labels(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda d: d["label"]))), ",")

    first = F.transform("base", lambda d: d["first"])
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), labels("base").alias("base_labels"), labels("detections").alias("labels"), score.alias("score")
    )
