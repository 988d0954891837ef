"""Expressions on nucleotide and protein sequences, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def oriented_allele(allele: Column, strand: Column) -> Column:
    """The allele as read on its strand."""
    return F.when(strand == "-", reverse_complement(allele)).otherwise(allele)


def char_at(s: Column, position: Column) -> Column:
    """Character at a position from 0; null outside the text."""
    return F.when((position >= 0) & (position < F.length(s)), F.substring(s, position + 1, F.lit(1)))


def mismatches(a: Column, b: Column) -> Column:
    """Positions from 0 at which two texts of equal length differ; null for different lengths."""
    n = F.length(a)
    where = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)))
    return F.when(n != F.length(b), None).when(n == 0, F.array().cast("array<int>")).otherwise(where)


def orientation(reference: Column, position: Column, ref: Column, strand: Column) -> Column:
    """assay, reverse_complement or invalid: which reading of the allele the reference has at the position."""
    here = char_at(reference, position)
    return F.when(here == oriented_allele(ref, strand), "assay").when(here == oriented_allele(complement(ref), strand), "reverse_complement").otherwise("invalid")


def in_alphabet(s: Column, alphabet: str) -> Column:
    """Whether a non-empty text has only characters of the alphabet."""
    return s.rlike(f"^[{alphabet}]+$")


def windows(s: Column, k: int) -> Column:
    """All substrings of length k in order; none for a shorter text."""
    # a match of no length at every position, so the text is read once
    return F.coalesce(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)), F.array().cast("array<string>"))


def words_of(alphabet: str, k: int) -> list[str]:
    """All words of length k over the alphabet, sorted."""
    out = [""]
    for _ in range(k):
        out = [w + c for w in out for c in sorted(alphabet)]
    return out


def kmer_frequencies(s: Column, vocabulary: Sequence[str]) -> Column:
    """Share of each vocabulary word among the windows that are in the vocabulary; zeros if there are none."""
    k = len(vocabulary[0])
    letters = "".join(sorted(set("".join(vocabulary))))
    # windows side by side with a comma between, in which each word is counted by what is left without it
    joined = F.array_join(F.regexp_extract_all(s, F.lit(f"(?=([{letters}]{{{k}}}))"), F.lit(1)), ",")
    words = F.array(*[F.lit(w) for w in vocabulary])

    def counted(text: Column) -> Column:
        return F.transform(words, lambda w: F.length(text) - F.length(F.replace(text, w, F.lit(""))))

    def shared(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
        return _bound(total, lambda t: F.transform(counts, lambda n: F.when(t > 0, n / t).otherwise(0.0)))

    return F.when(s.isNotNull(), _bound(joined, lambda text: _bound(counted(text), shared)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as an expression that stands twice in a plan is copied."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kmer_table(rows: DataFrame, key: str, text: str, vocabulary: Sequence[str]) -> DataFrame:
    """``key, kmer, share`` for every row and vocabulary word; rows with a null text have zeros."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    shares = kmer_frequencies(F.coalesce(text, F.lit("")), vocabulary)
    return rows.select(key, F.explode(F.arrays_zip(words.alias("kmer"), shares.alias("share"))).alias("x")).select(key, "x.*")


def count_char(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def composition(s: Column, alphabet: str) -> Column:
    """log1p of the length, the share of each letter, and the share of all others; zeros for an empty text."""
    n = F.length(s)
    shares = [F.coalesce(F.try_divide(count_char(s, c).cast("double"), n.cast("double")), F.lit(0.0)) for c in alphabet]
    known = sum((count_char(s, c) for c in alphabet[1:]), count_char(s, alphabet[0]))
    unknown = F.coalesce(F.try_divide((n - known).cast("double"), n.cast("double")), F.lit(0.0))
    return F.array(F.log1p(n.cast("double")), *shares, unknown)


def longest_run(s: Column, alphabet: str) -> Column:
    """Length of the longest stretch of alphabet characters."""
    return F.array_max(F.transform(F.split(s, f"[^{alphabet}]"), lambda x: F.length(x)))


def valid_windows(s: Column, alphabet: str, width: int) -> Column:
    """Number of windows of a width that have only alphabet characters."""
    return F.aggregate(F.split(s, f"[^{alphabet}]"), F.lit(0), lambda a, x: a + F.greatest(F.lit(0), F.length(x) - width + 1))


def clipped(s: Column, position: Column, reach: int) -> Column:
    """The text around a position from 0, ``reach`` characters to both sides, clipped to the text."""
    start = F.greatest(F.lit(0), position - reach)
    return F.substring(s, start + 1, F.least(F.length(s), position + reach + 1) - start)


def substitutions(mutant: Column) -> Column:
    """Parsed ``A123C:D45E``: an array of structs ``from, position (from 1), to``; null if any part is malformed."""
    part = r"^([A-Z])([1-9][0-9]{0,8})([A-Z])$"
    parts = F.split(mutant, ":")
    parsed = F.transform(parts, lambda m: F.struct(F.regexp_extract(m, part, 1).alias("from"), F.regexp_extract(m, part, 2).try_cast("int").alias("position"), F.regexp_extract(m, part, 3).alias("to")))
    return F.when(F.forall(parts, lambda m: m.rlike(part)), parsed)


def substitutions_fit(subs: Column, sequence: Column) -> Column:
    """Whether parsed substitutions lie in the sequence, start from its residues, change them, and do not repeat a position."""
    inside = F.forall(subs, lambda x: (x["position"] <= F.length(sequence)) & (F.substring(sequence, x["position"], F.lit(1)) == x["from"]) & (x["from"] != x["to"]))
    distinct = F.size(F.array_distinct(F.transform(subs, lambda x: x["position"]))) == F.size(subs)
    return F.coalesce(inside & distinct, F.lit(False))


def substituted(subs: Column, sequence: Column) -> Column:
    """The sequence with the substitutions applied."""
    return F.aggregate(subs, sequence, lambda s, x: F.concat(F.substring(s, F.lit(1), x["position"] - 1), x["to"], F.substring(s, x["position"] + 1, F.length(s))))


def depth_bucket(mutant: Column, top: int = 5) -> Column:
    """Number of substitutions as text, with ``top`` and more in one bucket."""
    n = F.size(F.split(mutant, ":"))
    return F.when(n >= top, f"{top}+").otherwise(n.cast("string"))


def char_ngrams(s: Column, low: int = 1, high: int = 3) -> Column:
    """All character n-grams of the lengths from low to high."""
    return F.concat(*[windows(s, k) for k in range(low, high + 1)])
