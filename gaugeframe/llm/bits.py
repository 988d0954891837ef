"""Bloom filter bit arrays built and tested with built-in Spark functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BloomShape:
    """Size of one Bloom filter: ``words`` 64-bit words and ``hashes`` probes; ``seed`` tells filters apart."""

    words: int
    hashes: int
    seed: int

    @classmethod
    def sized(cls, keys: int, false_rate: float, seed: int = 0) -> BloomShape:
        bits = max(64.0, keys * math.log(1 / false_rate) / math.log(2) ** 2)
        words = math.ceil(bits / 64)
        return cls(words, max(1, min(16, round(words * 64 / max(1, keys) * math.log(2)))), seed)

    def probes(self, key: Column) -> list[Column]:
        """Bit positions of a key, by double hashing."""
        bits = F.lit(self.words * 64).cast("bigint")
        a = F.pmod(F.xxhash64(F.lit(2 * self.seed), key), bits)
        b = F.pmod(F.xxhash64(F.lit(2 * self.seed + 1), key), bits - 1) + 1
        return [a] + [F.pmod(a + F.lit(j) * b, bits) for j in range(1, self.hashes)]

    def word_rows(self, keys: DataFrame, key: str, *by: str) -> DataFrame:
        """One row per non-zero word (and per value of ``by``): ``word``, ``bits``; partial sums combine before the shuffle."""
        return (
            keys.select(*by, F.explode(F.array(*self.probes(F.col(key)))).alias("_p"))
            .groupBy(*by, F.floor(F.col("_p") / 64).cast("int").alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("_p"), F.lit(64)).cast("int"))).alias("bits"))
        )

    def might_contain(self, words: Column, key: Column) -> Column:
        """Whether all of the key's bits are set in an array of ``self.words`` longs; later probes run only if earlier ones hit."""
        test = F.lit(True)
        for p in self.probes(key):
            word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
            test = test & (F.call_function("shiftrightunsigned", word, F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return test


def literal_words(rows: list, words: int) -> Column:
    """A constant array of longs, from collected (word, bits) rows; the caller has bounded ``words``."""
    values = ["0"] * words
    for r in rows:
        values[r["word"]] = str(r["bits"])
    return F.split(F.lit(",".join(values)), ",").cast("array<bigint>")


@dataclass(frozen=True)
class HashFilter:
    """Bloom filter of 64-bit hashes in blocks of one word: a key sets and tests four bits of a single word, all taken from its hash."""

    words: int

    @classmethod
    def sized(cls, keys: int, bits_per_key: int = 32, most_bits: int = 1 << 23) -> HashFilter:
        """Beyond ``most_bits`` the rate of false hits rises (0.0004 at 32 bits a key, 0.01 at 14, 0.1 at 7)."""
        return cls(max(1, math.ceil(min(keys * bits_per_key, most_bits) / 64)))

    def _word(self, key: Column) -> Column:
        return F.pmod(F.call_function("shiftright", key, F.lit(24)), F.lit(self.words).cast("bigint")).cast("int")

    def _bit(self, key: Column, k: int) -> Column:
        return (F.call_function("shiftright", key, F.lit(6 * k)) if k else key).bitwiseAND(F.lit(63).cast("bigint")).cast("int")

    def word_rows(self, keys: DataFrame, key: str) -> DataFrame:
        """One row per non-zero word: ``word``, ``bits``."""
        mask = F.lit(0).cast("bigint")
        for k in range(4):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), self._bit(F.col(key), k)))
        return keys.select(self._word(F.col(key)).alias("word"), mask.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def might_contain(self, words: Column, key: Column) -> Column:
        """Bit after bit: most keys that are not there fail the first."""
        test = None
        for k in range(4):
            hit = F.call_function("shiftrightunsigned", F.get(words, self._word(key)), self._bit(key, k)).bitwiseAND(F.lit(1).cast("bigint")) == F.lit(1).cast("bigint")
            test = hit if test is None else test & hit
        return test
