"""Which records belong to which keys, as bitmaps of numbers.

Members are numbered once; a key's members are bits of bitmaps of 32,768 numbers
each, one row per key and bucket that has any.  So a key with a third of all
members is many rows of four kilobytes rather than one list, and unions and
sizes are aggregates that combine before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered


def dictionary(edges: DataFrame, member: str) -> DataFrame:
    """``member, number``: the distinct members by their order, from 1; nulls have none."""
    return numbered(edges.select(member).filter(F.col(member).isNotNull()).distinct(), [F.col(member)], "number")


def bitmaps(edges: DataFrame, keys: Sequence[str], member: str, numbers: DataFrame) -> DataFrame:
    """``keys, bucket, bits``: the members of every key; repeated edges count once, and edges without a member not at all."""
    found = edges.select(*keys, member).join(numbers, member)
    return found.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def unions(maps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``groups, bucket, bits``: the members of any key of each group; ``groups`` are columns of ``maps``."""
    return maps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def shared(maps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``groups, bucket, bits``: the members of all keys of each group."""
    keys = maps.select(*groups, *[c for c in maps.columns if c not in (*groups, "bucket", "bits")])
    wanted = keys.distinct().groupBy(*groups).agg(F.count("*").alias("_keys"))
    together = maps.groupBy(*groups, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n"))
    same = [F.col(f"w.{g}").eqNullSafe(F.col(f"t.{g}")) for g in groups]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    # a key without a row in the bucket has none of its members
    return together.alias("t").join(wanted.alias("w"), condition).filter("_n = _keys AND bitmap_count(bits) > 0").select(*[F.col(f"t.{g}").alias(g) for g in groups], "bucket", "bits")


def sizes(maps: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """``keys`` and the number of their members; the bitmaps of one key must not overlap."""
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def listed(maps: DataFrame, keys: Sequence[str], numbers: DataFrame, member: str) -> DataFrame:
    """``keys, member``: one row per member of every key again."""
    # a bit is told by its byte and place; in this encoding ascii() gives the byte
    byte = F.ascii(F.decode(F.expr("substring(bits, CAST(_at DIV 8 AS INT) + 1, 1)"), "ISO-8859-1"))
    at = maps.select(*keys, "bucket", "bits", F.explode(F.sequence(F.lit(0), F.length("bits") * 8 - 1)).alias("_at"))
    held = at.filter(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_at % 8 AS INT))")) != 0)
    return held.select(*keys, ((F.col("bucket") - 1) * 32768 + F.col("_at") + 1).alias("number")).join(numbers, "number").select(*keys, member)
