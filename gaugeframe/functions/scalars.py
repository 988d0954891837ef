"""Column expressions shared by all operators; each is safe under ANSI mode."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing value in text tables (fixed values).
MISSING_TOKENS = ("", "NA", "N/A", "None", "null")


def null_if_missing(c: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """Null for the tokens of a source that mean a missing value."""
    return F.when(~c.isin(*tokens), c)


def finite(c: Column) -> Column:
    """Whether a number is neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def parse_number(c: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """A finite double from text, null otherwise."""
    x = null_if_missing(F.trim(c), tokens).try_cast("double")
    return F.when(finite(x), x)


def parse_flag(c: Column) -> Column:
    """Booleans written exactly as True or False; null for anything else."""
    return F.when(c == "True", True).when(c == "False", False)


def round_even(c: Column, digits: int = 3) -> Column:
    """Round half to even on the scaled value, as numpy does."""
    s = 10.0**digits
    return F.rint(c * s) / s


def nearest_second(ts: Column) -> Column:
    """Whole seconds since 1970, the nearest ones (halves to even), as SQL's cast of an epoch gives them; ``unix_timestamp`` cuts instead."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("bigint")


def unit_hash(seed: Column | str, key: Column) -> Column:
    """A number in [0, 1): the first 64 bits of sha256("seed:key") over 2**64."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    digits = F.substring(F.sha2(F.concat(seed, F.lit(":"), key).cast("binary"), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def opaque_id(salt: str, *keys: Column) -> Column:
    """An id that carries no order of its source; the same in every run of the same salt."""
    return F.sha2(F.concat_ws("\u001f", F.lit(salt), *keys).cast("binary"), 256)


def close(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """|a - b| within an absolute or a relative tolerance; null if either is null."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def ratio(a: Column, b: Column) -> Column:
    """Double quotient, null for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def significant(c: Column, digits: int = 3) -> Column:
    """Round to significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, 0.0).otherwise(F.round(c * scale) / scale)


def dollars_up(rate: Column, count: Column, hours: Column) -> Column:
    """Price in cents precision, rounded up."""
    return (F.ceil(rate.cast("decimal(18,4)") * count.cast("decimal(10,0)") * hours.cast("decimal(10,4)") * 100) / 100).cast("decimal(18,2)")


def hours(value: Column, unit: Column) -> Column:
    """Durations in hours from seconds, minutes, hours or days."""
    return F.when(unit == "second", value / 3600).when(unit == "minute", value / 60).when(unit == "hour", value).when(unit == "day", value * 24)


def scrub(c: Column) -> Column:
    """Tabs and line breaks as spaces, for one-line fields."""
    return F.translate(c, "\t\n\r", "   ")


def slug(c: Column) -> Column:
    """Characters other than letters, digits and ``: . _ -`` as hyphens."""
    return F.regexp_replace(c, r"[^A-Za-z0-9:._-]", "-")


def normal_text(c: Column) -> Column:
    """Lower case; runs of other characters than letters and digits as one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def composite_count(*keys: Column) -> Column:
    """Distinct combinations of keys, where a null is a value like any other."""
    return F.count_distinct(F.struct(*keys))
