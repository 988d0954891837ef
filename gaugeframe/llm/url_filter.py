"""Exact block-list membership of page URLs by a cascade of Bloom filters.

The cascade's first filter encodes the listed keys.  The second encodes those
keys of the corpus that the first passes wrongly, the third the listed keys
that the second passes, and so on until a level has nothing left to encode.
As the levels are built over the complete key universe of the corpus, the
number of filters that a key passes in a row tells exactly whether it is
listed; the pages themselves are never joined with the list.

Everything runs in DataFrame functions.  A cascade of up to ``max_bits`` bits
is a constant in the plan.  A larger one is split by a hash of the key into
shards of bounded size, one row each, and pages meet their shard's row in an
equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import BloomShape, literal_words
from .storage import materialise, table

#: Bits of a cascade that may be a constant in the plan (1 MiB); larger cascades are sharded.
MAX_BITS = 1 << 23
#: Rate of false hits of the levels after the first: their bits add up to about as many as at one half, in a quarter of the levels.
LATER_RATE = 1 / 16
#: A cascade deeper than this means equal keys on both sides, which the key preparation excludes.
MAX_LEVELS = 60


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query, as given.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = F.coalesce(at, F.lit(0)) > 0
    host = F.when(known, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (by host, then path length if equally long); null if none fits.

    The rules are a short hand-written list and become one CASE expression.
    """
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (text, verdict) if text is not None else (none, none)


@dataclass(frozen=True)
class Cascade:
    """Filters of alternating meaning; level 0 encodes listed keys."""

    shapes: tuple[BloomShape, ...]
    shards: int
    #: One array column of longs per level: constants (one shard), or columns of ``rows``.
    words: tuple[Column, ...]
    rows: DataFrame | None

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.shards)).cast("int")

    def listed(self, pages: DataFrame, key: Column, name: str) -> DataFrame:
        """``pages`` with an exact boolean column ``name``, for keys of the universe."""
        if self.rows is not None:
            kept = pages.columns
            joined = pages.withColumn("_gf_shard", self.shard(key)).join(self.rows, "_gf_shard", "left")
            return joined.withColumn(name, self._verdict(key)).select(*[f"`{c}`" for c in kept if c != name], name)
        return pages.withColumn(name, self._verdict(key))

    def _verdict(self, key: Column) -> Column:
        out = F.lit(len(self.shapes) % 2 == 1)  # a key that passes every level is of the kind that the last one encodes
        for level in reversed(range(len(self.shapes))):
            hit = F.coalesce(self.shapes[level].might_contain(self.words[level], key), F.lit(False))
            out = F.when(hit, out).otherwise(F.lit(level % 2 == 1))
        return out


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
    """Cascade over the ``key`` columns of ``universe`` and ``listed``.

    Null keys take no part; repeated keys count once; listed keys need not be
    in the universe.  An empty list gives a cascade without levels, which
    lists nothing.
    """
    keys = materialise(
        universe.select("key", F.lit(0).alias("is_listed"))
        .unionByName(listed.select("key", F.lit(1).alias("is_listed")))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg((F.max("is_listed") == 1).alias("is_listed"))
    )
    n = {r["is_listed"]: r["count"] for r in keys.groupBy("is_listed").count().collect()}
    inside, outside = n.get(True, 0), n.get(False, 0)
    first_rate = min(0.5, max(1e-4, math.sqrt(0.5) * inside / max(1, outside)))
    # later levels add about as many bits again as the first
    shards = max(1, math.ceil(2 * 64 * BloomShape.sized(inside, first_rate).words / max_bits))
    shard = F.pmod(F.xxhash64(F.lit(-1), F.col("key")), F.lit(shards)).cast("int")
    keys = keys.withColumn("_gf_shard", shard)

    shapes: list[BloomShape] = []
    words: list[Column] = []
    rows = None
    # a level encodes the keys of its own side that have passed every filter so far; sides take turns
    sides = [keys.filter("is_listed").select("key", "_gf_shard"), keys.filter("NOT is_listed").select("key", "_gf_shard")]
    while True:
        level = len(shapes)
        encoded = sides[level % 2]
        if level:
            s, w = shapes[-1], words[-1]  # keys have passed the earlier ones already
            if rows is not None:
                encoded = encoded.join(rows, "_gf_shard", "left")
            encoded = encoded.filter(F.coalesce(s.might_contain(w, F.col("key")), F.lit(False))).select("key", "_gf_shard")
            sides[level % 2] = encoded = materialise(encoded)
        largest = encoded.groupBy("_gf_shard").count().agg(F.max("count")).first()[0] or 0
        if largest == 0:
            break
        if level >= MAX_LEVELS:
            raise RuntimeError("the cascade does not end; are keys on both sides equal?")
        shape = BloomShape.sized(largest, first_rate if level == 0 else LATER_RATE, seed=level)
        if shards == 1:
            words.append(literal_words(shape.word_rows(encoded, "key").collect(), shape.words))
        else:
            # a shard's words are bounded by max_bits, so they fit one row; zero rows stand for words without bits
            none = encoded.select("_gf_shard").distinct().select("_gf_shard", F.explode(F.sequence(F.lit(0), F.lit(shape.words - 1))).alias("word"), F.lit(0).cast("bigint").alias("bits"))
            filled = shape.word_rows(encoded, "key", "_gf_shard").unionByName(none).groupBy("_gf_shard", "word").agg(F.bit_or("bits").alias("bits"))
            at = f"_gf_w{level}"
            dense = filled.groupBy("_gf_shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias(at))
            rows = materialise(dense if rows is None else rows.join(dense, "_gf_shard", "full"))
            words.append(F.col(at))
        shapes.append(shape)
    return Cascade(tuple(shapes), shards, tuple(words), rows)


def judge_urls(pages: DataFrame, blocked: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``listed``.

    ``blocked`` has the block list's ``url`` column.  The verdict is the
    longest fitting rule's, else ``block`` for a listed host and path and
    ``allow`` for any other.  Null and malformed URLs have an empty host and
    path and are allowed; very long URLs are read whole; repeated rows are
    judged alike; empty tables give empty results; columns of ``pages`` with
    the names of added columns are replaced, all others stay.
    """

    def keyed(df: DataFrame, column: str) -> DataFrame:
        host, path = url_parts(F.col(f"`{column}`"))
        return df.select(F.concat(host, path).alias("key")).filter("key <> ''")

    host, path = url_parts(F.col(f"`{url}`"))
    cascade = build_cascade(keyed(pages, url), keyed(blocked, "url"), max_bits)
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.withColumns({"host": host, "path": path})
    return cascade.listed(parsed, F.concat("host", "path"), "listed").withColumns({"rule": text, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))})


def toxic_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's block list: URLs whose path ends in the number of a document labelled toxic."""
    _, path = url_parts(F.col("url"))
    numbered = pages.select("url", F.regexp_extract(path, r"/(\d{1,18})(?:\.html)?/?$", 1).try_cast("bigint").alias("doc_id"))
    return numbered.join(labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge_urls(pages, toxic_urls(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE_SQL = r"""
WITH part AS (
  SELECT page_id, url, position('://' IN url) AS colon, substr(url, position('://' IN url) + 3) AS rest FROM pages
), cut AS (
  SELECT page_id,
    CASE WHEN coalesce(colon, 0) > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN coalesce(colon, 0) > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM part
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), listed AS (
  SELECT DISTINCT host || path AS key FROM cut
  WHERE host || path <> '' AND try_cast(regexp_extract(path, '/(\d{1,18})(?:\.html)?/?$', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)
)
SELECT c.page_id, c.host, c.path, f.rule,
  coalesce(f.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.key IS NOT NULL AS listed
FROM cut c LEFT JOIN fit f USING (page_id) LEFT JOIN listed l ON l.key = c.host || c.path
"""
