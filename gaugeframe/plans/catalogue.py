"""The library's operators as queries over the example tables, each with its SQL for DuckDB.

Every query reads its whole tables.  Doubles are rounded to six digits on both
sides, as engines add in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detectors, scalars, sequence
from ..operators import boosting, features, graph, heads, intervals, joins, membership, metrics, overlap, ranking, records, resample, splits
from ..sources import indexed
from ..storage import shared_folder
from ..storage import table as t
from ..streaming import events as event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """All documents; quality is the label, the text's length the score (with ties)."""
    return t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")


_RANKED = """
WITH s AS (SELECT d.doc_id, d.lang, d.source, l.quality AS y, d.n_chars AS x FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY {p} ORDER BY x) + (count(*) OVER (PARTITION BY {p}, x) - 1) / 2.0e0 AS r,
  sum(y) OVER (PARTITION BY {p} ORDER BY x DESC) AS tp, count(*) OVER (PARTITION BY {p} ORDER BY x DESC) AS k FROM s),
m AS (SELECT {p} AS g, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS prevalence,
  CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * (count(*) - sum(y))), 6) END AS auroc,
  CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round(avg(CASE WHEN y = 1 THEN tp / k::DOUBLE END), 6) END AS average_precision FROM r GROUP BY 1)
"""


@query(
    _RANKED.format(p="1 = 1")
    + """, top AS (SELECT y FROM s ORDER BY x DESC, sha256(doc_id::VARCHAR) LIMIT 100)
SELECT n, positives, prevalence, auroc, average_precision,
  (SELECT round(avg(y), 6) FROM top) AS precision_at, (SELECT round(sum(y) / (SELECT sum(y) FROM s)::DOUBLE, 6) FROM top) AS recall_at,
  (SELECT count(*) FROM documents) AS denominator, n AS scored, (SELECT count(*) FROM documents) - n AS unscored FROM m"""
)
def point_metrics(spark, d):
    return metrics.point_metrics(labelled(spark, d), "quality", "n_chars", "doc_id", 100)


@query(_RANKED.format(p="lang") + "SELECT g AS lang, n, positives, prevalence, auroc, average_precision FROM m")
def point_metrics_by_stratum(spark, d):
    return metrics.ranking_metrics(labelled(spark, d), "quality", "n_chars", ["lang"])


@query("""
SELECT CASE WHEN l.doc_id IS NULL THEN 'missing_prediction' ELSE 'scored' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def coverage_reconcile(spark, d):
    rows = t(spark, d, "documents").select("doc_id")
    p = t(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return joins.scored_rows(rows, p, "doc_id").groupBy(F.coalesce("reason", F.lit("scored")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def unknown_ids(spark, d):
    return joins.unknown(t(spark, d, "pages").select("page_id"), t(spark, d, "labels").select(F.col("doc_id").alias("page_id")), "page_id")


@query("""
WITH r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0e0 AS ra,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0e0 AS rb FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg((l_quantity - l_extendedprice) * (l_quantity - l_extendedprice)), 2) AS mse, round(avg(abs(l_quantity - l_extendedprice)), 2) AS mae,
  round(corr(l_extendedprice, l_quantity), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY 1""")
def spearman_pearson_mse_mae(spark, d):
    x = t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    m = metrics.regression_metrics(x, "l_extendedprice", "l_quantity", ["l_returnflag"]).join(metrics.spearman(x, "l_extendedprice", "l_quantity", ["l_returnflag"]), "l_returnflag")
    return m.withColumns({"mse": F.round("mse", 2), "mae": F.round("mae", 2)})


@query("SELECT o_orderstatus, NULL::DOUBLE AS pearson FROM orders GROUP BY 1")
def constant_correlation_is_null(spark, d):
    x = t(spark, d, "orders").select("o_orderstatus", "o_totalprice").withColumn("c", F.lit(1.0))
    return metrics.regression_metrics(x, "o_totalprice", "c", ["o_orderstatus"]).select("o_orderstatus", "pearson")


@query("""
WITH s AS (SELECT d.lang, l.quality AS y, d.n_chars AS x FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, median(x) AS m FROM s GROUP BY 1),
k AS (SELECT s.lang, sum((x >= m AND y = 1)::INT)::DOUBLE AS tp, sum((x >= m AND y = 0)::INT)::DOUBLE AS fp, sum((x < m AND y = 1)::INT)::DOUBLE AS fn, sum((x < m AND y = 0)::INT)::DOUBLE AS tn FROM s JOIN c USING (lang) GROUP BY 1)
SELECT lang, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM k""")
def mcc_at_median(spark, d):
    return metrics.mcc_at_median(labelled(spark, d), "quality", "n_chars", ["lang"])


@query("""
WITH g AS (SELECT lang, CASE WHEN contains(text, 'ó') OR contains(text, 'ñ') THEN 'es' WHEN contains(text, 'ß') OR contains(text, 'ü') THEN 'de' WHEN contains(text, 'è') OR contains(text, 'ê') THEN 'fr' ELSE 'en' END AS guess FROM documents),
c AS (SELECT class, sum(s) AS s, sum(k) AS k, sum(h) AS h FROM (SELECT lang AS class, 1 AS s, 0 AS k, (lang = guess)::INT AS h FROM g UNION ALL SELECT guess, 0, 1, 0 FROM g) GROUP BY 1),
f AS (SELECT *, coalesce(2.0e0 * h / nullif(s + k, 0), 0) AS f1 FROM c)
SELECT sum(s)::BIGINT AS n, round(sum(h) / sum(s)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * s) / sum(s)::DOUBLE, 6) AS f1_weighted FROM f""")
def accuracy_f1(spark, d):
    def has(*letters):
        c = F.contains("text", F.lit(letters[0]))
        for x in letters[1:]:
            c = c | F.contains("text", F.lit(x))
        return c

    guess = F.when(has("ó", "ñ"), "es").when(has("ß", "ü"), "de").when(has("è", "ê"), "fr").otherwise("en")
    return metrics.class_metrics(t(spark, d, "documents").select("lang", guess.alias("guess")), "lang", "guess")


@query("""
WITH g AS (SELECT p_brand, p_size, p_retailprice - min(p_retailprice) OVER (PARTITION BY p_brand) AS g FROM part),
r AS (SELECT p_brand, avg(g) OVER (PARTITION BY p_brand, p_size) / log2(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + 1) AS a, g / log2(row_number() OVER (PARTITION BY p_brand ORDER BY g DESC) + 1) AS i FROM g)
SELECT p_brand, round(sum(a) / nullif(sum(i), 0), 6) AS ndcg FROM r GROUP BY 1""")
def ndcg_full(spark, d):
    return metrics.ndcg_full(t(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), "p_retailprice", "p_size", ["p_brand"])


@query("""
WITH b AS (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) OVER (PARTITION BY p_brand) AS hi, floor(count(*) OVER (PARTITION BY p_brand) * 0.1e0) AS k FROM part),
g AS (SELECT *, coalesce((p_retailprice - lo) / nullif(hi - lo, 0), 0) AS g FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r, row_number() OVER (PARTITION BY p_brand ORDER BY g DESC, p_partkey) AS j FROM g)
SELECT p_brand, round(sum(CASE WHEN r <= k THEN g / log2(r + 1) ELSE 0 END) / nullif(sum(CASE WHEN j <= k THEN g / log2(j + 1) ELSE 0 END), 0), 6) AS ndcg_top FROM r GROUP BY 1""")
def ndcg_top10pct(spark, d):
    return metrics.ndcg_top(t(spark, d, "part"), "p_retailprice", "p_size", "p_partkey", by=["p_brand"])


@query("""
WITH c AS (SELECT p_brand, quantile_cont(p_retailprice, 0.9) AS a, quantile_cont(p_size::DOUBLE, 0.9) AS b FROM part GROUP BY 1)
SELECT p_brand, round(sum((p_retailprice >= a AND p_size >= b)::INT) / nullif(sum((p_retailprice >= a)::INT), 0)::DOUBLE, 6) AS top_recall FROM part JOIN c USING (p_brand) GROUP BY 1""")
def top_recall(spark, d):
    return metrics.top_recall(t(spark, d, "part"), "p_retailprice", "p_size", by=["p_brand"])


def _turns(spark, d):
    return metrics.paired_differences(t(spark, d, "conversations").select("conv_id", "role", F.length("text").alias("n")), "conv_id", "role", "n", "user", "assistant")


_TURNS = """WITH p AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN length(text) END) - max(CASE WHEN role = 'assistant' THEN length(text) END) AS d0 FROM conversations GROUP BY 1),
p2 AS (SELECT conv_id, d0::DOUBLE AS d FROM p WHERE d0 IS NOT NULL)"""


@query(
    _TURNS
    + """SELECT count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d, 0.05), 6) AS p05, round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.95), 6) AS p95,
round(avg((d > 0)::INT), 6) AS sign_accuracy, sum((d = 0)::INT)::BIGINT AS tied FROM p2"""
)
def paired_difference_stats(spark, d):
    return metrics.difference_stats(_turns(spark, d))


@query(
    _TURNS
    + """, z AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0e0 AS r FROM p2 WHERE d <> 0),
c AS (SELECT sum(m * m * m - m)::DOUBLE AS t FROM (SELECT count(*) AS m FROM z GROUP BY abs(d)))
SELECT count(*) AS n, (SELECT sum((d = 0)::INT)::BIGINT FROM p2) AS zeros, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 6) AS statistic, round(count(*) * (count(*) + 1) / 4.0e0, 6) AS mean,
round(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0e0 - (SELECT t FROM c) / 48, 6) AS variance FROM z"""
)
def wilcoxon_large_n(spark, d):
    return metrics.wilcoxon_terms(_turns(spark, d))


@query("""
WITH a AS (SELECT s_nationkey, n_regionkey, round_even(s_acctbal / 7, 3) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT s_nationkey, n_regionkey, avg(v) AS v FROM a GROUP BY 1, 2), c AS (SELECT n_regionkey, avg(v) AS v FROM b GROUP BY 1)
SELECT round_even(avg(v), 3) AS value FROM c""")
def two_level_mean(spark, d):
    s = t(spark, d, "supplier").join(F.broadcast(t(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    s = s.select("s_nationkey", "n_regionkey", (F.col("s_acctbal") / 7).alias("value"))
    return metrics.nested_mean(s, "value", [["s_nationkey", "n_regionkey"], ["n_regionkey"], []])


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT s_suppkey AS id, s_nationkey AS k, floor(s_acctbal / 100)::BIGINT AS b FROM supplier),
e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM n x JOIN n y ON x.k = y.k OR x.b = y.b),
r AS (SELECT id, id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT id AS supplier, min(c) AS component FROM r GROUP BY 1""")
def group_components(spark, d):
    s = t(spark, d, "supplier").select(F.format_string("%020d", F.col("s_suppkey")).alias("supplier"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("band"))
    g = graph.key_groups(s, "supplier", ["nation", "band"])
    return g.select(F.col("supplier").cast("bigint").alias("supplier"), F.col("component").cast("bigint").alias("component"))


@query("SELECT count(DISTINCT (s_nationkey, floor(s_acctbal / 100)::BIGINT)) AS naive, count(DISTINCT s_nationkey) AS nations FROM supplier")
def naive_key_count(spark, d):
    s = t(spark, d, "supplier")
    return s.agg(scalars.composite_count(F.col("s_nationkey"), F.floor(F.col("s_acctbal") / 100)).alias("naive"), F.count_distinct("s_nationkey").alias("nations"))


_HOLDOUT = """
WITH b AS (SELECT d.source, l.quality AS y FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT source, count(*) AS n, sum(y) AS p FROM b GROUP BY 1),
u AS (SELECT g.*, r.restart, coalesce(sum(n) OVER (PARTITION BY restart ORDER BY sha256('0:' || restart || ':' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g, range(20) r(restart)),
v AS (SELECT *, before < (SELECT count(*) FROM b) * 0.3e0 AS test FROM u),
best AS (SELECT restart FROM v WHERE test GROUP BY 1 ORDER BY abs(sum(p) / sum(n)::DOUBLE - (SELECT avg(y) FROM b)), restart LIMIT 1),
h AS (SELECT source, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM v WHERE restart = (SELECT restart FROM best))
"""


def _held(spark, d):
    rows = labelled(spark, d).filter("quality IS NOT NULL")
    return rows, splits.holdout_groups(rows, "source", "quality", 0.3, 20)


@query(_HOLDOUT + "SELECT source, split FROM h")
def group_holdout(spark, d):
    return _held(spark, d)[1]


@query(_HOLDOUT + "SELECT split, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 5) AS prevalence, count(DISTINCT source) AS groups FROM b JOIN h USING (source) GROUP BY 1")
def split_manifest(spark, d):
    rows, held = _held(spark, d)
    return splits.arms(rows.join(held, "source"), "source", "quality")


@query("""
WITH z AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS groups, max(size) AS largest, sum((size = 1)::INT)::BIGINT AS singletons, (SELECT size FROM z ORDER BY size LIMIT 1 OFFSET (SELECT count(*) // 2 FROM z)) AS upper_median FROM z""")
def group_size_profile(spark, d):
    return splits.group_sizes(t(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (b IS NULL) AS only_first, count(*) FILTER (a IS NULL) AS only_second FROM (SELECT doc_id AS a FROM labels) x FULL JOIN (SELECT page_id AS b FROM pages) y ON a = b")
def compare_common_subset(spark, d):
    return joins.overlap_counts(t(spark, d, "labels").select("doc_id"), t(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages INTERSECT SELECT vec_id FROM embeddings")
def method_intersection(spark, d):
    parts = [t(spark, d, n).select(F.col(c).alias("doc_id")) for n, c in (("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"), ("embeddings", "vec_id"))]
    return joins.common(parts, "doc_id")


@query("""
WITH b AS (SELECT p_partkey, CASE WHEN p_size <= 2 THEN 'canonical' WHEN p_size <= 10 THEN 'near' WHEN p_size <= 30 THEN 'proximal' ELSE 'distal' END AS band, (p_retailprice > 1500)::INT AS y, p_size AS x FROM part)
SELECT band, count(*) AS n, sum(y)::BIGINT AS positives, round(sum(y) / nullif(sum(sum(y)) OVER (), 0)::DOUBLE, 6) AS share_of_positives, greatest(1, round_even(100.0e0 * count(*) / sum(count(*)) OVER (), 0)::INT)::INT AS capacity FROM b GROUP BY 1""")
def bands_and_capacity(spark, d):
    band = F.when(F.col("p_size") <= 2, "canonical").when(F.col("p_size") <= 10, "near").when(F.col("p_size") <= 30, "proximal").otherwise("distal")
    rows = t(spark, d, "part").select("p_partkey", band.alias("band"), (F.col("p_retailprice") > 1500).cast("int").alias("y"), F.col("p_size").cast("double").alias("x"))
    return resample.band_metrics(rows, "band", "y", "x", "p_partkey", 100).select("band", "n", "positives", "share_of_positives", "capacity")


@query("""
WITH r AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
c AS (SELECT p_brand, p_size AS cutoff FROM r WHERE i = least(20, n))
SELECT p_brand, cutoff, sum((p_size > cutoff)::INT)::BIGINT AS above, sum((p_size = cutoff)::INT)::BIGINT AS tied, least(20, count(*)) - sum((p_size > cutoff)::INT)::BIGINT AS filled_from_ties FROM part JOIN c USING (p_brand) GROUP BY 1, 2""")
def tie_summary(spark, d):
    return metrics.tie_summary(t(spark, d, "part").select("p_brand", "p_size"), "p_size", 20, ["p_brand"])


@query("""
WITH b AS (SELECT d.source, l.quality AS y, d.n_chars::DOUBLE AS x FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM b)), n AS (SELECT count(*) AS n FROM g),
dr AS (SELECT r.draw, s.i AS slot, ('0x' || substr(sha256('0:' || r.draw || ':' || s.i), 1, 12))::BIGINT % (SELECT n FROM n) AS pick FROM range(40) r(draw), g s),
z AS (SELECT dr.draw, b.y, b.x FROM dr JOIN g ON g.i = dr.pick JOIN b USING (source)),
k AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY x) + (count(*) OVER (PARTITION BY draw, x) - 1) / 2.0e0 AS r FROM z)
SELECT draw, count(*) AS n, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * (count(*) - sum(y))), 6) END AS auroc FROM k GROUP BY 1""")
def group_bootstrap(spark, d):
    rows = labelled(spark, d).filter("quality IS NOT NULL").select("source", "quality", F.col("n_chars").cast("double").alias("x"))
    drawn = resample.weighted_draws(rows, "source", ["quality", "x"], 40)
    return metrics.ranking_metrics(drawn, "quality", "x", ["draw"], weight="weight").select("draw", "n", "auroc")


@query("""
WITH b AS (SELECT d.source, l.quality AS y, d.n_chars::DOUBLE AS x FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM b)), n AS (SELECT count(*) AS n FROM g),
dr AS (SELECT r.draw, s.i AS slot, ('0x' || substr(sha256('0:' || r.draw || ':' || s.i), 1, 12))::BIGINT % (SELECT n FROM n) AS pick FROM range(40) r(draw), g s),
z AS (SELECT dr.draw, b.y, b.x FROM dr JOIN g ON g.i = dr.pick JOIN b USING (source) UNION ALL SELECT -1, y, x FROM b),
k AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY x) + (count(*) OVER (PARTITION BY draw, x) - 1) / 2.0e0 AS r FROM z),
a AS (SELECT draw, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * (count(*) - sum(y))) END AS auroc FROM k GROUP BY 1),
d AS (SELECT draw, 1 - 2 * auroc AS delta FROM a)
SELECT (SELECT round(delta, 6) FROM d WHERE draw = -1) AS observed, CASE WHEN 40 - count(delta) <= 2 THEN round(quantile_cont(delta, 0.025), 6) END AS low, CASE WHEN 40 - count(delta) <= 2 THEN round(quantile_cont(delta, 0.975), 6) END AS high,
  count(delta) AS used, 40 - count(delta) AS skipped, 40 - count(delta) > 2 AS refused FROM d WHERE draw >= 0""")
def paired_bootstrap_interval(spark, d):
    rows = labelled(spark, d).filter("quality IS NOT NULL").withColumns({"a": F.col("n_chars").cast("double"), "b": -F.col("n_chars").cast("double")})
    return resample.paired_bootstrap(rows, "source", "quality", "a", "b", 40)


@query("""
WITH w AS (SELECT substr(lower(text), i::INT, 3) AS ngram FROM benchmark, range(1, 100000) r(i) WHERE i <= length(text) - 2)
SELECT ngram, count(*) AS n FROM w GROUP BY 1""")
def ngram_counts(spark, d):
    return t(spark, d, "benchmark").select(F.explode(sequence.windows(F.lower("text"), 3)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


_BASES = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _bases(text):
    return F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


@query(f"""
WITH s AS (SELECT item_id, {_BASES} AS s FROM benchmark), w AS (SELECT item_id, substr(s, i::INT, 2) AS k FROM s, range(1, 100000) r(i) WHERE i <= length(s) - 1),
f AS (SELECT item_id, k, count(*) AS n FROM w WHERE regexp_full_match(k, '[ACGT]+') GROUP BY 1, 2), v AS (SELECT a || b AS k FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(a), (VALUES ('A'), ('C'), ('G'), ('T')) y(b))
SELECT s.item_id, v.k AS kmer, round(coalesce(f.n / (sum(coalesce(f.n, 0)) OVER (PARTITION BY s.item_id))::DOUBLE, 0), 6) AS share FROM s CROSS JOIN v LEFT JOIN f ON f.item_id = s.item_id AND f.k = v.k""")
def kmer_frequency(spark, d):
    words = sequence.words_of("ACGT", 2)
    return sequence.kmer_table(t(spark, d, "benchmark").select("item_id", _bases("text").alias("s")), "item_id", "s", words)


@query(f"""
WITH s AS (SELECT doc_id, {_BASES} AS s FROM documents)
SELECT doc_id, round(ln(1 + length(s)), 6) AS log_length, {", ".join(f"round(coalesce((length(s) - length(replace(s, '{c}', ''))) / nullif(length(s), 0)::DOUBLE, 0), 6) AS share_{c.lower()}" for c in "ACGT")},
round(coalesce(length(regexp_replace(s, '[ACGT]', '', 'g')) / nullif(length(s), 0)::DOUBLE, 0), 6) AS share_other FROM s""")
def composition_vector(spark, d):
    c = t(spark, d, "documents").select("doc_id", sequence.composition(_bases("text"), "ACGT").alias("v"))
    return c.select("doc_id", *[F.col("v")[i].alias(n) for i, n in enumerate(("log_length", "share_a", "share_c", "share_g", "share_t", "share_other"))])


@query(f"""
WITH s AS (SELECT item_id, {_BASES} AS s FROM benchmark), r AS (SELECT item_id, s, reverse(translate(s, 'ACGT', 'TGCA')) AS rc FROM s)
SELECT item_id, rc, (SELECT count(*) FROM range(1, length(s) + 1) q(i) WHERE substr(s, i::INT, 1) <> substr(rc, i::INT, 1)) AS mismatches FROM r""")
def revcomp_mismatch(spark, d):
    b = t(spark, d, "benchmark").select("item_id", _bases("text").alias("s")).withColumn("rc", sequence.reverse_complement(F.col("s")))
    return b.select("item_id", "rc", F.size(sequence.mismatches(F.col("s"), F.col("rc"))).cast("bigint").alias("mismatches"))


@query("""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]')) AS x FROM documents)
SELECT doc_id, max(length(x)) AS longest, sum(greatest(0, length(x) - 4))::BIGINT AS n FROM p GROUP BY 1""")
def valid_windows(spark, d):
    s = F.lower("text")
    return t(spark, d, "documents").select("doc_id", sequence.longest_run(s, "a-z").cast("bigint").alias("longest"), sequence.valid_windows(s, "a-z", 5).cast("bigint").alias("n"))


@query("SELECT doc_id, round(('0x' || substr(sha256('7:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0e0, 6) AS score FROM documents")
def hash_score(spark, d):
    return t(spark, d, "documents").select("doc_id", scalars.unit_hash("7", F.col("doc_id").cast("string")).alias("score"))


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 10")
def ordinal_limit_per_split(spark, d):
    return splits.first_of_split(t(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 10)


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('13:' || doc_id), doc_id) <= 16")
def stratified_hash_sample(spark, d):
    return ranking.stratified_hash_sample(t(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 16, "13")


@query("""
WITH i AS (SELECT user_id, epoch(min(ts))::BIGINT AS a, epoch(max(ts))::BIGINT AS b FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, count(*) AS n FROM events e JOIN i ON i.user_id = e.user_id AND epoch(e.ts)::BIGINT BETWEEN a AND b GROUP BY 1""")
def interval_join(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", scalars.nearest_second(F.col("ts")).alias("at"))
    spans = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    return intervals.point_in_interval(e.select("user_id", "at"), spans, "at", "a", "b", ["user_id"], width=86400).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, sum((p IS NOT NULL AND ts <= p + INTERVAL 1 HOUR)::INT)::BIGINT AS n FROM e GROUP BY 1""")
def adjacent_overlap(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 3_600_000_000)
    return intervals.overlaps_before(e, "user_id", "a", "b", "event_id").groupBy("user_id").agg(F.count_if("overlaps").alias("n"))


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'NA') AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def eligibility_and_left_annotation(spark, d):
    o = t(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'").select("o_orderkey", F.col("o_custkey").alias("id"))
    c = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return joins.annotate(o, c, "id", F.col("segment")).select("o_orderkey", "segment")


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_path(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count("*").alias("n"))


@query("""
SELECT 'discount' AS rule, sum((l_discount > 0.05e0)::INT)::BIGINT AS n, min(CASE WHEN l_discount > 0.05e0 THEN l_orderkey END) AS example FROM lineitem
UNION ALL SELECT 'quantity', sum((l_quantity > 45)::INT)::BIGINT, min(CASE WHEN l_quantity > 45 THEN l_orderkey END) FROM lineitem
UNION ALL SELECT 'negative', sum((l_tax < 0)::INT)::BIGINT, min(CASE WHEN l_tax < 0 THEN l_orderkey END) FROM lineitem""")
def flag_counts_one_pass(spark, d):
    rules = {"discount": F.col("l_discount") > 0.05, "quantity": F.col("l_quantity") > 45, "negative": F.col("l_tax") < 0}
    return joins.violations(t(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_quantity", "l_tax"), rules, "l_orderkey")


@query("SELECT 0::BIGINT AS only_first, (SELECT count(*) FROM labels WHERE toxic = 1) AS only_second")
def multiset_difference(spark, d):
    x = t(spark, d, "labels").select("doc_id", "quality")
    again = x.unionByName(t(spark, d, "labels").filter("toxic = 1").select("doc_id", "quality")).repartition(7)
    return joins.multiset_differences(x, again)


@query("""
WITH o AS (SELECT 'n' AS metric, count(*)::DOUBLE AS v FROM labels UNION ALL SELECT 'prevalence', avg(quality) FROM labels), e(metric, expected, tolerance) AS (VALUES ('n', 399.0e0, 0.0e0), ('prevalence', 0.85e0, 0.02e0), ('absent', 1.0e0, 1.0e0))
SELECT metric, expected, round(v, 6) AS observed, coalesce(abs(v - expected) <= tolerance, false) AS ok FROM e LEFT JOIN o USING (metric)""")
def expected_value_checks(spark, d):
    x = t(spark, d, "labels").agg(F.count("*").cast("double").alias("n"), F.avg("quality").alias("prevalence"))
    observed = x.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("n", "prevalence")])).alias("m")).select("m.*")
    expected = spark.createDataFrame([("n", 399.0, 0.0), ("prevalence", 0.85, 0.02), ("absent", 1.0, 1.0)], "metric string, expected double, tolerance double")
    return joins.expected_checks(observed, expected)


@query("""
WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 0 THEN upper(n_name) || '!' ELSE n_name END AS v FROM nation WHERE n_nationkey > 4)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def full_outer_diff(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    changed = n.filter("k > 4").withColumn("v", F.when(F.col("k") % 7 == 0, F.concat(F.upper("v"), F.lit("!"))).otherwise(F.col("v")))
    return joins.differences(n.filter("k < 20"), changed, "k", "v")


@query("""
WITH p AS (SELECT p_brand, p_type, count(*) AS n, sum(p_retailprice) AS v FROM part GROUP BY 1, 2), q AS (SELECT p_brand || '/' || p_type AS key, p_brand, round(v, 2) AS value, round(v / n, 2) AS per_hour, n AS flags, CASE WHEN n >= 3 THEN 1 ELSE 2 END AS bucket FROM p)
SELECT key, bucket, row_number() OVER (ORDER BY bucket, CASE WHEN bucket = 1 THEN -coalesce(per_hour, 0) END NULLS FIRST, value DESC, flags DESC, key) AS place FROM q""")
def ranked_proposals(spark, d):
    p = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("flags"), F.sum("p_retailprice").alias("v"))
    q = p.select(F.concat_ws("/", "p_brand", "p_type").alias("key"), F.round("v", 2).alias("value"), F.round(F.col("v") / F.col("flags"), 2).alias("per_hour"), "flags", F.when(F.col("flags") >= 3, 1).otherwise(2).alias("bucket"))
    return records.proposals(q, "bucket", "value", "per_hour", "flags", "key").select("key", "bucket", "place")


@query("""
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
c AS (SELECT 'r' || r_regionkey AS root, dst AS node, 1 AS depth FROM region JOIN e ON src = 'r' || r_regionkey UNION ALL SELECT root, dst, depth + 1 FROM c JOIN e ON src = node)
SELECT root, node, min(depth) AS depth FROM c GROUP BY 1, 2""")
def closure_descendants(spark, d):
    def e(name, a, x, b, y):
        return t(spark, d, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))

    links = e("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(e("supplier", "n", "s_nationkey", "s", "s_suppkey")).unionByName(e("customer", "n", "c_nationkey", "c", "c_custkey"))
    return graph.closure(links, t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root")))


@query("""
SELECT s_nationkey, CASE min(CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal > 9000 THEN 1 WHEN s_acctbal > 5000 THEN 2 ELSE 3 END) WHEN 0 THEN 'debt' WHEN 1 THEN 'rich' WHEN 2 THEN 'well' ELSE 'plain' END AS reason FROM supplier GROUP BY 1""")
def best_reason_by_priority(spark, d):
    b = F.col("s_acctbal")
    return records.best_reason(t(spark, d, "supplier"), "s_nationkey", [("debt", b < 0), ("rich", b > 9000), ("well", b > 5000)], "plain")


@query("SELECT l_partkey, count(DISTINCT s_nationkey) AS studies FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) >= 2")
def shared_by_two(spark, d):
    x = t(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return records.seen_in_several(x, "l_partkey", "s_nationkey")


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def most_frequent_value(spark, d):
    return records.most_frequent(t(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("""
SELECT c_nationkey, count(DISTINCT c_mktsegment) AS studies, count(DISTINCT c_mktsegment) = 1 AS single_study, bool_and(c_mktsegment = 'BUILDING') AS no_independent FROM customer GROUP BY 1""")
def study_flags(spark, d):
    return records.study_flags(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_mktsegment", "BUILDING")


@query("SELECT s_suppkey, list_filter([CASE WHEN s_acctbal < 0 THEN 'debt' END, CASE WHEN s_nationkey < 5 THEN 'nation' END], lambda x: x IS NOT NULL) AS reasons, NOT (s_acctbal < 0 OR s_nationkey < 5) AS kept FROM supplier")
def screened_reasons(spark, d):
    return records.screened(t(spark, d, "supplier"), [("debt", F.col("s_acctbal") < 0), ("nation", F.col("s_nationkey") < 5)]).select("s_suppkey", "reasons", "kept")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def subjects_without_evidence(spark, d):
    return records.without_evidence(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""
WITH s AS (SELECT l_returnflag, l_quantity AS y, CASE WHEN ('0x' || substr(sha256('0:' || l_orderkey), 1, 12))::BIGINT % 100 < 30 THEN 'test' ELSE 'train' END AS split FROM lineitem)
SELECT round(avg(y), 6) AS mean, count(*) AS n, (SELECT l_returnflag FROM s WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS majority FROM s WHERE split = 'train'""")
def train_mean_and_majority(spark, d):
    x = t(spark, d, "lineitem").select("l_returnflag", "l_quantity", splits.hashed_split(F.col("l_orderkey"), "0").alias("split"))
    return joins.with_row(heads.training_mean(x, "split", "l_quantity"), heads.majority(x, "split", "l_returnflag").select(F.col("class").alias("majority")))


@query()
def ridge_probe(spark, d):
    x = t(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"), splits.hashed_split(F.col("vec_id"), "0").alias("split"))
    w, b = heads.ridge(heads.moments(x.filter("split = 'train'"), "embedding", "y"), 10.0)
    return heads.linear_scores(x.filter("split = 'test'"), "embedding", w, b).select("vec_id", "score")


@query()
def logistic_probe(spark, d):
    x = t(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"), splits.hashed_split(F.col("vec_id"), "0").alias("split"))
    return heads.logistic_probe(x.filter("split = 'train'"), x.filter("split = 'test'"), "embedding", "y", 1.0, True).select("vec_id", "score")


@query("SELECT doc_id, CASE WHEN n_chars > 50 THEN round(n_chars / 7.0e0, 6) END AS score, CASE WHEN n_chars <= 50 THEN 'too_short' END AS reason FROM documents")
def adapter_in_batches(spark, d):
    def adapter(batch):
        return [(k, n / 7, None) if n > 50 else (k, None, "too_short") for k, n in zip(batch["doc_id"], batch["n_chars"], strict=True)]

    return heads.score_in_batches(t(spark, d, "documents"), "doc_id", ["n_chars"], adapter)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    out = event_windows.windowed_counts(t(spark, d, "events"))
    return out.withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("""
WITH e AS (SELECT user_id, ts, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE AS cut FROM events), s AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    out = event_windows.sessions(t(spark, d, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal FROM events) SELECT user_id, event_id, ordinal FROM e""")
def source_ordinals(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "ts")
    return ranking.numbered(e, [F.col("ts"), F.col("event_id")], "place", ["user_id"]).select("user_id", "event_id", (F.col("place") - 1).alias("ordinal"))


@query("SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS id, 'n' || lpad((20 + n_nationkey % 5)::VARCHAR, 2, '0') AS resolved FROM nation")
def chain_resolution(spark, d):
    def name(k):
        return F.concat(F.lit("n"), F.lpad(k.cast("string"), 2, "0"))

    k = F.col("n_nationkey")
    return graph.resolve_chain(t(spark, d, "nation").select(name(k).alias("id"), F.when(k < 20, name(k + 5)).alias("next")))


@query("""
WITH p AS (SELECT least(abs(p_size - 10), abs(p_size - 30)) AS d FROM part)
SELECT CASE WHEN d <= 2 THEN 'canonical' WHEN d <= 10 THEN 'near' WHEN d <= 50 THEN 'proximal' ELSE 'distal' END AS band, count(*) AS n FROM p GROUP BY 1""")
def distance_bands(spark, d):
    band = intervals.distance_band(F.col("p_size"), F.lit(10), F.lit(30))
    return t(spark, d, "part").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT sha256(o_orderkey::VARCHAR) AS h FROM orders)
SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(h, 16, 15))::HUGEINT)::VARCHAR AS digest FROM h""")
def population_digest(spark, d):
    return joins.population_digest(t(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("""
SELECT o_orderkey, (ceil(o_totalprice::DECIMAL(18, 4) * 2 * 1.5 * 100) / 100)::DECIMAL(18, 2)::VARCHAR AS dollars, abs(o_totalprice - 100000) <= greatest(0.05e0 * greatest(abs(o_totalprice), 100000), 10) AS is_close,
  regexp_replace(o_orderpriority, '[^A-Za-z0-9:._-]', '-', 'g') AS slug, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS plain FROM orders""")
def scalar_conversions(spark, d):
    o = t(spark, d, "orders")
    p = F.col("o_totalprice")
    return o.select("o_orderkey", scalars.dollars_up(p, F.lit(2), F.lit(1.5)).cast("string").alias("dollars"), scalars.close(p, F.lit(100000.0), 10.0, 0.05).alias("is_close"), scalars.slug(F.col("o_orderpriority")).alias("slug"), scalars.normal_text(F.col("o_orderpriority")).alias("plain"))


@query()
def ridge_leave_one_out(spark, d):
    x = t(spark, d, "embeddings").select("embedding", F.col("label").cast("double").alias("y"))
    return spark.createDataFrame(heads.ridge_leave_one_out(x, "embedding", "y", [0.1, 1.0, 10.0]), "alpha double, mse double")


@query("""
WITH x AS (SELECT lang, quality AS y, (n_chars > 500)::INT AS g FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, round(avg((y = g)::INT), 6) AS accuracy, round(coalesce(2.0e0 * sum((y = 1 AND g = 1)::INT) / nullif(sum(y) + sum(g), 0), 0), 6) AS f1 FROM x GROUP BY 1""")
def binary_f1(spark, d):
    x = labelled(spark, d).filter("quality IS NOT NULL").withColumn("g", (F.col("n_chars") > 500).cast("int"))
    return metrics.binary_f1(x, "quality", "g", ["lang"])


@query("SELECT s_suppkey, s_acctbal, rank() OVER (ORDER BY s_acctbal DESC) AS place FROM supplier")
def metrics_table(spark, d):
    return metrics.leaderboard(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal")


@query("""
WITH m AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN v END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN v END) AS O, any_value(c_mktsegment) AS c_mktsegment, any_value(n_name) AS n_name
FROM m LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def wide_metrics_with_lookups(spark, d):
    m = t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    return metrics.wide_metrics(m, "o_custkey", "o_orderstatus", "v", ["F", "O"], [(c, "c_custkey")])


@query("""
WITH g AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), n AS (SELECT count(*) AS n FROM g),
dr AS (SELECT r.draw, ('0x' || substr(sha256('0:' || r.draw || ':' || s.i), 1, 12))::BIGINT % (SELECT n FROM n) AS pick FROM range(60) r(draw), g s), m AS (SELECT draw, avg(s_acctbal) AS m FROM dr JOIN g ON g.i = pick GROUP BY 1)
SELECT round(stddev_samp(m), 6) AS standard_error FROM m""")
def bootstrap_standard_error(spark, d):
    return resample.bootstrap_error(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", 60)


@query("""
WITH g AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
dr AS (SELECT r.draw, s_nationkey, ('0x' || substr(sha256('0:' || r.draw || ':' || s_nationkey || ':' || i), 1, 12))::BIGINT % n AS pick FROM range(60) r(draw), g),
m AS (SELECT draw, avg(m) AS m FROM (SELECT draw, g.s_nationkey, avg(s_acctbal) AS m FROM dr JOIN g ON g.s_nationkey = dr.s_nationkey AND g.i = pick GROUP BY 1, 2) GROUP BY 1)
SELECT round(stddev_samp(m), 6) AS standard_error FROM m""")
def stratified_bootstrap_error(spark, d):
    return resample.bootstrap_error(t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", "s_acctbal", 60, stratum="s_nationkey")


@query("""
SELECT 'first' AS how, row_number() OVER (ORDER BY p_partkey) - 1 AS slot, p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 20)
UNION ALL SELECT 'random', row_number() OVER (ORDER BY h, p_partkey) - 1, p_partkey FROM (SELECT p_partkey, sha256('5:' || p_partkey) AS h FROM part ORDER BY h, p_partkey LIMIT 20)
UNION ALL SELECT 'weighted', slot, p_partkey FROM (
  WITH c AS (SELECT p_partkey, coalesce(sum(p_size::DOUBLE) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(p_size::DOUBLE) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS hi FROM part WHERE p_partkey <> 3),
  s AS (SELECT i AS slot, ('0x' || substr(sha256('5:' || i), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0e0 * (SELECT max(hi) FROM c) AS pos FROM range(1, 20) r(i))
  SELECT slot, p_partkey FROM s JOIN c ON pos >= lo AND pos < hi UNION ALL SELECT 0, 3)""")
def sampled_rows(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_size")
    ways = [resample.sample_rows(p, 20, "first", "p_partkey", ordinal="p_partkey"), resample.sample_rows(p, 20, "random", "p_partkey", "5"), resample.sample_rows(p, 20, "weighted", "p_partkey", "5", weight="p_size", keep=3)]
    out = [w.select(F.lit(n).alias("how"), F.col("slot").cast("bigint").alias("slot"), "p_partkey") for n, w in zip(("first", "random", "weighted"), ways, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""
WITH t AS (SELECT item_id, item_id % 3 <> 0 AS train, lower(text) AS s FROM benchmark), w AS (SELECT item_id, train, substr(s, i::INT, k::INT) AS ngram FROM t, range(1, 4) q(k), range(1, 100000) r(i) WHERE i + k - 1 <= length(s)),
c AS (SELECT item_id, ngram, count(*)::DOUBLE AS n FROM w WHERE ngram IN (SELECT ngram FROM w WHERE train) GROUP BY 1, 2)
SELECT item_id, ngram, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM c""")
def ngram_weights(spark, d):
    return heads.ngram_weights(t(spark, d, "benchmark").select("item_id", F.lower("text").alias("s")), "item_id", "s", "item_id % 3 <> 0")


@query()
def ngram_head(spark, d):
    x = t(spark, d, "benchmark").select("item_id", "text", (F.length("text") > 300).cast("int").alias("y"))
    return heads.ngram_head(x.filter("item_id % 3 <> 0"), x.filter("item_id % 3 = 0"), "text", "y", classes=False).select("item_id", "score")


@query()
def ridge_chosen_by_validation(spark, d):
    x = t(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"), splits.hashed_split(F.col("vec_id"), "0").alias("split"), splits.hashed_split(F.col("vec_id"), "1", 20).alias("part"))
    train = x.filter("split = 'train'")
    _, w, b = heads.ridge_validated(train.filter("part = 'train'"), train.filter("part = 'test'"), "embedding", "y", [0.1, 1.0, 10.0, 100.0])
    return heads.linear_scores(x.filter("split = 'test'"), "embedding", w, b).select("vec_id", "score")


_HARDWARE = "CASE p_partkey % 5 WHEN 0 THEN p_size || ' x NVIDIA A100' WHEN 1 THEN p_size || ' GPUs, 64 GB' WHEN 2 THEN 'one Tesla card' WHEN 3 THEN p_size || ' CPU cores' END"


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN p_size::INT END AS gpus FROM part")
def gpu_counts(spark, d):
    return t(spark, d, "part").select("p_partkey", detectors.gpu_count(F.expr(_HARDWARE)).alias("gpus"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'org/' || replace(lower(c_name), '#', '') END AS repository FROM customer")
def repositories(spark, d):
    name = F.replace("c_name", F.lit("#"), F.lit(""))
    url = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("See https://GitHub.com/Org/"), name, F.lit(".git"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("github.com/org/"), name, F.lit("?tab=readme"))).otherwise(F.concat(F.lit("https://gitlab.com/org/"), name))
    return t(spark, d, "customer").select("c_custkey", detectors.repository(url).alias("repository"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'software' WHEN 1 THEN 'closed' WHEN 2 THEN 'laboratory' WHEN 3 THEN 'people' WHEN 4 THEN 'unknown' WHEN 5 THEN 'software' WHEN 6 THEN 'laboratory' ELSE 'unknown' END AS runs_by,
  CASE o_orderkey % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 5 THEN 'closed' ELSE 'unknown' END AS data FROM orders""")
def release_statements(spark, d):
    access = F.expr(
        "CASE o_orderkey % 8 WHEN 0 THEN 'Code at https://github.com/a/b' WHEN 1 THEN 'The system is not publicly available.' WHEN 2 THEN 'A laboratory test of the company' "
        "WHEN 4 THEN 'calibration code at https' WHEN 5 THEN 'Released weights; data on request' WHEN 6 THEN 'now a clinical assay' END"
    )
    description = F.expr("CASE o_orderkey % 8 WHEN 3 THEN 'Scored with manual curation of reports' WHEN 7 THEN 'Needs no manual curation' END")
    return t(spark, d, "orders").select("o_orderkey", detectors.runs_by(access, description, F.lit(False)).alias("runs_by"), detectors.data_access(access, description).alias("data"))


@query("""
SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linenumber = 7 THEN NULL ELSE greatest(l_discount, l_tax) END) AS change, max(greatest(l_discount, l_tax, 0.01e0)) AS delta FROM lineitem GROUP BY 1, 2""")
def reported_changes(spark, d):
    # two numbers by one order, as structs would sort all rows; both are of the same row
    most = F.greatest("l_discount", "l_tax")
    x = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_discount", most).alias("discount"), F.max_by("l_tax", most).alias("tax"))
    raw = F.when(F.col("l_linenumber") == 7, "gene|Warnings:none").otherwise(F.concat(F.lit("gene|-12:"), F.col("discount").cast("string"), F.lit("|3:-"), F.col("tax").cast("string"), F.lit("|Warnings:x:1")))
    entries = F.array(F.concat_ws("|", F.lit("A"), F.lit("gene"), F.col("discount").cast("string"), F.lit("0.0"), F.col("tax").cast("string"), F.lit("0.01"), F.lit("5")))
    return x.select("l_orderkey", "l_linenumber", detectors.largest_change(raw).alias("change"), detectors.best_delta(entries).alias("delta"))


@query("""
WITH e AS (SELECT o_custkey, o_orderkey AS start, o_orderkey + 10 AS stop FROM orders)
SELECT o_custkey, string_agg((start - 1) || ',', '' ORDER BY start) AS starts, string_agg(stop || ',', '' ORDER BY start) AS stops, min(start)::INT AS first FROM e GROUP BY 1""")
def exon_lists(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 10).alias("stop")))).alias("exons"))
    x = o.select("o_custkey", detectors.joined_ends(F.col("exons"), "start", -1).alias("starts"), detectors.joined_ends(F.col("exons"), "stop").alias("stops"))
    return x.withColumn("first", F.get(detectors.spans_of(F.col("starts"), F.col("stops"), 1), F.lit(0))["start"])


@query("SELECT p_partkey, list_filter([replace(p_brand, '#', ''), 'PP' || p_size, p_type], lambda w: length(w) >= 3 AND (regexp_matches(w, '[0-9]') OR regexp_matches(w, '[A-Z].*[A-Z]'))) AS words, 100 AS whole, p_size % 2 = 0 AS cited FROM part")
def names_in_text(spark, d):
    name = F.concat(F.lit("the "), F.col("p_brand"), F.lit(" of PP"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"))
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("see part-"), F.col("p_partkey").cast("string"), F.lit("."))).otherwise(F.concat(F.lit("see part-"), F.col("p_partkey").cast("string"), F.lit("-b and sub-part-"), F.col("p_partkey").cast("string")))
    cited = detectors.cites(text, F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
    return t(spark, d, "part").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit(""))).select("p_partkey", detectors.distinctive(name).alias("words"), detectors.name_score(scalars.normal_text(F.concat(F.lit("on "), name, F.lit(" again"))), name).alias("whole"), cited.alias("cited"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN [n_nationkey::VARCHAR, 'Seven'] WHEN 1 THEN [] ELSE ['half'] END AS stray, n_nationkey % 3 = 1 AS link FROM nation")
def stray_numbers(spark, d):
    k, name = F.col("n_nationkey"), F.concat(F.lit("ESM-"), F.col("n_nationkey").cast("string"))
    text = F.when(k % 3 == 0, F.concat(name, F.lit(" wins by "), k.cast("string"), F.lit(" of Seven"))).when(k % 3 == 1, F.concat(name, F.lit(" at www.example.org"))).otherwise(F.concat(F.lit("half of "), name))
    return t(spark, d, "nation").select("n_nationkey", detectors.stray_numbers(text, F.array(name)).alias("stray"), detectors.has_link(text).alias("link"))


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS name, CASE WHEN n_regionkey > 1 THEN n_regionkey::VARCHAR END AS region, NULL::VARCHAR AS absent FROM nation")
def slim_attributes(spark, d):
    k = F.col("n_nationkey")
    a = F.create_map(F.lit("name"), F.when(k % 8 == 0, "Not stated").when(k % 4 == 0, " ").otherwise(F.col("n_name")), F.lit("region"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string")))
    return records.slim(t(spark, d, "nation").select(k.cast("string").alias("id"), a.alias("attributes")), ["name", "region", "absent"])


@query("""
WITH c AS (SELECT s_nationkey::VARCHAR AS owner, s_suppkey AS recipe, s_suppkey % 7 = 0 AS guide, s_suppkey % 3 = 0 AS evaluates, s_suppkey % 5 AS protocol, s_suppkey % 2 = 0 AS scored, s_suppkey % 11 = 0 AS todo FROM supplier),
j AS (SELECT *, CASE WHEN NOT scored THEN 'no score' WHEN NOT guide AND protocol NOT IN (0, 1) THEN 'unknown protocol' WHEN todo THEN 'unfinished' ELSE 'ready' END AS state FROM c)
SELECT owner, recipe, state FROM j QUALIFY row_number() OVER (PARTITION BY owner ORDER BY state IN ('no score', 'unknown protocol'), NOT guide, NOT evaluates, recipe) = 1""")
def recipe_readiness(spark, d):
    k = F.col("s_suppkey")
    c = t(spark, d, "supplier").select(
        F.col("s_nationkey").cast("string").alias("owner"), k.alias("recipe"), F.when(k % 7 == 0, "guide").otherwise("recipe").alias("kind"), F.when(k % 3 == 0, "generate_and_evaluate").otherwise("train").alias("purpose"),
        F.concat(F.lit("p"), (k % 5).cast("string")).alias("protocol"), k.alias("ordinal"), F.array(F.when(k % 2 == 0, "AUROC per assay").otherwise("embeddings")).alias("outputs"), F.when(k % 11 == 0, "Install. The split script is still being prepared; run it.").otherwise("Install. Run it.").alias("run_text"),
    )
    return records.ready_recipes(c, spark.createDataFrame([("p0",), ("p1",)], "protocol string"))


@query("""
WITH c AS (SELECT DISTINCT l_suppkey AS finding, l_returnflag AS study, l_partkey % 400 AS protocol FROM lineitem WHERE l_linenumber = 7),
shared AS (SELECT finding, min(protocol) AS anchor, list(DISTINCT protocol ORDER BY protocol) AS protocols FROM (SELECT finding, protocol FROM c GROUP BY 1, 2 HAVING count(DISTINCT study) >= 2) GROUP BY 1),
anc AS (SELECT protocol, protocol AS anchor FROM (SELECT DISTINCT protocol FROM c) UNION ALL SELECT protocol, 1000 + protocol % 9 FROM (SELECT DISTINCT protocol FROM c)),
u AS (SELECT c.*, anchor FROM c JOIN anc USING (protocol)),
common AS (SELECT finding, anchor, count(DISTINCT study) AS n FROM u GROUP BY 1, 2 HAVING count(DISTINCT study) >= 2),
best AS (SELECT finding, anchor FROM common QUALIFY row_number() OVER (PARTITION BY finding ORDER BY CASE WHEN anchor < 1000 THEN 1 WHEN anchor % 3 = 0 THEN 0 WHEN anchor % 3 = 1 THEN 3 ELSE 2 END, n DESC, anchor) = 1),
part AS (SELECT finding, anchor, list(DISTINCT protocol ORDER BY protocol) AS protocols FROM u JOIN best USING (finding, anchor) GROUP BY 1, 2),
first AS (SELECT finding, study FROM c QUALIFY row_number() OVER (PARTITION BY finding ORDER BY study <> 'R', study) = 1),
own AS (SELECT finding, min(protocol) AS anchor, list(DISTINCT protocol ORDER BY protocol) AS protocols FROM c JOIN first USING (finding, study) GROUP BY 1)
SELECT finding, CASE WHEN s.finding IS NOT NULL THEN 'shared' WHEN p.finding IS NOT NULL THEN 'part' ELSE 'own' END AS rule, coalesce(s.anchor, p.anchor, o.anchor) AS anchor, coalesce(s.protocols, p.protocols, o.protocols) AS protocols
FROM own o LEFT JOIN shared s USING (finding) LEFT JOIN part p USING (finding)""")
def discrepancy_anchors(spark, d):
    c = t(spark, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_suppkey").alias("finding"), F.col("l_returnflag").alias("study"), F.when(F.col("l_returnflag") == "R", "outlier").alias("role"), F.ascii("l_returnflag").alias("ordinal"), (F.col("l_partkey") % 400).alias("protocol"))
    p = c.select("protocol").distinct()
    up = p.select("protocol", (1000 + F.col("protocol") % 9).alias("anchor"))
    ancestors = p.select("protocol", F.col("protocol").cast(up.schema["anchor"].dataType).alias("anchor")).unionByName(up)
    kinds = ancestors.select("anchor").distinct().select("anchor", F.when(F.col("anchor") < 1000, "protocol").when(F.col("anchor") % 3 == 0, "task").when(F.col("anchor") % 3 == 1, "benchmark").otherwise("suite").alias("kind"))
    return records.discrepancy_anchors(c, ancestors, kinds)


@query("""
SELECT 's' || s_suppkey AS root, CASE WHEN s_nationkey % 2 = 0 THEN 'n' || s_nationkey ELSE 'r' || n_regionkey END AS ancestor, CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END AS depth FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def first_ancestors(spark, d):
    s = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    n = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    wanted = F.col("node").startswith("r") | (F.col("node").startswith("n") & (F.substring("node", 2, 9).try_cast("int") % 2 == 0))
    return graph.first_ancestor(s.unionByName(n), s.select(F.col("src").alias("root")), wanted)


@query("""
SELECT c_custkey, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS proxies FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def gaps_with_proxies(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return records.missing_evidence(t(spark, d, "customer").select("c_custkey"), o.filter("o_orderstatus = 'F'").select("c_custkey"), o.filter("o_orderstatus = 'O'").select("c_custkey", F.col("o_orderpriority").alias("study")), "c_custkey")


@query("SELECT l_orderkey, min(l_shipdate) AS start, max(l_shipdate) AS stop, count(*) AS n FROM lineitem GROUP BY 1")
def interval_envelopes(spark, d):
    return intervals.envelopes(t(spark, d, "lineitem"), "l_orderkey", "l_shipdate", "l_shipdate")


@query("SELECT source, count(DISTINCT s) AS splits FROM (SELECT source, CASE WHEN ('0x' || substr(sha256('0:' || doc_id), 1, 12))::BIGINT % 100 < 30 THEN 'test' ELSE 'train' END AS s FROM documents) GROUP BY 1 HAVING count(DISTINCT s) > 1")
def split_leaks(spark, d):
    return splits.leaks(t(spark, d, "documents").select("source", splits.hashed_split(F.col("doc_id"), "0").alias("split")), "source")


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def first_of_pairs(spark, d):
    return records.first_per_pair(t(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""
SELECT p_partkey, chr(65 + (p_size % 26)::INT) AS here, p_size < 40 AS valid, CASE WHEN p_size % 4 + 1 >= 3 THEN '3+' ELSE (p_size % 4 + 1)::VARCHAR END AS depth, (p_size % 4 + 1)::INT AS n FROM part""")
def sequence_checks(spark, d):
    alphabet = F.lit("".join(chr(65 + i) for i in range(26)))
    mutant = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda i: F.concat(F.lit("A"), (i + 1).cast("string"), F.lit("C"))), ":")
    valid = sequence.in_alphabet(F.when(F.col("p_size") < 40, "ACGT").otherwise("ACGN"), "ACGT")
    return t(spark, d, "part").select("p_partkey", sequence.char_at(alphabet, (F.col("p_size") % 26).cast("int")).alias("here"), valid.alias("valid"), sequence.depth_bucket(mutant, 3).alias("depth"), F.size(sequence.substitutions(mutant)).alias("n"))


_VARIANTS = f"""
SELECT item_id, regexp_replace({_BASES}, '[^ACGT]', 'N', 'g') AS s, item_id % 20 + 1 AS p, item_id % 7 AS i1, item_id % 11 + 1 AS ex, item_id % 5 AS i2, CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id / 8.0e0 END AS ph,
['exon', 'upstr_intron', 'downstr_intron', 'other'][item_id % 4 + 1] AS region, ['A', 'C', 'G', 'T'][item_id % 4 + 1] AS ref, ['A', 'C', 'G', 'T'][item_id // 4 % 4 + 1] AS alt FROM benchmark"""


@query(f"""
WITH v AS ({_VARIANTS}), w AS (SELECT *, substr(s, greatest(1, p - {features.REACH}), least(length(s), p + {features.REACH}) - greatest(1, p - {features.REACH}) + 1) AS c FROM v WHERE p <= length(s)),
k AS (SELECT item_id, substr(c, i::INT, 3) AS k FROM w, range(1, 20) r(i) WHERE i <= length(c) - 2), f AS (SELECT item_id, k, count(*) AS n FROM k WHERE regexp_full_match(k, '[ACGT]+') GROUP BY 1, 2),
t AS (SELECT item_id, sum(n) AS n FROM f GROUP BY 1), b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), m AS (SELECT a.x || b.x || c.x AS k FROM b a, b, b c),
a AS (SELECT item_id, unnest([p, p / 20.0e0, p - i1, p - i1 - ex, least(abs(p - i1), abs(p - i1 - ex)), ex, i1, i2, ph, NULL, (region = 'exon')::INT, (region = 'upstr_intron')::INT, (region = 'downstr_intron')::INT,
  (ref = 'A')::INT, (ref = 'C')::INT, (ref = 'G')::INT, (ref = 'T')::INT, (alt = 'A')::INT, (alt = 'C')::INT, (alt = 'G')::INT, (alt = 'T')::INT]::DOUBLE[]) AS value, unnest(range(21)) AS nr FROM w)
SELECT item_id, nr::INT AS feature, round(value, 6) AS value FROM a
UNION ALL SELECT w.item_id, (20 + dense_rank() OVER (ORDER BY m.k))::INT, round(coalesce(f.n / t.n::DOUBLE, 0), 6) FROM w CROSS JOIN m LEFT JOIN f ON f.item_id = w.item_id AND f.k = m.k LEFT JOIN t ON t.item_id = w.item_id""")
def variant_features(spark, d):
    """Every benchmark text as a sequence with a variant, its numbers from the item's id."""
    i = F.col("item_id")

    def of(choices, at):
        return F.element_at(F.array(*[F.lit(c) for c in choices]), (at + 1).cast("int"))

    p = i % 20 + 1
    numbers = {"rel_position": p, "rel_position_scaled": p / 20, "intron1_len": i % 7, "exon_len": i % 11 + 1, "intron2_len": i % 5, "phylop_score": F.when(i % 3 != 0, i / 8), "mean_phastCons_score": F.lit("NA")}
    rows = t(spark, d, "benchmark").select(
        "item_id", F.regexp_replace(_bases("text"), "[^ACGT]", "N").alias("mutant_sequence"), *[F.coalesce(v.cast("string"), F.lit("NA")).alias(k) for k, v in numbers.items()],
        of((*features.REGIONS, "other"), i % 4).alias("region"), of(features.BASES, i % 4).alias("ref_allele"), of(features.BASES, F.floor(i / 4) % 4).alias("alt_allele"),
    )
    return features.variant_features(rows).filter("features IS NOT NULL").select("item_id", F.posexplode("features").alias("feature", "value"))


def _coarse(spark, d):
    """Vectors in steps of an eighth, and whether their label is odd."""
    return t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(8.0) * x).cast("double")).alias("x"), (F.col("label") % 2).alias("y"))


@query("""
WITH r AS (SELECT vec_id, list_transform(embedding, lambda e: floor(8 * e::DOUBLE)) AS x, label % 2 AS y FROM embeddings), n AS (SELECT count(*) AS n, sum(y) AS p FROM r),
d AS (SELECT f, x[f] AS v, round((p / n - y) * 1073741824) AS g, round(p / n * (1 - p / n) * 1073741824) AS h FROM r, n, range(1, 65) q(f)),
c AS (SELECT f, v, sum(g) AS g, sum(h) AS h, count(*) AS k FROM d GROUP BY f, v),
l AS (SELECT f, v, sum(g) OVER w / 1073741824 AS gl, sum(h) OVER w / 1073741824 AS hl, sum(k) OVER w AS kl, sum(g) OVER a / 1073741824 AS gt, sum(h) OVER a / 1073741824 AS ht, sum(k) OVER a AS kt FROM c WINDOW w AS (PARTITION BY f ORDER BY v), a AS (PARTITION BY f)),
s AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM l WHERE kl >= 20 AND kt - kl >= 20 ORDER BY gain DESC, f, v LIMIT 1)
SELECT vec_id, round(1 / (1 + exp(-(ln(p / (n - p)) - 0.5e0 * CASE WHEN x[f] <= v THEN gl / (hl + 1) ELSE (gt - gl) / (ht - hl + 1) END))), 6) AS score FROM r, n, s""")
def boosted_stump(spark, d):
    """One tree of two leaves, whose split SQL can look for."""
    rows = _coarse(spark, d)
    return boosting.predict(rows, boosting.fit(rows, "x", "y", trees=1, rate=0.5, leaves=2), "x").select("vec_id", "score")


@query()
def boosted_trees(spark, d):
    """Trees of several leaves on the vectors as they are; the tests compare them with a booster that looks at all rows for every split."""
    rows = t(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("y"))
    return boosting.predict(rows, boosting.fit(rows, "embedding", "y", trees=4, rate=0.3, leaves=6), "embedding").select("vec_id", "score")


@query(f"""
WITH s AS (SELECT item_id, regexp_replace({_BASES}, '[^ACGT]', 'N', 'g') AS s FROM benchmark)
SELECT item_id, 1 + item_id * 7 % length(s) AS start, least(length(s), 40 + item_id * 7 % length(s)) AS stop, substr(s, 1 + item_id * 7 % length(s), 40) AS bases FROM s WHERE length(s) > 0""")
def indexed_ranges(spark, d):
    """Every benchmark text as a contig of sequence files in the shared folder, and forty bases of each by their bytes."""
    rows = t(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("contig"), F.regexp_replace(_bases("text"), "[^ACGT]", "N").alias("sequence")).filter("sequence <> ''")
    folder = f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}"
    indexed.write_sequences(rows, folder)
    n = F.length("sequence").cast("bigint")
    start = F.col("item_id") * 7 % n
    wanted = rows.select(F.col("item_id").alias("id"), "contig", (start + 1).alias("start"), F.least(n, start + 40).alias("stop"))
    return indexed.fetch_ranges(indexed.build_index(spark, folder), wanted).select(F.col("id").alias("item_id"), "start", "stop", "bases")


@query("""SELECT s_suppkey AS key, c_custkey AS issue, 10 AS score FROM supplier JOIN customer ON split_part(s_name, '#', 2) = split_part(c_name, '#', 2)""")
def best_cover(spark, d):
    """Every supplier's name looked for in all customers' names: they share numbers, and a word that says nothing."""
    p = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return records.best_cover(p, t(spark, d, "customer").select(F.col("c_custkey").alias("issue"), F.col("c_name").alias("title")))


@query("""SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1""")
def member_unions(spark, d):
    """Parts by return flag, as unions of the bitmaps of each flag and line number."""
    rows = t(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_partkey")
    maps = membership.bitmaps(rows, ["l_returnflag", "l_linenumber"], "l_partkey", membership.dictionary(rows, "l_partkey"))
    return membership.sizes(membership.unions(maps, ["l_returnflag"]), ["l_returnflag"])


_TWO = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE / 1000 AS y, ('0x' || substr(sha256('0:' || l_orderkey), 1, 12))::BIGINT % 100 < 30 AS test,
  ('0x' || substr(sha256('1:' || l_orderkey), 1, 12))::BIGINT % 100 < 20 AS held FROM lineitem),
m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM s WHERE {rows}),
c AS (SELECT sum((a - ma) ** 2) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) ** 2) AS bb, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS yb FROM s, m WHERE {rows}),
w AS (SELECT p, aa + p AS aa, ab, bb + p AS bb, (aa + p) * (bb + p) - ab * ab AS det, (ay * (bb + p) - yb * ab) / ((aa + p) * (bb + p) - ab * ab) AS wa, (yb * (aa + p) - ay * ab) / ((aa + p) * (bb + p) - ab * ab) AS wb
  FROM c, (SELECT unnest([{penalties}]) AS p))
"""


def _two_columns(spark, d):
    k = F.col("l_orderkey")
    x = t(spark, d, "lineitem").select(k, "l_linenumber", F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return x.withColumns({"split": splits.hashed_split(k, "0"), "part": splits.hashed_split(k, "1", 20)})


@query(_TWO.format(rows="NOT test", penalties="10.0e0") + "SELECT l_orderkey, l_linenumber, round(my + wa * (a - ma) + wb * (b - mb), 3) AS score FROM s, m, w WHERE test")
def ridge_two_columns(spark, d):
    x = _two_columns(spark, d)
    w, b = heads.ridge(heads.moments(x.filter("split = 'train'"), "x", "y"), 10.0)
    return heads.linear_scores(x.filter("split = 'test'"), "x", w, b).select("l_orderkey", "l_linenumber", F.round("score", 3).alias("score"))


@query(
    _TWO.format(rows="true", penalties="0.1e0, 10.0e0, 1000.0e0")
    + "SELECT p AS alpha, round(avg(((y - my - wa * (a - ma) - wb * (b - mb)) / (1 - 1 / n::DOUBLE - ((a - ma) ** 2 * bb - 2 * (a - ma) * (b - mb) * ab + (b - mb) ** 2 * aa) / det)) ** 2), 6) AS mse FROM s, m, w GROUP BY p"
)
def ridge_left_out_two_columns(spark, d):
    return spark.createDataFrame(heads.ridge_leave_one_out(_two_columns(spark, d), "x", "y", [0.1, 10.0, 1000.0]), "alpha double, mse double")


@query(
    _TWO.format(rows="NOT test AND NOT held", penalties="0.1e0, 100.0e0, 10000.0e0")
    + "SELECT p AS alpha, round(wa, 6) AS quantity, round(wb, 6) AS discount, round(my - wa * ma - wb * mb, 6) AS intercept FROM (SELECT w.*, ma, mb, my, sum((y - my - wa * (a - ma) - wb * (b - mb)) ** 2) AS e FROM s, m, w WHERE NOT test AND held GROUP BY ALL) ORDER BY e, p LIMIT 1"
)
def ridge_validated_two_columns(spark, d):
    train = _two_columns(spark, d).filter("split = 'train'")
    alpha, w, b = heads.ridge_validated(train.filter("part = 'train'"), train.filter("part = 'test'"), "x", "y", [0.1, 100.0, 10000.0])
    return spark.createDataFrame([(alpha, float(w[0]), float(w[1]), b)], "alpha double, quantity double, discount double, intercept double")


@query("SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal FROM customer")
def one_to_one_join(spark, d):
    c = t(spark, d, "customer")
    return joins.one_to_one(c.select("c_custkey", "c_name"), c.select("c_custkey", F.col("c_acctbal").cast("double")), "c_custkey")


def _says(pattern: str) -> str:
    return f"coalesce(regexp_matches(text, '{pattern}'), false)"


@query(f"""
SELECT conv_id, turn, coalesce(regexp_matches(regexp_replace(text, '{detectors.OTHER_CODE}', '', 'g'), '{detectors.RELEASED}'), false) AND NOT {_says(detectors.NO_RELEASE)} AS released, {_says(detectors.SCORE_OUTPUT)} AS scored,
CASE WHEN {_says(detectors.DATA_CLOSED)} THEN 'closed' WHEN {_says(detectors.DATA_OPEN)} THEN 'open' ELSE 'unknown' END AS data, CASE WHEN {_says(detectors.GPU)} THEN TRY_CAST(regexp_extract(text, '{detectors.GPU_COUNT}', 1) AS INT) END AS gpus FROM conversations""")
def conversation_statements(spark, d):
    """What every turn of the conversations states."""
    text = F.col("text")
    return t(spark, d, "conversations").select("conv_id", "turn", detectors.released(text).alias("released"), detectors.says(text, detectors.SCORE_OUTPUT).alias("scored"), detectors.data_access(text, F.lit(None).cast("string")).alias("data"), detectors.gpu_count(text).alias("gpus"))


@query(f"""
SELECT doc_id, coalesce(regexp_matches(regexp_replace(text, '{detectors.OTHER_CODE}', '', 'g'), '{detectors.RELEASED}'), false) AND NOT {_says(detectors.NO_RELEASE)} AS released,
CASE WHEN {_says(detectors.DATA_CLOSED)} THEN 'closed' WHEN {_says(detectors.DATA_OPEN)} THEN 'open' ELSE 'unknown' END AS data, {_says(detectors.PLACEHOLDER)} AS unfinished, CASE WHEN regexp_matches(text, '(?i)github\\.com/([^/\\s]+)/([^/\\s#?]+)') THEN true ELSE false END AS linked FROM documents""")
def document_statements(spark, d):
    """What every document states."""
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", detectors.released(text).alias("released"), detectors.data_access(text, F.lit(None).cast("string")).alias("data"), detectors.says(text, detectors.PLACEHOLDER).alias("unfinished"), detectors.repository(text).isNotNull().alias("linked"))


@query("""
WITH b AS (SELECT item_id, text, length(text) AS n FROM benchmark WHERE text <> ''), k AS (SELECT *, CASE WHEN n < 127 THEN 0 ELSE (n - 127) // 62 + 1 END AS last FROM b),
s AS (SELECT item_id, text, n, unnest(CASE WHEN n <= 64 THEN [0] ELSE list_concat(list_concat(list_transform(range(last + 1), lambda i: i * 31), list_transform(range(last + 1), lambda i: n - 64 - i * 31)), CASE WHEN 128 + 62 * last - n < 31 THEN [n // 2 - 32] ELSE [] END) END) AS start FROM k),
c AS (SELECT item_id, n, start + i AS position, i, unicode(substr(text, (start + i + 1)::INT, 1)) + i % 7 AS v FROM s, range(64) r(i) WHERE start + i < n),
w AS (SELECT item_id, position, v, CASE WHEN n <= 64 THEN 1 WHEN i BETWEEN 1 AND 16 THEN 1 / (1 + exp(-(i - 8.0e0))) WHEN i BETWEEN 46 AND 62 THEN 1 / (1 + exp(i - 62 + 8.0e0)) ELSE 1 END AS w FROM c)
SELECT item_id, position, round(sum(w * v) / sum(w), 4) AS score FROM w GROUP BY 1, 2""")
def overlapping_windows(spark, d):
    """Every character of the benchmark, by windows of 64 and an adapter whose values depend on the place in the window."""

    def adapter(windows):
        return [[ord(c) + i % 7 for i, c in enumerate(w)] for w in windows]

    return overlap.position_scores(t(spark, d, "benchmark"), "item_id", "text", adapter, 64).select("item_id", "position", F.round("score", 4).alias("score"))


@query(f"""
WITH s AS (SELECT item_id, unnest([{{'side': 'reference', 's': {_BASES}}}, {{'side': 'mutant', 's': translate({_BASES}, 'AC', 'CG')}}]) AS x FROM benchmark), p AS (SELECT item_id, x.side, x.s FROM s)
SELECT item_id, side, round(ln(1 + length(s)), 6) AS log_length, round(coalesce((length(s) - length(replace(s, 'C', ''))) / nullif(length(s), 0)::DOUBLE, 0), 6) AS share_c, round(coalesce(length(regexp_replace(s, '[ACGT]', '', 'g')) / nullif(length(s), 0)::DOUBLE, 0), 6) AS share_other FROM p""")
def paired_composition(spark, d):
    """Both sequences of a pair, the second with other bases."""
    x = features.paired_composition(t(spark, d, "benchmark").select("item_id", _bases("text").alias("reference_sequence"), F.translate(_bases("text"), "AC", "CG").alias("mutant_sequence")))
    sides = x.select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"features.{k}").alias("v")) for k in ("reference", "mutant")])).alias("x")).select("item_id", "x.*")
    return sides.select("item_id", "side", *[F.col("v")[i].alias(n) for i, n in ((0, "log_length"), (2, "share_c"), (5, "share_other"))])


@query("""
WITH e AS (SELECT l_orderkey // 16 AS use_case, l_suppkey % 7 AS system, l_returnflag AS study, l_linestatus AS origin, l_linenumber AS protocol FROM lineitem),
st AS (SELECT use_case, system, count(DISTINCT study) AS studies, bool_and(origin = 'F') AS own, bool_or(origin = 'O') AS free FROM e GROUP BY 1, 2),
f AS (SELECT use_case, system, studies = 1 AND NOT own AS single, NOT free AS alone FROM st WHERE (studies = 1 AND NOT own) OR NOT free),
r AS (SELECT DISTINCT use_case, protocol, system, protocol % 3 AS benchmark FROM e),
h AS (SELECT use_case, system, benchmark, count(*) AS n FROM r JOIN f USING (use_case, system) GROUP BY 1, 2, 3),
c AS (SELECT use_case, system, benchmark FROM h QUALIFY row_number() OVER (PARTITION BY use_case, system ORDER BY n DESC, benchmark) = 1),
g AS (SELECT c.system, c.benchmark, count(DISTINCT c.use_case) AS use_cases, bool_or(f.single) AS single, bool_or(f.alone) AS alone FROM c JOIN f ON f.use_case = c.use_case AND f.system = c.system GROUP BY 1, 2),
s AS (SELECT c.system, c.benchmark, count(DISTINCT e.study) AS studies FROM c JOIN e ON e.use_case = c.use_case AND e.system = c.system GROUP BY 1, 2),
p AS (SELECT DISTINCT c.system, c.benchmark, r.protocol FROM c JOIN r ON r.use_case = c.use_case AND r.system = c.system AND r.benchmark = c.benchmark),
k AS (SELECT p.system, p.benchmark, count(*) AS rankings FROM p JOIN r ON r.system = p.system AND r.protocol = p.protocol GROUP BY 1, 2)
SELECT g.system, g.benchmark, g.use_cases, g.single, g.alone, s.studies, k.rankings FROM g JOIN s ON s.system = g.system AND s.benchmark = g.benchmark JOIN k ON k.system = g.system AND k.benchmark = g.benchmark""")
def verification_gaps(spark, d):
    """Suppliers in seven groups as systems, stretches of orders as use cases, return flags as studies and line numbers as protocols."""
    e = t(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("use_case"), (F.col("l_suppkey") % 7).alias("system"), F.col("l_returnflag").alias("study"), F.col("l_linestatus").alias("origin"), F.col("l_linenumber").alias("protocol"))
    found = records.verification_gaps(e, e, e.select("protocol", (F.col("protocol") % 3).alias("benchmark")), "F", ["O"])
    has = [F.array_contains("flags", x).alias(n) for n, x in (("single", "single-study"), ("alone", "no-independent"))]
    return found.select("system", "benchmark", F.size("use_cases").cast("bigint").alias("use_cases"), *has, "studies", "rankings")


@query("""
WITH c AS (SELECT l_suppkey AS subject, l_partkey % 50 AS proxy, count(DISTINCT l_orderkey) AS studies FROM lineitem GROUP BY 1, 2)
SELECT subject, proxy, studies, (row_number() OVER (PARTITION BY subject ORDER BY studies DESC, proxy))::INT AS place FROM c QUALIFY row_number() OVER (PARTITION BY subject ORDER BY studies DESC, proxy) <= 3""")
def top_proxies(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 50).alias("proxy"), F.col("l_orderkey").alias("study"))
    return records.top_proxies(x, "subject", "proxy", "study")


@query("""
WITH r AS (SELECT c_custkey AS metric, c_acctbal::DOUBLE AS value FROM customer WHERE c_custkey % 9 <> 0), k AS (SELECT c_custkey AS metric, CASE WHEN c_custkey % 3 > 0 THEN 0.0e0 END AS low, c_custkey % 2 = 0 AS whole FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(r.metric, k.metric) AS metric, round(r.value, 6) AS value, CASE WHEN r.metric IS NULL THEN 'missing' WHEN k.metric IS NULL THEN 'unknown' WHEN r.value < k.low OR r.value > 5000 THEN 'out of bounds' ELSE 'not whole' END AS problem
FROM r FULL JOIN k ON k.metric = r.metric WHERE r.metric IS NULL OR k.metric IS NULL OR r.value < k.low OR r.value > 5000 OR (k.whole AND r.value <> floor(r.value))""")
def contract_violations(spark, d):
    """Every customer's balance as a metric, and bounds that some lack."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    bounds = c.filter(k % 11 != 0).select(k.alias("metric"), F.when(k % 3 > 0, 0.0).alias("low"), F.lit(5000.0).alias("high"), (k % 2 == 0).alias("whole"))
    return joins.contract_violations(c.filter(k % 9 != 0).select(k.alias("metric"), F.col("c_acctbal").cast("double").alias("value")), bounds)


_FACTS = """
WITH u AS (SELECT c_custkey AS k, 'use-case-' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN 's' || c_custkey END AS slug, c_mktsegment AS area FROM customer),
f AS (SELECT k, id, coalesce(title, CASE WHEN k % 5 > 0 THEN 'R' || k END, id) AS title, coalesce(slug, k::VARCHAR) AS slug, CASE WHEN k % 5 > 0 AND k % 2 = 0 THEN 'clinic' ELSE 'own' END AS context,
  CASE WHEN k % 5 > 0 AND k % 7 = 0 THEN 9 WHEN area = 'BUILDING' THEN 1 WHEN area = 'MACHINERY' THEN 2 ELSE 3 END AS tier FROM u)
"""


def _facts(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    name = F.concat(F.lit("use-case-"), k.cast("string"))
    u = c.select(name.alias("id"), F.when(k % 3 == 0, F.col("c_name")).alias("title"), F.when(k % 4 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("slug"), F.lit(None).cast("string").alias("question"), F.array(F.lit("own")).alias("contexts"), F.col("c_mktsegment").alias("area"))
    r = c.filter(k % 5 != 0).select(name.alias("id"), F.concat(F.lit("R"), k.cast("string")).alias("name"), F.lit("text").alias("description"), F.when(k % 2 == 0, F.array(F.lit("clinic"))).alias("contexts"), F.array().cast("array<string>").alias("areas"), F.when(k % 7 == 0, 9).alias("tier"))
    return records.use_case_facts(u, r, ["clinic"], ["BUILDING"], ["MACHINERY"])


@query(_FACTS + "SELECT id, title, slug, context, context = 'clinic' AS clinical, tier FROM f")
def use_case_facts(spark, d):
    return _facts(spark, d).select("id", "title", "slug", F.col("contexts")[0].alias("context"), "clinical", "tier")


@query(
    _FACTS
    + """, g AS (SELECT o_orderkey // 8 AS gap, count(*) % 3 AS rankings, min(o_orderkey) % 3 AS kind, round(sum(o_totalprice)::DOUBLE / 1000, 3) AS hours, bool_or(f.context = 'clinic') AS clinical FROM orders JOIN f ON f.k = o_custkey GROUP BY 1)
SELECT gap, ((CASE WHEN clinical THEN 2 ELSE 1 END) * (1 + rankings))::BIGINT AS value, kind::INT AS bucket, CASE WHEN kind = 1 THEN round((CASE WHEN clinical THEN 2 ELSE 1 END) * (1 + rankings) / hours, 6) END AS per_gpu_hour FROM g"""
)
def valued_gaps(spark, d):
    o = t(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("gap"), "o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("p"))
    gaps = o.groupBy("gap").agg((F.count("*") % 3).alias("rankings"), F.element_at(F.array(F.lit("cpu"), F.lit("gpu"), F.lit("none")), (F.min("o_orderkey") % 3 + 1).cast("int")).alias("estimate"), F.round(F.sum("p") / 1000, 3).alias("gpu_hours"))
    members = o.select("gap", F.concat(F.lit("use-case-"), F.col("o_custkey").cast("string")).alias("use_case"))
    return records.valued(gaps, members, _facts(spark, d)).select("gap", F.col("value").cast("bigint").alias("value"), "bucket", "per_gpu_hour")
