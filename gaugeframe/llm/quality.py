"""Quality grades by ordinal cumulative-link regression on hashed text.

A text is a sparse vector of hashed words and of a few counts of its form.  One
weight vector is shared by all grades; ordered thresholds cut its score into
grades: P(grade > k) = sigmoid(score - threshold[k]).  The expected grade and
the tail probability P(grade >= good) follow from it.

The model is fit on a bounded sample of the labelled documents (MAX_RATED, those
with the smallest hashes of their ids) and scores every document in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .columns import shielded
from .storage import in_batches, materialise, table

#: Hashed word features.
BUCKETS = 1 << 16
#: Labelled documents that the model is fit on, at most; their features are some 4 kB each.
MAX_RATED = 12_000
#: Rows whose words the fit handles at once.
BLOCK_ROWS = 2048
#: Documents are kept at this tail probability of a good grade or more.
KEEP_AT = 0.5

#: Form features, each a share of bytes or words, or a saturating count.
FORM = ("letters", "digits", "upper", "punctuation", "symbols", "distinct_words", "repeated_words", "top_word", "word_length", "length")

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 letter, 2 upper-case letter, 3 digit, 4 ordinary punctuation, 5 symbol, 6 space
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[33:127][_KIND[33:127] == 0] = 5
_KIND[[ord(c) for c in ".,;:?!'\"-()"]] = 4
_KIND[[9, 10, 13, 32]] = 6


@dataclass(frozen=True)
class Features:
    """Rows of sparse word weights (of unit length) and dense form features."""

    offsets: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    form: np.ndarray


def featurise(texts: pa.Array, buckets: int = BUCKETS) -> Features:
    """Features of a slice of texts; null counts as empty, and an empty text has no words and a zero form."""
    n = len(texts)
    words, word_at = hashing.word_hashes(texts)
    raw, byte_at = hashing.text_bytes(texts, lower=False)
    owner = np.repeat(np.arange(n), np.diff(word_at))
    cells, inverse, counts = np.unique(owner.astype(np.uint64) * np.uint64(buckets) + words % np.uint64(buckets), return_inverse=True, return_counts=True)
    of = (cells // np.uint64(buckets)).astype(np.int64)
    damped = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(of, damped**2, n))
    n_words = np.maximum(1, np.diff(word_at))
    size = np.maximum(1, np.diff(byte_at))
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(byte_at)) * 7 + _KIND[raw], minlength=7 * n).reshape(n, 7) / size[:, None]
    most = np.zeros(n)
    np.maximum.at(most, of, counts)
    again = np.zeros(n)  # words equal to the word before
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=n)
    form = np.stack(
        [kinds[:, 1] + kinds[:, 2], kinds[:, 3], kinds[:, 2], kinds[:, 4], kinds[:, 5], np.bincount(of, minlength=n) / n_words, again / n_words, most / n_words, np.minimum(4, size / n_words / 8), np.log1p(np.diff(word_at)) / 10],
        axis=1,
    )
    form[np.diff(byte_at) == 0] = 0
    return Features(np.searchsorted(of, np.arange(n + 1)), (cells % np.uint64(buckets)).astype(np.int64), damped / np.maximum(norm[of], 1e-9), form)


@dataclass(frozen=True)
class OrdinalModel:
    """``grades`` ascending; one threshold fewer than grades, ascending."""

    grades: np.ndarray
    words: np.ndarray
    form: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    thresholds: np.ndarray

    def scores(self, x: Features) -> np.ndarray:
        n = len(x.form)
        of = np.repeat(np.arange(n), np.diff(x.offsets))
        return np.bincount(of, self.words[x.buckets] * x.weights, n) + ((x.form - self.mean) / self.scale) @ self.form

    def tails(self, x: Features) -> np.ndarray:
        """P(grade > grades[k]) for each threshold k."""
        return 1 / (1 + np.exp(-np.clip(self.scores(x)[:, None] - self.thresholds[None, :], -40, 40)))


def fit(x: Features, ratings: np.ndarray, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3) -> OrdinalModel:
    """Maximum likelihood with a small ridge, by Adam over the whole sample.

    A single grade gives a model without thresholds, which expects that grade
    of every text.
    """
    grades, y = np.unique(ratings, return_inverse=True)
    mean, scale = x.form.mean(axis=0), np.maximum(x.form.std(axis=0), 1e-3)
    form = (x.form - mean) / scale
    n, k = len(form), len(grades) - 1
    buckets = max(int(x.buckets.max()) + 1 if len(x.buckets) else 1, BUCKETS)
    # rows in blocks, so that what a step makes of their words stays small
    blocks = [(a, min(n, a + BLOCK_ROWS), slice(x.offsets[a], x.offsets[min(n, a + BLOCK_ROWS)])) for a in range(0, n, BLOCK_ROWS)]

    def word_sums(w: np.ndarray) -> np.ndarray:
        """Of the weights of each row's words."""
        return np.concatenate([np.bincount(np.repeat(np.arange(b - a), np.diff(x.offsets[a : b + 1])), w[x.buckets[own]] * x.weights[own], b - a) for a, b, own in blocks])

    def bucket_sums(ds: np.ndarray) -> np.ndarray:
        """Of the gradient's share in each word."""
        out = np.zeros(buckets)
        for a, b, own in blocks:
            out += np.bincount(x.buckets[own], np.repeat(ds[a:b], np.diff(x.offsets[a : b + 1])) * x.weights[own], buckets)
        return out

    if k == 0:
        return OrdinalModel(grades, np.zeros(buckets), np.zeros(form.shape[1]), mean, scale, np.zeros(0))
    shares = np.array([(y > j).mean() for j in range(k)])
    # thresholds are a first value and positive gaps, so that they stay ordered
    t = -np.log(shares / (1 - shares))
    p = np.concatenate([np.zeros(buckets + form.shape[1]), t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    above, below = np.minimum(y, k) - 1, y  # thresholds on either side of the grade
    for step in range(1, steps + 1):
        w, f, cut = p[:buckets], p[buckets : buckets + form.shape[1]], np.cumsum(np.r_[p[-k], np.exp(p[len(p) - k + 1 :])])
        s = word_sums(w) + form @ f
        sig = 1 / (1 + np.exp(-np.clip(s[:, None] - cut[None, :], -40, 40)))  # P(grade > j)
        upper = np.where(y == 0, 1.0, sig[np.arange(n), np.maximum(y - 1, 0)])
        lower = np.where(y == k, 0.0, sig[np.arange(n), np.minimum(y, k - 1)])
        prob = np.maximum(upper - lower, 1e-12)
        du = np.where(y == 0, 0.0, upper * (1 - upper)) / prob
        dl = np.where(y == k, 0.0, lower * (1 - lower)) / prob
        ds = -(du - dl) / n
        dcut = np.bincount(np.maximum(y - 1, 0), du, k)[:k] / n - np.bincount(np.minimum(y, k - 1), dl, k)[:k] / n
        gaps = np.exp(p[len(p) - k + 1 :])
        dgap = np.array([dcut[j + 1 :].sum() * gaps[j] for j in range(k - 1)])
        g = np.concatenate([bucket_sums(ds) + ridge * w / 10, form.T @ ds + ridge * f / 10, [dcut.sum()], dgap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cut = np.cumsum(np.r_[p[-k], np.exp(p[len(p) - k + 1 :])])
    return OrdinalModel(grades, p[:buckets], p[buckets : buckets + form.shape[1]], mean, scale, cut)


def _join_features(parts: list[Features]) -> Features:
    at = np.cumsum([0, *[p.offsets[-1] for p in parts]])
    return Features(np.concatenate([[0], *[p.offsets[1:] + a for p, a in zip(parts, at[:-1], strict=True)]]), np.concatenate([p.buckets for p in parts]), np.concatenate([p.weights for p in parts]), np.concatenate([p.form for p in parts]))


def train(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED, hold_out: bool = False) -> OrdinalModel | None:
    """Model of ``labels.quality`` from at most ``max_rated`` labelled documents of ``docs``; None without any.

    An id that is labelled twice counts with its lowest grade; one that comes
    with several texts with one of them (of the smallest hash).  With
    ``hold_out`` ids whose crc32 is divisible by 5 are left to testing.
    """
    rated = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    if hold_out:
        rated = rated.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    # labels of other documents take no places of the sample, so the limit follows the join; only ids and hashes are shuffled
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_key"))
    chosen = keyed.select("doc_id", "_key").join(rated, "doc_id").groupBy("doc_id").agg(F.min("_key").alias("_key"), F.first("quality").alias("quality"))
    chosen = materialise(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated))
    sample = keyed.join(F.broadcast(chosen), ["doc_id", "_key"]).select("doc_id", "text", "quality")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in hashing.chunks(batch.column(1)):
                x = featurise(texts)
                cells = [x.buckets[a:b].astype(np.int32).tobytes() for a, b in zip(x.offsets[:-1], x.offsets[1:], strict=True)]
                weights = [x.weights[a:b].astype(np.float32).tobytes() for a, b in zip(x.offsets[:-1], x.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(cells, pa.binary()), pa.array(weights, pa.binary()), pa.array([f.tobytes() for f in x.form], pa.binary())], names=["doc_id", "quality", "cells", "weights", "form"])

    # rows that repeat an id and its text are one, so at most max_rated rows reach the driver
    rows = in_batches(sample).mapInArrow(run, "doc_id bigint, quality double, cells binary, weights binary, form binary").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    if rows.num_rows == 0:
        return None
    sizes = np.array([len(c) // 4 for c in rows["cells"].to_pylist()])
    x = Features(
        np.cumsum([0, *sizes]),
        np.frombuffer(b"".join(rows["cells"].to_pylist()), np.int32),
        np.frombuffer(b"".join(rows["weights"].to_pylist()), np.float32),
        np.frombuffer(b"".join(rows["form"].to_pylist())).reshape(rows.num_rows, -1),
    )
    ratings = rows["quality"].to_numpy()
    del rows
    return fit(x, ratings)


def grade(docs: DataFrame, model: OrdinalModel | None, good: float | None = None) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``p_good`` = P(grade >= ``good``), by default the highest grade.

    Every row gets both, null and empty texts too, as texts without words, and
    repeated rows alike; whole texts are read, however long.  Without a model
    (no labels) both are null; an empty table stays empty.  Columns of the
    caller stay, whatever their names, but those two are replaced.
    """
    kept = [c for c in docs.columns if c not in ("expected_grade", "p_good")]
    docs = docs.select(*[f"`{c}`" for c in kept])
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "p_good": F.lit(None).cast("double")})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.index("text")
    good = float(model.grades[-1]) if good is None else good
    cut = int(np.searchsorted(model.grades, good))  # P(grade >= grades[cut]) is the tail of threshold cut - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            expected, tail = [np.zeros(0)], [np.zeros(0)]
            for _, texts in hashing.chunks(batch.column(at)):
                tails = m.tails(featurise(texts))
                expected.append(m.grades[0] + tails @ np.diff(m.grades))
                tail.append(np.ones(len(texts)) if cut == 0 else tails[:, cut - 1] if cut <= tails.shape[1] else np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(expected)), pa.array(np.concatenate(tail))], names=[*kept, "expected_grade", "p_good"])

    return in_batches(docs).mapInArrow(run, docs.withColumns({"expected_grade": F.lit(0.0).try_cast("double"), "p_good": F.lit(0.0).try_cast("double")}).schema)


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` whose tail probability of the highest grade is ``keep_at`` or more (all, if nothing is labelled)."""
    model = train(docs, labels)

    def good(d: DataFrame) -> DataFrame:
        return grade(d, model).filter((F.col("p_good") >= keep_at) | F.col("p_good").isNull()).select(*d.columns)

    return shielded(docs, ["text"], good)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    graded = grade(docs.select("doc_id", "text"), train(docs, labels))
    return graded.select("doc_id", "expected_grade", "p_good", (F.col("p_good") >= KEEP_AT).alias("keep"))
