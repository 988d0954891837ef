"""Toxicity scores from class-conditional Kneser-Ney word models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary
labelled documents, back off to shared ones at both orders: a class's bigrams
to the bigrams of both classes in equal weight, and its continuation counts to
those of both.  So an expression that is rare in a class is judged as in the
other, and tells nothing.

The evidence is the difference of the two log-likelihoods, each divided by the
number of words: over the whole text, and over its EXPRESSIONS strongest words,
as toxic expressions are a few words in a text of any length.  A logistic curve
of the two is the score.

Bigrams are counted once a text, and copies of a text once, as copies say nothing
about a language.  Discounts are estimated from the numbers of bigrams seen once
and twice.

Words are hashed into ``VOCABULARY`` ids.  Every bigram, context and word of the
labelled documents is counted, in a table that grows with the corpus.  Of it the
scores need only the rows whose discounted counts are above zero (of a class, or
of both together): for all others the formulas give the same ratio as for rows
that are not there, so leaving these out changes no score.  Models of up to
``BROADCAST_ROWS`` such rows go to the tasks as sorted arrays.  Of larger ones the
tasks hold the most frequent rows and Bloom filters of the others, so that only
bigrams that a filter lets pass are joined with the table, with the same result:
a bigram without a row has the sum of two ratios, one of its context and one of
its word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .bits import HashFilter
from .storage import discard, in_batches, materialise, shared_folder, table, written

VOCABULARY = 1 << 31
#: Taken from every continuation count for the back-off.
DISCOUNT = 0.75
PREDICT_AT = 0.7
#: Strongest words of a text whose mean log ratio is its second evidence (all words, if it has fewer).
EXPRESSIONS = 3
#: Evidence is binned for the fit of the curve: width of a bin and bins to either side of 0, of the whole text and of the strongest words.
BINS = ((0.01, 200), (0.05, 160))
#: Labels up to which they are broadcast to the documents (12 bytes each).
BROADCAST_LABELS = 1_000_000
#: Bigrams, contexts and words of the model together up to which they are broadcast (16 bytes a bigram, 56 a context, 24 a word).
#: Of larger models as many rows are (16 bytes each), a third of them contexts and a third words at most.
BROADCAST_ROWS = 8_000_000
#: Bits a row of the filters of all other rows, and of a filter at most; beyond, it passes more bigrams to the join.
FILTER_BITS, MOST_FILTER_BITS = 24, 1 << 29
#: Texts that a task remembers, to hand on the bigrams of a copied text once.
HELD_TEXTS = 100_000
#: Distinct bigrams that a task sums before it hands them on.
HELD_BIGRAMS = 1 << 20


def fold(doc_id: Column) -> Column:
    """By crc32 of the id's text: 1 is held out (remainder 1 of 3); of the others a quarter is 2, for the curve, the rest 0, for the counts."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.when(crc % 3 == 1, 1).when(F.floor(crc / 3) % 4 == 0, 2).otherwise(0)


def _ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words and of the words before them (0 before the first), and the offsets of the texts."""
    words, offsets = hashing.word_hashes(texts)
    w = (words % np.uint64(VOCABULARY - 1)).astype(np.int64) + 1
    v = np.zeros_like(w)
    v[1:] = w[:-1]
    v[offsets[:-1][np.diff(offsets) > 0]] = 0
    return v, w, offsets


def _by_text(v: np.ndarray, w: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the text and bigram (the word in its high bits) of every word, sorted by both."""
    text, pair = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), w * VOCABULARY + v
    order = np.lexsort((pair, text))
    return text[order], pair[order]


def _first(text: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Where each distinct bigram of a text begins in the sorted ones."""
    return np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])]) if len(pair) else np.zeros(0, np.int64)


def _balanced(n0, n1, scale: tuple[float, float]):
    """Count of a bigram in both classes, which get the same weight; the arguments are columns or arrays."""
    return n0 * scale[0] + n1 * scale[1]


def _probabilities(n: dict, of: dict, word: dict, scale: tuple[float, float], discounts: tuple[float, float, float], positive) -> list:
    """Probabilities of a word after a context by class, from the counts of its bigram; the values are columns or arrays."""
    both = positive(_balanced(n["n0"], n["n1"], scale) - discounts[2]) * of["i"]
    return [positive(n[f"n{c}"] * scale[c] - discounts[c]) * of[f"i{c}"] + of[f"b{c}"] * (both + of["b"] * word[f"p{c}"]) for c in (0, 1)]


@dataclass(frozen=True)
class Head:
    """What the tasks hold of a model that is too large for them: its most frequent rows, and filters of the others."""

    #: The sorted ids and their log ratios: of bigrams, of contexts and of words (each the ratio of its back-off weights or probabilities).
    arrays: tuple[dict[str, np.ndarray], ...]
    #: Filters of the bigrams, contexts and words that ``arrays`` lacks.
    filters: tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Model:
    """Tables of the bigrams, contexts and words that tell something, the same as sorted arrays if they are few, else their head, and the curve; class 0 is ordinary, 1 toxic."""

    #: ``id, n0, n1``, and ``ratio``, the log ratio of the probabilities, if there is a head
    pairs: DataFrame
    #: ``id``, the number ``n`` of bigrams, the inverse counts ``i0, i1`` (scaled) and ``i`` (of both classes), and the back-off weights ``b0, b1, b``
    contexts: DataFrame
    #: ``id, n, p0, p1``
    words: DataFrame
    #: Of words that no labelled document has.
    p_new: tuple[float, float]
    #: Of the counts of each class.
    scale: tuple[float, float]
    #: Taken from the counts of bigrams, of each class and of both.
    discounts: tuple[float, float, float]
    arrays: Broadcast | None
    slopes: tuple[float, float] = (0.0, 0.0)
    intercept: float = 0.0
    prior: float = 0.0
    #: Of a model without ``arrays``.
    head: Broadcast | None = None
    #: ``id, ratio`` of the bigrams that the head lacks.
    rest: DataFrame | None = None
    #: Whether the head lacks contexts or words.
    vague: bool = False

    def evidence(self, docs: DataFrame) -> DataFrame:
        """``docs`` with, in place of ``text``, ``evidence`` and ``run_evidence``: mean log ratio of the probabilities of all words and of the strongest; null for texts without words."""
        names = [c for c in docs.columns if c != "text"]
        return self._by_lookup(docs.select(*names, "text")) if self.arrays is not None else self._by_head(docs.select(*names, "text"))

    def _by_lookup(self, docs: DataFrame) -> DataFrame:
        arrays, scale, discounts, names = self.arrays, self.scale, self.discounts, [*docs.columns[:-1], "evidence", "run_evidence"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, texts in hashing.chunks(batch.column(batch.num_columns - 1)):
                    e = _evidence(texts, arrays.value, scale, discounts)
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(texts)) for c in batch.columns[:-1]], *[pa.array(e[:, k], from_pandas=True) for k in (0, 1)]], names=names)

        return in_batches(docs).mapInArrow(run, docs.withColumns({"evidence": F.lit(0.0), "run_evidence": F.lit(0.0)}).drop("text").schema.simpleString()[7:-1].replace(":", " "))

    def _by_head(self, docs: DataFrame) -> DataFrame:
        """Without a bound on the tables; words that the head leaves open wait for a join, and the three strongest of both kinds are merged."""
        head, vague, names = self.head, self.vague, [*docs.columns[:-1], "_key", "_sum", "_n", "_best", "_open"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: set[int] = set()
            epoch = 0  # texts that were forgotten get other keys, so that no key has its bigrams twice
            for batch in batches:
                of_text = batch.column(batch.num_columns - 2).to_numpy()
                for at, texts in hashing.chunks(batch.column(batch.num_columns - 1)):
                    if len(held) > HELD_TEXTS:
                        held, epoch = set(), epoch + 1
                    with np.errstate(over="ignore"):
                        keys = hashing.mix64(of_text[at : at + len(texts)].astype(np.uint64) + np.uint64(epoch)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(texts)) for c in batch.columns[:-2]], pa.array(keys), *_partly(texts, keys, held, head.value, vague)], names=names)

        # a key of each task's own, as copies of a text may be in any number of tasks
        keyed = docs.select(*docs.columns[:-1], F.xxhash64("text", F.spark_partition_id()).alias("_key"), "text")
        kinds = {"_sum": F.lit(0.0), "_n": F.lit(0).cast("bigint"), "_best": F.lit(None).cast("array<double>"), "_open": F.lit(None).cast("array<struct<pair:bigint,n:bigint,known:double>>")}
        judged = written(in_batches(keyed).mapInArrow(run, keyed.drop("text").withColumns(kinds).schema))
        rows = judged.filter(F.size("_open") > 0).select("_key", F.inline("_open"))
        found = rows.join(self.rest.withColumnRenamed("id", "pair"), "pair", "left")
        ratio = [F.col("ratio"), F.col("known")]
        if self.vague:
            seen = rows.filter("known IS NULL").select("pair").distinct().withColumns({"_w": F.shiftright("pair", 31), "_v": F.col("pair").bitwiseAND(VOCABULARY - 1)})
            of_context, of_word = self.tilts()
            seen = seen.join(of_context.select(F.col("id").alias("_v"), F.col("ratio").alias("_of_v")), "_v", "left").join(of_word.select(F.col("id").alias("_w"), F.col("ratio").alias("_of_w")), "_w", "left")
            seen = seen.select("pair", (F.coalesce("_of_v", F.lit(0.0)) + F.coalesce("_of_w", F.lit(self.tilt_new()))).alias("_default"))
            found, ratio = found.join(seen, "pair", "left"), [*ratio, F.col("_default")]
        found = found.select("_key", "n", F.coalesce(*ratio).alias("ratio"))
        rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("ratio"), "n"))
        strong = F.when(F.col("_rank") <= EXPRESSIONS, F.expr(f"array_repeat(ratio, int(least(n, {EXPRESSIONS})))"))
        found = found.withColumn("_rank", rank).groupBy("_key").agg(F.sum(F.col("n") * F.col("ratio")).alias("_more"), F.flatten(F.collect_list(strong)).alias("_also"))
        best = F.slice(F.sort_array(F.concat("_best", F.coalesce("_also", F.array().cast("array<double>"))), asc=False), 1, EXPRESSIONS)
        means = {"evidence": (F.col("_sum") + F.coalesce("_more", F.lit(0.0))) / F.col("_n"), "run_evidence": F.aggregate(best, F.lit(0.0), lambda x, y: x + y) / F.size(best)}
        return judged.join(found, "_key", "left").select(*docs.columns[:-1], *[F.when(F.col("_n") > 0, x).alias(c) for c, x in means.items()])

    def tilts(self) -> tuple[DataFrame, DataFrame]:
        """``id, n, ratio`` of the contexts and of the words; a bigram without a row has the sum of both ratios."""
        return self.contexts.select("id", "n", (F.log("b1") - F.log("b0")).alias("ratio")), self.words.select("id", "n", (F.log("p1") - F.log("p0")).alias("ratio"))

    def tilt_new(self) -> float:
        """The ratio of words that no labelled document has."""
        return float(np.log(self.p_new[1]) - np.log(self.p_new[0]))

    def with_head(self, rows: int) -> Model:
        """The model with the ratios of its bigrams in a table, and a head of ``rows`` rows."""
        seen = self.pairs.withColumns({"_w": F.shiftright("id", 31), "_v": F.col("id").bitwiseAND(VOCABULARY - 1)})
        # a bigram that tells something has its context and its word in their tables; the table with fewer columns comes first
        seen = seen.join(self.words.select(F.col("id").alias("_w"), "p0", "p1"), "_w").join(self.contexts.drop("n").withColumnRenamed("id", "_v"), "_v")
        of = {c: F.col(c) for c in ("n0", "n1", "i0", "i1", "i", "b0", "b1", "b", "p0", "p1")}
        p = _probabilities(of, of, of, self.scale, self.discounts, lambda x: F.greatest(x, F.lit(0.0)))
        pairs = written(seen.select("id", "n0", "n1", (F.log(p[1]) - F.log(p[0])).alias("ratio")))

        room, arrays, filters, rests, lacks = rows, [], [], [], []
        of_context, of_word = self.tilts()
        for kept, most, absent in ((of_context, rows // 3, 0.0), (of_word, rows // 3, self.tilt_new()), (pairs.withColumn("n", F.col("n0") + F.col("n1")), rows, float("nan"))):
            kept = kept.withColumn("_level", F.floor(F.log2("n") * 16).cast("int"))
            least, n, lack = None, 0, 0
            for r in sorted(kept.groupBy("_level").count().collect(), reverse=True):
                if not lack and n + r["count"] <= min(most, room):
                    least, n = r["_level"], n + r["count"]
                else:
                    lack += r["count"]
            inside = F.lit(False) if least is None else F.col("_level") >= least
            rests.append(kept.filter(~inside).select("id", "ratio"))
            arrays.append(_sorted(kept.filter(inside), {"ratio": absent}))
            filters.append(_filter(rests[-1], lack))
            lacks.append(lack)
            room -= n
        head = Head((arrays[2], arrays[0], arrays[1]), (filters[2], filters[0], filters[1]))
        return replace(self, pairs=pairs, head=pairs.sparkSession.sparkContext.broadcast(head), rest=rests[2], vague=any(lacks[:2]))

    def score(self) -> Column:
        """Probability of the toxic label from ``evidence`` and ``run_evidence``; the share of toxic labels for texts without words."""
        x = F.col("evidence") * self.slopes[0] + F.col("run_evidence") * self.slopes[1] + self.intercept
        return F.when(F.col("evidence").isNull(), self.prior).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x)))))


def _rows(table: dict[str, np.ndarray], wanted: np.ndarray) -> dict[str, np.ndarray]:
    """The other columns of the rows with these ids."""
    at = np.searchsorted(table["id"], wanted)
    at = np.where(table["id"][at] == wanted, at, len(table["id"]) - 1)  # the last row stands for what is not there
    return {c: x[at] for c, x in table.items() if c != "id"}


def _strongest(ratio: np.ndarray, begin: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The greatest ratio of each text, the next one and so on, -inf where there is none; ``ratio`` is used up."""
    of, out = np.repeat(np.arange(len(n)), n), []
    for _ in range(EXPRESSIONS):
        out.append(np.maximum.reduceat(ratio, begin))
        at = np.flatnonzero(ratio == out[-1][of])
        ratio[at[np.unique(of[at], return_index=True)[1]]] = -np.inf  # one word of each text
    return out


def _evidence(texts: pa.Array, arrays: tuple[dict[str, np.ndarray], ...], scale: tuple[float, float], discounts: tuple[float, float, float]) -> np.ndarray:
    """Mean log ratio of all words and of the strongest of each text; NaN for texts without words."""
    v, w, offsets = _ids(texts)
    pairs, contexts, words = arrays
    counts = {c: x.astype(np.float64) for c, x in _rows(pairs, w * VOCABULARY + v).items()}
    p = _probabilities(counts, _rows(contexts, v), _rows(words, w), scale, discounts, lambda x: np.maximum(x, 0))
    ratio = np.log(p[1]) - np.log(p[0])
    n = np.diff(offsets)
    some, out = n > 0, np.full((len(n), 2), np.nan)
    if some.any():
        begin, n = offsets[:-1][some], n[some]
        out[some, 0] = np.add.reduceat(ratio, begin) / n
        total = np.zeros(len(n))
        for k, most in enumerate(_strongest(ratio, begin, n)):
            total += np.where(n > k, most, 0)
        out[some, 1] = total / np.minimum(n, EXPRESSIONS)
    return out


def _partly(texts: pa.Array, keys: np.ndarray, held: set[int], head: Head, vague: bool) -> list[pa.Array]:
    """For each text the sum of the ratios that the head knows, the number of all words, the strongest of what it knows, and the bigrams that it leaves open.

    These have the ratio that they have if no row of the table is theirs, or null if the head lacks
    that too.  Texts whose keys are in ``held`` leave nothing open again.
    """
    v, w, offsets = _ids(texts)
    pair, n = w * VOCABULARY + v, np.diff(offsets)
    pairs, contexts, words = head.arrays
    ratio = _rows(pairs, pair)["ratio"]
    other = np.flatnonzero(np.isnan(ratio))
    default = _rows(contexts, v[other])["ratio"] + _rows(words, w[other])["ratio"]
    ratio[other] = default
    waits = _may_hold(head.filters[0], pair[other])
    if vague:
        unknown = _may_hold(head.filters[1], v[other]) | _may_hold(head.filters[2], w[other])
        default[unknown] = np.nan
        waits |= unknown
    at, default = other[waits], default[waits]

    ratio[at] = 0
    some, total = n > 0, np.zeros(len(n))
    best = np.full((len(n), EXPRESSIONS), -np.inf)
    if some.any():
        begin = offsets[:-1][some]
        total[some] = np.add.reduceat(ratio, begin)
        ratio[at] = -np.inf
        best[some] = np.stack(_strongest(ratio, begin, n[some]), axis=1)
    known = np.isfinite(best)

    text = np.repeat(np.arange(len(n)), n)[at]
    fresh = np.zeros(len(n), bool)
    for i in np.unique(text):
        fresh[i] = int(keys[i]) not in held
        held.add(int(keys[i]))
    text, pair, default = text[fresh[text]], pair[at[fresh[text]]], default[fresh[text]]
    order = np.lexsort((pair, text))
    text, pair, default = text[order], pair[order], default[order]
    first = _first(text, pair)
    times = np.diff(np.r_[first, len(pair)]).astype(np.int64)
    waiting = pa.StructArray.from_arrays([pa.array(pair[first]), pa.array(times), pa.array(default[first], from_pandas=True)], names=["pair", "n", "known"])

    def lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)

    return [pa.array(total), pa.array(n.astype(np.int64)), lists(known.sum(axis=1), pa.array(best[known])), lists(np.bincount(text[first], minlength=len(n)), waiting)]


def _filter_bits(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter and the bits of each id there, as in ``bits.HashFilter``."""
    h = hashing.mix64(ids.astype(np.uint64))
    bits = np.zeros(len(h), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(24)) % np.uint64(words)).astype(np.int64), bits.view(np.int64)


def _may_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    word, bits = _filter_bits(ids, len(words))
    return words[word] & bits == bits


def _filter(rows: DataFrame, n: int) -> np.ndarray:
    """The filter of the ids of a table of ``n`` rows."""
    words = HashFilter.sized(n, FILTER_BITS, MOST_FILTER_BITS).words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _filter_bits(batch.column(0).to_numpy(), words))), names=["word", "bits"])

    out = np.zeros(words, np.int64)
    if n:
        kept = rows.select("id").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        for word, bits in _pieces(kept, {"word": np.dtype(np.int64), "bits": np.dtype(np.int64)}):
            out[word] = bits
    return out


def _pieces(rows: DataFrame, types: dict[str, np.dtype]) -> Iterator[list[np.ndarray]]:
    """These columns of a table, batch after batch; the driver takes one partition at a time."""
    names = list(types)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in names], names=names)

    for r in rows.select(*names).mapInArrow(run, ", ".join(f"{c} binary" for c in names)).toLocalIterator():
        yield [np.frombuffer(r[c], types[c]) for c in names]


def _sorted(rows: DataFrame, absent: dict[str, float]) -> dict[str, np.ndarray]:
    """The columns of a table as arrays in the order of ``id``, with a last row for ids that it does not have."""
    names = ["id", *absent]
    types = {"id": np.dtype(np.int64)} | {f.name: np.dtype(np.int32 if f.dataType.simpleString() == "int" else np.float64) for f in rows.schema.fields if f.name in absent}
    parts, out = list(_pieces(rows, {c: types[c] for c in names})), {}
    for k, c in enumerate(names):
        out[c] = np.concatenate([*[x[k] for x in parts], np.array([np.iinfo(np.int64).max if c == "id" else absent[c]], types[c])])
        for x in parts:
            x[k] = None
    order = np.argsort(out["id"])
    for c in names:
        out[c] = out[c][order]
    return out


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, fold`` of the labelled documents that are not held out; an id labelled twice counts as toxic if any label says so."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(fold(F.col("doc_id")) != 1)
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id").select("doc_id", "text", "toxic", fold(F.col("doc_id")).cast("int").alias("fold"))


def _once(labelled: DataFrame) -> DataFrame:
    """``text, toxic`` of one document of each text and class; only hashes are shuffled."""
    keyed = labelled.withColumn("_key", F.xxhash64("text"))
    first = materialise(keyed.groupBy("_key", "toxic").agg(F.min("doc_id").alias("doc_id")).select("_key", "doc_id"))
    if first.count() <= BROADCAST_LABELS:
        first = F.broadcast(first)
    return keyed.join(first, ["_key", "doc_id"], "left_semi").select("text", "toxic")


def bigram_counts(labelled: DataFrame) -> DataFrame:
    """``pair, n0, n1``: every distinct bigram with the number of texts of each class that have it."""
    return bigram_and_context_counts(labelled).filter(F.shiftright("pair", 31) > 0)


def bigram_and_context_counts(labelled: DataFrame) -> DataFrame:
    """The same, and pairs without a word (high bits 0), which hold the sums over all bigrams of a context.

    Each task sums its own rows first.  Rows are dealt by ranges of ``pair``, so that all
    bigrams of a word lie together and a frequent word is many ranges.
    """

    def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        pair, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return pair, *[np.bincount(inverse, np.concatenate([x[c] for x in held]), len(pair)).astype(np.int64) for c in (1, 2)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for at, texts in hashing.chunks(batch.column(0)):
                text, pair = _by_text(*_ids(texts))
                first = _first(text, pair)
                of, pair = toxic[at + text[first]] > 0, pair[first]
                held += [(x, (~of).astype(np.int64), of.astype(np.int64)) for x in (pair, pair % VOCABULARY)]
                size += 2 * len(pair)
                if size > 4 * HELD_BIGRAMS:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD_BIGRAMS:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=["pair", "n0", "n1"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed(held))), names=["pair", "n0", "n1"])

    rows = in_batches(labelled.select("text", "toxic")).mapInArrow(run, "pair bigint, n0 bigint, n1 bigint")
    return rows.repartitionByRange("pair").groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discount(once: int, twice: int) -> float:
    """Ney's estimate from the numbers of bigrams that were seen once and twice, always below 1."""
    return once / (once + 2 * twice) if once and twice else 0.75


def build(counts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> Model:
    """The two models from ``bigram_and_context_counts``; at most ``broadcast_rows`` of their rows come to the driver, the most frequent ones."""
    word, context = F.shiftright("pair", 31), F.col("pair").bitwiseAND(VOCABULARY - 1)
    pairs = counts.filter(word > 0)
    seen = [(F.col(c) > 0).cast("bigint") for c in ("n0", "n1")]
    often = [F.sum((F.col(f"n{c}") == k).cast("bigint")).alias(f"n{c}_{k}") for c in (0, 1) for k in (1, 2)]
    t = pairs.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(seen[0]).alias("k0"), F.sum(seen[1]).alias("k1"), F.count("*").alias("k"), *often).first()
    # Counts of the larger class are scaled to the size of the smaller, so that the same discount means the same
    # rarity in both; otherwise every rare word would speak for the class of which more is known.
    tokens, types = [max(1, t["n0"] or 0), max(1, t["n1"] or 0)], [max(1, t["k0"] or 0), max(1, t["k1"] or 0)]
    rarer, scale = [min(types) / k for k in types], (min(tokens) / tokens[0], min(tokens) / tokens[1])
    of_class = [discount(t[f"n{c}_1"] or 0, t[f"n{c}_2"] or 0) for c in (0, 1)]
    discounts = (*of_class, max(of_class))

    above = {f"m{c}": F.greatest(F.col(f"n{c}") * scale[c] - discounts[c], F.lit(0.0)) for c in (0, 1)} | {"m": F.greatest(_balanced(F.col("n0"), F.col("n1"), scale) - discounts[2], F.lit(0.0))}
    tells = (F.col("m0") > 0) | (F.col("m1") > 0) | (F.col("m") > 0)
    telling = pairs.withColumns(above).filter(tells)

    word_sums = materialise(pairs.withColumns(above).groupBy(word.alias("id")).agg(F.sum(seen[0]).alias("k0"), F.sum(seen[1]).alias("k1"), F.count("*").alias("k"), F.sum(F.col("n0") + F.col("n1")).alias("n"), F.max(tells).alias("held")))
    freed = [F.sum(F.least(F.col(f"k{c}") * rarer[c], F.lit(DISCOUNT))).alias(f"f{c}") for c in (0, 1)]
    # A word whose continuation counts are below the discount has the same ratio of probabilities whatever it is, unless
    # a bigram that tells something holds it; a context without such a bigram has the back-off weight 1.
    wanted = (F.col("k0") * rarer[0] > DISCOUNT) | (F.col("k1") * rarer[1] > DISCOUNT) | F.col("held")
    w = word_sums.agg(F.count("*").alias("n"), F.count_if(wanted).alias("wanted"), *freed).first()
    mass = t["k"] + w["n"] + 1
    share = [w[f"f{c}"] / min(types) if w["n"] and t[f"k{c}"] else 1.0 for c in (0, 1)]
    p_new = (share[0] * 2 / mass, share[1] * 2 / mass)
    words = word_sums.filter(wanted).select("id", "n", *[(F.greatest(F.col(f"k{c}") * rarer[c] - DISCOUNT, F.lit(0.0)) / float(min(types)) + (F.col("k") + 1) * (share[c] / mass)).alias(f"p{c}") for c in (0, 1)])

    def inverse(n: Column) -> Column:
        return 1 / F.greatest(n.cast("double"), F.lit(1e-9))

    # the sums of a context meet those of its bigrams that tell something
    total, own = [F.sum(F.when(word == 0, F.col(n))).alias(n) for n in ("n0", "n1")], [F.sum(F.when(word > 0, F.col(m))).alias(m) for m in above]
    contexts = counts.withColumns(above).filter((word == 0) | tells).groupBy(context.alias("id")).agg(*total, *own).filter("m IS NOT NULL")
    contexts = contexts.withColumns({"i0": inverse(F.col("n0") * scale[0]), "i1": inverse(F.col("n1") * scale[1]), "i": inverse(_balanced(F.col("n0"), F.col("n1"), scale))})
    contexts = contexts.select("id", (F.col("n0") + F.col("n1")).alias("n"), "i0", "i1", "i", *[F.greatest(1 - F.col(f"m{c}") * F.col(f"i{c}"), F.lit(1e-4)).alias(f"b{c}") for c in ("0", "1", "")])
    telling = telling.select(F.col("pair").alias("id"), "n0", "n1")

    arrays = None
    size = telling.agg(F.count("*").alias("n"), F.greatest(F.max("n0"), F.max("n1")).alias("most")).first()
    contexts = materialise(contexts)
    if size["n"] + w["wanted"] + contexts.count() <= broadcast_rows:
        kind = "int" if (size["most"] or 0) < 1 << 31 else "double"  # counts of more than 31 bits are kept as doubles
        small = telling.select("id", F.col("n0").cast(kind), F.col("n1").cast(kind))
        arrays = pairs.sparkSession.sparkContext.broadcast(
            (_sorted(small, {"n0": 0, "n1": 0}), _sorted(contexts, {"i0": 0, "i1": 0, "i": 0, "b0": 1, "b1": 1, "b": 1}), _sorted(words, {"p0": p_new[0], "p1": p_new[1]}))
        )
    model = Model(telling, contexts, words, p_new, scale, discounts, arrays)
    return model if arrays is not None else model.with_head(broadcast_rows)


def calibrate(model: Model, labelled: DataFrame) -> Model:
    """The logistic curve of the evidence of labelled documents that the counts have not seen, from a histogram of bounded size."""
    bins = [F.greatest(F.lit(-most), F.least(F.lit(most), F.rint(F.col(c) / width))).cast("int").alias(name) for c, name, (width, most) in zip(("evidence", "run_evidence"), ("whole", "run"), BINS, strict=True)]
    rows = model.evidence(labelled.select("text", "toxic")).filter("evidence IS NOT NULL").select(*bins, "toxic").groupBy("whole", "run", "toxic").count().collect()
    x = np.array([[r["whole"] * BINS[0][0], r["run"] * BINS[1][0]] for r in rows]).reshape(-1, 2)
    y = np.array([float(r["toxic"] > 0) for r in rows])
    n = np.array([float(r["count"]) for r in rows])
    prior = float((n * y).sum() / n.sum()) if len(rows) else 0.0
    if not 0 < prior < 1:
        return replace(model, slopes=(0.0, 0.0), intercept=40.0 if prior >= 1 else -40.0, prior=prior)
    mean = (n[:, None] * x).sum(axis=0) / n.sum()
    scale = np.maximum(1e-6, np.sqrt((n[:, None] * (x - mean) ** 2).sum(axis=0) / n.sum()))
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    beta, ridge = np.array([0.0, 0.0, np.log(prior / (1 - prior))]), np.array([0.1, 0.1, 1e-9])
    for _ in range(100):  # Newton steps; the small ridge bounds the slopes of separable classes
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (n * (p - y)) + ridge * np.r_[beta[:2], 0])
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[:2] / scale
    return replace(model, slopes=(float(slopes[0]), float(slopes[1])), intercept=float(beta[2] - slopes @ mean), prior=prior)


def train(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> Model:
    """Counts over all labelled documents of fold 0, the curve over all of fold 2; held-out labels are not read."""
    labelled = _labelled(docs, labels)
    path = f"{shared_folder(docs.sparkSession)}/table-{uuid.uuid4().hex}"
    model = build(written(bigram_and_context_counts(_once(labelled.filter("fold = 0"))), path), broadcast_rows)
    if model.arrays is None:  # the tables of such a model are written
        discard(docs.sparkSession, path)
    return calibrate(model, labelled.filter("fold = 2"))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, run_evidence`` of every row.

    Only the text counts.  Null, empty and wordless texts score the share of
    toxic labels and have no evidence; without labels every text scores 0.
    Repeated rows score alike; rows with a null id are scored and not held out.
    Whole texts are read, however long.  An empty table has no scores.  Other
    columns of ``docs`` are not returned, whatever their names.
    """
    scored = model.evidence(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).withColumn("score", model.score())
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "evidence", "run_evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
