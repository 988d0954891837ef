"""Fitted heads: constants, ridge and logistic probes, from sums that tasks combine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.sequence import char_ngrams
from ..storage import materialise
from . import sparse
from .joins import with_row


def training_mean(rows: DataFrame, split: str, target: str, value: str = "train") -> DataFrame:
    """One row of ``mean, n`` of the training rows."""
    return rows.filter(F.col(split) == value).agg(F.avg(target).alias("mean"), F.count(target).alias("n"))


def majority(rows: DataFrame, split: str, target: str, value: str = "train") -> DataFrame:
    """One row of ``class, n``: the most frequent training class, the lowest of equals."""
    return rows.filter(F.col(split) == value).groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(1)


def constant_scores(rows: DataFrame, split: str, target: str, test: str = "test") -> DataFrame:
    """The training mean as the score of every test row."""
    return with_row(rows.filter(F.col(split) == test), training_mean(rows, split, target).select(F.col("mean").alias("score")))


def moments(rows: DataFrame, features: str, target: str) -> dict[str, np.ndarray]:
    """Sums for least squares (n, sum of x, x x', x y, y, y y): each task adds its own and returns one row of d * d numbers."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            x = np.stack(b["x"].to_numpy()).astype(float) if len(b) else np.zeros((0, 0))
            if not len(b):
                continue
            y = b["y"].to_numpy(dtype=float)
            one = np.concatenate([[len(y)], x.sum(0), (x.T @ x).ravel(), x.T @ y, [y.sum(), y @ y]])
            total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"s": [total.tolist()]})

    parts = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").mapInPandas(run, "s array<double>")
    # element by element, so that sums of tasks combine before they reach the driver
    sums = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    s = np.array([r["v"] for r in sums])
    if not len(s):
        raise ValueError("no rows to fit")
    d = round((-2 + np.sqrt(4 + 4 * (len(s) - 3))) / 2)
    return {"n": s[0], "x": s[1 : d + 1], "xx": s[d + 1 : d + 1 + d * d].reshape(d, d), "xy": s[d + 1 + d * d : 2 * d + 1 + d * d], "y": s[-2], "yy": s[-1]}


def ridge(m: dict[str, np.ndarray], alpha: float, standardise_target: bool = True) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ridge regression with an unpenalised intercept, in closed form.

    With a standardised target (population deviation) the solution is scaled
    back; the penalty then means the same whatever the target's unit.
    """
    n, mean, centre = m["n"], m["x"] / m["n"], m["y"] / m["n"]
    xx = m["xx"] - n * np.outer(mean, mean)
    xy = m["xy"] - n * mean * centre
    w = np.linalg.solve(xx + alpha * np.eye(len(mean)), xy)
    return w, float(centre - mean @ w)


def ridge_leave_one_out(rows: DataFrame, features: str, target: str, alphas: Sequence[float]) -> list[Row]:
    """``alpha, mse`` of leave-one-out errors e / (1 - h), which need one more pass and no refits."""
    m = moments(rows, features, target)
    n, mean = m["n"], m["x"] / m["n"]
    xx = m["xx"] - n * np.outer(mean, mean)
    models = []
    for a in alphas:
        w, b = ridge(m, a)
        models.append((a, w, b, np.linalg.inv(xx + a * np.eye(len(mean)))))
    shared = rows.sparkSession.sparkContext.broadcast((mean, n, models))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, n, models = shared.value
        for b in batches:
            if not len(b):
                continue
            x, y = np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(dtype=float)
            for a, w, c, inverse in models:
                z = x - centre
                h = 1 / n + np.einsum("ij,jk,ik->i", z, inverse, z)
                e = (y - x @ w - c) / (1 - h)
                yield pd.DataFrame({"alpha": [a], "e": [float((e**2).sum())], "n": [len(e)]})

    clean = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return clean.mapInPandas(run, "alpha double, e double, n long").groupBy("alpha").agg((F.sum("e") / F.sum("n")).alias("mse")).orderBy("mse", "alpha").collect()  # one row per alpha


def linear_scores(rows: DataFrame, features: str, weights: np.ndarray, intercept: float, name: str = "score") -> DataFrame:
    """``intercept + features . weights`` as a JVM expression."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(F.col(features).cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn(name, dot + F.lit(float(intercept)))


def logistic_probe(train: DataFrame, test: DataFrame, features: str, target: str, c: float = 1.0, balanced: bool = False) -> DataFrame:
    """``test`` with ``score``: probability of class 1 by L2 logistic regression with inverse strength ``c``."""
    from pyspark.ml.classification import LogisticRegression

    def vectors(df: DataFrame) -> DataFrame:
        return df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))

    n = train.agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("p")).first()
    weight = F.when(F.col(target) == 1, n["n"] / (2 * n["p"])).otherwise(n["n"] / (2 * (n["n"] - n["p"]))) if balanced else F.lit(1.0)
    model = LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="_w", regParam=1 / (c * n["n"]), standardization=False, maxIter=200, tol=1e-10).fit(vectors(train).withColumns({"_y": F.col(target).cast("double"), "_w": weight}))
    from pyspark.ml.functions import vector_to_array

    return model.transform(vectors(test)).withColumn("score", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def ngram_weights(rows: DataFrame, key: str, text: str, train: str, low: int = 1, high: int = 3) -> DataFrame:
    """``key, ngram, weight``: counts of character n-grams that training rows have (``train``, a condition), scaled to unit length per row."""
    grams = rows.select(key, F.expr(train).alias("_t"), F.explode(char_ngrams(F.col(text), low, high)).alias("ngram")).groupBy(key, "_t", "ngram").agg(F.count("*").cast("double").alias("n"))
    known = grams.join(grams.filter("_t").select("ngram").distinct(), "ngram", "left_semi")
    norms = known.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_l"))
    return known.join(norms, key).select(key, "ngram", (F.col("n") / F.col("_l")).alias("weight"))


def ngram_head(train: DataFrame, test: DataFrame, text: str, target: str, classes: bool = True, strength: float = 1.0, driver_bound: int = 1 << 18) -> DataFrame:
    """``test`` with ``score`` of a linear head on unit-length character 1-3-gram counts of the training rows' vocabulary.

    With ``classes`` logistic regression with inverse strength ``strength``: the
    score is the probability of class 1 where the training rows have the classes
    0 and 1, else the most likely of all their classes.  Without, ridge regression with
    that penalty.  Up to ``driver_bound`` coefficients the driver holds them;
    beyond it they are a table, and the result is the same.
    """
    labels = sorted(float(r[0]) for r in train.select(target).distinct().limit(1001).collect() if r[0] is not None) if classes else []
    if classes and not 2 <= len(labels) <= 1000:
        raise ValueError("the training rows must be of two classes or more" if labels else "no rows to fit")
    if len(labels) == 2 and labels != [0.0, 1.0]:
        raise ValueError("two classes must be 0 and 1")
    vocabulary = train.select(F.explode(char_ngrams(F.col(text))).alias("g")).agg(F.count_distinct("g").alias("n")).first()["n"]
    fitted = _ngram_head_on_driver if vocabulary * max(1, len(labels)) <= driver_bound else _ngram_head_of_tables
    return fitted(train, test, text, target, labels, strength, max(1, vocabulary))


def _ngram_head_on_driver(train: DataFrame, test: DataFrame, text: str, target: str, labels: list[float], strength: float, vocabulary: int) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, Normalizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    def grams(df: DataFrame) -> DataFrame:
        return df.withColumn("_grams", char_ngrams(F.col(text)))

    known = train.agg(F.count(target).alias("n"), F.stddev_pop(F.col(target).cast("double")).alias("s")).first()
    n = known["n"]
    if n == 0:
        raise ValueError("no rows to fit")
    shared = {"featuresCol": "_x", "labelCol": "_y", "maxIter": 200, "tol": 1e-9, "standardization": False}
    head = LogisticRegression(regParam=1 / (strength * n), **shared) if labels else LinearRegression(regParam=strength / n * (known["s"] or 1.0), **shared)  # Spark divides it by the deviation of the labels
    steps = [CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=vocabulary), Normalizer(inputCol="_counts", outputCol="_x"), head]
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(target).cast("double")).cast("double") - 1 if labels else F.col(target).cast("double")
    out = Pipeline(stages=steps).fit(grams(train).withColumn("_y", y).filter("_y IS NOT NULL")).transform(grams(test))
    if len(labels) > 2:
        score = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("prediction") + 1).cast("int"))
    else:
        score = vector_to_array("probability")[1] if labels else F.col("prediction")
    return out.select(*[f"`{c}`" for c in test.columns], score.alias("score"))


def _ngram_head_of_tables(train: DataFrame, test: DataFrame, text: str, target: str, labels: list[float], strength: float, vocabulary: int) -> DataFrame:
    numbered = materialise(
        train.select(F.lit(True).alias("_t"), F.col(target).cast("double").alias("y"), F.col(text).alias("s"), F.lit(None).alias("_r")).filter("y IS NOT NULL")
        .unionByName(test.select(F.lit(False).alias("_t"), F.lit(None).cast("double").alias("y"), F.col(text).alias("s"), F.struct(*[f"`{c}`" for c in test.columns]).alias("_r")), allowMissingColumns=True)
        .withColumn("row", F.monotonically_increasing_id())
    )
    entries = materialise(ngram_weights(numbered.filter("s IS NOT NULL"), "row", "s", "_t").withColumnsRenamed({"ngram": "key", "weight": "x"}))
    model = sparse.fit(entries, numbered.filter("_t").select("row", "y"), "class" if labels else "value", 1 / strength if labels else strength)
    asked = numbered.filter("NOT _t")
    return asked.join(sparse.scores(entries, asked, model), "row").select("_r.*", "score")


def ridge_validated(train: DataFrame, validation: DataFrame, features: str, target: str, alphas: Sequence[float]) -> tuple[float, np.ndarray, float]:
    """Penalty, coefficients and intercept of the ridge fit on ``train`` with the least squared error on ``validation``, the smaller penalty of equals.

    Only the training rows are fit; the validation rows choose.
    """
    m = moments(train, features, target)
    v = moments(validation, features, target)
    best = None
    for alpha in sorted(alphas):
        w, b = ridge(m, alpha)
        # the sum of squares follows from the moments
        error = v["yy"] - 2 * (w @ v["xy"] + b * v["y"]) + w @ v["xx"] @ w + 2 * b * (w @ v["x"]) + b * b * v["n"]
        if best is None or error < best[0] - 1e-12:
            best = (error, alpha, w, b)
    return best[1:]


def score_in_batches(rows: DataFrame, key: str, columns: Sequence[str], adapter) -> DataFrame:
    """``key, score, reason`` from ``adapter(pandas frame of the key and columns) -> list of (key, score, reason)``.

    Only the named columns reach the adapter.  Ids that it invents or repeats
    are refused; ids that it leaves out come back as missing_prediction, and a
    score that is not finite needs a reason.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked, seen, out = set(b[key]), set(), []
            for k, score, reason in adapter(b):
                if k not in asked or k in seen:
                    raise ValueError(f"the adapter returned an id out of its batch or twice: {k}")
                seen.add(k)
                if score is not None and not np.isfinite(score):
                    raise ValueError(f"the score of {k} is not finite")
                if score is None and not reason:
                    raise ValueError(f"{k} has neither a score nor a reason")
                out.append((k, score, reason))
            out += [(k, None, "missing_prediction") for k in b[key] if k not in seen]
            yield pd.DataFrame(out, columns=[key, "score", "reason"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *columns).mapInPandas(run, f"{key} {kind}, score double, reason string")
