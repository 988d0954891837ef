"""Linear heads whose coefficients are a table: no bound on the number of features.

Rows come as entries (row, key, x).  The fit is L-BFGS in its vector-free form:
coefficients, gradient and the last steps are columns of one table with a row per
key, the products of these columns are sums, and the driver works on these few
numbers only.  As margins are linear in the coefficients, one join gives those of
the direction, and the losses of all step sizes come from a single aggregate over
the rows.

Each iteration joins the entries with the coefficients by key and with the
residuals by row, and sums; entries of one key or row are summed before they are
shuffled.  The smaller side is broadcast only up to BROADCAST_ROWS.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Rows of a table up to which it is broadcast in a join.
BROADCAST_ROWS = 500_000
#: Steps that are remembered.
MEMORY = 6
#: Step sizes that are tried at once, and the share of the expected decrease that a step must reach.
STEPS, SUFFICIENT = tuple(2.0**-i for i in range(-2, 12)), 1e-4


@dataclass(frozen=True)
class Linear:
    """``coefficients`` has ``key`` and one column ``w_i`` per margin; ``classes`` is empty for a regression."""

    coefficients: DataFrame
    intercepts: tuple[float, ...]
    classes: tuple[float, ...]
    keys: int


def _joined(entries: DataFrame, other: DataFrame, on: str, rows: int) -> DataFrame:
    return entries.join(F.broadcast(other) if rows <= BROADCAST_ROWS else other, on)


def _products(entries: DataFrame, coefficients: DataFrame, names: Sequence[str], keys: int) -> DataFrame:
    """``row`` and the sum over its entries of x times each named column."""
    found = _joined(entries, coefficients.select("key", *names), "key", keys)
    return found.groupBy("row").agg(*[F.sum(F.col("x") * F.col(n)).alias(n) for n in names])


def _loss(margins: Sequence[Column], y: Column, kind: str) -> Column:
    """Loss of a row; ``y`` is the number of the class, or the value."""
    if kind == "value":
        return (margins[0] - y) * (margins[0] - y) / 2
    if len(margins) == 1:
        m = F.when(y == 1, margins[0]).otherwise(-margins[0])
        return F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    top = F.greatest(*margins)
    own = sum((F.when(y == i, m).otherwise(0.0) for i, m in enumerate(margins)), F.lit(0.0))
    return top + F.log(sum((F.exp(m - top) for m in margins), F.lit(0.0))) - own


def _residuals(margins: Sequence[Column], y: Column, kind: str) -> list[Column]:
    """Derivative of the loss of a row by each margin."""
    if kind == "value":
        return [margins[0] - y]
    if len(margins) == 1:
        return [1 / (1 + F.exp(-margins[0])) - y]
    top = F.greatest(*margins)
    total = sum((F.exp(m - top) for m in margins), F.lit(0.0))
    return [F.exp(m - top) / total - (y == i).cast("double") for i, m in enumerate(margins)]


def _direction(gram: np.ndarray, memory: int) -> np.ndarray:
    """L-BFGS by products alone: weights of the basis (steps, changes of the gradient, gradient; newest first) that make the direction."""
    out = np.zeros(len(gram))
    out[-1] = -1.0
    alpha = np.zeros(memory)
    for i in range(memory):
        alpha[i] = gram[i] @ out / gram[i, memory + i]
        out[memory + i] -= alpha[i]
    if memory:
        out *= gram[0, memory] / gram[memory, memory]
    for i in reversed(range(memory)):
        out[i] += alpha[i] - gram[memory + i] @ out / gram[i, memory + i]
    return out


def fit(entries: DataFrame, targets: DataFrame, kind: str = "class", penalty: float = 1.0, iterations: int = 200, tolerance: float = 1e-4) -> Linear:
    """Least loss plus penalty / 2 times the squared coefficients; intercepts are not penalised.

    ``entries`` has ``row, key, x`` without repeats, ``targets`` has ``row, y``;
    rows without entries have margins of zero.  ``kind`` is ``value`` (squared
    error), or ``class``: logistic for two classes, softmax for more.  It ends
    when the gradient has fallen to ``tolerance`` of the first.
    """
    targets = targets.select("row", F.col("y").cast("double").alias("y")).filter("row IS NOT NULL AND y IS NOT NULL")
    classes: tuple[float, ...] = ()
    if kind == "class":
        classes = tuple(sorted(r["y"] for r in targets.select("y").distinct().collect()))  # one row per class
        if len(classes) < 2:
            raise ValueError("the rows must be of two classes or more")
        targets = targets.withColumn("y", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")).cast("double") - 1)
    width = len(classes) if len(classes) > 2 else 1
    ws, gs, ps, ms = ([f"{c}_{i}" for i in range(width)] for c in "wgpm")
    entries = materialise(entries.join(targets.select("row"), "row", "left_semi"))
    rows = materialise(targets.select("row", "y", *[F.lit(0.0).alias(m) for m in ms]))
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit")
    zeros = [F.lit(0.0).alias(c) for c in (*ws, *gs)]
    table = materialise(entries.select("key").distinct().select("key", *zeros))
    keys = table.count()
    b = np.zeros(width)
    # the driver's part of each vector: what belongs to the intercepts
    steps_b: list[np.ndarray] = []
    changes_b: list[np.ndarray] = []
    first = None
    g_b = np.zeros(width)

    def history(i: int) -> list[list[str]]:
        return [[f"{c}{j}_{k}" for k in range(width)] for c in "su" for j in range(i)]

    def gradient(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """``table`` with the gradient as ``n_i``, and that of the intercepts."""
        margins = [F.col(m) + float(v) for m, v in zip(ms, b, strict=True)]
        residuals = materialise(rows.select("row", *[r.alias(m) for r, m in zip(_residuals(margins, F.col("y"), kind), ms, strict=True)]))
        sums = residuals.agg(*[F.sum(m).alias(m) for m in ms]).first()
        found = _joined(entries, residuals, "row", n).groupBy("key").agg(*[F.sum(F.col("x") * F.col(m)).alias(f"n_{i}") for i, m in enumerate(ms)])
        new = table.join(found, "key", "left")
        return new.withColumns({f"n_{i}": F.coalesce(f"n_{i}", F.lit(0.0)) + penalty * F.col(w) for i, w in enumerate(ws)}), np.array([sums[m] for m in ms])

    for it in range(iterations + 1):
        new, new_b = gradient(table, rows)
        if it:
            memory = min(MEMORY, it)
            old = history(min(MEMORY, it - 1))
            half = len(old) // 2
            # the newest step and change come first; the oldest ones go
            kept = {"s": [ps, *old[:half]][:memory], "u": [None, *old[half:]][:memory]}
            columns = ["key", *ws, *[F.col(f"n_{i}").alias(g) for i, g in enumerate(gs)]]
            columns += [F.col(c).alias(f"s{j}_{k}") for j, names in enumerate(kept["s"]) for k, c in enumerate(names)]
            columns += [(F.col(names[k]) if names else F.col(f"n_{k}") - F.col(gs[k])).alias(f"u{j}_{k}") for j, names in enumerate(kept["u"]) for k in range(width)]
            changes_b = [new_b - g_b, *changes_b][:memory]
            table = materialise(new.select(*columns))
        else:
            memory = 0
            table = materialise(new.select("key", *ws, *[F.col(f"n_{i}").alias(g) for i, g in enumerate(gs)]))
        g_b = new_b
        basis = [*history(memory), gs]
        basis_b = [*steps_b, *changes_b, g_b]

        def product(a: Sequence[str], c: Sequence[str]) -> Column:
            return F.coalesce(F.sum(sum((F.col(x) * F.col(y) for x, y in zip(a, c, strict=True)), F.lit(0.0))), F.lit(0.0))

        vectors = [*basis, ws]
        pairs = [(i, j) for i in range(len(vectors)) for j in range(i + 1)]
        sums = table.agg(*[product(vectors[i], vectors[j]).alias(f"d{i}_{j}") for i, j in pairs]).first()
        full = np.zeros((len(vectors), len(vectors)))
        for i, j in pairs:
            full[i, j] = full[j, i] = sums[f"d{i}_{j}"]
        gram = full[:-1, :-1] + np.array([[x @ y for y in basis_b] for x in basis_b])
        first = gram[-1, -1] if first is None else first
        if it == iterations or gram[-1, -1] <= tolerance**2 * first:
            break
        if memory and gram[0, memory] <= 0:  # no curvature along the last step: begin anew
            weights = np.eye(len(gram))[-1] * -1.0
        else:
            weights = _direction(gram, memory)
        if not memory:
            weights = weights / max(1.0, n / 4)
        p_b = sum((w * x for w, x in zip(weights, basis_b, strict=True)), np.zeros(width))
        direction = [sum((float(w) * F.col(v[k]) for w, v in zip(weights, basis, strict=True)), F.lit(0.0)).alias(ps[k]) for k in range(width)]
        table = materialise(table.select("*", *direction))
        moved = _products(entries, table, ps, keys).select("row", *ps)
        rows = materialise(rows.join(moved, "row", "left").select("row", "y", *ms, *[F.coalesce(p, F.lit(0.0)).alias(p) for p in ps]))

        def at(t: float, p_b=p_b) -> list[Column]:
            return [F.col(m) + float(v) + t * (F.col(p) + float(q)) for m, p, v, q in zip(ms, ps, b, p_b, strict=True)]

        losses = rows.agg(*[F.sum(_loss(at(t), F.col("y"), kind)).alias(f"t{i}") for i, t in enumerate((0.0, *STEPS))]).first()
        w_w, w_p, p_p = full[-1, -1], float(weights @ full[:-1, -1]), float(weights @ full[:-1, :-1] @ weights)
        slope = float(weights @ gram[-1])
        value = {t: losses[f"t{i}"] + penalty / 2 * (w_w + 2 * t * w_p + t * t * p_p) for i, t in enumerate((0.0, *STEPS))}
        good = [t for t in STEPS if value[t] <= value[0.0] + SUFFICIENT * t * slope]
        if not good:  # as near as doubles get
            break
        t = min(good, key=lambda t: (value[t], -t))
        b = b + t * p_b
        steps_b = [t * p_b, *steps_b][:MEMORY]
        table = table.withColumns({**{w: F.col(w) + t * F.col(p) for w, p in zip(ws, ps, strict=True)}, **{p: t * F.col(p) for p in ps}})
        rows = rows.select("row", "y", *[(F.col(m) + t * F.col(p)).alias(m) for m, p in zip(ms, ps, strict=True)])
    return Linear(table.select("key", *ws), tuple(b.tolist()), classes, keys)


def scores(entries: DataFrame, rows: DataFrame, model: Linear) -> DataFrame:
    """``row, score`` of every row: the value, the probability of the second of two classes, or the class of the largest margin (the first of equals)."""
    ws = [c for c in model.coefficients.columns if c != "key"]
    found = _products(entries, model.coefficients, ws, model.keys)
    margins = [F.coalesce(w, F.lit(0.0)) + float(b) for w, b in zip(ws, model.intercepts, strict=True)]
    if not model.classes:
        score = margins[0]
    elif len(ws) == 1:
        score = 1 / (1 + F.exp(-margins[0]))
    else:
        best = F.array_max(F.array(*[F.struct(m.alias("m"), F.lit(-i).alias("i")) for i, m in enumerate(margins)]))
        score = F.element_at(F.array(*[F.lit(c) for c in model.classes]), 1 - best["i"])
    return rows.select("row").join(found, "row", "left").select("row", score.alias("score"))
