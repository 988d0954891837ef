"""Gradient boosted trees for two classes, grown leaf by leaf on binned features.

Rows stay where they are.  A pass sums gradients, curvatures and counts by
(node, feature, bin) inside each task; Spark adds these up, finds the best split
of every (node, feature), and the driver gets one row per node.  Gradients are
whole multiples of 2**-30, so that their sums do not depend on the order of the
rows, and a task that runs again changes nothing.

A tree takes the split of the largest gain next, whatever its depth.  As the best
split of a node does not depend on the others, one pass looks at the children of
all splits that would be taken as far as gains are known; a tree of 31 leaves
needs some ten passes instead of thirty, and is the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

UNIT = float(1 << 30)
#: Bin of a missing value; other bins are below.
MISSING = 255
#: Rows that a task works on at once.
ROWS = 8192
#: Trees after which the rows' scores are written again.
REFRESH = 25
#: Least curvature of a leaf, and least gain of validation loss that counts.
LEAST_CURVATURE, LEAST_PROGRESS = 1e-3, 1e-7


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first; ``feature`` is -1 in leaves.  Bins up to ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins comes to."""
        at = np.zeros(len(bins), dtype=np.int64)
        open_ = np.arange(len(bins)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            node = at[open_]
            b = bins[open_, self.feature[node]]
            goes_left = np.where(b == MISSING, self.missing_left[node], b <= self.bin[node])
            at[open_] = np.where(goes_left, self.left[node], self.right[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at


@dataclass(frozen=True)
class Model:
    """Upper limits of the bins by feature, the score of the training prevalence, and trees that add to it."""

    limits: tuple[np.ndarray, ...]
    base: float
    trees: tuple[Tree, ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for f, limits in enumerate(self.limits):
            out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(limits, x[:, f], side="left"))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins, raw = self.bins(x), np.full(len(x), self.base)
        for t in self.trees:
            raw += t.value[t.leaves(bins)]
        return 1 / (1 + np.exp(-raw))


@dataclass
class _Node:
    sums: tuple[int, int, int]
    split: tuple | None = None
    known: bool = False
    children: tuple[int, int] | None = None
    slot: int = field(default=-1)


def bin_limits(rows: DataFrame, features: str, bins: int = 255) -> tuple[np.ndarray, ...]:
    """For each feature the upper limits of all bins but the last.

    They lie between neighbouring values where no more than ``bins`` occur;
    else they are the distinct approximate quantiles.  Missing values (null or
    NaN) have a bin of their own.
    """
    values = rows.select(F.posexplode(F.col(features).cast("array<double>")).alias("f", "v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    levels = [i / bins for i in range(1, bins)]
    found = values.groupBy("f").agg(F.approx_count_distinct("v", 0.02).alias("n"), F.percentile_approx("v", F.array(*[F.lit(x) for x in levels]), F.lit(100 * bins)).alias("q")).collect()  # one row per feature
    limits = {r["f"]: np.unique(np.array(r["q"] if r["q"] is not None else [], dtype=float)) for r in found}
    few = [r["f"] for r in found if r["n"] <= 1.2 * bins]
    if few:
        of_few = values.filter(F.col("f").isin(few) & F.col("v").isNotNull()).groupBy("f").agg(F.array_sort(F.collect_set("v")).alias("v"))  # at most some 1.3 * bins values each
        for r in of_few.collect():
            v = np.array(r["v"], dtype=float)
            if len(v) <= bins:
                limits[r["f"]] = (v[:-1] + v[1:]) / 2
    return tuple(limits[f] for f in sorted(limits))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(x) != len(column) * width:
        raise ValueError(f"every row must have {width} features")
    return x.reshape(-1, width)


def _best_split(l2: float, least: int):
    """A function from the bins of one (node, feature) to its best split."""

    def found(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        slot, feature = (k.as_py() for k in key)
        cells = cells.sort_by("bin")
        bins, g, h, n = (cells[c].to_numpy().astype(np.int64) for c in ("bin", "g", "h", "n"))
        total = np.array([g.sum(), h.sum(), n.sum()])
        lost = bins == MISSING
        missing = np.array([g[lost].sum(), h[lost].sum(), n[lost].sum()])
        left = np.cumsum(np.stack([g, h, n])[:, ~lost], axis=1)
        ways = [(left, False)] + ([(left + missing[:, None], True)] if missing[2] else [])
        best = (0.0, 0, False, total, total - total)
        for sums, missing_left in ways:
            other = total[:, None] - sums
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (sums[0] / UNIT) ** 2 / (sums[1] / UNIT + l2) + (other[0] / UNIT) ** 2 / (other[1] / UNIT + l2) - (total[0] / UNIT) ** 2 / (total[1] / UNIT + l2)
            allowed = (sums[2] >= least) & (other[2] >= least) & (sums[1] >= LEAST_CURVATURE * UNIT) & (other[1] >= LEAST_CURVATURE * UNIT)
            gain = np.where(allowed, gain, -np.inf)
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                # without missing values here, later ones follow the most rows
                best = (float(gain[i]), int(bins[~lost][i]), missing_left if missing[2] else bool(sums[2, i] > other[2, i]), sums[:, i], other[:, i])
        gain, at, missing_left, a, b = best
        row = {"slot": slot, "feature": feature, "gain": gain, "bin": at, "missing_left": missing_left}
        row |= {f"{side}_{c}": int(x) for side, s in (("l", a), ("r", b)) for c, x in zip("ghn", s, strict=True)}
        return pa.Table.from_pylist([row], schema=_SPLIT_SCHEMA)

    return found


_SUMS = ", ".join(f"{side}_{c} bigint" for side in "lr" for c in "ghn")
_SPLITS = f"slot int, feature int, gain double, bin int, missing_left boolean, {_SUMS}"
_SPLIT_SCHEMA = pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("bin", pa.int32()), ("missing_left", pa.bool_()), *[(f"{side}_{c}", pa.int64()) for side in "lr" for c in "ghn"]])


def _scored(batch: pa.RecordBatch, width: int, later: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Bins and scores of a batch of ``bins, label, held, raw``."""
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
    raw = batch.column(3).to_numpy().copy()
    for t in later:
        raw += t.value[t.leaves(bins)]
    return bins, raw


class _Rows:
    """Binned rows with their scores after the trees that are written, and the later trees."""

    def __init__(self, binned: DataFrame, width: int):
        self.table, self.width, self.later = binned, width, []

    def add(self, tree: Tree) -> None:
        self.later.append(tree)
        if len(self.later) < REFRESH:
            return
        later, width = list(self.later), self.width

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_scored(batch, width, later)[1])], names=batch.schema.names)

        self.table, self.later = materialise(self.table.mapInArrow(run, self.table.schema)), []

    def splits(self, tree: Tree, slots: dict[int, int], l2: float, least: int, loss: bool) -> tuple[dict[int, tuple], float | None]:
        """The best split by slot of the wanted nodes of a growing tree; with ``loss`` also the summed loss of the held-out rows."""
        later, width, count = list(self.later), self.width, len(slots)
        slot_of = np.full(len(tree.feature), -1)
        for node, s in slots.items():
            slot_of[node] = s

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, width, count * 256))
            held_loss = 0
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    bins, raw = _scored(batch, width, later)
                    y, held = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                    if loss:
                        held_loss += int(np.rint((np.logaddexp(0, raw) - y * raw)[held] * UNIT).sum())
                    p = 1 / (1 + np.exp(-raw))
                    slot = np.where(held, -1, slot_of[tree.leaves(bins)])
                    mine = np.flatnonzero(slot >= 0)
                    g, h = np.rint((p - y)[mine] * UNIT), np.rint((p * (1 - p))[mine] * UNIT)
                    for f in range(width):
                        cell = slot[mine] * 256 + bins[mine, f]
                        # whole numbers below 2**53: exact in doubles
                        for k, w in enumerate((g, h, None)):
                            sums[k, f] += np.bincount(cell, weights=w, minlength=count * 256)
            f, cell = np.nonzero(sums[2])
            cells = [(cell // 256).astype(np.int32), f.astype(np.int32), (cell % 256).astype(np.int32), *[sums[k, f, cell].astype(np.int64) for k in range(3)]]
            if loss:
                cells = [np.append(c, x).astype(c.dtype) for c, x in zip(cells, (-1, 0, 0, held_loss, 0, 0), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["slot", "feature", "bin", "g", "h", "n"])

        found = self.table.mapInArrow(run, "slot int, feature int, bin int, g bigint, h bigint, n bigint")
        # tasks have summed already; cells of one (node, feature), 256 at most, meet in one place
        cells = found.repartition("slot", "feature").groupBy("slot", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
        splits = cells.groupBy("slot", "feature").applyInArrow(_best_split(l2, least), _SPLITS)
        best = splits.groupBy("slot").agg(F.max_by(F.struct(*splits.columns), F.struct("gain", -F.col("feature"))).alias("s")).select("s.*").collect()  # one row per node
        out = {r["slot"]: tuple(r) for r in best}
        lost = out.pop(-1, None)
        return out, lost[5] / UNIT if lost else None


def _grow(rows: _Rows, leaves: int, rate: float, l2: float, least: int, loss: bool) -> tuple[Tree, float | None]:
    """The next tree, and the loss of the held-out rows before it."""
    nodes = [_Node((0, 0, 0))]

    def tree(chosen: set[int] | None = None) -> Tree:
        """All known splits, or those of ``chosen``."""
        inner = [n.children is not None and (chosen is None or i in chosen) for i, n in enumerate(nodes)]
        pick = [n.split if inner[i] else None for i, n in enumerate(nodes)]
        value = [0.0 if inner[i] or n.sums[2] == 0 else -rate * (n.sums[0] / UNIT) / (n.sums[1] / UNIT + l2) for i, n in enumerate(nodes)]
        return Tree(
            np.array([s[1] if s else -1 for s in pick]), np.array([s[3] if s else 0 for s in pick]), np.array([bool(s and s[4]) for s in pick]),
            np.array([n.children[0] if inner[i] else 0 for i, n in enumerate(nodes)]), np.array([n.children[1] if inner[i] else 0 for i, n in enumerate(nodes)]), np.array(value),
        )

    def look(wanted: list[int], with_loss: bool) -> float | None:
        found, lost = rows.splits(tree(), {n: s for s, n in enumerate(wanted)}, l2, least, with_loss)
        for s, n in enumerate(wanted):
            node = nodes[n]
            node.known = True
            if s in found:
                if n == 0:
                    node.sums = tuple(a + b for a, b in zip(found[s][5:8], found[s][8:11], strict=True))
                if found[s][2] > 0:
                    node.split, node.children = found[s], (len(nodes), len(nodes) + 1)
                    nodes.extend([_Node(found[s][5:8]), _Node(found[s][8:11])])
                    for child in nodes[-2:]:
                        child.known = child.sums[2] < 2 * least
        return lost

    lost = look([0], loss)
    while True:
        # take splits by gain as far as they are known; an unknown child could come before any later one
        heap, chosen, wanted = ([(-nodes[0].split[2], 0)] if nodes[0].split else []), set(), []
        while heap and len(chosen) < leaves - 1:
            _, n = heapq.heappop(heap)
            chosen.add(n)
            for c in nodes[n].children:
                if not nodes[c].known:
                    if len(chosen) < leaves - 1:
                        wanted.append(c)
                elif nodes[c].split:
                    heapq.heappush(heap, (-nodes[c].split[2], c))
        if not wanted:
            return tree(chosen), lost
        look(wanted, False)


def fit(rows: DataFrame, features: str, label: str, trees: int = 300, rate: float = 0.06, leaves: int = 31, l2: float = 1.0, least: int = 20, bins: int = 255, stop_after: int | None = None, validation: float = 0.1) -> Model:
    """Trees fit to an array column and a column of 0 and 1.

    Rows without features or label take no part; both classes must occur, and
    all rows have as many features.  Null and NaN features are missing: they go
    to the side that gains more.  Of equal splits the smaller feature and then
    the smaller bin is taken.  With ``stop_after`` a share of ``validation`` of
    the rows, chosen by a hash of their features, is held out, and growth ends
    when its loss has not fallen for so many trees.
    """
    if not 2 <= bins <= 255:
        raise ValueError("bins must be from 2 to 255")
    used = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    seen = {r["y"]: r["n"] for r in used.groupBy("y").agg(F.count("*").alias("n")).limit(3).collect()}  # more than two classes are refused
    if set(seen) != {0.0, 1.0}:
        raise ValueError("the labels must be 0 and 1, and both must occur")
    limits = bin_limits(used, "x", bins)
    width = len(limits)
    held = F.pmod(F.xxhash64("x"), F.lit(1_000_000)) < round(validation * 1_000_000) if stop_after else F.lit(False)
    blank = Model(limits, 0.0, ())

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = blank.bins(_matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), batch.column(1), batch.column(2), pa.array(np.zeros(len(b)))], names=["bins", "label", "held", "raw"])

    table = materialise(used.select("x", "y", held.alias("held")).mapInArrow(binned, "bins binary, label double, held boolean, raw double"))
    kept = {r["label"]: r["n"] for r in table.filter("NOT held").groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(kept) < 2:
        raise ValueError("both classes must occur among the rows that are not held out")
    base = float(np.log(kept[1.0] / kept[0.0]))
    grown: list[Tree] = []
    found = _Rows(table, width)
    # the base score is a tree of one leaf that the written scores do not have yet
    found.add(Tree(np.array([-1]), np.array([0]), np.array([False]), np.array([0]), np.array([0]), np.array([base])))
    best, since = np.inf, 0
    for _ in range(trees):
        tree, lost = _grow(found, leaves, rate, l2, least, stop_after is not None)
        if lost is not None:
            best, since = (lost, 0) if lost < best - LEAST_PROGRESS else (best, since + 1)
            if since >= stop_after:
                break
        grown.append(tree)
        found.add(tree)
        if tree.feature[0] < 0:  # nothing to split any more
            break
    return Model(limits, base, tuple(grown))


def predict(rows: DataFrame, model: Model, features: str, name: str = "score") -> DataFrame:
    """``rows`` with the probability of class 1; null for null features."""
    shared, width = rows.sparkSession.sparkContext.broadcast(model), len(model.limits)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        some = np.flatnonzero(x.notna())
        if len(some):
            out[some] = shared.value.probability(_matrix(pa.array(x.iloc[some], pa.list_(pa.float64())), width))
        return pd.Series(out).astype(object).where(x.notna().to_numpy(), None)

    return rows.withColumn(name, score(F.col(features).cast("array<double>")))
