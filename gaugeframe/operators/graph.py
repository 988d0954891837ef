"""Fixed-point operators on edge tables.

Every round is written to the shared folder, so plans stay short and a lost
executor costs one round at most.  No node's neighbours are ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MISSING_TOKENS
from ..storage import materialise
from .joins import with_row
from .ranking import numbered as in_order

#: Rounds grow with the logarithm of the longest path; this many mean an error.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node that has an edge to another; the component is its smallest node.

    Edges become stars around smaller nodes, for larger and for smaller
    neighbours in turn, until they are one star per component.  Edges with a
    null end and loops are ignored; repeated edges count once.
    """
    e = materialise(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        # done when every node has one smaller neighbour or is one, but not both
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)")
        if open_nodes.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        e = materialise(small.distinct())
    raise RuntimeError("components did not settle")


def key_groups(records: DataFrame, key: str, columns: Sequence[str], missing: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """``key, component`` of records that share a value of any column, directly or through others; the component is its smallest record key.

    A null or missing token links nothing.  Records link to the smallest record
    of each value, so a value of many records has as many edges, not pairs.
    """
    values = records.select(F.col(key).cast("string").alias("k"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("k", "v.*")
    values = values.filter(F.col("value").isNotNull() & ~F.col("value").isin(*missing))
    heads = values.groupBy("column", "value").agg(F.min("k").alias("head"))
    found = connected_components(values.join(heads, ["column", "value"]), "k", "head")
    return records.select(F.col(key).cast("string").alias("k")).distinct().join(found.withColumnRenamed("node", "k"), "k", "left").select(F.col("k").alias(key), F.coalesce("component", "k").alias("component"))


def numbered(groups: DataFrame, component: str, width: int = 4) -> DataFrame:
    """Adds ``group``: components numbered by their smallest member as g0001 and so on, wider if there are more."""
    order = in_order(groups.select(component).distinct(), [F.col(component)], "_n")
    digits = F.greatest(F.lit(width), F.length(F.col("_most").cast("string")))
    named = with_row(order, order.agg(F.count("*").alias("_most")))
    names = named.withColumn("group", F.concat(F.lit("g"), F.lpad(F.col("_n").cast("string"), digits, "0"))).drop("_n", "_most")
    return groups.join(names, component)


def closure(edges: DataFrame, start: DataFrame, max_depth: int = 50) -> DataFrame:
    """``root, node, depth``: what is reachable from each ``root`` along ``src -> dst``, with its least depth (from 1).

    A round joins only the nodes that are new, so cycles end.
    """
    edges = edges.select("src", "dst").distinct()
    found = materialise(start.select("root").distinct().join(edges, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct())
    new, depth = found, 1
    while depth < max_depth and not new.isEmpty():
        depth += 1
        step = new.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = materialise(step.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        found = materialise(found.unionByName(new))
    return found


def resolve_chain(links: DataFrame, stop: Column | None = None, max_rounds: int = 20) -> DataFrame:
    """``id, resolved``: the end of each chain of ``id -> next``, by doubling the jump each round.

    A null ``next`` ends a chain, and so does a row for which ``stop`` holds.
    Members of a cycle resolve to its smallest id.
    """
    base = links.select("id", F.when(F.lit(False) if stop is None else ~stop, F.col("next")).alias("next")) if stop is not None else links.select("id", "next")
    state = materialise(base.select("id", F.coalesce("next", "id").alias("at"), F.least("id", F.coalesce("next", "id")).alias("low")))
    for _ in range(max_rounds):
        nxt = state.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("low").alias("low2"))
        state2 = materialise(state.join(nxt, "at", "left").select("id", F.coalesce("to", "at").alias("at"), F.least("low", F.coalesce("low2", "low")).alias("low")))
        if state2.select("id", "at").exceptAll(state.select("id", "at")).isEmpty():
            break
        state = state2
    ends = base.filter("next IS NULL").select(F.col("id").alias("at"), F.lit(True).alias("_end"))
    outside = F.col("_known").isNull()  # a chain may end at an id that has no row
    known = base.select(F.col("id").alias("at"), F.lit(True).alias("_known"))
    out = state2.join(ends, "at", "left").join(known, "at", "left")
    return out.select("id", F.when(F.col("_end") | outside, F.col("at")).otherwise(F.col("low")).alias("resolved"))


def first_ancestor(links: DataFrame, starts: DataFrame, wanted: Column, most: int = 20) -> DataFrame:
    """``root, ancestor, depth``: the nearest node along ``src -> dst``, the root itself at depth 0, for which ``wanted`` (a condition on ``node``) holds; the smallest of equals.

    Roots that reach none within ``most`` steps have no row.
    """
    own = starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    reach = own.unionByName(closure(links, starts, most)).filter(wanted)
    return reach.groupBy("root").agg(F.min(F.struct("depth", "node")).alias("b")).select("root", F.col("b.node").alias("ancestor"), F.col("b.depth").alias("depth"))
