"""Connected components, and links among rows that share a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least node of its neighbourhood."""
    near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    return near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) of every node in ``edges`` (``a``, ``b``).

    Large-star and small-star alternate until nothing changes, a number of
    rounds that grows with the logarithm of the longest path. Neighbourhoods
    are only ever reduced to a minimum and joined, never gathered, so a node
    with very many links is no burden. Loops and repeated edges do no harm;
    without edges there are no nodes.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(ordered, "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if mark == seen:
            break
        seen = mark
        following = written(_small_star(_large_star(now)), "edges")
        discard(now)
        now = following
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    return now.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))


def shared_keys(keys: DataFrame, light: DataFrame | None = None) -> DataFrame:
    """The rows of keys that several nodes have, stored, with ``weight``: the sum of the sizes of all keys of the node.

    ``light`` has few, narrow columns for each ``node``, which the rows then carry.
    """
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = written(keys.join(sizes, "key"), "shared")
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    members = shared.join(weights, "node").select("key", "node", "weight")
    members = written(members if light is None else members.join(light, "node"), "members")
    discard(sizes, shared)
    return members


def apart(rows: DataFrame) -> DataFrame:
    """The rows of keys whose nodes are not all of one ``component``, with the key's largest one as ``main``."""
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    mains = sizes.groupBy("key").agg(
        F.max(F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("different")
    )
    mains = mains.where("different > 1").select("key", F.col("most.component").alias("main"))
    return rows.join(mains, "key")


def pairs_apart(rows: DataFrame, condition: Column | None = None) -> DataFrame:
    """Distinct pairs ``a < b`` of nodes of one ``key`` and different components.

    Only nodes outside a key's main component meet all others, so a key costs
    the number of its outsiders times its nodes, not the square. ``condition``
    is checked inside the join; it finds the remaining columns of the rows with
    ``_a`` and ``_b`` appended and has to be symmetric.
    """
    rows = apart(rows)
    sides = {
        end: rows.select("key", *[F.col(c).alias(f"{c}_{end}") for c in rows.columns if c != "key"]) for end in "ab"
    }
    outside = sides["a"].where("component_a <> main_a")
    # Two outsiders meet twice; one of the two is enough.
    once = (F.col("component_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b"))
    on = once & (F.col("component_a") != F.col("component_b"))
    on = on if condition is None else on & condition
    met = outside.withColumnRenamed("key", "key_a").join(sides["b"], (F.col("key_a") == F.col("key")) & on)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def linked_by_keys(
    members: DataFrame,
    accept: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame] = pairs_apart,
    condition: Column | None = None,
) -> DataFrame:
    """Components of the nodes, where nodes that share a key are linked if ``accept`` keeps their pair.

    ``members`` is a result of :func:`shared_keys`; ``accept`` filters a
    table of pairs ``a < b``. The result equals the components over all
    accepted pairs, but pairs whose ends are known to belong together are not
    looked at. First the node of a key that has most company in all its keys,
    as the original of many copies has, meets the others. Then ``rest`` gets
    the rows (``key``, ``node``, ``component``) of all keys and gives the pairs
    of different components which are still to be looked at. Nodes without an
    accepted pair are left out. ``condition``, as in :func:`pairs_apart`, holds
    for every pair that ``accept`` would keep, and spares it the first pairs
    that do not meet it.
    """
    light = [c for c in members.columns if c not in ("key", "node", "weight")]
    best = members.groupBy("key").agg(F.max(F.struct("weight", "node", *light)).alias("best"))
    met = members.join(best, "key").where("node <> best.node")
    met = met.select(*[F.col(side + c).alias(c + end) for c in ("node", *light) for side, end in (("", "_a"), ("best.", "_b"))])
    met = met if condition is None else met.where(condition)
    stars = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    groups = written(components(accept(stars)), "groups")
    placed = members.join(groups, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"), *light
    )
    links = accept(rest(placed))
    known = groups.where("node <> component").select("node", "component")
    result = written(components(links.union(known)), "components")
    discard(groups)
    return result
