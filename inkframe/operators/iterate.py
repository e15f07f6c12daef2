"""Iterative primitives: connected components, greedy suppression, greedy one-to-one matching.

Each is a loop of joins and map-side-combined aggregates. No neighbour list is ever collected, and
every round is written to the checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.session import cut


#: Edges of one component that a single task settles; larger components go on in rounds.
SETTLED_EDGES = 200_000
#: Rounds between two attempts to settle the small components at once.
ROUNDS = 4


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of each component: nodes(id), edges(src, dst) -> (id, component).

    Alternating large-star and small-star contraction; the number of rounds grows with the log of
    the component size. Stops when a round leaves the edge set unchanged.
    """
    e = edges.select("src", "dst").where("src <> dst")
    e = cut(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        e = cut(small.distinct())
        now = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == state:
            labels = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return nodes.select("id").join(labels, "id", "left").select(
                "id", F.coalesce("component", "id").alias("component")
            )
        state = tuple(now)


def greedy_keep(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep an item unless a better kept neighbour exists: items(id, prio), edges(a, b) -> kept ids.

    ``prio`` is any orderable value, larger is better; equal priorities fall back to the smaller id.
    The result is the one a sequential pass in that order gives. Each round keeps every undecided
    item that beats all its undecided neighbours and drops the neighbours of what was kept. Long
    chains would take a round for every other item, so from time to time components of at most
    SETTLED_EDGES open edges are settled in one grouped pass.
    """
    ranked = items.select("id", "prio")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    pa = ranked.select(F.col("id").alias("a"), F.col("prio").alias("pa"))
    pb = ranked.select(F.col("id").alias("b"), F.col("prio").alias("pb"))
    # worse <- better, once per pair
    better = both.distinct().join(pa, "a").join(pb, "b")
    better = better.where("pb > pa or (pb = pa and b < a)").select(F.col("a").alias("worse"), F.col("b").alias("better"))
    open_edges = cut(better)
    dropped_all, rounds = None, 0
    while not open_edges.isEmpty():
        rounds += 1
        if rounds % ROUNDS:
            ends = open_edges.select(F.col("worse").alias("id")).union(open_edges.select(F.col("better").alias("id"))).distinct()
            kept = ends.join(open_edges.select(F.col("worse").alias("id")).distinct(), "id", "left_anti")
            dropped = open_edges.join(kept.withColumnRenamed("id", "better"), "better", "left_semi")
            dropped = cut(dropped.select(F.col("worse").alias("id")).distinct())
            left = open_edges
        else:
            dropped, left = _settle_small(open_edges)
        dropped_all = dropped if dropped_all is None else dropped_all.union(dropped)
        # an edge is settled once its worse end is dropped, or its better end is dropped
        gone_w, gone_b = dropped.withColumnRenamed("id", "worse"), dropped.withColumnRenamed("id", "better")
        open_edges = cut(left.join(gone_w, "worse", "left_anti").join(gone_b, "better", "left_anti"))
    if dropped_all is None:
        return ranked.select("id")
    return ranked.select("id").join(dropped_all, "id", "left_anti")


def _settle_small(open_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids that a sequential pass drops in components of bounded size, edges of the other components)."""
    ends = open_edges.select(F.col("worse").alias("id")).union(open_edges.select(F.col("better").alias("id"))).distinct()
    of = connected_components(ends, open_edges.select(F.col("worse").alias("src"), F.col("better").alias("dst")))
    e = open_edges.join(of.withColumnRenamed("id", "worse"), "worse")
    small = cut(e.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SETTLED_EDGES).select("component"))
    kind = dict(open_edges.dtypes)["worse"]
    dropped = e.join(small, "component").groupBy("component").applyInPandas(_sequential_pass, f"id {kind}")
    return cut(dropped), cut(e.join(small, "component", "left_anti").select("worse", "better"))


def _sequential_pass(rows: pd.DataFrame) -> pd.DataFrame:
    worse, better = rows["worse"].tolist(), rows["better"].tolist()
    waits, under = Counter(worse), defaultdict(list)
    for w, b in zip(worse, better, strict=True):
        under[b].append(w)
    todo, dropped = [x for x in dict.fromkeys(better) if not waits[x]], set()
    while todo:  # every item after all better neighbours
        x = todo.pop()
        for w in under[x]:
            if x not in dropped:
                dropped.add(w)
            waits[w] -= 1
            if not waits[w]:
                todo.append(w)
    return pd.DataFrame({"id": pd.Series(list(dropped), dtype=rows["worse"].dtype)})


def greedy_match(edges: DataFrame) -> DataFrame:
    """One-to-one matching in strict edge order: edges(l, r, cost) -> chosen edges.

    ``cost`` is any orderable value (a struct works) and must order all edges strictly. An edge that
    is the cheapest at both of its ends is taken in every sequential order, so each round takes all
    of those at once and removes the edges at used ends.
    """
    open_edges = cut(edges.select("l", "r", "cost"))
    chosen = None
    while not open_edges.isEmpty():
        best_l = open_edges.groupBy("l").agg(F.min("cost").alias("cl"))
        best_r = open_edges.groupBy("r").agg(F.min("cost").alias("cr"))
        taken = open_edges.join(best_l, "l").join(best_r, "r").where("cost = cl and cost = cr").select("l", "r", "cost")
        taken = cut(taken)
        chosen = taken if chosen is None else chosen.union(taken)
        open_edges = cut(
            open_edges.join(taken.select("l"), "l", "left_anti").join(taken.select("r"), "r", "left_anti")
        )
    return chosen if chosen is not None else open_edges
