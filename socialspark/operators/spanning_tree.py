"""Minimum spanning tree of the mutual reachability graph, exact.

Boruvka's method: in every round each component takes its lightest outgoing
edge, so the number of components at least halves. An upper bound of that
edge, from the component's own blocks and from the pivots, limits which blocks
have to be compared. All weights of a round come from one comparison per pair
of blocks and ties are ordered by node, so the chosen edges cannot form a
cycle. A component with more than half of all nodes waits for the others to choose it,
so that the last rounds compare few nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.operators.pointers import follow
from socialspark.operators.skew import hot_keys, skew_join
from socialspark.operators.vector_blocks import (
    TIE,
    Blocks,
    NearPairs,
    VectorGroups,
    block_groups,
    block_pairs,
    block_vectors,
    compare_blocks,
    cosine_distances,
)
from socialspark.session import cut

EDGE_SCHEMA = "comp long, weight double, lo long, hi long, other long"


def _mutual_reachability(left, right, left_core, right_core) -> np.ndarray:
    return np.maximum(
        cosine_distances(left, right), np.maximum(left_core[:, None], right_core[None, :])
    )


def _lightest_edges(weights, mine, others, my_comps, other_comps) -> pd.DataFrame:
    """Per component of ``mine``: its lightest edge to another component."""
    by_node = np.argsort(others, kind="stable")
    weights, others, other_comps = weights[:, by_node], others[by_node], other_comps[by_node]
    weights = np.where(my_comps[:, None] == other_comps[None, :], np.inf, weights)
    col = weights.argmin(axis=1)
    edges = pd.DataFrame(
        {
            "comp": my_comps,
            "weight": weights[np.arange(len(mine)), col],
            "lo": np.minimum(mine, others[col]),
            "hi": np.maximum(mine, others[col]),
            "other": other_comps[col],
        }
    )
    edges = edges[np.isfinite(edges["weight"])]
    return edges.sort_values(["comp", "weight", "lo", "hi"]).drop_duplicates("comp")


def _block_state(labels: DataFrame) -> DataFrame:
    """Core distances and components of each block's nodes, in block order."""
    listed = labels.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "core", "comp"))).alias("_s")
    )
    return listed.select("block", F.col("_s.core").alias("cores"), F.col("_s.comp").alias("comps"))


def _component_bounds(blocks: Blocks, contents: DataFrame, pivot_state: dict) -> DataFrame:
    """``(comp, bound)``: an upper bound of the lightest outgoing edge."""
    pivots = blocks.pivots
    pivot_nodes = np.array(blocks.pivot_nodes)
    pivot_cores = np.array([pivot_state[n][0] for n in blocks.pivot_nodes])
    pivot_comps = np.array([pivot_state[n][1] for n in blocks.pivot_nodes])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                nodes, cores, comps = (np.asarray(row[c]) for c in ("nodes", "cores", "comps"))
                vectors = block_vectors(row["vectors"], len(nodes))
                found = []
                if len(np.unique(comps)) > 1:
                    own = _mutual_reachability(vectors, vectors, cores, cores)
                    found.append(_lightest_edges(own, nodes, nodes, comps, comps))
                there = _mutual_reachability(vectors, pivots, cores, pivot_cores)
                found.append(_lightest_edges(there, nodes, pivot_nodes, comps, pivot_comps))
                found.append(_lightest_edges(there.T, pivot_nodes, nodes, pivot_comps, comps))
                for edges in found:
                    yield edges[["comp", "weight"]]

    bounds = contents.mapInPandas(run, "comp long, weight double")
    return bounds.groupBy("comp").agg(F.min("weight").alias("bound"))


class _Part:
    """A block in a round: its nodes and the places of their components among those of a task."""

    def __init__(self, row, comps: np.ndarray) -> None:
        self.nodes, self.cores = np.asarray(row.nodes), np.asarray(row.cores, np.float64)
        self.comps = np.searchsorted(comps, np.asarray(row.comps))
        self.vectors, self.every = NearPairs(row.vectors, len(self.nodes)), np.arange(len(self.nodes))


class _Lightest:
    """The lightest edge found so far of each component of a task; a limit of minus infinity asks for none."""

    def __init__(self, comps: np.ndarray, limit: np.ndarray) -> None:
        n = len(comps)
        self.comps, self.limit = comps, limit
        self.weight, self.lo, self.hi, self.other = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def limits(self, part: _Part) -> np.ndarray:
        """How far the nodes of a block search: not at all where their own core distance is beyond the limit."""
        limit = self.limit[part.comps]
        return np.where(part.cores <= limit + TIE, limit, -np.inf)

    def offer(self, comp: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray) -> None:
        light = weight <= self.limit[comp] + TIE
        comp, weight, lo, hi, other = comp[light], weight[light], lo[light], hi[light], other[light]
        if not len(comp):
            return
        order = np.lexsort((hi, lo, weight, comp))
        first = order[np.unique(comp[order], return_index=True)[1]]
        c, w, x, y = comp[first], weight[first], lo[first], hi[first]
        old = self.weight[c], self.lo[c], self.hi[c]
        better = (w < old[0]) | ((w == old[0]) & ((x < old[1]) | ((x == old[1]) & (y < old[2]))))
        c, at = c[better], first[better]
        self.weight[c], self.lo[c], self.hi[c], self.other[c] = weight[at], lo[at], hi[at], other[at]
        self.limit[c] = np.minimum(self.limit[c], weight[at])


def _compare_lightest(frame: pd.DataFrame) -> pd.DataFrame:
    """For the blocks of two groups the lightest edge of each component to a partner's nodes."""
    every = np.concatenate([np.asarray(c) for c in frame["comps"]])
    known = np.concatenate([np.array(x, np.float64) for x in frame["limits"]])
    comps, first = np.unique(every, return_index=True)
    best = _Lightest(comps, np.where(np.isnan(known[first]), -np.inf, known[first]))
    parts = {row.block: _Part(row, comps) for row in frame.itertuples(index=False)}

    def search(a: _Part, b: _Part, mine: np.ndarray, theirs: np.ndarray, other_limit: np.ndarray, same: bool) -> None:
        limit = best.limits(a)[mine]
        apart = a.comps[mine][:, None] != b.comps[theirs][None, :]
        if same:
            apart &= mine[:, None] < theirs[None, :]
        x, y, distances = a.vectors.find(b.vectors, mine, theirs, limit, other_limit[theirs], apart)
        weights = np.maximum(distances, np.maximum(a.cores[x], b.cores[y]))
        u, v = a.nodes[x], b.nodes[y]
        lo, hi = np.minimum(u, v), np.maximum(u, v)
        best.offer(a.comps[x], weights, lo, hi, comps[b.comps[y]])
        best.offer(b.comps[y], weights, lo, hi, comps[a.comps[x]])

    for block, partners in zip(frame["block"], frame["partners"], strict=True):
        a = parts[block]
        for partner in sorted(partners):
            b, same = parts[partner], partner == block
            asks, asked = np.isfinite(best.limits(a)), np.isfinite(best.limits(b))
            if same or 2 * asks.sum() > len(asks):
                if asks.any() or asked.any():
                    search(a, b, a.every, b.every, best.limits(b), same)
                continue
            # few nodes of the block search: they meet all of the partner, the others those that search there
            if asks.any():
                search(a, b, np.flatnonzero(asks), b.every, best.limits(b), same)
            if asked.any():
                search(a, b, np.flatnonzero(~asks), np.flatnonzero(asked), best.limits(b), same)
    some = np.isfinite(best.weight)
    return pd.DataFrame(
        {"comp": comps[some], "weight": best.weight[some], "lo": best.lo[some], "hi": best.hi[some], "other": best.other[some]}
    )


def _outgoing_edges(blocks: Blocks, groups: DataFrame, labels: DataFrame, waiting: int | None = None) -> DataFrame:
    """``(comp, weight, lo, hi, other)``: the lightest edge of every component but ``waiting``."""
    state = cut(_block_state(labels))
    contents = blocks.table.select("block", "nodes", "vectors").join(state, "block")
    # One row per pivot.
    pivot_rows = labels.where(F.col("node").isin(blocks.pivot_nodes)).select("node", "core", "comp")
    pivot_state = {r.node: (r.core, r.comp) for r in pivot_rows.collect()}
    bounds = _component_bounds(blocks, contents, pivot_state)

    # A node whose own core distance exceeds the bound cannot improve on it.
    searching = F.lit(True) if waiting is None else F.col("comp") != waiting
    active = (
        labels.where(searching).groupBy("block", "comp").agg(F.min("core").alias("core"))
        .join(bounds, "comp")
        .where(F.col("core") <= F.col("bound"))
    )
    reach = active.groupBy("block").agg(F.sqrt(2 * F.max("bound")).alias("reach"))
    single = state.select(
        "block",
        F.when(F.array_min("comps") == F.array_max("comps"), F.array_min("comps")).alias("_only"),
    )
    pairs = (
        block_pairs(blocks, reach)
        .join(single.select(F.col("block").alias("a"), F.col("_only").alias("_a")), "a")
        .join(single.select(F.col("block").alias("b"), F.col("_only").alias("_b")), "b")
        .where(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
        .select("a", "b")
    )
    limits = (
        labels.join(bounds, "comp", "left").groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.when(searching, F.col("bound")).alias("bound")))).alias("_s"))
        .select("block", F.col("_s.bound").alias("limits"))
    )
    payload = contents.join(limits, "block")
    found = compare_blocks(pairs, groups, payload, _compare_lightest, EDGE_SCHEMA)
    lightest = found.groupBy("comp").agg(F.min(F.struct("weight", "lo", "hi", "other")).alias("_e"))
    return cut(lightest.select("comp", "_e.*"))


def spanning_tree(grouped: VectorGroups, blocks: Blocks, cores: DataFrame) -> DataFrame:
    """``(weight, lo, hi)``: ``n_nodes - 1`` edges between distinct vectors."""
    labels = cut(
        blocks.table.select("block", F.posexplode("nodes").alias("pos", "node"))
        .join(cores, "node")
        .withColumn("comp", F.col("node"))
    )
    groups = block_groups(blocks)
    n_comps, chosen, waiting = grouped.n_nodes, [], None
    while n_comps > 1:
        edges = _outgoing_edges(blocks, groups, labels, waiting)
        chosen.append(edges.select("weight", "lo", "hi"))
        # Two components that chose each other: the lesser one is the root, as is one that waits.
        ends = edges.select("comp", "other")
        if waiting is not None:
            ends = ends.unionByName(
                labels.sparkSession.createDataFrame([(waiting, waiting)], "comp long, other long")
            )
        back = ends.select(F.col("comp").alias("other"), F.col("other").alias("_back"))
        hooks = ends.join(back, "other")
        is_root = (F.col("_back") == F.col("comp")) & (F.col("comp") <= F.col("other"))
        roots = follow(
            hooks.select(
                F.col("comp").alias("node"),
                F.when(is_root, F.col("comp")).otherwise(F.col("other")).alias("ptr"),
                is_root.alias("done"),
            )
        )
        sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        hot = hot_keys(sizes, ["comp"], "n", grouped.n_nodes)
        moved = skew_join(labels, roots.withColumnRenamed("node", "comp"), ["comp"], hot)
        labels = cut(moved.drop("comp").withColumnRenamed("root", "comp"))
        n_comps = roots.where("node = root").count()
        largest = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > grouped.n_nodes / 2).first()
        waiting = largest["comp"] if largest else None
    if not chosen:
        return labels.sparkSession.createDataFrame([], "weight double, lo long, hi long")
    return reduce(DataFrame.unionByName, chosen).distinct()
