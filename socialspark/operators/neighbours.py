"""Exact nearest neighbours by cosine distance, and core distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from socialspark.constants import POST_ID
from socialspark.operators.projections import near_by_projections
from socialspark.operators.ranking import top_per_key
from socialspark.operators.skew import skew_join
from socialspark.operators.vector_blocks import (
    BLOCK_ROWS,
    FARTHEST,
    TIE,
    Blocks,
    NearPairs,
    VectorGroups,
    block_groups,
    block_pairs,
    block_vectors,
    build_blocks,
    compare_blocks,
    cosine_distances,
    group_vectors,
)
from socialspark.session import cut

_NEIGHBOUR_SCHEMA = "node long, other long, other_size long, distance double"
_NOBODY = np.iinfo(np.int64).max


class _Nearest:
    """The ``k`` nearest others found so far of the rows of a block, by distance, then by node."""

    def __init__(self, row, k: int) -> None:
        self.nodes, self.sizes = np.asarray(row.nodes), np.asarray(row.sizes)
        n = len(self.nodes)
        self.vectors, self.every = NearPairs(row.vectors, n), np.arange(n)
        self.limit = np.array(row.limits, np.float64)
        self.distance = np.full((n, k), np.inf)
        self.other, self.size = np.full((n, k), _NOBODY), np.zeros((n, k), np.int64)

    def offer(self, rows: np.ndarray, others: np.ndarray, sizes: np.ndarray, distances: np.ndarray) -> None:
        near = distances <= self.limit[rows] + TIE
        rows, others, sizes, distances = rows[near], others[near], sizes[near], distances[near]
        if not len(rows):
            return
        k = self.distance.shape[1]
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, k), rows])
        distances = np.concatenate([self.distance[touched].ravel(), distances])
        others = np.concatenate([self.other[touched].ravel(), others])
        sizes = np.concatenate([self.size[touched].ravel(), sizes])
        order = np.lexsort((others, distances, rows))
        pick = order[np.searchsorted(rows[order], touched)[:, None] + np.arange(k)]
        self.distance[touched], self.other[touched], self.size[touched] = distances[pick], others[pick], sizes[pick]
        self.limit[touched] = np.minimum(self.limit[touched], distances[pick[:, -1]])


def _compare_nearest(k: int):
    """For the blocks of two groups the ``k`` nearest of each row among the rows of its partners."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = {row.block: _Nearest(row, k) for row in frame.itertuples(index=False)}
        for block, partners in zip(frame["block"], frame["partners"], strict=True):
            a = blocks[block]
            for partner in sorted(partners):
                b, same = blocks[partner], partner == block
                apart = ~np.eye(len(a.nodes), dtype=bool) if same else None
                mine, theirs, distances = a.vectors.find(
                    b.vectors, a.every, b.every, a.limit, np.full(len(b.limit), -np.inf) if same else b.limit, apart
                )
                a.offer(mine, b.nodes[theirs], b.sizes[theirs], distances)
                if not same:
                    b.offer(theirs, a.nodes[mine], a.sizes[mine], distances)
        nodes = np.concatenate([np.repeat(b.nodes, k) for b in blocks.values()])
        other, size, distance = (np.concatenate([getattr(b, c).ravel() for b in blocks.values()]) for c in ("other", "size", "distance"))
        found = pd.DataFrame({"node": nodes, "other": other, "other_size": size, "distance": distance})
        return found[np.isfinite(distance)]

    return run


def nearest_nodes(blocks: Blocks, k: int) -> DataFrame:
    """``(node, other, other_size, distance)``: the ``k`` nearest other nodes.

    A first pass inside each block bounds how far the ``k``-th neighbour of each
    row can be; the second compares the block with all blocks within that bound.
    """

    def own_reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                n = len(row["nodes"])
                limits = np.full(n, FARTHEST)
                if n > k:
                    vectors = block_vectors(row["vectors"], n)
                    distances = cosine_distances(vectors, vectors)
                    np.fill_diagonal(distances, np.inf)
                    limits = np.partition(distances, k - 1, axis=1)[:, k - 1]
                reach = float(np.sqrt(2.0 * limits.max()))
                yield pd.DataFrame({"block": [row["block"]], "reach": [reach], "limits": [limits]})

    reach = cut(
        blocks.table.select("block", "nodes", "vectors").mapInPandas(
            own_reach, "block long, reach double, limits array<double>"
        )
    )
    payload = blocks.table.select("block", "nodes", "sizes", "vectors").join(reach.select("block", "limits"), "block")
    pairs = block_pairs(blocks, reach.select("block", "reach"))
    found = compare_blocks(pairs, block_groups(blocks), payload, _compare_nearest(k), _NEIGHBOUR_SCHEMA)
    return top_per_key(found, ["node"], [F.col("distance"), F.col("other")], k)


def node_core_distances(grouped: VectorGroups, near: DataFrame, min_samples: int) -> DataFrame:
    """``(node, core)``: distance to the ``min_samples``-th other row.

    Copies of a vector are other rows at distance 0. With fewer other rows
    than ``min_samples`` the farthest one counts. A node has at most
    ``min_samples`` neighbours, so its window is short.
    """
    order = Window.partitionBy("node").orderBy("distance", "other")
    reached = near.withColumn("_rows", F.sum("other_size").over(order)).join(
        grouped.groups.select("node", F.col("size").alias("_size")), "node", "right"
    )
    enough = F.min(F.when(F.col("_size") - 1 + F.col("_rows") >= min_samples, F.col("distance")))
    return reached.groupBy("node").agg(
        F.when(F.first("_size") > min_samples, F.lit(0.0))
        .otherwise(F.coalesce(enough, F.max("distance"), F.lit(0.0)))
        .alias("core")
    )


def core_distance(
    vectors: DataFrame,
    min_samples: int = 3,
    key: str = POST_ID,
    column: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(key, core)`` by cosine distance, exact."""
    grouped = group_vectors(vectors, key, column)
    near = nearest_nodes(build_blocks(grouped, block_rows), min_samples)
    cores = node_core_distances(grouped, near, min_samples)
    return skew_join(grouped.members, cores, ["node"], grouped.hot).select(key, "core")


def knn_cosine(
    vectors: DataFrame,
    k: int = 3,
    key: str = POST_ID,
    column: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    method: str = "exact",
    recall: float = 0.95,
) -> DataFrame:
    """``(key, rank, neighbour, distance)``: the ``k`` nearest other rows, exact.

    With ``method="projections"`` they are approximate, and found in buckets of random projections; as many tables
    are used as a sample of the vectors needs to reach ``recall``, see ``near_by_projections``. Where a bounded
    number of tables does not reach it, the exact search takes over. Neighbours found have exact distances; a
    row may have fewer than ``k``.

    Equal distances are ordered by id. Rows with equal vectors share one
    search. Of all copies of a vector only the ``k + 1`` least ids can ever be
    an answer, so a list never grows with the number of copies.
    """
    if method not in ("exact", "projections"):
        raise ValueError(f"unknown method {method!r}")
    grouped = group_vectors(vectors, key, column)
    near = near_by_projections(grouped, k, recall, block_rows)[0] if method == "projections" else None
    if near is None:
        near = nearest_nodes(build_blocks(grouped, block_rows), k)
    least_ids = cut(top_per_key(grouped.members, ["node"], [F.col(key)], k + 1))
    own = least_ids.select("node", F.col(key).alias("neighbour"), F.lit(0.0).alias("distance"))
    others = near.join(
        least_ids.select(F.col("node").alias("other"), F.col(key).alias("neighbour")), "other"
    ).select("node", "neighbour", "distance")
    answers = top_per_key(
        own.unionByName(others), ["node"], [F.col("distance"), F.col("neighbour")], k + 1
    )
    # k + 1 entries per node at most.
    lists = answers.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("_list")
    )
    rows = skew_join(grouped.members, lists, ["node"], grouped.hot)
    other_rows = F.slice(F.filter("_list", lambda item: item["neighbour"] != F.col(key)), 1, k)
    return rows.select(key, F.posexplode(other_rows).alias("_pos", "_item")).select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_item.neighbour").alias("neighbour"),
        F.col("_item.distance").alias("distance"),
    )
