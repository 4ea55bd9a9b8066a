"""Blocks of vectors that let exact neighbour searches skip most of the data.

Vectors are scaled to unit length, where cosine distance ``d`` and Euclidean
distance ``e`` obey ``e * e = 2 * d`` and the triangle inequality holds for
``e``. Every vector belongs to the cell of its nearest pivot. A cell is sorted
by the distance to its pivot and cut into blocks of bounded size: thin shells.
A block keeps its least and greatest distance to every pivot, which bounds the
distance to any other block from below. Searches pair only blocks that may
hold an answer, compare the vectors of a pair inside one task, and keep the
best of each row; pairs of vectors never become rows.

A cell that holds a third of all vectors is many blocks, because the range
exchange that forms blocks splits it by radius and node.

Blocks are dealt into a fixed number of groups of like size, and a task compares two groups. So a block is
sent once per group, not once per partner, and a task answers once for each of its
rows. Only where a group would pass ``GROUP_BLOCKS`` blocks are there more groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.operators.clusters import hashed_sample
from socialspark.operators.embed import usable
from socialspark.operators.ranking import number_rows
from socialspark.operators.skew import hot_keys, skew_join
from socialspark.session import cut

BLOCK_ROWS = 1024
MAX_PIVOTS = 512
#: Groups of blocks, and blocks of a group; a task holds two groups.
GROUPS = 16
GROUP_BLOCKS = 64
#: Cosine distances known beforehand may differ from those compared with them in the last of their rounded digits.
TIE = 1e-11
SLACK = 1e-6  # on Euclidean bounds; rounding errors are far smaller
FARTHEST = 2.0  # no two unit vectors are farther apart

BLOCK_SCHEMA = (
    "block long, cell int, r_min double, r_max double, near array<double>, far array<double>,"
    " nodes array<long>, sizes array<long>, vectors binary"
)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at unit length, in double precision.

    One coordinate is added. It is 0 except for rows of zeros, which get 1
    there: they have cosine distance 1 from everything else.
    """
    matrix = np.asarray(matrix, dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    zero = norms == 0
    return np.hstack([matrix / np.where(zero, 1.0, norms), zero.astype(np.float64)])


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded, so that a distance does not depend on the shape of the block."""
    return np.round(np.maximum(1.0 - a @ b.T, 0.0), 12)


def block_vectors(raw: bytes, n: int) -> np.ndarray:
    return unit(np.frombuffer(raw, dtype=np.float32).reshape(n, -1))


@dataclass
class VectorGroups:
    """Distinct vectors, numbered, and the rows that share them."""

    groups: DataFrame  # node, size, embedding
    members: DataFrame  # key, node
    n_nodes: int
    n_rows: int
    hot: DataFrame  # nodes with very many copies


def group_vectors(vectors: DataFrame, key: str, column: str = "embedding") -> VectorGroups:
    """Collapse equal vectors, so that copies cost one comparison, not many.

    Rows without a usable vector are left out.
    """
    vectors = usable(vectors, column).select(key, F.col(column).cast("array<float>").alias("embedding"))
    counted = vectors.groupBy("embedding").agg(
        F.count(F.lit(1)).alias("size"), F.min(key).alias("_first")
    )
    groups = cut(number_rows(counted, ["_first"], "node").select("node", "size", "embedding"))
    n_nodes, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    hot = hot_keys(groups, ["embedding", "node"], "size", n_rows)
    members = skew_join(
        vectors, groups.select("embedding", "node"), ["embedding"], hot.select("embedding")
    ).select(key, "node")
    return VectorGroups(groups, cut(members), n_nodes, n_rows, hot.select("node"))


@dataclass
class Blocks:
    table: DataFrame  # see BLOCK_SCHEMA
    pivot_nodes: list[int]
    pivots: np.ndarray


def build_blocks(grouped: VectorGroups, block_rows: int = BLOCK_ROWS) -> Blocks:
    n_pivots = min(MAX_PIVOTS, max(1, math.ceil(grouped.n_nodes / (4 * block_rows))))
    # At most MAX_PIVOTS vectors reach the driver.
    chosen = hashed_sample(grouped.groups, "node", n_pivots).collect()
    pivots = unit(np.array([row.embedding for row in chosen], dtype=np.float32))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = unit(np.array(frame["embedding"].tolist(), dtype=np.float32))
            to_pivots = np.sqrt(2.0 * cosine_distances(rows, pivots))
            cell = to_pivots.argmin(axis=1)
            yield frame.assign(cell=cell, r=to_pivots[np.arange(len(rows)), cell])

    def cut_into_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(part: pd.DataFrame) -> pd.DataFrame:
            matrix = np.array(part["embedding"].tolist(), dtype=np.float32)
            to_pivots = np.sqrt(2.0 * cosine_distances(unit(matrix), pivots))
            return pd.DataFrame(
                {
                    "block": [part["node"].iloc[0]],
                    "cell": [part["cell"].iloc[0]],
                    "r_min": [part["r"].min()],
                    "r_max": [part["r"].max()],
                    "near": [to_pivots.min(axis=0)],
                    "far": [to_pivots.max(axis=0)],
                    "nodes": [part["node"].to_numpy()],
                    "sizes": [part["size"].to_numpy()],
                    "vectors": [matrix.tobytes()],
                }
            )

        waiting = None
        for frame in frames:
            rows = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            waiting = None
            for _, run in rows.groupby("cell", sort=True):
                full = len(run) - len(run) % block_rows
                for start in range(0, full, block_rows):
                    yield block(run.iloc[start : start + block_rows])
                if full < len(run):
                    # Only the last cell of the batch may go on in the next one.
                    if waiting is not None:
                        yield block(waiting)
                    waiting = run.iloc[full:]
        if waiting is not None:
            yield block(waiting)

    placed = grouped.groups.mapInPandas(
        place, "node long, size long, embedding array<float>, cell int, r double"
    )
    order = ["cell", "r", "node"]
    shells = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    table = cut(shells.mapInPandas(cut_into_blocks, BLOCK_SCHEMA))
    return Blocks(table, [row.node for row in chosen], pivots)


def block_pairs(blocks: Blocks, reach: DataFrame) -> DataFrame:
    """``(a, b)`` with ``a <= b``: pairs of blocks that may be within reach.

    ``reach`` is ``(block, reach)`` in Euclidean distance; a block without a
    row searches nothing but can be found by others. Only bounds are joined
    here, a few numbers per block and cell.
    """
    table = blocks.table
    # One row per pivot, MAX_PIVOTS at most: safe to broadcast.
    cells = F.broadcast(table.groupBy("cell").agg(F.max("r_max").alias("radius")))
    shells = F.transform(
        F.arrays_zip("near", "far"),
        lambda shell, cell: F.struct(cell.alias("cell"), shell["near"].alias("near"), shell["far"].alias("far")),
    )
    limit = F.col("reach") + SLACK
    search = (
        table.select("block", "near", "far")
        .join(reach, "block")
        .select("block", "reach", F.inline(shells))
        .join(cells, "cell")
        .where(F.col("near") - F.col("radius") <= limit)
    )
    targets = table.select("cell", F.col("block").alias("other"), "r_min", "r_max")
    found = search.join(targets, "cell").where(
        (F.col("near") - F.col("r_max") <= limit) & (F.col("r_min") - F.col("far") <= limit)
    )
    return found.select(
        F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    ).distinct()


def block_groups(blocks: Blocks, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """``(block, group)``: neighbouring shells in ``GROUPS`` runs of like length, or more that none is too long."""
    order = ["cell", "r_min", "block"]
    numbered = number_rows(blocks.table.select(*order), order, "_number")
    n = blocks.table.count()
    groups = max(min(GROUPS, n), math.ceil(n / group_blocks))
    return cut(numbered.select("block", F.floor(F.col("_number") * groups / max(n, 1)).cast("int").alias("group")))


def compare_blocks(
    pairs: DataFrame,
    groups: DataFrame,
    payload: DataFrame,
    kernel: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run ``kernel`` on every pair of groups that holds a pair ``(a, b)`` of blocks.

    The kernel sees the payload of the blocks of both groups, a row each; ``partners`` are the blocks each is to
    be compared with, so that every pair occurs once.
    """
    of_a = groups.select(F.col("block").alias("a"), F.col("group").alias("_ga"))
    of_b = groups.select(F.col("block").alias("b"), F.col("group").alias("_gb"))
    placed = cut(
        pairs.join(of_a, "a").join(of_b, "b")
        .select("a", "b", F.least("_ga", "_gb").alias("_x"), F.greatest("_ga", "_gb").alias("_y"))
    )
    ends = placed.select("_x", "_y", F.col("a").alias("block"), F.col("b").alias("partner")).unionByName(
        placed.select("_x", "_y", F.col("b").alias("block"), F.lit(None).cast("long").alias("partner"))
    )
    # at most 2 * GROUP_BLOCKS partners
    wanted = ends.groupBy("block", "_x", "_y").agg(F.collect_list("partner").alias("partners"))
    return payload.join(wanted, "block").groupBy("_x", "_y").applyInPandas(
        lambda frame: kernel(frame.sort_values("block", ignore_index=True)), schema
    )


class NearPairs:
    """The pairs of rows of two matrices of unit vectors that may be near, and their distances.

    A product in single precision rules out most pairs; the others are measured in double precision.
    """

    def __init__(self, raw: bytes, n: int) -> None:
        self.full = block_vectors(raw, n)
        self.rough = self.full.astype(np.float32)

    def find(
        self, other: NearPairs, mine: np.ndarray, theirs: np.ndarray, limit: np.ndarray, other_limit: np.ndarray, apart=None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``mine`` and ``theirs`` at most one of both limits apart, and their distances.

        A limit of minus infinity asks for nothing. ``apart`` is a mask of the pairs in question.
        """
        slack = TIE + 2.4e-7 * (self.full.shape[1] + 4)  # more than the rounding errors of a product
        least = (1.0 - slack - limit).astype(np.float32), (1.0 - slack - other_limit).astype(np.float32)
        near = self.rough[mine] @ other.rough[theirs].T
        near = near >= (np.minimum(least[0][:, None], least[1][None, :]) if np.isfinite(other_limit).any() else least[0][:, None])
        if apart is not None:
            near &= apart
        rows, cols = np.nonzero(near)
        if 8 * len(rows) > near.size:
            distances = cosine_distances(self.full[mine], other.full[theirs])[rows, cols]
        else:
            products = [
                np.einsum("ij,ij->i", self.full[mine[rows[at : at + 65_536]]], other.full[theirs[cols[at : at + 65_536]]])
                for at in range(0, len(rows), 65_536)
            ]
            distances = np.round(np.maximum(1.0 - np.concatenate(products or [np.zeros(0)]), 0.0), 12)
        return mine[rows], theirs[cols], distances
