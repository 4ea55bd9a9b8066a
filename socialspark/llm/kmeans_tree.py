"""Approximate search for the largest inner products in a hierarchical k-means tree.

Vectors are lengthened by one component to a common norm, so that the largest inner
product is the least distance. A tree of k-means centres is fitted on a bounded
sample; every row is indexed, in the leaf that a walk to the nearest centre of each level
reaches. A query visits leaves best-bin-first: a priority queue holds the branches seen so far, by
distance to their centre, and the nearest is opened next.

How many leaves are visited is calibrated: for a bounded sample of the queries the exact neighbours are found in all rows, and visits
are widened until the leaves opened hold the target share of them. Every query opens that
number of leaves at least, and more while they hold fewer than ``k + 1`` rows, in one join of
blocks of queries with blocks of leaf members; scores are exact inner products in double precision.

Bounds: the tree is fitted on ``sample`` vectors at most, with ``calibrate`` queries at most;
tree and calibration queries are sent to all tasks. Leaves grow with the table
beyond that and are searched in blocks of ``BLOCK`` rows. Equal vectors are one with their smallest ids.

Defined results: vectors that are null, empty or zero or hold a null or non-finite component
take no part, nor do rows without an id; an id with several vectors is one candidate, at its nearest; ties go to the smaller id; only if the
table has fewer different candidates than ``k`` are there fewer results, all of these; a table of one leaf is
searched whole. Vectors must have equal length; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.llm.neighbour_lists import BLOCK, blocks, expand, first_ids, merge, usable, with_ids
from socialspark.session import cut

K = 20
SAMPLE = 16_384
CALIBRATE = 256
RECALL = 0.97
BRANCHES = 16
LEAF = 256
QUERIES = 512
#: Neighbours that a task holds before it drops all but the nearest of each query, or passes them on.
HELD = 1 << 20


def lengthen(vectors: np.ndarray, norm: float) -> np.ndarray:
    """One component more, so that all have the norm."""
    rest = np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0)
    return np.column_stack([vectors, np.sqrt(rest)])


def lloyd(points: np.ndarray, k: int, random: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the nearest centre of each point."""
    centres = points[random.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres, nearest(points, centres)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * points @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)


@dataclass
class Tree:
    """``children[n]`` are the children of node ``n``; a node without any is a leaf. ``centres`` by node."""

    children: list[np.ndarray]
    centres: np.ndarray

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, going to the nearest centre at each level."""
        node = np.zeros(len(points), np.int64)
        while True:
            inner = [n for n in np.unique(node) if len(self.children[n])]
            if not inner:
                return node
            for n in inner:
                own = np.flatnonzero(node == n)
                node[own] = self.children[n][nearest(points[own], self.centres[self.children[n]])]

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                yield node
                continue
            gaps = self.centres[below] - query
            for far, child in zip((gaps * gaps).sum(axis=1).tolist(), below.tolist(), strict=True):
                heapq.heappush(queue, (far, child))

    def opened(self, query: np.ndarray, visits: int, rows: np.ndarray, least: int) -> list[int]:
        """``visits`` leaves, best bin first, and more until they hold ``least`` of the ``rows`` by node."""
        leaves, held = [], 0
        for leaf in self.best_bins(query):
            if len(leaves) >= visits and held >= least:
                break
            leaves.append(leaf)
            held += int(rows[leaf])
        return leaves


def grow(points: np.ndarray, leaf: int, branches: int = BRANCHES, seed: int = 11) -> Tree:
    """Split nodes of more than ``leaf`` points by k-means."""
    random = np.random.Generator(np.random.PCG64(seed))
    centres, children = [points.mean(axis=0)], [np.zeros(0, np.int64)]
    todo = [(0, points)]
    while todo:
        node, own = todo.pop()
        if len(own) <= leaf:
            continue
        found, near = lloyd(own, min(branches, len(own)), random)
        used = np.unique(near)
        if len(used) < 2:
            continue
        children[node] = np.arange(len(centres), len(centres) + len(used))
        for c in used:
            todo.append((len(centres), own[near == c]))
            centres.append(found[c])
            children.append(np.zeros(0, np.int64))
    return Tree(children, np.array(centres))


_BEST = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())]))
_BEST_SQL = "array<struct<far:double,id:bigint>>"


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def best_in_block(queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """The ``k + 1`` largest products of each query, as ``(-product, id)``.

    A matrix product picks the candidates with a margin for its rounding; the
    products that count are summed one way for all, so that equal vectors tie.
    """
    rough = queries @ vectors.T
    out = []
    for query, row in zip(queries, rough, strict=True):
        take = k + 1
        while True:
            if len(row) > take:
                edge = np.partition(row, len(row) - take)[len(row) - take]
                near = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
            else:
                near = np.arange(len(row))
            exact = (vectors[near] * query).sum(axis=1)
            found = first_ids(sorted((-float(s), x) for s, j in zip(exact, near, strict=True) for x in ids[j]), k + 1)
            if len(found) > k or len(near) == len(row):
                break
            take *= 4  # an id with several vectors among the nearest
        out.append(found)
    return out


class Best:
    """The ``k + 1`` nearest of every query that a task has met, with different ids."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.clear()

    def clear(self) -> None:
        self.keys, self.far, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, lists: list[list[tuple[float, int]]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = [pair for found in lists for pair in found]
        far, ids = np.array([f for f, _ in flat], float), np.array([i for _, i in flat], np.int64)
        self.parts.append((np.repeat(keys, sizes), far, ids))
        self.waiting += len(flat)
        if self.waiting >= HELD:
            self.shrink()

    def shrink(self) -> None:
        keys, far, ids = (np.concatenate(x) for x in zip((self.keys, self.far, self.ids), *self.parts, strict=True))
        for by_id in (True, False):  # an id once for each query, then the nearest
            order = np.lexsort((far, ids, keys) if by_id else (ids, far, keys))
            keys, far, ids = keys[order], far[order], ids[order]
            if by_id:
                first = np.ones(len(keys), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            else:
                starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(starts, len(keys)))
                first = np.arange(len(keys)) - np.repeat(starts, sizes) <= self.k
            keys, far, ids = keys[first], far[first], ids[first]
        self.keys, self.far, self.ids = keys, far, ids
        self.parts, self.waiting = [], 0

    def flush(self) -> pa.RecordBatch:
        self.shrink()
        starts = np.flatnonzero(np.diff(self.keys, prepend=self.keys[:1] - 1)) if len(self.keys) else np.zeros(0, np.int64)
        values = pa.StructArray.from_arrays([pa.array(self.far), pa.array(self.ids)], ["far", "id"])
        lists = pa.ListArray.from_arrays(np.append(starts, len(self.keys)).astype(np.int32), values)
        batch = pa.RecordBatch.from_arrays([pa.array(self.keys[starts]), lists], ["key", "best"])
        self.clear()
        return batch


def kmeans_tree_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
    sample: int = SAMPLE,
    calibrate: int = CALIBRATE,
    leaf: int = LEAF,
    visits: int | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every row of ``queries``.

    ``visits`` fixes the least number of leaves and skips calibration.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    index = cut(with_ids(rows, "vec", k))
    asked = cut(usable(queries, id_col, vector_col))
    distinct = asked.groupBy(F.xxhash64("vec").alias("_hash"), "vec").agg(F.min("id").alias("key")).drop("_hash")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    size, longest = index.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    picked = index.orderBy(F.xxhash64(F.element_at("ids", 1)), F.element_at("ids", 1)).limit(sample).select("vec").toPandas()
    points = lengthen(np.array(picked["vec"].tolist()), longest)
    grown = grow(points, max(8, round(leaf * len(points) / size)))
    tree = spark.sparkContext.broadcast({"children": grown.children, "centres": grown.centres})  # bounded by sample

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = Tree(**tree.value).leaf_of(lengthen(_matrix(batch.column("vec")), longest))
                yield pa.RecordBatch.from_arrays([pa.array(leaves), *batch.columns], ["leaf", *batch.schema.names])

    placed = cut(index.select("vec", "ids").mapInArrow(to_leaves, "leaf long, vec array<double>, ids array<bigint>"))
    if visits is None:
        visits = _calibrated(distinct, placed, grown, k, recall, calibrate)
    held = np.zeros(len(grown.children), np.int64)
    for row in placed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect():  # a row per leaf
        held[row["leaf"]] = row["n"]

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.column_stack([_matrix(batch.column("vec")), np.zeros(batch.num_rows)])
            leaves = [Tree(**tree.value).opened(p, visits, held, k + 1) for p in points]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], [*batch.schema.names, "leaves"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for members, queries in zip(batch.column("block"), batch.column("asked"), strict=True):
                members, queries = members.values, queries.values
                found = best_in_block(_matrix(queries.field("vec")), _matrix(members.field("vec")), members.field("ids").to_pylist(), k)
                best.add(queries.field("key").to_numpy(), found)
                if len(best.keys) > HELD:  # bounded, however many queries there are
                    yield best.flush()
        yield best.flush()

    routed = distinct.select("key", "vec").mapInArrow(to_bins, "key long, vec array<double>, leaves array<bigint>")
    routed = routed.select("key", "vec", F.explode("leaves").alias("leaf"))
    members = blocks(placed, ["leaf"], ["vec", "ids"], F.xxhash64(F.element_at("ids", 1)), BLOCK)
    wanted = blocks(routed, ["leaf"], ["key", "vec"], F.xxhash64("key"), QUERIES).select("leaf", F.col("block").alias("asked"))
    # Spark takes what Python and explode give for as small as what they read, and would broadcast it; it grows with the queries.
    met = members.join(wanted.hint("merge"), "leaf").select("block", "asked").mapInArrow(look, f"key long, best {_BEST_SQL}")
    found = distinct.join(merge(met, "key", k).hint("merge"), "key").select("vec", "best")
    return expand(asked, found.hint("merge"), "vec", k).select(
        "query_id", "rank", F.col("near.id").alias("vec_id"), (-F.col("near.far")).alias("score")
    )


def _calibrated(distinct: DataFrame, placed: DataFrame, tree: Tree, k: int, recall: float, calibrate: int) -> int:
    """Leaves to visit for the target recall on a sample of the queries."""
    some = distinct.orderBy(F.xxhash64("key"), "key").limit(calibrate).select("key", "vec").toPandas()
    if not len(some):
        return 1
    keys, asked = some["key"].to_numpy(), np.array(some["vec"].tolist())
    sent = distinct.sparkSession.sparkContext.broadcast((keys, asked))  # bounded by calibrate

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, asked = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves, ids = batch.column("leaf").to_pylist(), batch.column("ids").to_pylist()
            leaf_of = {x: n for n, own in zip(leaves, ids, strict=True) for x in own}
            best = best_in_block(asked, _matrix(batch.column("vec")), ids, k)
            lists = [[{"far": s, "id": x, "leaf": leaf_of[x]} for s, x in row] for row in best]
            kind = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64()), ("leaf", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lists, kind)], ["key", "best"])

    lists = placed.mapInArrow(exact, "key long, best array<struct<far:double,id:bigint,leaf:bigint>>")
    truth = {r["key"]: [x["leaf"] for x in r["best"]] for r in merge(lists, "key", k).collect()}
    needed = []
    for key, query in zip(keys, asked, strict=True):
        rank = {n: i + 1 for i, n in enumerate(tree.best_bins(np.append(query, 0.0)))}
        needed += [rank[n] for n in truth[key]]
    needed.sort()
    visits = 1
    while np.searchsorted(needed, visits, side="right") < recall * len(needed):
        visits += 1
    return visits
