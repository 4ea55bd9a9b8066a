"""Density clustering: dendrogram, condensed tree, stability selection.

All steps are exact and none passes all points through one task. Equal vectors
are one leaf with a size; a leaf of ``min_cluster_size`` copies or more falls
apart at its core distance.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.constants import POST_ID
from socialspark.operators.neighbours import nearest_nodes, node_core_distances
from socialspark.operators.pointers import follow, forest_components
from socialspark.operators.ranking import number_rows
from socialspark.operators.skew import skew_join
from socialspark.operators.spanning_tree import spanning_tree
from socialspark.operators.vector_blocks import BLOCK_ROWS, build_blocks, group_vectors
from socialspark.session import cut

#: Edges of one task of the dendrogram; longer lists are halved first.
MERGES_PER_TASK = 1024
LEAST_DISTANCE = 1e-12  # keeps 1 / distance finite for equal points
NOISE = -1

_MERGE_SCHEMA = (
    "parent long, left long, right long, left_size long, right_size long, weight double"
)


def _merge_interval(n_nodes: int):
    """Single-linkage merges of one interval of consecutive edges."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        up: dict[int, int] = {}
        size: dict[int, int] = {}

        def top(node: int) -> int:
            while node in up:
                if up[node] in up:
                    up[node] = up[up[node]]
                node = up[node]
            return node

        out = []
        for edge in frame.itertuples(index=False):
            size.setdefault(edge.u, edge.u_size)
            size.setdefault(edge.v, edge.v_size)
            left, right = sorted((top(edge.u), top(edge.v)))
            parent = n_nodes + edge.rank
            up[left] = up[right] = parent
            size[parent] = size[left] + size[right]
            out.append((parent, left, right, size[left], size[right], edge.weight))
        return pd.DataFrame(
            out, columns=["parent", "left", "right", "left_size", "right_size", "weight"]
        )

    return run


def dendrogram(
    tree: DataFrame, sizes: DataFrame, n_nodes: int, merges_per_task: int = MERGES_PER_TASK
) -> DataFrame:
    """``(parent, left, right, left_size, right_size, weight)`` of single linkage.

    ``tree`` is ``(weight, lo, hi)``, ``sizes`` is ``(node, size)``. Leaves
    keep their node number; the merge of the edge with rank ``r`` is
    ``n_nodes + r``.

    The ranked edges are halved until an interval has ``merges_per_task`` edges
    at most. Halving contracts the lower half of every interval: in the upper
    half a component of the lower half is replaced by the merge that completed
    it. After that the intervals are independent, and each is merged by one
    task. A level costs the components of a forest, for all intervals at once.
    """
    edges = number_rows(tree, ["weight", "lo", "hi"], "rank")
    u = sizes.select(F.col("node").alias("lo"), F.col("size").alias("u_size"))
    v = sizes.select(F.col("node").alias("hi"), F.col("size").alias("v_size"))
    edges = cut(
        edges.join(u, "lo").join(v, "hi")
        .withColumnsRenamed({"lo": "u", "hi": "v"})
        .withColumn("part", F.lit(0).cast("long"))
    )
    width = 1
    while width < n_nodes - 1:
        width *= 2
    span = 2 * n_nodes
    while width > merges_per_task:
        width //= 2
        half = F.floor(F.col("rank") / width)
        edges = edges.withColumn("part", half)
        lower = edges.where("part % 2 = 0")
        upper = edges.where("part % 2 = 1")
        # A node is told apart by the pair of halves it is in.
        key = F.floor(F.col("part") / 2) * span
        joined = cut(
            lower.select((key + F.col("u")).alias("u"), (key + F.col("v")).alias("v"), "rank", "u_size", "v_size")
        )
        roots = forest_components(joined.select("u", "v"))
        inside = joined.select(F.col("u").alias("node"), F.col("u_size").alias("size")).unionByName(
            joined.select(F.col("v").alias("node"), F.col("v_size").alias("size"))
        ).distinct()
        component_size = inside.join(roots, "node").groupBy("root").agg(F.sum("size").alias("_size"))
        last = (
            joined.select(F.col("u").alias("node"), "rank")
            .groupBy("node").agg(F.max("rank").alias("rank"))
            .join(roots, "node").groupBy("root").agg((F.max("rank") + n_nodes).alias("_merge"))
        )
        replaced = cut(roots.join(component_size, "root").join(last, "root").select("node", "_merge", "_size"))

        def contract(df: DataFrame, end: str) -> DataFrame:
            found = replaced.select(
                F.col("node").alias("_key"), F.col("_merge").alias("_m"), F.col("_size").alias("_s")
            )
            keyed = df.withColumn("_key", key + F.col(end))
            return (
                skew_join(keyed, found, ["_key"], total=n_nodes, how="left")
                .withColumn(end, F.coalesce("_m", end))
                .withColumn(f"{end}_size", F.coalesce("_s", f"{end}_size"))
                .drop("_key", "_m", "_s")
            )

        edges = cut(lower.unionByName(contract(contract(upper, "u"), "v").select(*lower.columns)))
    # At most merges_per_task edges per part.
    parts = edges.withColumn("part", F.floor(F.col("rank") / width))
    return cut(parts.groupBy("part").applyInPandas(_merge_interval(n_nodes), _MERGE_SCHEMA))


def _condensed_clusters(
    merges: DataFrame, leaves: DataFrame, min_cluster_size: int
) -> tuple[DataFrame, DataFrame]:
    """Candidate clusters, and the cluster each leaf falls out of.

    Returns ``(cluster, parent, stability)``, the root having a null parent,
    and ``(node, cluster)`` with a null cluster where everything is small.
    """
    m = min_cluster_size
    density = 1.0 / F.greatest(F.col("weight"), F.lit(LEAST_DISTANCE))
    inner = merges.select(
        F.col("parent").alias("node"),
        (F.col("left_size") + F.col("right_size")).alias("size"),
        density.alias("density"),
        F.when(
            (F.col("left_size") >= m) == (F.col("right_size") >= m),
            F.col("left_size") + F.col("right_size"),
        ).otherwise(F.least("left_size", "right_size")).alias("leaving"),
    )
    leaf = leaves.select(
        "node", "size", (1.0 / F.greatest(F.col("core"), F.lit(LEAST_DISTANCE))).alias("density"),
        F.col("size").alias("leaving"),
    )
    up = merges.select(
        "parent",
        density.alias("parent_density"),
        (F.col("left_size") + F.col("right_size")).alias("parent_size"),
        F.inline(
            F.array(
                F.struct(F.col("left").alias("node"), F.col("right_size").alias("sibling_size")),
                F.struct(F.col("right").alias("node"), F.col("left_size").alias("sibling_size")),
            )
        ),
    )
    nodes = cut(inner.unionByName(leaf).join(up, "node", "left"))
    is_big, is_root = F.col("size") >= m, F.col("parent").isNull()

    # A big node goes on as the cluster of its parent unless its sibling is big.
    starts = is_root | (F.col("sibling_size") >= m)
    big = nodes.where(is_big)
    top = cut(
        follow(
            big.select(
                "node", F.when(starts, F.col("node")).otherwise(F.col("parent")).alias("ptr"),
                starts.alias("done"),
            )
        )
    )
    # Everything else leaves with the first big node above it.
    climb = follow(
        nodes.select(
            "node",
            F.when(is_big | is_root, F.col("node")).otherwise(F.col("parent")).alias("ptr"),
            (is_big | is_root).alias("done"),
        )
    )
    cluster_of = top.select("node", F.col("root").alias("cluster"))
    leaving = (
        big.select("node", "leaving", "density").join(cluster_of, "node")
        .groupBy("cluster").agg(F.sum(F.col("leaving") * F.col("density")).alias("_left"))
    )
    born = big.where(starts).select(
        F.col("node").alias("cluster"),
        "size",
        F.col("parent").alias("_at"),
        F.coalesce("parent_density", F.lit(0.0)).alias("_birth"),
    )
    clusters = (
        born.join(leaving, "cluster")
        .join(cluster_of.select(F.col("node").alias("_at"), F.col("cluster").alias("parent")), "_at", "left")
        .select(
            "cluster", "parent", "size",
            (F.col("_left") - F.col("_birth") * F.col("size")).alias("stability"),
        )
    )
    exits = (
        leaves.select("node").join(climb, "node")
        .join(cluster_of.withColumnRenamed("node", "root"), "root", "left")
        .select("node", "cluster")
    )
    return cut(clusters), exits


def _cluster_values(clusters: DataFrame) -> DataFrame:
    """Add ``below``, the values of the children, and ``value``, the greater of it and ``stability``.

    The tree is contracted by rake and compress. A node whose children are all
    settled is settled itself (rake). A node with one open child has the value
    ``max(a, b + value of the child)``; such functions compose, so chains of these
    nodes are followed by pointer doubling (compress). The rounds are
    logarithmic in the number of clusters, however deep the tree is.
    """
    state = cut(
        clusters.select(
            "cluster", "parent", "stability", F.lit(None).cast("long").alias("ptr"),
            *[F.lit(None).cast("double").alias(c) for c in ("a", "b", "value")],
        )
    )
    is_open = F.col("value").isNull()
    while not state.where(is_open).isEmpty():
        children = (
            state.where("parent is not null")
            .groupBy(F.col("parent").alias("cluster"))
            .agg(
                F.count(F.when(is_open, 1)).alias("_open"),
                F.max(F.when(is_open, F.col("cluster"))).alias("_child"),
                F.sum("value").alias("_below"),
            )
        )
        target = state.select(
            F.col("cluster").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("a").alias("_a"),
            F.col("b").alias("_b"), F.col("value").alias("_value"),
        )
        open_, below = F.coalesce("_open", F.lit(0)), F.coalesce("_below", F.lit(0.0))
        plain, one, jumps = F.col("ptr").isNull(), open_ == 1, F.col("_ptr").isNotNull()
        # Joined before a pointer is set, so that a node jumps from the next round on.
        state = cut(
            state.where(~is_open).unionByName(
                state.where(is_open)
                .join(children, "cluster", "left")
                .join(target, "ptr", "left")
                .select(
                    "cluster", "parent", "stability",
                    F.when(plain & one, F.col("_child")).otherwise(F.coalesce("_ptr", "ptr")).alias("ptr"),
                    F.when(plain, F.col("stability"))
                    .when(jumps, F.greatest("a", F.col("b") + F.col("_a"))).otherwise(F.col("a")).alias("a"),
                    F.when(plain, below)
                    .when(jumps, F.col("b") + F.col("_b")).otherwise(F.col("b")).alias("b"),
                    F.when(plain & (open_ == 0), F.greatest("stability", below))
                    .when(~plain & F.col("_value").isNotNull(), F.greatest("a", F.col("b") + F.col("_value")))
                    .alias("value"),
                )
            )
        )
    total = state.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("_below"))
    return state.join(total, "cluster", "left").select(
        "cluster", "parent", "stability", "value", F.coalesce("_below", F.lit(0.0)).alias("below")
    )


def _select_clusters(clusters: DataFrame) -> DataFrame:
    """``(cluster, chosen)``: the selected cluster each candidate belongs to.

    From the leaves up, a cluster is preferred to its children unless their
    stabilities sum to more; the root is never chosen. The topmost
    preferred ancestor wins, found by pointer doubling. There are fewer candidates than
    ``2 * points / min_cluster_size``.
    """
    picked = (F.col("below") <= F.col("stability")) & F.col("parent").isNotNull()
    # `chosen` is the topmost preferred cluster from the node up to, but without, `ptr`.
    state = cut(
        _cluster_values(clusters).select(
            "cluster", F.col("parent").alias("ptr"), F.when(picked, F.col("cluster")).alias("chosen")
        )
    )
    while not state.where("ptr is not null").isEmpty():
        above = state.select(F.col("cluster").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("chosen").alias("_above"))
        state = cut(
            state.join(above, "ptr", "left").select(
                "cluster", F.col("_ptr").alias("ptr"), F.coalesce("_above", "chosen").alias("chosen")
            )
        )
    return state.select("cluster", "chosen")


def clusters_of_tree(
    tree: DataFrame,
    leaves: DataFrame,
    n_nodes: int,
    min_cluster_size: int,
    merges_per_task: int = MERGES_PER_TASK,
) -> DataFrame:
    """``(node, cluster)`` for ``leaves (node, size, core)``; noise is -1.

    Clusters are numbered from 0 in the order of their least node.
    """
    merges = dendrogram(tree, leaves.select("node", "size"), n_nodes, merges_per_task)
    clusters, exits = _condensed_clusters(merges, leaves, min_cluster_size)
    if clusters.isEmpty():
        return leaves.select("node", F.lit(NOISE).alias("cluster"))
    chosen = _select_clusters(clusters)
    owned = cut(exits.join(chosen, "cluster", "left").select("node", "chosen"))
    least = owned.where("chosen is not null").groupBy("chosen").agg(F.min("node").alias("_least"))
    numbers = number_rows(least, ["_least"], "_number")
    return owned.join(numbers, "chosen", "left").select(
        "node", F.coalesce(F.col("_number").cast("int"), F.lit(NOISE)).alias("cluster")
    )


def density_clusters(
    vectors: DataFrame,
    min_cluster_size: int = 50,
    min_samples: int = 3,
    key: str = POST_ID,
    column: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    merges_per_task: int = MERGES_PER_TASK,
) -> DataFrame:
    """``(key, cluster)`` by cosine distance; noise is -1."""
    grouped = group_vectors(vectors, key, column)
    blocks = build_blocks(grouped, block_rows)
    cores = cut(node_core_distances(grouped, nearest_nodes(blocks, min_samples), min_samples))
    tree = cut(spanning_tree(grouped, blocks, cores))
    leaves = cut(grouped.groups.select("node", "size").join(cores, "node"))
    labels = cut(clusters_of_tree(tree, leaves, grouped.n_nodes, min_cluster_size, merges_per_task))
    return skew_join(grouped.members, labels, ["node"], grouped.hot).select(key, "cluster")


def mutual_reachability_tree(
    vectors: DataFrame,
    min_samples: int = 3,
    key: str = POST_ID,
    column: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(source, target, weight)``: the spanning tree over all rows.

    Copies of a vector hang on its least id, at the vector's core distance.
    """
    grouped = group_vectors(vectors, key, column)
    blocks = build_blocks(grouped, block_rows)
    cores = cut(node_core_distances(grouped, nearest_nodes(blocks, min_samples), min_samples))
    tree = spanning_tree(grouped, blocks, cores)
    first = cut(grouped.members.groupBy("node").agg(F.min(key).alias("_first")))
    low = first.select(F.col("node").alias("lo"), F.col("_first").alias("source"))
    high = first.select(F.col("node").alias("hi"), F.col("_first").alias("target"))
    between = tree.join(low, "lo").join(high, "hi").select("source", "target", "weight")
    hubs = first.join(cores, "node").select("node", F.col("_first").alias("source"), "core")
    copies = (
        skew_join(grouped.members, hubs, ["node"], grouped.hot)
        .where(F.col(key) != F.col("source"))
        .select("source", F.col(key).alias("target"), F.col("core").alias("weight"))
    )
    return between.unionByName(copies)


def label_platforms(labels: DataFrame, posts: DataFrame, platform: str, key: str = POST_ID) -> DataFrame:
    """``(platform, key, cluster)``: cluster labels with their source column."""
    return posts.select(platform, key).join(labels, key).select(platform, key, "cluster")
