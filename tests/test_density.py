import numpy as np
import pytest
from pyspark.sql import functions as F

from socialspark.operators import density, neighbours, pointers, projections, vector_blocks
from socialspark.operators.vector_blocks import build_blocks, group_vectors
from tests import density_by_hand as by_hand


def make_points(seed, n=120, dims=6, copies=25):
    """Three groups, scattered noise, many copies of one vector, a zero vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, dims))
    spread = rng.choice([0.05, 0.15], size=3)
    rows = [centres[i % 3] + rng.normal(size=dims) * spread[i % 3] for i in range(n)]
    rows += list(rng.normal(size=(20, dims)))
    rows += [centres[0] * 1.5] * copies + [rows[5]] * 2 + [np.zeros(dims)]
    points = np.array(rows, dtype=np.float32)
    return points[rng.permutation(len(points))]


def as_table(spark, points):
    return spark.createDataFrame(
        [(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<float>"
    ).repartition(3)


@pytest.fixture(scope="module")
def points():
    return make_points(7)


@pytest.fixture(scope="module")
def table(spark, points):
    return as_table(spark, points).cache()


def test_groups_and_blocks_hold_every_row_once(table, points):
    grouped = group_vectors(table, "id")
    assert grouped.n_rows == len(points)
    assert grouped.members.count() == len(points)
    assert grouped.n_nodes == len(np.unique(points, axis=0))
    blocks = build_blocks(grouped, block_rows=16).table
    nodes = [r.node for r in blocks.select(F.explode("nodes").alias("node")).collect()]
    assert sorted(nodes) == list(range(grouped.n_nodes))
    assert blocks.agg(F.max(F.size("nodes"))).first()[0] <= 16


def test_knn_equals_brute_force(table, points):
    k = 4
    got = neighbours.knn_cosine(table, k, key="id", block_rows=16).collect()
    d = by_hand.cosine_matrix(points)
    np.fill_diagonal(d, np.inf)
    want = {}
    for i in range(len(points)):
        order = np.lexsort((np.arange(len(points)), d[i]))[:k]
        want[i] = [round(d[i][j], 9) for j in order]
    found = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        assert r.neighbour != r.id
        assert abs(d[r.id][r.neighbour] - r.distance) < 1e-9
        found.setdefault(r.id, []).append(round(r.distance, 9))
    assert found == want


def test_knn_of_copies_prefers_the_least_ids(spark):
    same = [[1.0, 0.0]] * 5 + [[0.0, 1.0]]
    got = neighbours.knn_cosine(as_table(spark, np.array(same)), 2, key="id").collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        lists.setdefault(r.id, []).append(r.neighbour)
    assert lists == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 1], 4: [0, 1], 5: [0, 1]}


def test_core_distance_equals_brute_force(table, points):
    got = {r.id: r.core for r in neighbours.core_distance(table, 3, key="id", block_rows=16).collect()}
    want = by_hand.core_distances(by_hand.cosine_matrix(points), 3)
    assert len(got) == len(points)
    assert np.allclose([got[i] for i in range(len(points))], want, atol=1e-9)


def test_core_distance_of_few_rows_uses_the_farthest(spark):
    got = neighbours.core_distance(as_table(spark, np.eye(2)), 3, key="id").collect()
    assert {r.id: r.core for r in got} == {0: 1.0, 1: 1.0}


def test_tree_and_clusters_equal_brute_force(table, points):
    tree = density.mutual_reachability_tree(table, 3, key="id", block_rows=16).collect()
    d = by_hand.cosine_matrix(points)
    weights = by_hand.mutual_reachability(d, by_hand.core_distances(d, 3))
    assert len(tree) == len(points) - 1
    got = np.sort([r.weight for r in tree])
    assert np.allclose(got, by_hand.spanning_weights(weights), atol=1e-9)
    for r in tree:
        assert abs(weights[r.source][r.target] - r.weight) < 1e-9

    labels = {
        r.id: r.cluster
        for r in density.density_clusters(table, 10, 3, key="id", block_rows=16).collect()
    }
    edges = [(r.weight, r.source, r.target) for r in tree]
    assert [labels[i] for i in range(len(points))] == list(by_hand.tree_clusters(len(points), edges, 10))
    assert len(set(labels.values())) > 2


def test_condensed_tree_equals_brute_force(spark):
    """Random trees over leaves of different sizes, for several cluster sizes."""
    rng = np.random.default_rng(11)
    sizes = rng.choice([1, 1, 1, 2, 12], size=60)
    core = np.where(sizes > 3, 0.0, 0.01)
    edges = [(float(np.round(rng.random() + 0.05, 6)), int(rng.integers(max(0, i - 9), i)), i) for i in range(1, 60)]
    tree = spark.createDataFrame(edges, "weight double, lo long, hi long")
    leaves = spark.createDataFrame(
        [(i, int(s), float(c)) for i, (s, c) in enumerate(zip(sizes, core))], "node long, size long, core double"
    )
    # The same tree with every copy as a point of its own.
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    points = [(w, int(first[a]), int(first[b])) for w, a, b in edges]
    points += [(float(core[i]), int(first[i]), int(first[i]) + j) for i in range(60) for j in range(1, sizes[i])]
    for m, limit in ((10, 16), (200, 65_536)):
        got = {r.node: r.cluster for r in density.clusters_of_tree(tree, leaves, 60, m, limit).collect()}
        want = by_hand.tree_clusters(int(sizes.sum()), points, m)
        assert [got[i] for i in range(60)] == [want[f] for f in first], m


@pytest.mark.parametrize("limit", [4, 1000])
def test_dendrogram_is_the_same_for_any_interval_size(spark, limit):
    rng = np.random.default_rng(3)
    n = 24
    edges = [(float(rng.integers(1, 9)), int(rng.integers(0, i)), i) for i in range(1, n)]
    tree = spark.createDataFrame(edges, "weight double, lo long, hi long")
    sizes = spark.range(n).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"))
    got = density.dendrogram(tree, sizes, n, limit).orderBy("parent").collect()
    top, size, want = list(range(2 * n)), [1] * n + [0] * n, []

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for rank, (w, a, b) in enumerate(sorted(edges)):
        left, right = sorted((find(a), find(b)))
        top[left] = top[right] = n + rank
        size[n + rank] = size[left] + size[right]
        want.append((n + rank, left, right, size[left], size[right], w))
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_follow_and_forest_components(spark, coalesce):
    # with partitions kept apart, chains leave them and have to be joined
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    chain = spark.createDataFrame(
        [(i, max(i - 1, 0), i == 0) for i in range(50)], "node long, ptr long, done boolean"
    )
    assert {r.root for r in pointers.follow(chain).collect()} == {0}
    edges = spark.createDataFrame([(9, 4), (4, 7), (7, 1), (20, 30), (30, 25)], "u long, v long")
    got = {r.node: r.root for r in pointers.forest_components(edges).collect()}
    assert got == {9: 1, 4: 1, 7: 1, 1: 1, 20: 20, 30: 20, 25: 20}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cores_do_not_depend_on_partitioning_or_block_size(spark, points):
    few = as_table(spark, points[:60])
    runs = [
        sorted(neighbours.core_distance(few.repartition(p), 3, key="id", block_rows=b).collect())
        for p, b in ((1, 1024), (7, 10))
    ]
    assert runs[0] == runs[1]


def _chosen_by_hand(rows):
    """The same selection, one cluster after the other from the leaves up."""
    children, stability, parent = {}, {}, {}
    for cluster, up, value in rows:
        children.setdefault(up, []).append(cluster)
        stability[cluster], parent[cluster] = value, up
    order, stack = [], list(children[None])
    while stack:
        node = stack.pop()
        order.append(node)
        stack += children.get(node, [])
    value, picked = {}, set()
    for node in reversed(order):
        below = sum(value[c] for c in children.get(node, []))
        value[node] = max(stability[node], below)
        if parent[node] is not None and below <= stability[node]:
            picked.add(node)
    chosen = {}
    for node in order:
        above = chosen.get(parent[node])
        chosen[node] = above if above is not None else node if node in picked else None
    return chosen


def _tree(seed, n, deep):
    """``n`` splits of a random or of the newest cluster; whole stabilities, so that ties are exact."""
    rng = np.random.default_rng(seed)
    rows, leaves = [(0, None, 0.0)], [0]
    for _ in range(n):
        at = len(leaves) - 1 if deep else int(rng.integers(len(leaves)))
        up = leaves.pop(at)
        for _ in range(2):
            leaves.append(len(rows))
            rows.append((len(rows), up, float(rng.integers(1, 6 if deep else 12))))
    return rows


@pytest.mark.parametrize("seed, n, deep", [(1, 1, False), (2, 60, False), (3, 300, False), (4, 200, True)])
def test_selected_clusters_equal_the_level_by_level_ones(spark, seed, n, deep):
    rows = _tree(seed, n, deep)
    table = spark.createDataFrame(rows, "cluster long, parent long, stability double")
    got = {r.cluster: r.chosen for r in density._select_clusters(table).collect()}
    assert got == _chosen_by_hand(rows)


def test_a_chain_of_ten_thousand_clusters_takes_few_rounds(spark, monkeypatch):
    rows = _tree(5, 5000, deep=True)
    rounds = []
    real = density.cut
    monkeypatch.setattr(density, "cut", lambda df: rounds.append(1) or real(df))
    table = spark.createDataFrame(rows, "cluster long, parent long, stability double")
    got = {r.cluster: r.chosen for r in density._select_clusters(table).collect()}
    assert len(rows) == 10_001 and got == _chosen_by_hand(rows)
    assert len(rounds) < 40


def test_projections_reach_the_recall_they_measure(spark):
    # a third of all rows in one small region, many small groups, copies and a zero vector
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 16))
    rows = [centres[0] + rng.normal(size=16) * 0.01 for _ in range(600)]
    rows += [centres[i % 100] + rng.normal(size=16) * 0.2 for i in range(1200)] + [centres[3]] * 30 + [np.zeros(16)]
    points = np.array(rows, dtype=np.float32)
    table = as_table(spark, points)
    grouped = group_vectors(table, "id")
    near, reached = projections.near_by_projections(grouped, 3, 0.95, bucket_rows=128)
    assert reached >= 0.95
    exact = {(r.node, r.other): r.distance for r in neighbours.nearest_nodes(build_blocks(grouped), 3).collect()}
    got = {(r.node, r.other): r.distance for r in near.collect()}
    assert len(exact.keys() & got.keys()) >= 0.93 * len(exact)  # over all rows, not the sample alone
    assert all(abs(got[p] - exact[p]) < 1e-9 for p in exact.keys() & got.keys())
    per_node = {}
    for node, other in got:
        assert node != other
        per_node[node] = per_node.get(node, 0) + 1
    assert set(per_node.values()) == {3} and len(per_node) == grouped.n_nodes
    assert projections.near_by_projections(grouped, 3, 1.0, bucket_rows=8, max_tables=4)[0] is None


def test_knn_by_projections_falls_back_and_takes_odd_tables(spark, points, table):
    rows = lambda df: sorted(map(tuple, df.collect()))
    # all rows in one bucket: as exact as the exact search
    assert rows(neighbours.knn_cosine(table, 4, key="id", method="projections")) == rows(neighbours.knn_cosine(table, 4, key="id"))
    assert neighbours.knn_cosine(table.where("false"), 4, key="id", method="projections").count() == 0
    assert neighbours.knn_cosine(table.limit(1), 4, key="id", method="projections").count() == 0
    with pytest.raises(ValueError, match="unknown method"):
        neighbours.knn_cosine(table, method="other", key="id")
    with pytest.raises(ValueError, match="recall"):
        neighbours.knn_cosine(table, method="projections", recall=0, key="id")


def test_a_row_is_answered_once_a_group_of_blocks(spark, monkeypatch):
    """Blocks are compared in a fixed number of groups, so answers and copies of blocks do not grow with the square of the rows."""
    points = np.random.default_rng(23).normal(size=(1200, 24)).astype(np.float32)
    grouped = group_vectors(as_table(spark, points), "id")
    blocks = build_blocks(grouped, block_rows=16)
    assert blocks.table.count() > 3 * vector_blocks.GROUPS
    real, answers = neighbours.top_per_key, []
    monkeypatch.setattr(neighbours, "top_per_key", lambda df, *rest: answers.append(df.count()) or real(df, *rest))
    near = neighbours.nearest_nodes(blocks, 2).collect()
    assert answers[0] <= 2 * grouped.n_nodes * vector_blocks.GROUPS
    d = by_hand.cosine_matrix(points)
    np.fill_diagonal(d, np.inf)
    ids = {r.node: r.id for r in grouped.members.collect()}
    got = {(ids[r.node], ids[r.other]) for r in near}
    assert got == {(i, int(j)) for i in range(len(points)) for j in np.argsort(d[i])[:2]}
