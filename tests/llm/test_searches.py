import math

import numpy as np
import pytest

from socialspark.llm.hamming_search import hamming_search, sign_codes
from socialspark.llm.kmeans_tree import kmeans_tree_search


def vectors(seed=1, n=600, dims=24):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    rows = centres[r.integers(0, 12, n)] + 0.6 * r.normal(size=(n, dims))
    rows[100:160] = rows[100]  # a large group of copies
    rows[200] = 0
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    out[201] = (201, None)
    out[202] = (202, out[202][1][:-1] + [float("nan")])
    out[203] = (203, out[203][1][:-1] + [None])
    out[220] = (220, out[220][1][:-1] + [float("inf")])
    out += [(None, out[1][1]), (5, out[5][1])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, code int").repartition(4)


def fine(rows):
    keep = {i: v for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    return keep


def nearest(keep, k, far):
    out = {}
    for q in (i for i in keep if i % 20 == 0):
        ranked = sorted((far(keep[q], v), i) for i, v in keep.items() if i != q)
        out[q] = ranked[:k]
    return out


def test_hamming_search_is_exact(spark):
    rows = vectors()
    codes = sign_codes(frame(spark, rows))
    found = hamming_search(codes, codes.where("id % 20 = 0"), k=7, block=50).toPandas()
    want = nearest(fine(rows), 7, lambda a, b: int(((np.array(a) > 0) != (np.array(b) > 0)).sum()))
    got = {q: [(d, i) for _, d, i in sorted(zip(g["rank"], g["distance"], g["vec_id"]))] for q, g in found.groupby("query_id")}
    assert got == want


def test_hamming_search_of_few_rows(spark):
    rows = vectors(n=600)[:3]
    codes = sign_codes(frame(spark, rows))
    assert hamming_search(codes, codes.where("id = 0"), k=7).count() == 2
    assert hamming_search(codes.limit(0), codes.limit(0)).count() == 0


def test_tree_search_recall_order_and_ties(spark):
    rows = vectors()
    table = frame(spark, rows)
    found = kmeans_tree_search(table, table.where("vec_id % 20 = 0"), k=7, leaf=20, sample=300).toPandas()
    want = nearest(fine(rows), 7, lambda a, b: -float(np.dot(a, b)))
    hits = 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 8)) and q not in set(g["vec_id"])
        assert list(g["score"]) == sorted(g["score"], reverse=True)
        for i, s in zip(g["vec_id"], g["score"]):
            assert s == pytest.approx(np.dot(fine(rows)[q], fine(rows)[i]), rel=1e-12)
        hits += len(set(g["vec_id"]) & {i for _, i in want[q]})
    assert set(found["query_id"]) == set(want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_tree_search_does_not_broadcast_what_grows_with_the_queries(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(600, 24)))], "vec_id long, embedding array<double>")
    rows.write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    most = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")  # counts per leaf fit in, queries by leaf do not
    try:
        found = kmeans_tree_search(table, table, k=3, leaf=20, sample=300, visits=10_000)
        assert found.count() == 3 * 600
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)


def test_tree_search_of_everything_is_exact(spark):
    rows = vectors(seed=4)
    table = frame(spark, rows)
    found = kmeans_tree_search(table, table.where("vec_id % 20 = 0"), k=7, leaf=20, visits=10_000).toPandas()
    want = nearest(fine(rows), 7, lambda a, b: -float((np.array(a) * np.array(b)).sum()))
    got = {q: list(g.sort_values("rank")["vec_id"]) for q, g in found.groupby("query_id")}
    assert got == {q: [i for _, i in x] for q, x in want.items()}
    assert kmeans_tree_search(table.limit(0), table.limit(0)).count() == 0
    assert kmeans_tree_search(table.where("vec_id < 3"), table.where("vec_id = 0"), k=7).count() == 2


def test_tree_search_fills_all_ranks_from_small_leaves(spark):
    r = np.random.default_rng(6)
    dense = np.array([10.0] + [0.0] * 7) + r.normal(size=(400, 8)) * 0.1
    far = np.array([0.0] * 7 + [-10.0]) + r.normal(size=(3, 8)) * 0.1
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*dense, *far])]
    table = frame(spark, rows)
    found = kmeans_tree_search(table, table, k=20, leaf=40, visits=1).toPandas()
    assert set(found.groupby("query_id")["rank"].max()) == {20}
    assert found["query_id"].nunique() == len(rows)
    few = frame(spark, rows[-6:])
    assert kmeans_tree_search(few, few, k=20, leaf=2, visits=1).count() == 6 * 5


def repeated(seed=6):
    """Ids that many different vectors share, some of them nearest to a query."""
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(300, 8)))]
    for i in (7, 40, 41, 60):
        rows += [(i, [float(x) for x in np.array(rows[20][1]) + 0.01 * r.normal(size=8)]) for _ in range(90)]
    return rows


def nearest_ids(rows, k, far):
    out = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        found = set()
        for own in (v for i, v in rows if i == q):
            best: dict = {}
            for i, v in rows:
                if i != q:
                    best[i] = min(best.get(i, math.inf), far(own, v))
            found.add(tuple(sorted((d, i) for i, d in best.items())[:k]))
        out[q] = found
    return out


def test_an_id_with_many_vectors_is_one_candidate(spark):
    rows = repeated()
    one = [(i, v) for i, v in rows if i % 20 or i in (0, 20)]  # queries with one vector
    table = frame(spark, one)
    found = kmeans_tree_search(table, table.where("vec_id % 20 = 0"), k=6, leaf=20, visits=1000).toPandas()
    want = nearest_ids(one, 6, lambda a, b: -float(np.dot(a, b)))
    for q, part in found.groupby("query_id"):
        got = [i for _, i in sorted(zip(part["rank"], part["vec_id"]))]
        assert got == [i for _, i in next(iter(want[q]))]
    codes = sign_codes(table)
    found = hamming_search(codes, codes.where("id % 20 = 0"), k=6, block=50).toPandas()
    want = nearest_ids(one, 6, lambda a, b: int(((np.array(a) > 0) != (np.array(b) > 0)).sum()))
    for q, part in found.groupby("query_id"):
        got = [(d, i) for _, d, i in sorted(zip(part["rank"], part["distance"], part["vec_id"]))]
        assert got == list(next(iter(want[q])))
