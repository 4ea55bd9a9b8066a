import math
from fractions import Fraction

import numpy as np
import pytest

from socialspark.llm import whitening


def vectors(n=400, dims=20, seed=2):
    r = np.random.default_rng(seed)
    rows = r.normal(size=(n, dims)) @ np.diag(np.linspace(3, 0.3, dims)) @ np.linalg.qr(r.normal(size=(dims, dims)))[0]
    rows[50:180] = rows[50]  # a third are copies of one vector
    rows[:, 3] += 2_000_000.0  # far from the origin
    out = [(i, [float(c) for c in v]) for i, v in enumerate(rows)]
    out[7] = (7, None)
    out[8] = (8, out[8][1][:-1] + [None])
    out[9] = (9, out[9][1][:-1] + [math.nan])
    out[10] = (10, out[10][1][:-1] + [math.inf])
    out[11] = (11, [])
    out[12] = (12, [1.0, 2.0])
    return out + [(None, out[20][1]), (21, out[21][1]), (5, out[22][1])]


def frame(spark, rows):
    data = [(i, v, 0, 1.0) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, n int, whitened double").repartition(5)


def by_hand(rows, dims):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], directions[:, ::-1]


def test_as_by_hand(spark):
    rows = vectors()
    kept, n, sums, values, directions = by_hand(rows, 20)
    found = whitening.whiten(frame(spark, rows)).toPandas()
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == 16 * len(kept) and (found["n"] == n).all()
    assert found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9
    share = values / values.sum()
    for component, part in found.groupby("component"):
        assert part["explained"].to_numpy() == pytest.approx(share[component - 1], rel=1e-9)
    want = {}
    for i, x in kept:
        gaps = [n * c - s for c, s in zip(x, sums)]
        white = np.abs(np.array([g / n for g in gaps]) @ directions[:, :16] / np.sqrt(values[:16]))
        want.setdefault(-1 if i is None else i, []).append((sum(g * g for g in gaps), white))
    for i, part in found.assign(vec_id=found["vec_id"].fillna(-1).astype(int)).groupby("vec_id"):
        assert sorted(part["deviation"].unique()) == sorted({d for d, _ in want[i]})
        for d, white in want[i]:
            own = part[part["deviation"] == d].groupby("component")["whitened"].first().abs()
            assert own.to_numpy() == pytest.approx(white, rel=1e-6, abs=1e-7)


def test_sign_is_the_same_for_all_rows_and_the_covariance_is_the_identity(spark):
    rows = [(i, v) for i, v in vectors(seed=5) if v and len(v) == 20 and None not in v and np.isfinite(v).all()]
    found = whitening.whiten(frame(spark, rows), components=5).toPandas()
    wide = found.dropna(subset="vec_id").drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    fit = np.unique(wide.round(9).to_numpy(), axis=0)
    assert fit.T @ fit / len(fit) == pytest.approx(np.eye(5), abs=0.02)  # fit rows of a shared id aside


def test_flat_directions_few_and_no_rows(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    found = whitening.whiten(frame(spark, flat)).toPandas()
    assert len(found) == 10 and (found["component"] == 1).all() and found["identity_error"][0] < 1e-9
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, flat).limit(0)).count() == 0


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in r.normal(scale=1e8, size=3)]) for i in range(40)] + [(99, [1e300, 0.0, 0.0])]
    kept, n, sums, *_ = by_hand(rows[:40], 3)
    found = whitening.whiten(frame(spark, rows)).toPandas()
    want = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in kept}
    got = {int(i): d for i, d in zip(found["vec_id"], found["deviation"])}
    assert set(got) == set(want) and found["identity_error"][0] < 1e-9
    for i, d in want.items():
        assert (got[i] == d) if d < 1 << 63 else np.isnan(got[i])


def test_many_blocks_in_both_directions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "WIDE", 8)
    monkeypatch.setattr(whitening, "BLOCKS_EACH", 2)
    rows = vectors()
    _, _, _, values, _ = by_hand(rows, 20)
    found = whitening.whiten(frame(spark, rows)).toPandas()
    assert found["identity_error"][0] < 1e-9
    assert found[found["component"] == 16]["explained"].iloc[0] == pytest.approx(values[15] / values.sum(), rel=1e-9)
