import math

import numpy as np
import pytest

from socialspark.llm import hard_negatives
from socialspark.llm.hard_negatives import bounds, hilbert_index, mine, products


def rows_of(seed=1, n=900, dims=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dims))
    points = centres[r.integers(0, 9, n)] + 0.3 * r.normal(size=(n, dims))
    points[300:420] = points[300]  # copies
    labels = np.where(r.random(n) < 0.4, 0, r.integers(0, 5, n))  # a hot label
    out = [(i, [float(c) for c in p], int(k)) for i, (p, k) in enumerate(zip(points, labels))]
    out[1] = (1, None, 0)
    out[2] = (2, out[2][1][:-1] + [None], 0)
    out[3] = (3, out[3][1][:-1] + [math.nan], 0)
    out[4] = (4, out[4][1][:-1] + [-math.inf], 0)
    out[5] = (5, out[5][1], None)
    out[6] = (6, [], 0)
    out[8] = (8, [1.0], 0)
    out[500] = (500, out[300][1], out[500][2])  # an anchor among the copies
    out.append((None, out[20][1], 0))
    out.append((21, out[21][1], out[21][2]))  # a repeated row
    out.append((22, out[23][1], 1))  # an id with another vector
    out.append((200, out[201][1], out[200][2]))  # an anchor's id twice
    return out


def frame(spark, rows):
    data = [(i, v, k, 0, 1) for i, v, k in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, score int, block int").repartition(6)


def by_hand(rows, every=100, positives=5, negatives=5, dims=12):
    kept = [
        (i, np.array([math.floor(256 * c) for c in v], object), k)
        for i, v, k in rows
        if i is not None and k is not None and v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for place, (anchor, x, label) in enumerate(kept):
        if anchor % every:
            continue
        scored = [(-int(x @ y), i, k) for at, (i, y, k) in enumerate(kept) if at != place]
        for far, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            window = sorted(s for s in scored if s[2] != label and 80 * -far <= 100 * -s[0] <= 100 * -far)
            out += [(anchor, positive, r, i, -far, -s) for r, (s, i, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [16, 1024])
def test_as_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ZONES", 8)
    monkeypatch.setattr(hard_negatives, "BLOCKS_EACH", 5)
    rows = rows_of()
    got = mine(frame(spark, rows), block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(got) == by_hand(rows) != []


def test_zone_maps_rule_blocks_out(spark, monkeypatch):
    rows = rows_of(seed=3)
    read = []
    needed = hard_negatives._needed

    def counted(*args, **kwargs):
        out = needed(*args, **kwargs)
        read.append(out.count())
        return out

    monkeypatch.setattr(hard_negatives, "_needed", counted)
    table = frame(spark, rows)
    assert found(mine(table, every=10, block=16)) == by_hand(rows, every=10)
    whole = hard_negatives.hilbert_blocks(hard_negatives.whole_vectors(table, "vec_id", "embedding", table["label"]), 16)
    groups = hard_negatives.anchor_blocks(whole, 10)
    pairs = whole.count() * groups.count()
    assert sum(read[1::2]) < pairs  # each of the two searches reads part of what concerns it


def test_few_rows_one_label_and_none(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.5], 1), (7, [0.9, 2.0], 2)]
    assert found(mine(frame(spark, rows))) == by_hand(rows, dims=2) != []
    assert found(mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)]))) == []
    assert found(mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)]))) == []
    assert found(mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]))) == []
    assert found(mine(frame(spark, rows).limit(0))) == []
    opposite = [(0, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2)]  # negative scores: empty windows
    assert found(mine(frame(spark, opposite))) == by_hand(opposite, dims=2) == []


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i * 10, [float(c) for c in np.floor(r.normal(scale=2e5, size=4))], i % 3) for i in range(60)]
    assert found(mine(frame(spark, rows), block=8)) == by_hand(rows, dims=4) != []


def test_products_are_exact_and_bounds_hold():
    r = np.random.default_rng(2)
    for scale in (100, 1 << 26, 1 << 29):
        a, x = (r.integers(-scale, scale, (n, 6)) for n in (7, 30))
        want = [[int(sum(int(p) * int(q) for p, q in zip(u, v))) for v in x] for u in a]
        assert products(a, x).tolist() == want
        least, most = bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
        assert (least[:, 0] <= np.min(want, axis=1).astype(float)).all() and (most[:, 0] >= np.max(want, axis=1).astype(float)).all()


def test_the_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hilbert_index(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()
