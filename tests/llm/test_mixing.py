import math
import random

import numpy as np
import pytest

from socialspark.llm import mixing


def documents(seed=3, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["good"] * 6 + ["poor", "toxic"])
        words = [r.choice("alpha beta gamma delta eps".split()) for _ in range(r.randint(20, 200))]
        if kind == "poor":
            words = [w + "!!" for w in words]
        if kind == "toxic":
            words[:: 10] = ["scum"] * len(words[::10])
        rows.append((i, " ".join(words), kind))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 2], "doc_id long, domain string")
    return docs, labels, {i: k for i, _, k in rows}


def test_targets_are_met(tables):
    docs, labels, truth = tables
    targets = {"good": 0.5, "poor": 0.3, "toxic": 0.2}
    found = mixing.mix(docs, labels, targets).toPandas()
    assert (found["rate"] >= 0).all()
    p = np.array(found["posteriors"].tolist())
    assert np.allclose(p.sum(1), 1)
    named = np.array(["good", "poor", "toxic"])[p.argmax(1)]
    assert (named == found["doc_id"].map(truth)).mean() > 0.97
    given = (p * (found["rate"] * found["n_tokens"]).to_numpy()[:, None]).sum(0)
    assert np.allclose(given / found["n_tokens"].sum(), [0.5, 0.3, 0.2], atol=2e-3)
    assert abs(found["copies"].sum() / found["rate"].sum() - 1) < 0.1


def test_rates_are_those_of_plain_projected_gradient(tables):
    docs, labels, _ = tables
    model = mixing.fit_classifier(docs, labels)
    posteriors = mixing.cut(mixing.domain_posteriors(docs, model))
    rated, reached = mixing.fit_rates(posteriors, model.domains, {"good": 1.0}, steps=7, tolerance=0.0)
    found = rated.toPandas()
    p, n = np.array(found["posteriors"].tolist()), found["n_tokens"].to_numpy(float)
    natural = p.T @ n
    scale = np.maximum(natural, 1e-9 * natural.sum())
    step = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p / np.sqrt(np.outer(scale, scale))).max()
    goal, rate = np.array([natural.sum(), 0, 0]), np.ones(len(n))
    for _ in range(7):
        rate = np.maximum(rate + p @ (step * (goal - p.T @ (n * rate)) / scale), 0)
    assert np.allclose(found["rate"], rate)
    assert np.allclose(list(reached.values()), p.T @ (n * rate))


def test_largest_budget_without_repeats(tables):
    docs, labels, _ = tables
    found = mixing.mix(docs, labels, {"good": 0.98, "poor": 0.015, "toxic": 0.005}, budget=math.inf).toPandas()
    assert found["rate"].max() < 1.01
    good = found[np.array(found["posteriors"].tolist()).argmax(1) == 0]
    assert good["rate"].min() > 0.99 and found["rate"].min() < 0.3


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "scum " * 30_000), (2, "scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "good"), (2, "toxic"), (None, "good"), (3, None)], "doc_id long, domain string")
    found = mixing.mix(docs, labels, {"good": 0.5, "toxic": 0.5}).toPandas()
    assert len(found) == 5 and sorted(found["n_tokens"]) == [0, 0, 1, 2, 30_000] or sorted(found["n_tokens"]) == [0, 0, 1, 2, 30_001]
    none = mixing.mix(docs, labels.limit(0), {"good": 1.0}).toPandas()
    assert (none["rate"] == 1).all()
    assert mixing.mix(docs.limit(0), labels, {"good": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, labels, {"other": 1.0})
