"""Mixing documents to target weights of domains that are known by a soft label only.

``fit_classifier`` learns from a labelled table how words, and last two characters of words,
are distributed over domains; ``domain_posteriors`` gives each document the
probability of every domain. ``fit_rates`` then finds a rate per document, not negative,
so that the expected tokens of each domain, ``sum(rate * tokens * posterior)``, match
the targets: projected-gradient least squares that starts from rate 1 and steps against
the residuals of the domains.

A step changes a rate only through the residuals of the domains at that step. So the
rate after any number of steps is a fold over that short list, and each step
is one aggregate over the posteriors, which are written once to the shared folder;
no state per document is kept between steps. All of it is DataFrame functions.

Bounds: the classifier is fitted on about ``sample_docs`` labelled rows, chosen by a hash
of their id, and keeps ``vocabulary`` words and as many endings, so it can be broadcast. Each domain
brings one column to a few sums on the driver.

Defined results: a null or empty text has no tokens, the prior as posteriors, and a rate like others; without
labelled rows there are no domains and every rate is 1; a domain with target 0 is driven
towards rate 0; targets for unknown domains are refused. Ids may be null or repeat, each row
counts by itself. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.session import cut

SAMPLE_DOCS = 20_000
VOCABULARY = 4000
LEAST_COUNT = 10
STEPS = 200
TOLERANCE = 1e-3
SMOOTH = 0.5


@dataclass
class Classifier:
    """Log weights of words and endings per domain, and the log of each domain's share of documents."""

    domains: list[str]
    prior: list[float]
    words: DataFrame | None
    endings: DataFrame | None


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \n\t]+")


def _ending(word: Column) -> Column:
    return F.substring(word, -2, 2)


def _weights(counts: DataFrame, domains: list[str], vocabulary: int) -> DataFrame:
    """``(entry, w0, w1, …)``: log of each domain's share of an entry over the mean share."""
    wide = counts.groupBy("entry").agg(
        *[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    )
    wide = cut(wide)
    places = range(len(domains))
    totals = wide.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in places], F.count(F.lit(1))).first()
    size = totals[len(domains)]
    share = [(F.col(f"n{i}") + SMOOTH) / (totals[i] + SMOOTH * max(size, 1)) for i in places]
    mean = sum(share[1:], share[0]) / len(domains)
    count = sum((F.col(f"n{i}") for i in places[1:]), F.col("n0"))
    scored = wide.where(count >= LEAST_COUNT).select(
        "entry", *[F.log(s / mean).alias(f"w{i}") for i, s in enumerate(share)],
        sum((F.abs(s - mean) for s in share[1:]), F.abs(share[0] - mean)).alias("tells"),
    )
    return cut(scored.orderBy(F.desc("tells"), "entry").limit(vocabulary).drop("tells"))


def fit_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    sample_docs: int = SAMPLE_DOCS,
    vocabulary: int = VOCABULARY,
) -> Classifier:
    """Learn domains from ``labels`` ``(id, domain)``; rows with a null in either are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where(
        "id is not null and domain is not null"
    )
    shares = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains, total = sorted(shares), sum(shares.values())
    if not domains:
        return Classifier([], [], None, None)
    draw = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = F.broadcast(known.where(draw < sample_docs / total))  # bounded by sample_docs
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    words = rows.select("domain", F.explode(_words(F.col("text"))).alias("entry")).where("entry <> ''")
    counts = cut(words.groupBy("domain", "entry").agg(F.count(F.lit(1)).alias("n")))
    ends = counts.groupBy("domain", _ending(F.col("entry")).alias("entry")).agg(F.sum("n").alias("n"))
    prior = [math.log(shares[d] / total) for d in domains]
    return Classifier(domains, prior, _weights(counts, domains, vocabulary), _weights(ends, domains, vocabulary))


def domain_posteriors(
    docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_tokens, posteriors)`` of every row; probabilities in the order of ``model.domains``."""
    # numbered before the words are spread, so that words of a row share the number
    numbered = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = numbered.select(id_col, "_row", F.explode(_words(F.col("_text"))).alias("_word"))
    tokens = F.count_if(F.col("_word") != "").alias("n_tokens")
    if not model.domains:
        found = rows.groupBy("_row", id_col).agg(tokens)
        return found.select(id_col, "n_tokens", F.array().cast("array<double>").alias("posteriors"))
    places = range(len(model.domains))
    ends = model.endings.select(F.col("entry").alias("_end"), *[F.col(f"w{i}").alias(f"e{i}") for i in places])
    joined = (
        rows.withColumn("_end", _ending(F.col("_word")))
        .join(F.broadcast(model.words.withColumnRenamed("entry", "_word")), "_word", "left")
        .join(F.broadcast(ends), "_end", "left")
    )
    sums = joined.groupBy("_row", id_col).agg(
        tokens,
        *[
            (F.coalesce(F.sum(f"w{i}"), F.lit(0.0)) + F.coalesce(F.sum(f"e{i}"), F.lit(0.0)) + model.prior[i]).alias(f"s{i}")
            for i in places
        ],
    )
    scores = F.array(*[f"s{i}" for i in places])
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return sums.select(id_col, "n_tokens", powers.alias("_p")).select(
        id_col,
        "n_tokens",
        F.transform("_p", lambda p: p / F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)).alias("posteriors"),
    )


def _rate(steps: list[list[float]]) -> Column:
    """The rate after ``steps``, each the change per domain, cut off at 0 after every step."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    dot = lambda move: F.aggregate(
        F.zip_with(move, F.col("posteriors"), lambda m, p: m * p), F.lit(0.0), lambda a, x: a + x
    )
    return F.aggregate(moves, F.lit(1.0), lambda rate, move: F.greatest(rate + dot(move), F.lit(0.0)))


def fit_rates(
    posteriors: DataFrame,
    domains: list[str],
    targets: dict[str, float],
    budget: float | None = None,
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, dict[str, float]]:
    """``posteriors`` with a ``rate``, and the tokens each domain is expected to give.

    ``targets`` are weights of the domains. ``budget`` is the number of tokens they share,
    all tokens by default; with ``math.inf`` the domain of the greatest weight keeps all its tokens, and the
    others get their weight relative to it, but no more than they have. The error of a
    domain counts relative to the tokens it has. Steps end when every domain
    is within ``tolerance`` of its target, or after ``steps``.
    """
    if unknown := set(targets) - set(domains):
        raise ValueError(f"no labelled rows for {sorted(unknown)}")
    places = range(len(domains))
    p = [F.element_at("posteriors", i + 1) for i in places]
    tokens = F.col("n_tokens").cast("double")

    def expected(rate: Column) -> np.ndarray:
        row = posteriors.agg(*[F.coalesce(F.sum(tokens * rate * x), F.lit(0.0)) for x in p]).first()
        return np.array(row, float)

    natural = expected(F.lit(1.0)) if domains else np.zeros(0)
    total = natural.sum()
    if not total:
        return posteriors.withColumn("rate", F.lit(1.0)), dict.fromkeys(domains, 0.0)
    weight = np.array([targets.get(d, 0.0) for d in domains], float)
    weight /= weight.sum()
    if budget is None:
        budget = total
    scale = np.maximum(natural, 1e-9 * total)
    goal = weight * (0 if math.isinf(budget) else budget)
    if math.isinf(budget):
        main = int(weight.argmax())
        goal = np.minimum(natural, weight * (natural[main] / weight[main]))
        budget = float(goal.sum())
    moments = posteriors.agg(*[F.sum(tokens * p[i] * p[j]) for i in places for j in places]).first()
    hessian = np.array(moments, float).reshape(len(domains), -1) / np.sqrt(np.outer(scale, scale))
    step = 1.0 / np.linalg.eigvalsh(hessian).max()
    taken: list[list[float]] = []
    reached = natural
    while len(taken) < steps and (np.abs(reached - goal) > tolerance * np.maximum(goal, 1e-3 * budget)).any():
        taken.append(list(step * (goal - reached) / scale))
        reached = expected(_rate(taken))
    return posteriors.withColumn("rate", _rate(taken)), dict(zip(domains, reached.tolist(), strict=True))


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    budget: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
) -> DataFrame:
    """``(id, n_tokens, posteriors, rate, copies)`` of every row.

    ``copies`` is the rate rounded up or down by a hash of the id, so that the mean over documents
    is the rate.
    """
    model = fit_classifier(docs, labels, id_col, text_col, domain_col)
    rated, _ = fit_rates(
        cut(domain_posteriors(docs, model, id_col, text_col)), model.domains, targets if model.domains else {}, budget
    )
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("rate", F.round("rate", 4)).withColumn("copies", F.floor(F.col("rate") + draw).cast("long"))
