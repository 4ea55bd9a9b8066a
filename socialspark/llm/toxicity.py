"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their first 3 to 6 letters, hashed. A text's score
is the logistic of ``b + sum(w_i) + sum(v_i . v_j)`` over its distinct terms ``i < j``: the products of
the factors let pairs weigh what neither term weighs alone, such as an insult
together with the mention of a group.

The classifier is fitted on about ``sample_docs`` labelled rows, chosen by a hash of their id; of
the hashed terms it uses the ``terms`` that tell the labels apart best by chi-square. One in ``1 / PAIRED`` of them
are terms that do so only together: of the most frequent others among the rows of label 1, those in the pairs of
greatest chi-square. So the model and what
comes to the driver are bounded, and texts of any length are scored by the terms that matter.
A batch hashes the terms of its distinct words together.

Defined results: a null or empty text has no terms and gets the score of the intercept; without labelled
rows of both kinds every score is the share of label 1 among them, 0 if there are none. Ids may be null or
repeat. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.llm.common import words_of
from socialspark.llm.words import Letters, distinct_words, in_chunks, parts_of
from socialspark.session import cut

SAMPLE_DOCS = 20_000
TERMS = 2048
#: Share of the terms that are chosen by pairs.
PAIRED = 1 / 8
BUCKETS = 1 << 20
RANK = 8
EPOCHS = 20
#: Lengths of the first letters that are terms.
FIRSTS = (3, 4, 5, 6)


def word_terms(words: list[str]) -> np.ndarray:
    """Hashed terms of each word in a row: the word, and its first letters; -1 where it has fewer."""
    out = np.full((len(words), 1 + len(FIRSTS)), -1, np.int64)
    for at, part in in_chunks(words):
        letters = Letters(part)
        out[at : at + len(part), 0] = letters.wholes() % np.uint64(BUCKETS)
        for column, k in enumerate(FIRSTS, 1):
            hashes, own = letters.firsts(k)
            out[at + own, column] = hashes % np.uint64(BUCKETS)
    return out


def distinct_terms(lists: pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, term)`` of the distinct terms of each row's words; of the places ``place`` gives them, if any, those from 0 on."""
    words, at, starts = distinct_words(lists)
    terms = word_terms(words)
    if place is not None:
        terms = np.where(terms >= 0, place[terms], -1)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    useful = (terms >= 0).any(axis=1)[at]
    own = terms[at[useful]]
    keys = (rows[useful][:, None] << 32 | own)[own >= 0]
    keys = np.unique(keys)
    return keys >> 32, keys & ((1 << 32) - 1)


@dataclass
class FactorizationMachine:
    """``terms`` are the used buckets; their order is that of ``weights`` and ``factors``."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def places(self) -> np.ndarray:
        """The place of every bucket, -1 for unused ones."""
        out = np.full(BUCKETS, -1, np.int64)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def scores(self, rows: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for ``n`` texts; text ``rows[i]`` has the term at ``used[i]``."""
        z = self.bias + np.bincount(rows, self.weights[used], n)
        for factor in self.factors.T:
            own = factor[used]
            z = z + 0.5 * (np.bincount(rows, own, n) ** 2 - np.bincount(rows, own * own, n))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(
    examples: list[np.ndarray], labels: np.ndarray, terms: int, rank: int = RANK, epochs: int = EPOCHS,
    rate: float = 0.02, decay: float = 1e-4, seed: int = 3,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the logistic loss; both labels weigh the same in total."""
    random = np.random.Generator(np.random.PCG64(seed))
    bias, weights = np.zeros(1), np.zeros(terms)
    factors = random.normal(0, 0.05, (terms, rank))
    share = labels.mean()
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (bias, weights, factors)]
    turn = 0
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for first in range(0, len(order), 256):
            rows = order[first : first + 256]
            x = np.zeros((len(rows), terms))
            for i, r in enumerate(rows):
                x[i, examples[r]] = 1
            sums = x @ factors
            z = bias[0] + x @ weights + 0.5 * (sums * sums - x @ (factors * factors)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[rows]) * importance[rows] / len(rows)
            pull = slope @ x
            gradients = [
                np.array([slope.sum()]),
                pull + decay * weights,
                x.T @ (slope[:, None] * sums) - pull[:, None] * factors + decay * factors,
            ]
            turn += 1
            for value, gradient, (mean, square) in zip((bias, weights, factors), gradients, moments, strict=True):
                mean += 0.1 * (gradient - mean)
                square += 0.001 * (gradient * gradient - square)
                value -= rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    return float(bias[0]), weights, factors


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_docs: int = SAMPLE_DOCS,
    terms: int = TERMS,
) -> FactorizationMachine:
    """Learn from ``labels`` ``(id, label)``, 0 or 1; other labels and null ids are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    total = known.count()
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = F.broadcast(known.where(draw < sample_docs / max(total, 1)))  # bounded by sample_docs

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            rows, found = distinct_terms(batch.column(1))
            starts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(starts, pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["y", "terms"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("y", words_of(F.col("text")).alias("words"))
    examples = cut(rows.mapInArrow(terms_of, "y int, terms array<int>").withColumn("row", F.monotonically_increasing_id()))
    counts = examples.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, ones = counts[0], counts[1] or 0
    if not n or ones in (0, n):
        share = ones / n if n else 0.0
        bias = -60.0 if share == 0 else 60.0
        return FactorizationMachine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, RANK)))
    seen, hit = F.col("n"), F.col("hit")
    told = F.pow(hit * n - seen * ones, 2) / (seen * (n - seen + 1) * float(ones) * (n - ones))
    ranked = cut(
        examples.select("y", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("hit"))
        .where("n >= 3")
    )
    paired = int(terms * PAIRED)
    best = [int(r["term"]) for r in ranked.orderBy(F.desc(told), "term").limit(terms).collect()]
    sure, spare = best[: terms - paired], best[terms - paired :]
    others = ranked.where(~F.col("term").isin(sure)).orderBy(F.desc("hit"), "term").limit(2 * paired).collect()
    candidates = list(dict.fromkeys([*sure, *spare, *(int(r["term"]) for r in others)]))
    used, y = _examples(examples, candidates)
    chosen = sure + _told_by_pairs(used, y, len(candidates), len(sure), candidates, paired) if paired else sure
    place = np.full(len(candidates), -1, np.int64)
    place[[candidates.index(t) for t in chosen]] = np.arange(len(chosen))
    kept = [p[p >= 0] for p in (place[u] for u in used)]
    return FactorizationMachine(np.array(chosen, np.int64), *train(kept, y, len(chosen)))


def _examples(examples: DataFrame, candidates: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The places of the candidates in each labelled row, and the labels; bounded by rows and candidates."""
    place = {t: i for i, t in enumerate(candidates)}
    among = F.array(*[F.lit(t) for t in candidates]) if candidates else F.array().cast("array<int>")
    found = examples.select("row", "y", F.array_intersect("terms", among).alias("terms")).orderBy("row").toArrow()
    used = [np.array([place[t] for t in ts], np.int64) for ts in found["terms"].to_pylist()]
    return used, found["y"].to_numpy()


def _told_by_pairs(used: list[np.ndarray], y: np.ndarray, n: int, sure: int, candidates: list[int], most: int) -> list[int]:
    """Up to ``most`` candidates that are not sure yet, in the order of the best chi-square of a pair they are in."""
    both, hits = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for first in range(0, len(used), 1024):
        x = np.zeros((len(used[first : first + 1024]), n), np.float32)
        for i, own in enumerate(used[first : first + 1024]):
            x[i, own] = 1
        both += x.T @ x
        toxic = x[y[first : first + 1024] == 1]
        hits += toxic.T @ toxic
    rows, ones = len(y), float(y.sum())
    both = np.maximum(both, 1e-9)
    told = (hits * rows - both * ones) ** 2 / (both * (rows - both + 1) * ones * (rows - ones))
    alone = np.diag(told).copy()
    told[(both < 3) | (told < 4 * np.log(max(n * n, 2)))] = 0  # what the best of so many pairs reaches by chance
    gain = told - np.maximum(alone[:, None], alone[None, :])  # what neither term tells by itself
    np.fill_diagonal(gain, 0)
    best = gain.max(axis=1)
    order = np.lexsort((np.arange(n), -np.maximum(best, alone)))
    return [candidates[i] for i in order.tolist() if i >= sure][:most]


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row, whole texts."""
    plain = {"terms": model.terms, "bias": model.bias, "weights": model.weights, "factors": model.factors}
    sent = docs.sparkSession.sparkContext.broadcast(plain)  # bounded, see fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(**sent.value)
        place = machine.places()
        for batch in (part for whole in batches for part in parts_of(whole)):
            scores = machine.scores(*distinct_terms(batch.column(1), place), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    rows = docs.select(id_col, words_of(F.col(text_col)).alias("words"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")
