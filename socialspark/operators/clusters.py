"""k-means, its quality measures, and per-cluster tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.constants import (
    CLEAN_TEXT,
    LABEL_INSTRUCTIONS,
    POST_ID,
    PROMPT_FORMAT,
    PROMPT_POSTS,
    PROMPT_WORDS,
)
from socialspark.functions.text import is_blank
from socialspark.operators.embed import usable
from socialspark.operators.ranking import number_within, top_per_key
from socialspark.session import cut

N_INIT = 20
#: Rows of a mini-batch, and passes without a better mean cost after which a start has settled.
BATCH_SIZE = 2048
PATIENCE = 10
#: Rounds of seeding.
SEED_ROUNDS = 3
#: Rows of a task of a pass at most.
TASK_ROWS = 1 << 15
_ROWS = 4096
#: Distances from rows to centres that a task holds at once, and centres whose sums travel in one row.
_GAPS = 1 << 18
_CENTRES = 16
#: Share of a vector's square that counts as rounding in a squared distance.
_ROUNDING = 1e-13


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _points(column: pa.Array, rows: int = _ROWS) -> Iterator[np.ndarray]:
    """Vectors of an Arrow column as matrices of ``rows`` rows, a few thousand."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    for first in range(0, len(flat), rows):
        yield flat[first : first + rows]


def _squared(gap: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Squared distances from products; what rounding alone may give is none, so that copies of a centre cost nothing."""
    far = gap + square
    return np.where(far > _ROUNDING * square, far, 0.0)


class _Centres:
    """The centres of several models, compared with points in one product."""

    def __init__(self, models: Sequence[np.ndarray]) -> None:
        self.sizes = [len(m) for m in models]
        self.all = np.concatenate(models)
        self.square = (self.all * self.all).sum(axis=1)

    def gaps(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each model the nearest centre of every point, and the squared distance to it."""
        gap = (-2.0 * x) @ self.all.T
        gap += self.square
        square = (x * x).sum(axis=1)
        at, rows = 0, np.arange(len(x))
        for size in self.sizes:
            own = gap[:, at : at + size]
            near = own.argmin(axis=1)
            yield near, _squared(own[rows, near], square)
            at += size


class _Adder:
    """Rows, sums and costs of the centres of several models, for points added a matrix at a time.

    Models of one size are compared with the points in one product and summed in another, a column for each point, so that
    the work between them is done for all of these models at once. Costs are added up by model; a centre's share of them
    follows from its sums.
    """

    def __init__(self, models: Sequence[np.ndarray]) -> None:
        starts = np.cumsum([0, *map(len, models)])
        self.found = np.zeros((starts[-1], 2 + len(models[0][0])))  # rows, sum and cost of each centre
        self.groups = []
        for size in sorted({len(m) for m in models}):
            own = [i for i, m in enumerate(models) if len(m) == size]
            centres = np.concatenate([models[i] for i in own])
            places = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
            self.groups.append((len(own), size, np.column_stack([(centres * centres).sum(axis=1), -2.0 * centres]), places))
        self.at_once = max(64, min(_ROWS, _GAPS // max(n * size for n, size, _, _ in self.groups)))
        self.totals = [np.zeros((len(places), self.found.shape[1])) for *_, places in self.groups]
        self.costs = [np.zeros(n) for n, *_ in self.groups]

    def add(self, x: np.ndarray) -> None:
        square = (x * x).sum(axis=1)
        wide = np.column_stack([np.ones(len(x)), x, square])
        across = np.ascontiguousarray(wide[:, :-1].T)
        for (n, size, centres, _), total, cost in zip(self.groups, self.totals, self.costs, strict=True):
            gap = (centres @ across).reshape(n, size, len(x))
            least = gap.min(axis=1)
            own = (gap == least[:, None, :]).reshape(n * size, len(x)).astype(np.float64)
            sums = own @ wide
            if sums[:, 0].sum() != n * len(x):  # a point as near to a second centre belongs to the first
                near = gap.argmin(axis=1) + size * np.arange(n)[:, None]
                own[:] = 0.0
                own[near, np.arange(len(x))] = 1.0
                sums = own @ wide
            total += sums
            cost += _squared(least, square).sum(axis=1)

    def result(self) -> np.ndarray:
        for (n, size, centres, places), total, cost in zip(self.groups, self.totals, self.costs, strict=True):
            each = np.maximum((centres * total[:, :-1]).sum(axis=1) + total[:, -1], 0.0).reshape(n, size)
            whole = each.sum(axis=1)
            each[whole == 0, 0], whole[whole == 0] = 1.0, 1.0
            self.found[places, :-1] = total[:, :-1]
            self.found[places, -1] = (each * (cost / whole)[:, None]).ravel()
        return self.found


def _sums(rows: DataFrame, models: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One pass: for each model the rows, sums and costs of its centres, which is all that reaches the driver."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast([np.asarray(m) for m in models])  # bounded by starts and centres

    every, dims = sum(len(m) for m in models), len(models[0][0])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = _Adder(sent.value)
        for batch in batches:
            for x in _points(batch.column(0), adder.at_once):
                adder.add(x)
        found = adder.result()
        parts = range(0, len(found), _CENTRES)
        sums = [found[at : at + _CENTRES].tobytes() for at in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(sums, pa.binary())], ["at", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(sums)
                total[at] = total[at] + part if at in total else part
        arrays = [pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["at", "sums"])

    schema = "at long, sums binary"
    found = rows.select("v").mapInArrow(add_up, schema).repartition("at").mapInArrow(merge, schema).collect()  # a row per 16 centres
    sent.unpersist()
    table = np.zeros((every, 2 + dims))
    for at, sums in found:
        table[at : at + _CENTRES] = np.frombuffer(sums).reshape(-1, 2 + dims)
    n, cost, sums = table[:, 0], table[:, -1], table[:, 1:-1]
    cuts = np.cumsum([len(m) for m in models])[:-1]
    return list(zip(np.split(n, cuts), np.split(sums, cuts), np.split(cost, cuts), strict=True))


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted points, each far from those before with high probability."""
    chosen = [int(random.choice(len(points), p=weights / weights.sum()))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chance = far * weights
        total = chance.sum()
        pick = int(random.choice(len(points), p=chance / total)) if total > 0 else int(random.integers(len(points)))
        chosen.append(pick)
        far = np.minimum(far, ((points - points[pick]) ** 2).sum(axis=1))
    return points[chosen]


def seed_centres(rows: DataFrame, ks: Sequence[int], key: str, seed: int, n_init: int) -> dict[tuple[int, int], np.ndarray]:
    """Starting centres ``{(k, start): centres}`` by k-means|| over all rows ``(key, v)``.

    Every start begins with one row and in each of ``SEED_ROUNDS`` rounds draws about ``2 * max(ks)`` more, with
    probabilities in proportion to the squared distance from those drawn before. All starts draw in the same passes. A
    last pass weighs the rows drawn by the rows nearest to them, and tasks reduce them to ``k`` for each ``k`` and start.
    """
    spark, most = rows.sparkSession, 2 * max(ks)
    unit = lambda *with_: F.pmod(F.xxhash64(F.col(key), F.lit(seed), *map(F.lit, with_)), F.lit(1 << 30))
    first = rows.agg(*[F.min_by("v", F.struct(unit(start), F.col(key))).alias(f"s{start}") for start in range(n_init)]).first()
    drawn = [np.array([first[f"s{start}"]]) for start in range(n_init)]
    for turn in range(SEED_ROUNDS):
        costs = np.array([cost.sum() for _, _, cost in _sums(rows, drawn)])
        chance = np.divide(most, costs, out=np.zeros(n_init), where=costs > 0)
        sent = spark.sparkContext.broadcast((drawn, chance))  # bounded by starts, rounds and ks

        def draw(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            models, chance = sent.value
            centres = _Centres(models)
            for batch in batches:
                units = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(models)) / float(1 << 30)
                for at, x in enumerate(_points(batch.column(0))):
                    own = units[at * _ROWS : at * _ROWS + len(x)]
                    for start, (_, far) in enumerate(centres.gaps(x)):
                        some = x[own[:, start] < far * chance[start]]
                        if len(some):
                            vectors = pa.array(list(some), pa.list_(pa.float64()))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), start)), vectors], ["start", "v"])

        units = F.array(*[unit(start, turn + 1) for start in range(n_init)])
        more = rows.select("v", units.alias("units")).mapInArrow(draw, "start long, v array<double>").collect()  # about n_init * most
        for start in range(n_init):
            own = sorted(r["v"] for r in more if r["start"] == start)
            drawn[start] = np.concatenate([drawn[start], own]) if own else drawn[start]
    weights = [n for n, _, _ in _sums(rows, drawn)]
    sent = spark.sparkContext.broadcast((drawn, weights))

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn, weights = sent.value
        for frame in frames:
            for k, start in zip(frame["k"], frame["start"], strict=True):
                random = np.random.Generator(np.random.PCG64([seed, k, start]))
                centres = _plus_plus(drawn[start], weights[start], k, random)
                yield pd.DataFrame({"k": [k], "start": [start], "centres": [centres.ravel()]})

    todo = spark.createDataFrame([(k, start) for k in ks for start in range(n_init)], "k long, start long").repartition("k", "start")
    found = todo.mapInPandas(reduce, "k long, start long, centres array<double>").collect()
    return {(r["k"], r["start"]): np.array(r["centres"]).reshape(r["k"], -1) for r in found}


def fit_kmeans(
    vectors: DataFrame,
    ks: Sequence[int],
    column: str = "embedding",
    key: str = POST_ID,
    seed: int = 42,
    max_iter: int = 200,
    n_init: int = N_INIT,
    tolerance: float = 1e-10,
    method: str = "full",
    batch_size: int = BATCH_SIZE,
    patience: int | None = PATIENCE,
    initial: np.ndarray | None = None,
) -> dict[int, tuple[np.ndarray, float]]:
    """``{k: (centres, inertia)}``: for each ``k`` the best of ``n_init`` k-means fits.

    All fits advance together: one pass over the vectors per iteration serves
    every start of every ``k`` that has not settled. A task adds up its
    own rows per centre; what reaches the driver is a sum per centre.
    Starts are seeded over all rows, see ``seed_centres``; ``initial`` gives the centres of a single start instead.

    ``method="mini-batch"`` lets a pass read one batch of about ``batch_size`` rows only, which a hash of the key
    deals out, the same on every run. A centre moves towards the mean of its rows of the batch by their share in all rows it has
    been given so far. A start has settled when the smoothed cost of its batches has not fallen for ``patience``
    passes (None: after ``max_iter`` passes). The costs that choose the best start are those of all rows.
    """
    if method not in ("full", "mini-batch"):
        raise ValueError(f"unknown method {method}")
    rows = usable(vectors, column).select(key, F.col(column).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        return {k: (np.zeros((0, 0)), 0.0) for k in ks}
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # Equal shares, as many for every core: with the files' own partitions a pass would leave cores idle.
    rows = rows.repartition(cores * -(-n // (cores * TASK_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    starts = 1 if initial is not None else n_init
    centres = {(ks[0], 0): np.asarray(initial, float)} if initial is not None else seed_centres(rows, ks, key, seed, n_init)
    if method == "full":
        costs = _full_batch(rows, centres, max_iter, tolerance)
    else:
        _mini_batch(rows, centres, n, key, seed, max_iter, batch_size, patience)
        every = list(centres)
        costs = {m: float(cost.sum()) for m, (_, _, cost) in zip(every, _sums(rows, [centres[m] for m in every]), strict=True)}
    rows.unpersist()
    best = {k: min(range(starts), key=lambda start: (costs[k, start], start)) for k in ks}
    return {k: (centres[k, start], max(0.0, costs[k, start])) for k, start in best.items()}


def _full_batch(rows: DataFrame, centres: dict[tuple[int, int], np.ndarray], max_iter: int, tolerance: float) -> dict[tuple[int, int], float]:
    """Move the centres to the means of their rows until they rest; the cost of each model."""
    costs: dict[tuple[int, int], float] = {}
    active = list(centres)
    for turn in range(max_iter + 1):
        going = []
        for model, (n, sums, cost) in zip(active, _sums(rows, [centres[m] for m in active]), strict=True):
            old = centres[model]
            costs[model] = float(cost.sum())
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], old)
            if ((new - old) ** 2).sum(axis=1).max() > tolerance and turn < max_iter:
                going.append(model)
                centres[model] = new
        active = going
        if not active:
            break
    return costs


def batch_number(key: str, seed: int, batches: int) -> Column:
    """The mini-batch of a row, by a hash of its key."""
    hashed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), F.lit(batches))


def _mini_batch(
    rows: DataFrame, centres: dict[tuple[int, int], np.ndarray], n: int, key: str, seed: int, max_iter: int, batch_size: int,
    patience: int | None,
) -> None:
    """Move the centres by one batch after the other; each pass reads the folder of its batch."""
    batches = max(1, -(-n // batch_size))
    used = min(batches, max_iter)
    dealt = rows.select("v", batch_number(key, seed, batches).alias("batch")).where(F.col("batch") < used)
    dealt = cut(dealt, by=["batch"])
    alpha = min(1.0, 2.0 * batch_size / (n + 1))
    given = {m: np.zeros(len(c)) for m, c in centres.items()}
    smooth: dict[tuple[int, int], float] = {}
    least, idle = dict.fromkeys(centres, np.inf), dict.fromkeys(centres, 0)
    active = list(centres)
    for turn in range(max_iter):
        found = _sums(dealt.where(F.col("batch") == turn % used).select("v"), [centres[m] for m in active])
        going = []
        for model, (count, sums, cost) in zip(active, found, strict=True):
            given[model] += count
            step = (sums - count[:, None] * centres[model]) / np.maximum(given[model], 1)[:, None]
            centres[model] = centres[model] + step
            if patience is not None and count.sum():
                mean = cost.sum() / count.sum()
                smooth[model] = mean if model not in smooth else (1 - alpha) * smooth[model] + alpha * mean
                idle[model] = 0 if smooth[model] < least[model] else idle[model] + 1
                least[model] = min(least[model], smooth[model])
                if idle[model] >= patience:
                    continue
            going.append(model)
        active = going
        if not active:
            break


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2.0 * x @ centres.T).argmin(axis=1).astype(np.int32)


def kmeans_clusters(
    vectors: DataFrame,
    k: int,
    column: str = "embedding",
    name: str = "cluster",
    seed: int = 42,
    max_iter: int = 200,
    n_init: int = N_INIT,
    key: str = POST_ID,
    method: str = "full",
    batch_size: int = BATCH_SIZE,
    patience: int | None = PATIENCE,
    initial: np.ndarray | None = None,
) -> DataFrame:
    """Add an integer ``cluster``: the best of ``n_init`` k-means fits by cost, see ``fit_kmeans``.

    Rows without a usable vector are left out.
    """
    centres, _ = fit_kmeans(
        vectors, [k], column, key, seed, max_iter, n_init, method=method, batch_size=batch_size, patience=patience, initial=initial
    )[k]

    @F.pandas_udf("int")
    def nearest(column: pd.Series) -> pd.Series:
        return pd.Series(_nearest(_matrix(column), centres) if len(column) else [], dtype="int32")

    return usable(vectors, column).withColumn(name, nearest(F.col(column)))


def sample_order(key: str, seed: int) -> Column:
    """A pseudo-random but repeatable order of rows, taken from their ids."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows without replacement, the same ones on every run.

    Rows are ranked by a hash of their id, so neither partitioning nor row
    order matters. Spark keeps the ``n`` least of every task.
    """
    return df.orderBy(sample_order(key, seed), key).limit(n)


def silhouette_samples(
    vectors: DataFrame,
    labels: Sequence[str] = ("cluster",),
    key: str = POST_ID,
    column: str = "embedding",
    *,
    sample_size: int,
    seed: int = 42,
) -> DataFrame:
    """``(key, labelling, silhouette)`` with Euclidean distance on a sample.

    ``sample_size`` has to be named: rows beyond it are not scored.

    One pass serves several label columns. The sample (``sample_size`` vectors
    at most) goes to every task; each task compares its own rows with it and
    sums distances per cluster, so no pair is ever a row. A row alone in its
    cluster scores 0, as does every row of a one-cluster labelling.
    """
    labels = list(labels)
    sample = hashed_sample(usable(vectors, column).select(key, column, *labels), key, sample_size, seed)
    local = sample.select(column, *labels).toPandas()
    points = np.asarray(local[column].tolist(), dtype=np.float64)
    codes = {}
    for name in labels:
        values, code = np.unique(local[name].to_numpy(), return_inverse=True)
        codes[name] = (values, np.eye(len(values))[code])
    shared = vectors.sparkSession.sparkContext.broadcast((points, codes))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, codes = shared.value
        square = (points * points).sum(axis=1)
        for frame in frames:
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                mine = np.asarray(part[column].tolist(), dtype=np.float64)
                # Differences, not the expanded square: exact for equal vectors.
                rough = (mine * mine).sum(axis=1)[:, None] + square - 2.0 * mine @ points.T
                near = rough < 1e-6
                rows, cols = np.nonzero(near)
                rough[rows, cols] = ((mine[rows] - points[cols]) ** 2).sum(axis=1)
                distance = np.sqrt(np.maximum(rough, 0.0))
                for name in labels:
                    values, member = codes[name]
                    own = np.searchsorted(values, part[name].to_numpy())
                    sizes = member.sum(axis=0)
                    sums = distance @ member
                    at = np.arange(len(part))
                    inside = sums[at, own] / np.maximum(sizes[own] - 1, 1)
                    means = sums / sizes
                    means[at, own] = np.inf
                    other = means.min(axis=1)
                    top = np.maximum(inside, other)
                    scored = (sizes[own] > 1) & np.isfinite(other) & (top > 0)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        value = np.where(scored, (other - inside) / top, 0.0)
                    yield pd.DataFrame({key: part[key].to_numpy(), "labelling": name, "silhouette": value})

    kind = sample.schema[key].dataType.simpleString()
    spread = sample.repartition(F.col(key))
    return spread.mapInPandas(score, f"`{key}` {kind}, labelling string, silhouette double")


def squared_silhouette(vectors: DataFrame, labels: Sequence[str] = ("cluster",), column: str = "embedding") -> DataFrame:
    """``(labelling, n, silhouette)`` with squared Euclidean distance over all rows.

    The mean squared distance to a cluster follows from its count, its sum and its sum of
    squares, so one pass adds these up and a second scores every row. The
    sums, one row per label, go to every task. A row alone in its cluster
    scores 0, as does every row of a one-cluster labelling.
    """
    labels = list(labels)
    rows = usable(vectors, column).select(F.col(column).cast("array<double>").alias("v"), *labels)
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("labelling"), F.col(c).cast("string").alias("label")) for c in labels]))
    sums = (
        rows.select("v", square.alias("square"), each)
        .groupBy("labelling", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("square").alias("squares"), Summarizer.sum(array_to_vector("v")).alias("s"))
        .collect()
    )
    stats = {
        c: (
            {r["label"]: i for i, r in enumerate(own)},
            np.array([r["n"] for r in own], float),
            np.array([r["squares"] for r in own]),
            np.array([r["s"].toArray() for r in own]),
        )
        for c in labels
        if (own := [r for r in sums if r["labelling"] == c])
    }
    sent = vectors.sparkSession.sparkContext.broadcast(stats)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), 2048):
                part = frame.iloc[first : first + 2048]
                x = _matrix(part["v"])
                norm, at = (x * x).sum(axis=1)[:, None], np.arange(len(part))
                for c in labels:
                    place, n, squares, s = sent.value[c]
                    own = part[c].map(lambda label: place[None if label is None or label != label else label]).to_numpy()
                    total = np.maximum(norm * n + squares - 2.0 * x @ s.T, 0.0)
                    inside = total[at, own] / np.maximum(n[own] - 1, 1)
                    means = total / n
                    means[at, own] = np.inf
                    other = means.min(axis=1)
                    top = np.maximum(inside, other)
                    scored = (n[own] > 1) & np.isfinite(other) & (top > 0)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        value = np.where(scored, (other - inside) / top, 0.0)
                    yield pd.DataFrame({"labelling": [c], "n": [len(part)], "total": [value.sum()]})

    texts = rows.select("v", *[F.col(c).cast("string").alias(c) for c in labels])
    parts = texts.mapInPandas(score, "labelling string, n long, total double")
    return parts.groupBy("labelling").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("silhouette"))


def silhouette(
    vectors: DataFrame,
    labels: Sequence[str] = ("cluster",),
    key: str = POST_ID,
    column: str = "embedding",
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``(labelling, n, silhouette)``: over all rows with squared Euclidean distance.

    With ``sample_size`` it is the mean over a sample, with Euclidean distance.
    """
    if sample_size is None:
        return squared_silhouette(vectors, labels, column)
    scores = silhouette_samples(vectors, labels, key, column, sample_size=sample_size, seed=seed)
    return scores.groupBy("labelling").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette"))


def k_sweep(
    vectors: DataFrame,
    k_max: int = 30,
    k_min: int = 2,
    key: str = POST_ID,
    column: str = "embedding",
    seed: int = 42,
    max_iter: int = 200,
    n_init: int = N_INIT,
    sample_size: int | None = None,
    method: str = "full",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``(k, inertia, silhouette)`` for every ``k``, see ``fit_kmeans`` and ``silhouette``."""
    ks = list(range(k_min, k_max + 1))
    fits = fit_kmeans(vectors, ks, column, key, seed, max_iter, n_init, method=method, batch_size=batch_size)
    rows = usable(vectors, column).select(key, F.col(column).cast("array<double>").alias(column))
    names = [f"k{k}" for k in ks]

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _matrix(frame[column])
            yield frame.assign(**{f"k{k}": _nearest(x, fits[k][0]) if len(x) else [] for k in ks})

    kind = rows.schema[key].dataType.simpleString()
    labelled = rows.mapInPandas(label, f"`{key}` {kind}, `{column}` array<double>, " + ", ".join(f"{n} int" for n in names))
    scores = {r["labelling"]: r["silhouette"] for r in silhouette(labelled, names, key, column, sample_size, seed).collect()}
    table = [(k, float(fits[k][1]), scores.get(f"k{k}")) for k in ks]
    return vectors.sparkSession.createDataFrame(table, "k int, inertia double, silhouette double")


def cluster_members(labelled: DataFrame, cluster: str = "cluster", key: str = POST_ID) -> DataFrame:
    """``(cluster, key, position)``: the members of each cluster, numbered by id."""
    return number_within(labelled.select(cluster, key), cluster, [key])


def cluster_member_table(
    labelled: DataFrame, k: int, cluster: str = "cluster", key: str = POST_ID
) -> DataFrame:
    """The wide form: a column per cluster, ids below each other, padded with ``""``.

    Labels outside ``range(k)``, such as the -1 of noise, and null labels share
    the column ``cluster_other``, which is there only if they are.
    """
    inside = F.coalesce(F.col(cluster).between(0, k - 1), F.lit(False))
    named = labelled.select(key, F.when(inside, F.col(cluster)).otherwise(k).alias(cluster))
    members = cut(cluster_members(named, cluster, key))
    others = not members.where(F.col(cluster) == k).isEmpty()
    places = range(k + others)
    wide = members.groupBy("position").pivot(cluster, list(places)).agg(F.first(F.col(key).cast("string")))
    names = [f"cluster_{c}" for c in range(k)] + ["cluster_other"]
    columns = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(names[c]) for c in places]
    return wide.select("position", *columns)


def cluster_samples(
    labelled: DataFrame,
    cluster: str = "cluster",
    key: str = POST_ID,
    text_col: str = CLEAN_TEXT,
    n: int = 10,
    seed: int = 42,
) -> DataFrame:
    """``(cluster, rank, key, text)``: up to ``n`` posts per cluster, repeatable."""
    texts = labelled.where(~is_blank(F.col(text_col)))
    order = [sample_order(key, seed), F.col(key)]
    return top_per_key(texts, [cluster], order, n, rank="rank").select(cluster, "rank", key, text_col)


def cluster_prompts(
    top_words: DataFrame,
    samples: DataFrame,
    cluster: str = "cluster",
    text_col: str = CLEAN_TEXT,
    instructions: str = LABEL_INSTRUCTIONS,
    n_words: int = 30,
    n_posts: int = 10,
    n_chars: int = 280,
) -> DataFrame:
    """``(cluster, prompt)``: text that asks for a label of the cluster.

    Input are ``cluster_top_words`` and ``cluster_samples``: a fixed number of
    rows per cluster, so their lists stay short. In samples the two characters
    backslash and ``n`` become a space.
    """

    def ordered_list(rows: DataFrame, limit: int, text, name: str) -> DataFrame:
        listed = rows.where(F.col("rank") <= limit).groupBy(cluster).agg(
            F.sort_array(F.collect_list(F.struct("rank", text.alias("text")))).alias(name)
        )
        return listed.withColumn(name, F.transform(name, lambda item: item["text"]))

    word = F.concat("word", F.lit("("), F.col("n").cast("string"), F.lit(")"))
    post = F.concat(
        F.lit("- "), F.replace(F.substring(text_col, 1, n_chars), F.lit("\\n"), F.lit(" "))
    )
    listed_words = ordered_list(top_words, n_words, word, "_words")
    listed_posts = ordered_list(samples, n_posts, post, "_posts")
    both = listed_posts.join(listed_words, cluster, "full_outer")
    empty = F.array().cast("array<string>")
    prompt = F.concat(
        F.lit(f"{instructions}\nCluster: "),
        F.col(cluster).cast("string"),
        F.lit(f"\n\n{PROMPT_WORDS}"),
        F.array_join(F.coalesce("_words", empty), ", "),
        F.lit(f"\n\n{PROMPT_POSTS}\n"),
        F.array_join(F.coalesce("_posts", empty), "\n"),
        F.lit(f"\n\n{PROMPT_FORMAT}"),
    )
    return both.select(cluster, prompt.alias("prompt"))
