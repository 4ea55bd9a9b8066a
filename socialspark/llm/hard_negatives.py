"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Components become whole numbers, ``x = floor(scale * c)``, and scores are exact integer inner products. For each
anchor its positives are the first rows of its own label; for each positive the negatives are the first rows of other
labels whose score lies in a window below the positive's score.

Rows are sorted by label and by their place on a **Hilbert curve** through the dimensions that vary most, and written as Parquet **blocks** of
one label. Each block has a **zone map**, the minimum and maximum of every dimension. By **interval arithmetic**, an anchor ``a`` scores
between ``sum(min(a_i * lo_i, a_i * hi_i))`` and ``sum(max(a_i * lo_i, a_i * hi_i))`` in a block; a block outside all of the
anchor's windows is not read. Both searches run twice over the zone maps:

1. every anchor reads the block with the largest upper bound that may hold results. The last of the ``k`` scores found there is a lower
   limit for the window;
2. every block that still meets one of the anchor's windows is read, and the results of its blocks are merged.

So results are exact whatever the data; where bounds cannot rule blocks out (directions at random in many
dimensions) the anchors, a stated share of the rows, meet all blocks of the labels in question.

Anchors travel in blocks as well. A task takes a block of anchors and at most ``BLOCKS_EACH`` blocks of candidates, one after the
other, and keeps the best of each anchor only. Labels, however large, are many blocks, and copies are told apart by their ids, so
no key is hot.

Defined results: rows with a null label, vector or component, a non-finite component, or a null id take no part, nor do empty vectors and
vectors of another length than the most frequent (of ties the longest). Rows that share an id are rows of their own; an anchor's own row is
never its positive, another row of that id may be. Without rows of the same or of another label there are no results for that anchor. Scores and components have to fit a
long; the run fails otherwise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from socialspark.session import cut

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: The window of negatives, in hundredths of the positive's score.
LEAST, MOST = 80, 100
#: Rows of a block of candidates, and of a block of anchors.
BLOCK = 1024
ANCHORS = 4096
#: Dimensions of the curve, and bits of each.
CURVE_DIMS = 8
CURVE_BITS = 7
ZONES = 512
BLOCKS_EACH = 64
#: Limits of a window that is open.
LOWEST, HIGHEST = -(1 << 62), 1 << 62
_EXACT = float(1 << 53)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (whole numbers below ``2**bits``) on the Hilbert curve, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the largest cubes down
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for i in range(dims):
            place = place << 1 | (x[i] >> bit & 1)
    return place


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """``(id, label, x)`` of the rows that take part."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = cut(
        vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"))
        .where("id is not null and label is not null and vec is not null and size(vec) > 0")
        .where(F.coalesce(fine, F.lit(False)))
        .select("id", "label", F.transform("vec", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))
    )
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows if common is None else rows.where(F.size("x") == common["d"])


def _curve(rows: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The dimensions of the largest variance, with their means and deviations."""
    stats = (
        rows.select(F.posexplode("x").alias("at", "c"))
        .groupBy("at")
        .agg(F.avg(F.col("c").cast("double")).alias("mean"), F.stddev_pop(F.col("c").cast("double")).alias("spread"))
        .orderBy(F.desc("spread"), "at")
        .limit(CURVE_DIMS)
        .collect()
    )
    spread = np.array([r["spread"] for r in stats])
    return [r["at"] for r in stats], np.array([r["mean"] for r in stats]), np.where(spread > 0, spread, 1.0)


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(n, -1)


_BLOCK_SQL = "block long, label long, ids array<bigint>, xs binary, lo array<bigint>, hi array<bigint>"


def _cut_blocks(size: int):
    """Rows sorted by label as blocks of one label and ``size`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, count = None, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, count
            ids, xs = (np.concatenate(x) for x in zip(*held, strict=True))
            columns = [
                pa.array([number], pa.int64()), pa.array([now], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([xs.tobytes()], pa.binary()),
                pa.array([xs.min(axis=0)], pa.list_(pa.int64())), pa.array([xs.max(axis=0)], pa.list_(pa.int64())),
            ]
            number, held, count = number + 1, [], 0
            return pa.RecordBatch.from_arrays(columns, ["block", "label", "ids", "xs", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, xs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _rows_of(batch.column(2))
            at = 0
            while at < len(ids):
                if held and (count == size or labels[at] != now):
                    yield flush()
                now = int(labels[at])
                stop = min(len(ids), at + size - count)
                other = np.flatnonzero(labels[at:stop] != now)
                stop = at + int(other[0]) if len(other) else stop
                held.append((ids[at:stop], xs[at:stop]))
                count += stop - at
                at = stop
        if held:
            yield flush()

    return run


def hilbert_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(id, label, x)`` as blocks of one label in the order of the curve, with their zone maps."""
    dims, mean, spread = _curve(rows)
    half = 1 << (CURVE_BITS - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = (_rows_of(batch.column("x"))[:, dims] - mean) / spread * (half / 4) + half  # four deviations to each side
                places = hilbert_index(np.clip(cells, 0, 2 * half - 1), CURVE_BITS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], [*batch.schema.names, "place"])

    placed = rows.select("id", "label", "x").mapInArrow(place, "id long, label long, x array<bigint>, place long")
    order = ["label", "place", "id"]
    ordered = cut(placed).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.select("id", "label", "x").mapInArrow(_cut_blocks(size), _BLOCK_SQL))


def anchor_blocks(blocks: DataFrame, every: int, size: int = ANCHORS) -> DataFrame:
    """The rows whose id is divisible by ``every`` as blocks ``(g, label, ids, rows, xs)``; ``rows`` are their places among the candidates."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, label, ids, xs in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own = np.flatnonzero(np.array(ids) % every == 0)
                if len(own):
                    x = _matrix(xs, len(ids))[own]
                    columns = [
                        pa.array(np.array(ids)[own]), pa.array(np.full(len(own), label)),
                        pa.array(list(x), pa.list_(pa.int64())), pa.array(np.full(len(own), block)), pa.array(own),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "label", "x", "block", "at"])

    picked = cut(blocks.select("block", "label", "ids", "xs").mapInArrow(pick, "id long, label long, x array<bigint>, block long, at long"))
    order = ["label", "block", "at"]
    ordered = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    # ``x`` carries the place of the row as two more numbers
    carried = ordered.select("id", "label", F.concat("x", F.array("block", "at")).alias("x"))
    return cut(carried.mapInArrow(_cut_blocks(size), _BLOCK_SQL).select(F.col("block").alias("g"), "label", "ids", "xs"))


def products(anchors: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all partial sums are whole numbers below ``2**53``, else as Python numbers."""
    if not len(anchors) or not len(xs):
        return np.zeros((len(anchors), len(xs)), np.int64)
    most = float(np.abs(anchors).max()) * float(np.abs(xs).max()) * xs.shape[1]
    if most < _EXACT:
        return (anchors.astype(float) @ xs.T.astype(float)).astype(np.int64)
    if most < float(1 << 62):
        return anchors @ xs.T
    return (anchors.astype(object) @ xs.T.astype(object)).astype(np.int64)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor in each zone; never too narrow, though computed in doubles."""
    up, down = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    lo, hi = lo.T.astype(float), hi.T.astype(float)
    least, most = up @ lo + down @ hi, up @ hi + down @ lo
    margin = 0.0
    if anchors.size and lo.size:
        size = float(np.abs(anchors).max()) * float(max(np.abs(lo).max(), np.abs(hi).max())) * anchors.shape[1]
        margin = size * 1e-12 if size >= _EXACT else 0.0
    return least - margin, most + margin


def _needed(asked: DataFrame, zones: DataFrame, same: bool, probe: bool) -> DataFrame:
    """``(g, block, at)``: the blocks that the windows of the anchors at ``at`` of a block ``g`` must read.

    With ``probe`` only one for each anchor, that with the largest upper bound.
    ``asked`` holds ``low`` and ``high``, the limits of every window of every anchor in a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, label, ids, xs, low, high, zone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(ids)
                anchors = _matrix(xs, n)[:, :-2]
                low, high = np.array(low, np.int64).reshape(n, -1), np.array(high, np.int64).reshape(n, -1)
                chosen = [z for z in zone if (z["label"] == label) == same]
                if not chosen:
                    continue
                block = np.array([z["block"] for z in chosen])
                least, most = bounds(anchors, np.array([z["lo"] for z in chosen]), np.array([z["hi"] for z in chosen]))
                need = np.zeros(least.shape, bool)
                for w in range(low.shape[1]):
                    need |= (most >= low[:, w : w + 1]) & (least <= high[:, w : w + 1]) & (low <= high)[:, w : w + 1]
                if probe:
                    best = np.where(need, most, -np.inf).argmax(axis=1)
                    at = np.flatnonzero(need.any(axis=1))
                    columns = [pa.array(np.full(len(at), g)), pa.array(block[best[at]]), pa.array(at), pa.array(most[at, best[at]])]
                    yield pa.RecordBatch.from_arrays(columns, ["g", "block", "at", "most"])
                else:
                    used = np.flatnonzero(need.any(axis=0))
                    at = [np.flatnonzero(need[:, z]) for z in used]
                    columns = [pa.array(np.full(len(used), g)), pa.array(block[used]), pa.array(at, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["g", "block", "at"])

    groups = zones.groupBy("z").agg(F.collect_list(F.struct("block", "label", "lo", "hi")).alias("zone"))
    last = zones.agg(F.max("z")).first()[0]
    pairs = asked.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(groups, "z")
    pairs = pairs.select("g", "label", "ids", "xs", "low", "high", "zone")
    if not probe:
        return cut(pairs.mapInArrow(run, "g long, block long, at array<bigint>"))
    each = pairs.mapInArrow(run, "g long, block long, at long, most double")
    best = each.groupBy("g", "at").agg(F.max_by("block", F.struct("most", "block")).alias("block"))
    return cut(best.groupBy("g", "block").agg(F.sort_array(F.collect_list("at")).alias("at")))


_BEST = pa.list_(pa.struct([("far", pa.int64()), ("id", pa.int64())]))


def _read(asked: DataFrame, blocks: DataFrame, needed: DataFrame, same: bool, k: int) -> DataFrame:
    """``(g, at, w, best)``: the first ``k`` of the needed blocks in each window ``w``, as ``(-score, id)``."""
    width = needed.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCKS_EACH).alias("slots"))
    none = F.lit(None).cast("array<bigint>")
    chosen = needed.join(width, "g").withColumn("slot", F.pmod(F.xxhash64("block"), F.col("slots")))
    held = chosen.join(blocks.select("block", "ids", "xs"), "block").select(
        "g", "slot", F.lit(1).alias("kind"), "block", "ids", "xs", "at", none.alias("low"), none.alias("high")
    )
    first = asked.join(width, "g").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).select(
        "g", "slot", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "ids", "xs", none.alias("at"), "low", "high"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(best)
            lists = [[{"far": s, "id": i} for s, i in zip(*(x.tolist() for x in best[key]), strict=True)] for key in keys]
            columns = [
                pa.array([now] * len(keys), pa.int64()), pa.array([a for a, _ in keys], pa.int64()),
                pa.array([w for _, w in keys], pa.int32()), pa.array(lists, _BEST),
            ]
            return pa.RecordBatch.from_arrays(columns, ["g", "at", "w", "best"])

        for batch in batches:
            for row in range(batch.num_rows):
                g, _, kind, block, ids, xs, at, low, high = (c[row] for c in batch.columns)
                ids = ids.values.to_numpy()
                if kind.as_py() == 0:
                    if best:
                        yield flush()
                    now, best, n = g.as_py(), {}, len(ids)
                    anchors = _matrix(xs.as_py(), n)
                    anchors, own = anchors[:, :-2], anchors[:, -2:]
                    lows, highs = (np.array(x.values).reshape(n, -1) for x in (low, high))
                    continue
                block, at = block.as_py(), at.values.to_numpy()
                scores = products(anchors[at], _matrix(xs.as_py(), len(ids)))
                if same:
                    mine = np.flatnonzero(own[at, 0] == block)
                    others = np.ones(scores.shape, bool)
                    others[mine, own[at[mine], 1]] = False
                for w in range(lows.shape[1]):
                    fits = (scores >= lows[at, w, None]) & (scores <= highs[at, w, None])
                    if same:
                        fits &= others
                    rows, columns = np.nonzero(fits)
                    far, found = -scores[rows, columns], ids[columns]
                    edges = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
                    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        a = int(at[rows[first]])
                        near, names = far[first:last], found[first:last]
                        if len(near) > 4 * k:
                            edge = near <= np.partition(near, k - 1)[k - 1]
                            near, names = near[edge], names[edge]
                        if (held := best.get((a, w))) is not None:
                            near, names = np.append(held[0], near), np.append(held[1], names)
                        order = np.lexsort((names, near))[:k]
                        best[a, w] = near[order], names[order]
                        if len(order) == k:
                            lows[a, w] = max(lows[a, w], -near[order[-1]])
        if best:
            yield flush()

    met = first.unionByName(held).repartition("g", "slot").sortWithinPartitions("g", "slot", "kind", "block")
    lists = met.mapInArrow(run, "g long, at long, w int, best array<struct<far:bigint,id:bigint>>")
    return cut(lists.groupBy("g", "at", "w").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")))


def search_windows(asked: DataFrame, blocks: DataFrame, zones: DataFrame, same: bool, k: int) -> DataFrame:
    """``(g, at, w, best)`` for the anchor blocks ``asked``, whose ``low`` and ``high`` hold the windows of each anchor in a row."""
    found = _read(asked, blocks, _needed(asked, zones, same, probe=True), same, k)
    full = found.where(F.size("best") == k).select("g", "at", "w", (-F.element_at("best", -1)["far"]).alias("limit"))
    limits = full.groupBy("g").agg(F.collect_list(F.struct("at", "w", "limit")).alias("limits"))  # bounded by the block of anchors

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = []
            for low, size, limits in zip(*(batch.column(c).to_pylist() for c in ("low", "n", "limits")), strict=True):
                low = np.array(low, np.int64).reshape(size, -1)
                for x in limits or []:
                    low[x["at"], x["w"]] = max(low[x["at"], x["w"]], x["limit"])
                lows.append(low.ravel())
            kept = [batch.column(c) for c in ("g", "label", "ids", "xs", "high")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lows, pa.list_(pa.int64()))], ["g", "label", "ids", "xs", "high", "low"])

    joined = asked.join(limits, "g", "left").withColumn("n", F.size("ids"))
    narrowed = cut(
        joined.mapInArrow(narrow, "g long, label long, ids array<bigint>, xs binary, high array<bigint>, low array<bigint>")
    )
    return _read(narrowed, blocks, _needed(narrowed, zones, same, probe=False), same, k)


def mine(
    vectors: DataFrame,
    label: Column | str = "label",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the anchors, the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = whole_vectors(vectors, id_col, vector_col, label)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    blocks = hilbert_blocks(rows, block)
    anchors = anchor_blocks(blocks, every)
    zones = _zones(blocks)
    open_window = [F.array_repeat(F.lit(v).cast("long"), F.size("ids")).alias(c) for c, v in (("low", LOWEST), ("high", HIGHEST))]
    near = search_windows(anchors.select("*", *open_window), blocks, zones, True, positives)
    pairs = cut(near.select("g", "at", F.posexplode("best").alias("w", "p")).select(
        "g", "at", "w", F.col("p.id").alias("positive_id"), (-F.col("p.far")).alias("positive_score")
    ))
    score = F.col("positive_score").cast("decimal(38,0)")
    windows = pairs.select(
        "g", "at", "w",
        F.ceil(score * least / 100).cast("long").alias("low"), F.floor(score * most / 100).cast("long").alias("high"),
    ).groupBy("g").agg(F.collect_list(F.struct("at", "w", "low", "high")).alias("windows"))  # bounded by the block of anchors

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits: tuple[list, list] = ([], [])
            for size, own in zip(batch.column("n").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                low, high = np.full((size, positives), HIGHEST), np.full((size, positives), LOWEST)  # empty windows
                for x in own:
                    low[x["at"], x["w"]], high[x["at"], x["w"]] = x["low"], x["high"]
                limits[0].append(low.ravel())
                limits[1].append(high.ravel())
            kept = [batch.column(c) for c in ("g", "label", "ids", "xs")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.list_(pa.int64())) for x in limits)], ["g", "label", "ids", "xs", "low", "high"])

    asked = cut(
        anchors.join(windows, "g").withColumn("n", F.size("ids"))
        .mapInArrow(spread, "g long, label long, ids array<bigint>, xs binary, low array<bigint>, high array<bigint>")
    )
    hard = search_windows(asked, blocks, zones, False, negatives)
    names = anchors.select("g", F.posexplode("ids").alias("at", "anchor_id"))
    return (
        hard.select("g", "at", "w", F.posexplode("best").alias("rank", "n"))
        .join(pairs, ["g", "at", "w"])
        .join(names, ["g", "at"])
        .select(
            "anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
            "positive_score", (-F.col("n.far")).alias("negative_score"),
        )
    )


def _zones(blocks: DataFrame) -> DataFrame:
    """The zone maps, in groups ``z`` of about ``ZONES``."""
    groups = -(-blocks.count() // ZONES)
    return cut(blocks.select("block", "label", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("z")))
