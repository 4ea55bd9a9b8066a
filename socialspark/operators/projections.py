"""Approximate nearest neighbours from bucketed random projections, with a measured recall.

A table projects every vector on random directions, rounds each projection to a multiple of a width, and sorts the
vectors by these numbers. Runs of equal length of the sorted vectors are the buckets, so a bucket has a
bounded number of vectors however crowded a region is, and a crowded region is told apart by its later
projections. Vectors are compared inside their buckets, one in each table.

The number of tables is not assumed: for a sample of vectors the true neighbours are found by comparing
them with all vectors, and tables are added until the wanted share of these neighbours share a bucket
with their vector. The sample, and the one that sets the widths, have a fixed size; all else covers all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.operators.clusters import hashed_sample
from socialspark.operators.ranking import number_rows, top_per_key
from socialspark.operators.vector_blocks import VectorGroups, cosine_distances, unit
from socialspark.session import cut

QUERIES = 256
WIDTH_ROWS = 4096
TABLES_A_ROUND = 4
MAX_TABLES = 64
BATCH = 1024


def _matrix(column: pd.Series) -> np.ndarray:
    return unit(np.array(column.tolist(), dtype=np.float32))


def _true_neighbours(nodes: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """``(query, other)``: the ``k`` nearest other nodes of each query, against all nodes."""
    asked, ids = _matrix(queries["embedding"]), queries["node"].to_numpy()

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), BATCH):
                part = frame.iloc[first : first + BATCH]
                others = part["node"].to_numpy()
                distances = cosine_distances(asked, _matrix(part["embedding"]))
                distances[ids[:, None] == others[None, :]] = np.inf
                take = min(k, len(others))
                at = np.argsort(distances, axis=1, kind="stable")[:, :take]
                found = np.take_along_axis(distances, at, axis=1).ravel()
                rows = pd.DataFrame({"query": np.repeat(ids, take), "other": others[at.ravel()], "distance": found})
                yield rows[np.isfinite(found)]

    found = nodes.select("node", "embedding").mapInPandas(best, "query long, other long, distance double")
    nearest = top_per_key(found, ["query"], [F.col("distance"), F.col("other")], k)
    return nearest.select("query", "other").toPandas()  # at most QUERIES * k rows


def _tables(nodes: DataFrame, n: int, numbers: list[int], sample: np.ndarray, rows: int, seed: int) -> DataFrame:
    """``(table, bucket, node)``: every node once in each of the tables ``numbers``."""
    levels = 2 + max(1, math.ceil(math.log2(n / rows + 1)))
    projections = {}
    for t in numbers:
        rng = np.random.default_rng([seed, t])
        directions = rng.normal(size=(sample.shape[1], levels))
        widths = np.maximum(2.0 * (sample @ directions).std(axis=0), 1e-9)
        projections[t] = (directions / widths, rng.random(levels))

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            matrix = _matrix(frame["embedding"])
            for t, (directions, offsets) in projections.items():
                places = np.floor(matrix @ directions + offsets).astype(np.int64)
                yield pd.DataFrame({"table": t, "node": frame["node"].to_numpy(), "_signature": list(places)})

    signed = nodes.select("node", "embedding").mapInPandas(sign, "table int, node long, _signature array<long>")
    numbered = number_rows(signed.withColumn("_mix", F.xxhash64("node", "table")), ["table", "_signature", "_mix"], "_index")
    # every table has n rows
    position = F.col("_index") - (F.col("table") - numbers[0]).cast("long") * n
    return cut(numbered.select("table", F.floor(position / rows).cast("long").alias("bucket"), "node"))


def near_by_projections(
    grouped: VectorGroups, k: int, recall: float = 0.95, bucket_rows: int = 1024, max_tables: int = MAX_TABLES, seed: int = 42
) -> tuple[DataFrame | None, float]:
    """``(node, other, other_size, distance)`` as ``nearest_nodes`` gives, and the recall measured.

    The frame is ``None`` if ``max_tables`` do not reach ``recall``, as where distances hardly differ; then
    the exact search is the cheaper one.
    """
    if not 0 < recall <= 1:
        raise ValueError("recall must be above 0 and at most 1")
    nodes, n = grouped.groups, grouped.n_nodes
    if n == 0:
        return nodes.sparkSession.createDataFrame([], "node long, other long, other_size long, distance double"), 1.0
    queries = hashed_sample(nodes.select("node", "embedding"), "node", QUERIES).toPandas()
    truth = _true_neighbours(nodes, queries, k)
    sample = _matrix(hashed_sample(nodes.select("node", "embedding"), "node", WIDTH_ROWS, seed=seed + 1).toPandas()["embedding"])
    wanted = nodes.sparkSession.createDataFrame(
        pd.DataFrame({"node": np.unique(np.concatenate([truth["query"], truth["other"]])).astype(np.int64)}), "node long"
    )
    covered, tables, reached = np.zeros(len(truth), dtype=bool), [], 0.0
    while reached < recall:
        first = len(tables) * TABLES_A_ROUND
        if first >= max_tables:
            return None, reached
        numbers = list(range(first, min(first + TABLES_A_ROUND, max_tables)))
        table = _tables(nodes, n, numbers, sample, bucket_rows, seed)
        tables.append(table)
        # at most QUERIES * (k + 1) nodes
        places = table.join(F.broadcast(wanted), "node").toPandas().pivot(index="node", columns="table", values="bucket")
        if len(truth):
            covered |= (places.loc[truth["query"]].to_numpy() == places.loc[truth["other"]].to_numpy()).any(axis=1)
        reached = float(covered.mean()) if len(truth) else 1.0

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, matrix = frame["node"].to_numpy(), frame["size"].to_numpy(), _matrix(frame["embedding"])
        distances = cosine_distances(matrix, matrix)
        np.fill_diagonal(distances, np.inf)
        order = np.argsort(ids, kind="stable")
        take = min(k, len(ids) - 1)
        at = order[np.argsort(distances[:, order], axis=1, kind="stable")[:, :take]]
        return pd.DataFrame(
            {
                "node": np.repeat(ids, take),
                "other": ids[at.ravel()],
                "other_size": sizes[at.ravel()],
                "distance": np.take_along_axis(distances, at, axis=1).ravel(),
            }
        )

    placed = tables[0]
    for table in tables[1:]:
        placed = placed.unionByName(table)
    found = placed.join(nodes, "node").groupBy("table", "bucket").applyInPandas(
        compare, "node long, other long, other_size long, distance double"
    )
    pairs = found.groupBy("node", "other").agg(F.min("other_size").alias("other_size"), F.min("distance").alias("distance"))
    return top_per_key(pairs, ["node"], [F.col("distance"), F.col("other")], k), reached
