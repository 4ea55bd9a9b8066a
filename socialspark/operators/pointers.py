"""Pointer doubling and components of forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.operators.skew import skew_join
from socialspark.session import cut


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the chains of one partition as far as they stay inside it."""
    held = list(frames)
    if not held:
        return
    frame = pd.concat(held, ignore_index=True).sort_values("node", ignore_index=True)
    node, ptr, done = (frame[c].to_numpy() for c in ("node", "ptr", "done"))
    here = np.arange(len(node))
    place = np.minimum(np.searchsorted(node, ptr), len(node) - 1)
    place = np.where(done | (node[place] != ptr), here, place)
    while True:
        further = place[place]
        if (further == place).all():
            break
        place = further
    yield pd.DataFrame({"node": node, "ptr": ptr[place], "done": done[place]})


def follow(pointers: DataFrame) -> DataFrame:
    """``(node, root)``: replace every pointer by the end of its chain.

    ``pointers`` is ``(node, ptr, done)`` with long values; a finished row has
    ``done`` and its final ``ptr``, and every unfinished ``ptr`` is a ``node``
    of the table. In each round a partition first follows the chains inside
    it, then one join doubles the steps of the others; so the number of rounds is at most
    the logarithm of the longest chain, and one where adaptive execution
    puts a small table into one partition. Finished rows leave the join, and a
    node that very many rows point to is spread over tasks.
    """
    table = pointers.select("node", "ptr", "done")
    while True:
        table = cut(table.repartition("node").mapInPandas(_contract, "node long, ptr long, done boolean"))
        left = table.where("not done").count()
        if left == 0:
            return table.select("node", F.col("ptr").alias("root"))
        ahead = table.select(
            F.col("node").alias("ptr"), F.col("ptr").alias("_next"), F.col("done").alias("_done")
        )
        moving = skew_join(table.where("not done").drop("done"), ahead, ["ptr"], total=left)
        table = table.where("done").unionByName(
            moving.select("node", F.col("_next").alias("ptr"), F.col("_done").alias("done"))
        )


def forest_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the edges ``(u, v)`` of a forest.

    Every node points to its least neighbour if that is smaller; chains are
    followed to their ends, the ends are joined by the remaining edges, and
    so on until none remain.
    """
    labels, n_edges = None, edges.count()
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        roots = follow(
            least.select(
                F.col("u").alias("node"),
                F.least("u", "m").alias("ptr"),
                (F.col("u") < F.col("m")).alias("done"),
            )
        )
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("_root"))
            moved = skew_join(labels, step, ["root"], total=labels.count(), how="left")
            labels = cut(moved.select("node", F.coalesce("_root", "root").alias("root")))
        to_u = roots.select(F.col("node").alias("u"), F.col("root").alias("_u"))
        to_v = roots.select(F.col("node").alias("v"), F.col("root").alias("_v"))
        ends = skew_join(skew_join(edges, to_u, ["u"], total=n_edges), to_v, ["v"], total=n_edges)
        edges = cut(
            ends.where("_u <> _v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        )
        n_edges = edges.count()
        if n_edges == 0:
            return labels
