"""Per-key choice of rows and global numbering, without one task per key.

``first_per_key`` and ``top_per_key`` filter a ``row_number`` by a constant.
Spark then places a partial group limit before the exchange, so that each map
task ships at most ``n`` rows of a key: a key that holds a third of all rows
costs no more than any other. Numbering whole groups cannot be limited like
that; ``number_rows`` range-partitions instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from socialspark.operators.skew import hot_keys, skew_join
from socialspark.session import cut


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every key in the given total order."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key. Null keys form one group."""
    return top_per_key(df, keys, order, 1)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add a gap-free 0-based index in ascending order of ``order``.

    One range exchange sorts the rows. Only the row count of each partition is
    summed up centrally, never the rows. The sorted rows are materialised
    before they are counted, so the two passes cannot disagree.
    """
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # One row per partition of the range exchange: safe to broadcast.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_part", "_local", "_offset")
    )


def number_within(df: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position of each row inside its key, however large the key is.

    Rows with a null key are a group, too.
    """
    # a key that joins to itself even where it is null
    numbered = cut(number_rows(df, [key, *order], "_index").withColumn("_group", F.struct(F.col(key))))
    starts = cut(
        numbered.groupBy("_group").agg(F.min("_index").alias("_start"), F.count(F.lit(1)).alias("_n"))
    )
    total = starts.agg(F.sum("_n")).first()[0] or 0
    placed = skew_join(numbered, starts.drop("_n"), ["_group"], hot_keys(starts, ["_group"], "_n", total))
    return placed.withColumn(name, F.col("_index") - F.col("_start")).drop("_index", "_start", "_group")
