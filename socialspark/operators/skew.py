"""A join for a side with hot keys and a side that is unique per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_FRACTION = 1 / 200
SALTS = 32


def hot_keys(counts: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """Keys that hold more than ``HOT_FRACTION`` of ``total`` rows.

    Their number cannot exceed ``1 / HOT_FRACTION``, whatever the data.
    """
    return counts.where(F.col(count) > max(1.0, total * HOT_FRACTION)).select(*keys)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None = None,
    total: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join ``left`` with ``right``, which is unique on ``keys``.

    Rows of a hot key are spread over ``SALTS`` tasks by a hash of their other
    columns, and the one right-hand row of that key is repeated for each.
    Without ``hot`` the hot keys are counted, given the ``total`` number of
    rows of ``left``; the count combines before its exchange.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "_n", total)
    # At most 1 / HOT_FRACTION rows, see hot_keys: safe to broadcast.
    flags = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    others = [c for c in left.columns if c not in keys] or keys
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")
    spread = left.join(flags, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(0)
    )
    copies = right.join(flags, keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return spread.drop("_hot").join(copies.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
