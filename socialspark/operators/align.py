"""Joins that stand in for alignment by row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def misaligned_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that do not occur exactly once on both sides.

    A union with counters needs one exchange and combines on the map side, so
    a key repeated by mistake millions of times is still one row per task.
    """
    sides = left.select(key, F.lit(1).alias("n_left"), F.lit(0).alias("n_right")).unionByName(
        right.select(key, F.lit(0).alias("n_left"), F.lit(1).alias("n_right"))
    )
    counts = sides.groupBy(key).agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")
    )
    return counts.where((F.col("n_left") != 1) | (F.col("n_right") != 1) | F.col(key).isNull())


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join two tables that must hold the same keys, each once.

    Raises ``ValueError`` when they do not (this runs one job).
    """
    problems = misaligned_keys(left, right, key)
    n_bad, example = problems.agg(F.count(F.lit(1)), F.min(key)).first()
    if n_bad:
        raise ValueError(f"{n_bad} values of {key} are not in both tables once, e.g. {example!r}")
    return left.join(right, key)


def new_rows_only(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``stored`` yet."""
    return batch.join(stored.select(*keys), list(keys), "left_anti")


def compare_embeddings(
    stored: DataFrame,
    recomputed: DataFrame,
    key: str,
    column: str = "embedding",
    rtol: float = 1e-5,
    atol: float = 1e-8,
) -> DataFrame:
    """``(key, matches)``: element-wise ``|a - b| <= atol + rtol * |b|``.

    Vectors of different lengths, or with NaN, do not match.
    """
    both = stored.select(key, F.col(column).alias("_a")).join(
        recomputed.select(key, F.col(column).alias("_b")), key
    )

    def close(a, b):
        a, b = a.cast("double"), b.cast("double")
        return F.coalesce(
            ~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) <= atol + rtol * F.abs(b)), F.lit(False)
        )

    matches = (F.size("_a") == F.size("_b")) & F.forall(
        F.zip_with("_a", "_b", close), lambda ok: ok
    )
    return both.select(key, matches.alias("matches"))
