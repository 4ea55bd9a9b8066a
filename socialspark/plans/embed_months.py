"""Vectors of every platform and month, as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.constants import CLEAN_TEXT, CREATED_AT, POST_ID
from socialspark.functions.predicates import all_present
from socialspark.functions.timeutil import month_of, parse_ts
from socialspark.operators.embed import embed_texts, usable
from socialspark.sources.writers import write_embeddings


def embed_months(
    posts: DataFrame,
    months: Sequence[str],
    platforms: Sequence[str] | None = None,
    key: str = POST_ID,
    text_col: str = CLEAN_TEXT,
    **encoding,
) -> DataFrame:
    """``(platform, month, key, embedding)`` of posts with text in the given months.

    ``encoding`` goes to ``embed_texts``. Vectors of failed batches are left out.
    """
    dated = posts.withColumn("month", month_of(parse_ts(F.col(CREATED_AT)))).where(F.col("month").isin(list(months)))
    if platforms is not None:
        dated = dated.where(F.col("platform").isin(list(platforms)))
    vectors = embed_texts(
        dated.where(all_present([text_col])), key=key, text_col=text_col, keep=["platform", "month"], **encoding
    )
    return usable(vectors).select("platform", "month", key, "embedding")


def write_embedded_months(posts: DataFrame, path: str, months: Sequence[str], mode: str = "errorifexists", **options) -> None:
    """``embed_months``, one folder per platform and month."""
    write_embeddings(embed_months(posts, months, **options), path, mode)
