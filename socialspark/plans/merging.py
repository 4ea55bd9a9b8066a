"""Merging exports: two sheets into one table, monthly author files into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.constants import CREATED_AT, MERGE_COLUMNS, POST_ID
from socialspark.functions.timeutil import format_ts, parse_ts
from socialspark.operators.ranking import first_per_key
from socialspark.sources.readers import read_matching


def merge_sources(
    sources: Sequence[DataFrame],
    columns: Sequence[str] = MERGE_COLUMNS,
    key: str = POST_ID,
    tie_break: Sequence[str] = (CREATED_AT, "url"),
    time_formats: Sequence[str] = (),
) -> DataFrame:
    """Union of exports in order of precedence, first row per key.

    Values become strings but nulls stay null. Rows without a key form one
    group, of which one row is kept.
    """

    def load(df: DataFrame, rank: int) -> DataFrame:
        names = [F.col(f"`{c}`").cast("string").alias(c) for c in columns if c != CREATED_AT]
        time = format_ts(parse_ts(F.col(CREATED_AT), time_formats)).alias(CREATED_AT)
        return df.select(*names, time, F.lit(rank).alias("_source"))

    merged = load(sources[0], 0)
    for rank, df in enumerate(sources[1:], start=1):
        merged = merged.unionByName(load(df, rank))
    order = [F.col("_source"), *[F.col(f"`{c}`").asc_nulls_last() for c in tie_break]]
    return first_per_key(merged, [key], order).select(*[f"`{c}`" for c in columns])


def merge_authors(authors: DataFrame, order: Sequence[str], key: str = "did") -> DataFrame:
    """One row per author. ``order`` names the columns that rank the copies."""
    return first_per_key(authors, [key], [F.col(c).asc_nulls_last() for c in order])


def merge_author_files(
    spark: SparkSession, folder: str, pattern: str, key: str = "did"
) -> DataFrame:
    """Distinct authors of all matching files; the first file name wins."""
    authors = read_matching(spark, folder, pattern)
    content = [c for c in authors.columns if c not in (key, "file_name")]
    return merge_authors(authors, ["file_name", *content], key).drop("file_name")
