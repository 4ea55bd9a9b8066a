"""Readers: post tables, folders of files, raw headers, landed search pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.constants import CLEAN_TEXT, CREATED_AT, POST_ID
from socialspark.functions.predicates import all_present
from socialspark.functions.timeutil import in_month_range, next_month, parse_ts
from socialspark.schemas import RAW_POST
from socialspark.sources.heads import read_footers, read_headers  # noqa: F401


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files or folders; only ``*.parquet`` files of a folder are read.

    Columns are the union over all files; what a file lacks is null.
    """
    return spark.read.option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(*paths)


def select_month(
    posts: DataFrame,
    month: str | None = None,
    columns: Sequence[str] = (POST_ID, CLEAN_TEXT, CREATED_AT),
    text_col: str = CLEAN_TEXT,
) -> DataFrame:
    """Posts with text, reduced to ``columns``, optionally of one month.

    Where the table carries a ``month`` column (see ``writers.write_posts``,
    which partitions by it) the month also prunes partitions.
    """
    kept = posts.where(all_present([text_col]))
    if month is not None:
        if "month" in posts.columns:
            kept = kept.where(F.col("month") == month)
        kept = kept.where(in_month_range(parse_ts(F.col(CREATED_AT)), month, next_month(month)))
    return kept.select(
        *[F.col(c).cast("string").alias(c) if c in (POST_ID, text_col) else F.col(c) for c in columns]
    )


def load_posts(spark: SparkSession, path: str, month: str | None = None, **kwargs) -> DataFrame:
    return select_month(read_parquet(spark, path), month, **kwargs)


def read_matching(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Parquet files of ``folder`` whose name matches a regular expression.

    Adds ``file_name``. Columns are the union over the files. Only the matching
    paths are read; their list is as long as the folder has files. Raises ``ValueError`` when no file matches.
    """
    found = (
        spark.read.format("binaryFile").load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))
        .where(F.col("file_name").rlike(pattern) & F.col("file_name").endswith(".parquet"))
    )
    paths = [row.path for row in found.select("path").collect()]
    if not paths:
        raise ValueError(f"no files matching {pattern} in {folder}")
    return read_parquet(spark, *paths).select("*", F.col("_metadata.file_name").alias("file_name"))


def read_raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Landed search pages, one JSON object per hit, with the declared schema."""
    return spark.read.schema(RAW_POST).json(folder)


def read_embeddings(spark: SparkSession, path: str, platform: str | None = None, month: str | None = None) -> DataFrame:
    """Stored vectors; ``platform`` and ``month`` are partition columns."""
    vectors = spark.read.parquet(path)
    if platform is not None:
        vectors = vectors.where(F.col("platform") == platform)
    if month is not None:
        vectors = vectors.where(F.col("month") == month)
    return vectors
