"""Writers. Spark creates missing parent folders itself.

The default mode is Spark's ``errorifexists``. A path that is being read must
never be the target: Spark would delete it before reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socialspark.constants import AUTHOR_FIELDS, CREATED_AT, POST_FIELDS
from socialspark.functions.timeutil import month_of, parse_ts


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_posts(posts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Posts partitioned by month, so that a month's load reads that month."""
    write_parquet(posts.withColumn("month", month_of(parse_ts(F.col(CREATED_AT)))), path, ["month"], mode)


def write_csv(
    df: DataFrame, path: str, max_rows_per_file: int | None = None, mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode).option("header", True)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.csv(path)


def write_flat_posts(posts: DataFrame, path: str, **kwargs) -> None:
    write_csv(posts.select(*POST_FIELDS), path, **kwargs)


def write_authors(authors: DataFrame, path: str, **kwargs) -> None:
    write_csv(authors.select(*AUTHOR_FIELDS), path, **kwargs)


def write_embeddings(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vectors with their ids, one folder per platform and month."""
    write_parquet(vectors, path, ["platform", "month"], mode)
