"""Reconciling files whose headers drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from socialspark.constants import X_COMMON_COLUMNS, X_SCHEMAS


def quote_name(name: str) -> str:
    """Backtick-quote a column name such as ``location.1`` or ``Scraping Date``."""
    return "`" + name.replace("`", "``") + "`"


def harmonize(
    df: DataFrame,
    columns: Sequence[str] | T.StructType,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exactly ``columns``, in that order; missing ones are null.

    With a ``StructType`` the columns are also cast to the declared types. A
    projection only: pruned columns are never read.
    """
    df = df.withColumnsRenamed(dict(renames or {}))
    present = set(df.columns)
    if isinstance(columns, T.StructType):
        wanted = [(f.name, f.dataType) for f in columns.fields]
    else:
        wanted = [(name, None) for name in columns]
    selected = []
    for name, kind in wanted:
        if name in present:
            c = F.col(quote_name(name))
            selected.append((c.cast(kind) if kind else c).alias(name))
        else:
            selected.append(F.lit(None).cast(kind or T.StringType()).alias(name))
    return df.select(*selected)


def schema_table(spark: SparkSession, schemas: Mapping[str, Sequence[str]] = X_SCHEMAS) -> DataFrame:
    """The known header shapes as ``(schema, columns)``; one row per shape."""
    return spark.createDataFrame(
        [(name, list(cols)) for name, cols in schemas.items()], "schema string, columns array<string>"
    )


def match_schemas(headers: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``schema`` to ``headers(…, columns)``; ``unknown`` when none is equal.

    Headers are compared as sets: order and repeats do not matter.
    """
    key = F.array_sort(F.array_distinct("columns"))
    shapes = known.select(key.alias("_key"), F.col("schema").alias("_schema"))
    return (
        headers.withColumn("_key", key)
        .join(shapes, "_key", "left")
        .withColumn("schema", F.coalesce("_schema", F.lit("unknown")))
        .drop("_key", "_schema")
    )


def schema_group_counts(matched: DataFrame) -> DataFrame:
    """``(schema, n_files, n_errors, files)``; an entry of ``files`` is a name, so a list is as long as its group."""
    error = F.col("error") if "error" in matched.columns else F.lit(None)
    return matched.groupBy("schema").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count(error).alias("n_errors"),
        F.sort_array(F.collect_list("file_name")).alias("files"),
    )


def schema_columns(known: DataFrame) -> DataFrame:
    """``(schema, column)`` pairs of ``(schema, columns)`` rows."""
    return known.select("schema", F.explode("columns").alias("column"))


def schema_diff(pairs: DataFrame, common: DataFrame | Sequence[str] = X_COMMON_COLUMNS) -> DataFrame:
    """``(column, schemas)``: columns outside the common core and who has them.

    ``pairs`` is ``(schema, column)``; ``schemas`` is a sorted array, at most
    as long as the number of distinct shapes.
    """
    if isinstance(common, DataFrame):
        rest = pairs.join(common.select("column"), "column", "left_anti")
    else:
        rest = pairs.where(~F.col("column").isin(list(common)))
    return rest.groupBy("column").agg(F.array_sort(F.collect_set("schema")).alias("schemas"))
