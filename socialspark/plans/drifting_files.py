"""Many delimited or Parquet files whose columns drift, read as one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from socialspark.constants import X_SCHEMAS
from socialspark.operators.schema_drift import harmonize, match_schemas, quote_name, schema_group_counts, schema_table
from socialspark.sources.heads import read_footers, read_headers


def folder_groups(
    spark: SparkSession, folder: str, glob: str = "*.csv.gz", schemas: Mapping[str, Sequence[str]] = X_SCHEMAS
) -> DataFrame:
    """``(schema, n_files, n_errors, files)`` of a folder, by its files' headers."""
    return schema_group_counts(match_schemas(read_headers(spark, folder, glob), schema_table(spark, schemas)))


def harmonize_folder(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str] | T.StructType,
    glob: str | None = None,
    renames: Mapping[str, str] | None = None,
    schemas: Mapping[str, Sequence[str]] = X_SCHEMAS,
    format: str = "csv",
) -> DataFrame:
    """All readable files as one table of ``columns``, with ``file_name`` and ``schema``.

    ``format`` is ``csv`` (``*.csv.gz`` unless a ``glob`` is given) or ``parquet``.
    Files with the same header, in the same order, are read together; Parquet files must agree
    in types, too. Each group is projected to ``columns`` and the groups are united. There are as many
    groups as different headers; the list of files is the only thing that comes
    to the driver. Files without a header are left out, see ``folder_groups``.

    With a ``StructType`` values are cast to its types, and one that cannot be raises an error.
    Otherwise a column with more than one type among Parquet files gets the type that holds
    them all: ``bigint`` for whole numbers, ``double`` for numbers, else ``string``.
    """
    if format not in ("csv", "parquet"):
        raise ValueError(f"format is csv or parquet, not {format}")
    if format == "parquet":
        found = read_footers(spark, folder, glob or "*.parquet")
    else:
        found = read_headers(spark, folder, glob or "*.csv.gz").withColumn("types", F.lit(None).cast("array<string>"))
    matched = match_schemas(found, schema_table(spark, schemas))
    groups: dict[tuple, list[str]] = {}
    for row in matched.where("error is null").select("schema", "columns", "types", "file_name").collect():
        shape = (row["schema"], tuple(row["columns"]), tuple(row["types"] or ()))
        groups.setdefault(shape, []).append(f"{folder}/{row['file_name']}")
    if not groups:
        raise ValueError(f"no readable files in {folder}")
    if format == "parquet" and not isinstance(columns, T.StructType):
        columns = spark.createDataFrame([], _common_types(groups, columns, renames or {})).schema
    parts = []
    for (schema, header, _), paths in sorted(groups.items()):
        if format == "parquet":
            # The files of a group have one schema, so Spark may take it from any of them.
            part = spark.read.option("mergeSchema", "false").parquet(*sorted(paths))
        else:
            kinds = T.StructType([T.StructField(name, T.StringType()) for name in header])
            part = spark.read.option("header", True).option("multiLine", True).schema(kinds).csv(sorted(paths))
        parts.append(_with_file(part, columns, renames).withColumn("schema", F.lit(schema)))
    return reduce(DataFrame.unionByName, parts)


_WHOLE = {"tinyint", "smallint", "int", "bigint"}
_NUMBERS = _WHOLE | {"float", "double"}


def _common_types(
    groups: Mapping[tuple, Sequence[str]], columns: Sequence[str], renames: Mapping[str, str]
) -> str:
    """A type for each of ``columns`` that holds its values in all groups, as the DDL of a schema."""
    kinds: dict[str, set[str]] = {}
    for _, header, types in groups:
        for name, kind in zip(header, types, strict=True):
            kinds.setdefault(renames.get(name, name), set()).add(kind)
    declared = []
    for name in columns:
        have = kinds.get(name, {"string"})
        if len(have) == 1:
            common = next(iter(have))
        else:
            common = "bigint" if have <= _WHOLE else "double" if have <= _NUMBERS else "string"
        declared.append(f"{quote_name(name)} {common}")
    return ", ".join(declared)


def _with_file(part: DataFrame, columns: Sequence[str] | T.StructType, renames: Mapping[str, str] | None) -> DataFrame:
    named = part.select("*", F.col("_metadata.file_name").alias("file_name"))
    if isinstance(columns, T.StructType):
        wanted: Sequence[str] | T.StructType = T.StructType([*columns.fields, T.StructField("file_name", T.StringType())])
    else:
        wanted = [*columns, "file_name"]
    return harmonize(named, wanted, renames)
