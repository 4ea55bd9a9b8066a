"""Posts per month and their share of a platform's total."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from socialspark.constants import CREATED_AT, MONTHS
from socialspark.functions.timeutil import month_of, parse_ts
from socialspark.sources.readers import read_parquet


def month_counts(
    posts: DataFrame, months: Sequence[str] = MONTHS, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, month, n)`` for every month of the calendar, 0 where none.

    Only ``created_at`` and the grouping columns are read. The months are
    counters of one aggregation, which fills absent months with 0 and sends
    one row per group and map task through the exchange.
    """
    ts = parse_ts(F.col(CREATED_AT))
    dated = posts.select(*by, month_of(ts).alias("_month"))
    per_month = F.array(
        *[
            F.struct(F.lit(m).alias("month"), F.count(F.when(F.col("_month") == m, 1)).alias("n"))
            for m in months
        ]
    )
    return dated.groupBy(*by).agg(per_month.alias("_series")).select(*by, F.inline("_series"))


def month_share(counts: DataFrame, by: Sequence[str] = ("platform",)) -> DataFrame:
    """Add ``share`` (percent of the group's total) and a printable label.

    A group has one row per month, so the window never grows with the data.
    A group without posts has a null share.
    """
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", F.try_divide(F.col("n") * 100.0, total)).withColumn(
        "label", F.format_number(F.col("n"), 0)
    )


_VERSION = ["file", "modified", "size"]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update_month_counts(
    spark: SparkSession, folder: str, state: str, months: Sequence[str] = MONTHS, by: Sequence[str] = ()
) -> DataFrame:
    """``month_counts`` of all Parquet files directly in ``folder``, scanning only those that are new since the last call.

    ``state`` keeps the counts of every version of a file (path, time, size) and a manifest of the versions
    counted. A new file adds its counts, a replaced one has its old counts left out, and so has
    one that is gone. Counts are written before the manifest names them, so a run that
    fails, or two runs at a time, do not count a file twice. All months are kept: the calendar
    may differ from call to call, ``by`` may not. A file replaced while a run reads it counts from the next run on.
    Columns ``by`` that no new file has raise an error, and so does a folder without files.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(
        "path",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("size"),
    )
    version = "file string, modified timestamp, size long, run string"
    manifest = _stored(spark, f"{state}/manifest", version)
    pending = listing.join(manifest, _VERSION, "left_anti")
    paths = [r.path for r in pending.select("path").collect()]
    if not paths and manifest.isEmpty():
        raise ValueError(f"no Parquet files in {folder}")
    if paths:
        run = uuid.uuid4().hex
        new = read_parquet(spark, *paths).select(
            *by, month_of(parse_ts(F.col(CREATED_AT))).alias("month"), "_metadata"
        )
        counts = new.groupBy(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_size").alias("size"),
            *by, "month",
        ).agg(F.count(F.lit(1)).alias("n"))
        counts.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{state}/counts")
        pending.select(*_VERSION, F.lit(run).alias("run")).write.mode("append").parquet(f"{state}/manifest")
        manifest = spark.read.schema(version).parquet(f"{state}/manifest")
    # two runs at a time may both have counted a version
    valid = listing.join(manifest, _VERSION).groupBy(*_VERSION).agg(F.max("run").alias("run"))
    counts = spark.read.parquet(f"{state}/counts").join(valid, [*_VERSION, "run"], "left_semi")
    per_month = F.array(
        *[
            F.struct(
                F.lit(m).alias("month"),
                F.coalesce(F.sum(F.when(F.col("month") == m, F.col("n"))), F.lit(0)).cast("long").alias("n"),
            )
            for m in months
        ]
    )
    return counts.groupBy(*by).agg(per_month.alias("_series")).select(*by, F.inline("_series"))
