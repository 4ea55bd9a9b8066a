"""Session set-up and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "socialspark", **conf) -> SparkSession:
    """A session with the settings the library expects.

    Only semantics (UTC, ANSI) and adaptive execution are set here. Memory,
    executors and the initial number of shuffle partitions belong to the
    cluster and can be passed in ``conf`` with dots written as ``__``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Months and formatted timestamps are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Bytes that Spark sends to a Python worker at once, of tables with whole texts. Both sides hold them, once or twice a task.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def use_small_batches(spark: SparkSession) -> SparkSession:
    """Batches of texts are bounded by bytes; a bound that the session sets itself stays."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named in ``spark.checkpoint.dir`` or set on the context, if any."""
    context = spark.sparkContext
    return (
        context.getCheckpointDir()
        or spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
    )


def set_shared_folder(spark: SparkSession, own: Callable[[], str]) -> None:
    """Let ``own`` choose the folder where the session names none.

    Only for sessions whose executors see the driver's folders. A cluster has
    to name one itself: a machine-local folder would vanish with its executor.
    """
    if shared_folder(spark) is None and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(own())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, which the session has to name."""
    folder = shared_folder(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def cut(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder, read it back.

    This ends the lineage like ``checkpoint()`` does and likewise survives the
    loss of executors. Unlike it, the new plan starts without the constraints
    of the old one, which in loops grow from round to round until planning
    takes longer than the work, and readers fetch only the columns they use.
    Tables of one application share a folder named after it. ``by`` names partition columns,
    which come last; a filter on them reads only the folders it needs.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/socialspark-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    if not by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.repartition(*by).write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.select(*[c for c in df.columns if c not in by], *by).schema).parquet(path)
