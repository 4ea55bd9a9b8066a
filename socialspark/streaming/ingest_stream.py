"""Incremental ingest of landed search pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from socialspark.constants import POST_FIELDS
from socialspark.functions.timeutil import parse_ts
from socialspark.operators.align import new_rows_only
from socialspark.plans.ingest import SEEN_ORDER, first_seen_posts, flat_post_columns
from socialspark.schemas import RAW_POST


def stream_raw_posts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(RAW_POST)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )


def stream_posts_bounded(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """Flat posts, each uri once within ``delay`` of event time.

    State is dropped once the watermark passes, so its size is bounded by the
    rate times the delay. A repeat that arrives later is emitted again; use
    ``start_exact_ingest`` where that matters.
    """
    created = parse_ts(F.coalesce("record.created_at", "record.createdAt"))
    return (
        raw.where(F.length("uri") > 0)
        .withColumn("created_ts", created)
        .withWatermark("created_ts", delay)
        .dropDuplicatesWithinWatermark(["uri"])
        .select(*flat_post_columns())
    )


def start_exact_ingest(
    raw: DataFrame, table: str, checkpoint: str, available_now: bool = True, buckets: int = 64
) -> StreamingQuery:
    """Append posts not yet in the Parquet folder ``table``, exactly once.

    A micro-batch is deduplicated, anti-joined with what is stored and written to
    its own folder, named after the checkpoint and the batch. So a batch repeated
    after a failure overwrites its own folder only, and a query with a new
    checkpoint adds to the table. Posts are stored by a hash of their uri, and a
    batch reads only the buckets its own posts fall into.
    """
    spark = raw.sparkSession
    run_id = "r" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("uri"), F.lit(buckets)).cast("int")
        fresh = first_seen_posts(batch).select(*flat_post_columns()).withColumn("uri_bucket", bucket)
        stored = _stored(spark, table, fresh)
        if stored is not None:
            touched = [row.uri_bucket for row in fresh.select("uri_bucket").distinct().collect()]  # at most buckets
            own = (F.col("run") == run_id) & (F.col("batch_id") == batch_id)
            fresh = new_rows_only(fresh, stored.where(F.col("uri_bucket").isin(touched) & ~own), ["uri"])
        fresh.write.mode("overwrite").option("compression", "zstd").partitionBy("uri_bucket").parquet(
            f"{table}/run={run_id}/batch_id={batch_id}"
        )

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _stored(spark: SparkSession, table: str, like: DataFrame) -> DataFrame | None:
    places = {"run": F.lit(""), "batch_id": F.lit(0).cast("long"), "uri_bucket": F.lit(0)}
    schema = like.drop("uri_bucket").withColumns(places).schema
    try:
        return spark.read.schema(schema).parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _seen_once(order: list[str], fields: list[str], keep_for_ms: int | None) -> StatefulProcessor:
    class SeenOnce(StatefulProcessor):
        """The first row of a key that has not been seen, none afterwards. The state is a flag per key."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._seen = handle.getValueState("seen", "seen boolean", keep_for_ms)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            if self._seen.exists():
                return
            self._seen.update((True,))
            # one row is held at a time; nulls go first, as in a sort
            first = min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in order])
            yield Row(**{f: first[f] for f in fields})

        def close(self) -> None:
            pass

    return SeenOnce()


def posts_seen_once(raw: DataFrame, keep_for_ms: int | None = None) -> DataFrame:
    """A stream of flat posts, each uri once, by state that Spark keeps in its state store.

    A micro-batch reads and writes the flags of its own uris only, whatever has been stored before; repeats within a
    batch give the first keyword, page and place. Without ``keep_for_ms`` flags are kept for ever, so no
    uri comes twice. With it a flag expires that long after its uri was emitted, by processing time, which bounds
    the state; a later repeat is emitted again. Rows without a uri are dropped.
    """
    if keep_for_ms is not None and keep_for_ms <= 0:
        raise ValueError("keep_for_ms must be positive")
    places = [F.col(c).alias(f"_{c}") for c in SEEN_ORDER]
    flat = raw.where(F.length("uri") > 0).select(*places, *flat_post_columns()).select(
        *[f"_{c}" for c in SEEN_ORDER], *POST_FIELDS
    )
    schema = flat.select(*POST_FIELDS).schema
    processor = _seen_once([f"_{c}" for c in SEEN_ORDER], POST_FIELDS, keep_for_ms)
    mode = "None" if keep_for_ms is None else "ProcessingTime"
    return flat.groupBy("uri").transformWithState(processor, schema, "Append", mode)


def start_managed_ingest(
    raw: DataFrame, table: str, checkpoint: str, keep_for_ms: int | None = None, available_now: bool = True
) -> StreamingQuery:
    """Append ``posts_seen_once`` to the Parquet folder ``table``, exactly once, without ever reading it.

    What has been seen lives in the checkpoint, so table and checkpoint belong together: to add to a table
    whose checkpoint is lost use ``start_exact_ingest``. The state is spread over as many tasks as
    ``spark.sql.shuffle.partitions`` said when the checkpoint was made, in RocksDB, off the heap.
    """
    conf = raw.sparkSession.conf
    own = {_STATE_STORE: _ROCKSDB}
    if available_now:
        own[_IDLE_BATCHES] = "false"  # flags that may still expire would keep the query running without input
    before = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        writer = (
            posts_seen_once(raw, keep_for_ms).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("compression", "zstd")
        )
        # the query takes a copy of the settings as it starts
        return (writer.trigger(availableNow=True) if available_now else writer).start(table)
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)
