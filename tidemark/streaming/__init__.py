"""Change events as a stream: the apply lane for each micro-batch, and rates by event time."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.events import split_valid
from tidemark.operators import events as ops
from tidemark.plans.lanes import Engine
from tidemark.schemas import ENVELOPE
from tidemark.sources.batches import discover


def read_stream(spark: SparkSession, root: str | Path, files_per_trigger: int | None = None) -> DataFrame:
    """Events of a batch folder as its files arrive."""
    reader = (
        spark.readStream.schema(ENVELOPE)
        .option("pathGlobFilter", "{*.jsonl,part-*}")
        .option("recursiveFileLookup", "true")
    )
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(str(root))


def apply_stream(engine: Engine, files_per_trigger: int | None = None) -> StreamingQuery:
    """Apply all events that are there, then stop. The batches of a micro-batch are applied one after the
    other in the order of their folders' numbers, each as the batch lane does it, so that state, ledger
    and checkpoint are the same. A batch is complete once as many of its rows have come as its
    manifest says, or, without one, at once. A micro-batch that Spark runs again after a failure is told
    apart by the ledger, as a batch is; the stream's own checkpoint is beside the lanes'. With
    files_per_trigger a batch's tables may come in several micro-batches, which changes nothing, as an
    event concerns one table; the rows of one file always come together."""
    quarantine = engine.root / "staged" / "stream_quarantine"
    seen: dict[int, int] = {}

    def one(batch: DataFrame, number: int) -> None:
        folder = F.regexp_extract(F.col("_folder"), r"batch_id=0*(\d+)/[^/]*$", 1).try_cast("long")
        rows = batch.withColumn("_folder", F.coalesce(folder, "batch_id")).persist()
        try:
            _, bad = split_valid(rows.drop("_folder"))
            bad.write.mode("overwrite").parquet(str(quarantine / f"micro={number:09d}"))
            known = {b.batch_id: b.manifest or {} for b in discover(engine.cdc)}
            for r in rows.groupBy("_folder").count().orderBy("_folder").collect():  # a row for each batch of the micro-batch
                valid, _ = split_valid(rows.where(F.col("_folder").eqNullSafe(r._folder)).drop("_folder"))
                counts = engine.apply_events(ops.deduplicate(valid, ("source_table",))[0].drop("canonical_event_hash"))
                seen[r._folder] = seen.get(r._folder, 0) + r["count"]
                if r._folder in known and seen[r._folder] >= known[r._folder].get("event_count", 0):
                    engine.reconcile()
                    engine.complete(r._folder, counts)
        finally:
            rows.unpersist()

    stream = read_stream(engine.spark, engine.cdc, files_per_trigger).withColumn("_folder", F.col("_metadata.file_path"))
    return (
        stream.writeStream.foreachBatch(one)
        .option("checkpointLocation", str(engine.root / "state" / "stream"))
        .trigger(availableNow=True)
        .start()
    )


def rates(events: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events by window of event time, table and operation; events later than the delay don't count. Works
    on a stream and on a table."""
    timed = (
        events.withColumn("at", F.col("event_timestamp").try_cast("timestamp"))
        .where("at is not null")
        .withWatermark("at", delay)
    )
    return timed.groupBy(F.window("at", window), "source_table", "operation").agg(F.count("*").alias("event_count"))
