"""Operators on sets of events: deduplication, collapse, lateness, the event store, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.events import canonical_hash, checked

IMMUTABLE = ("source_table", "business_key", "source_sequence", "operation", "payload", "schema_version")


class EventIdentityConflict(ValueError):
    """Two contents under one event id."""


def _delivery_order():
    return [
        F.col("ingested_timestamp").asc_nulls_last(),
        F.col("source_sequence").asc(),
        F.col("canonical_event_hash").asc()
    ]


def ranked_deliveries(events: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """events with canonical_event_hash and delivery_rank: 1 is kept, more are duplicates. scope:
    columns within which deliveries count as repeated, besides the event id."""
    rank = Window.partitionBy(*scope, "event_id").orderBy(*_delivery_order())
    return events.withColumn("canonical_event_hash", canonical_hash()).withColumn("delivery_rank", F.row_number().over(rank))


def deduplicate(events: DataFrame, scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    ranked = ranked_deliveries(events, scope)
    return ranked.where("delivery_rank = 1").drop("delivery_rank"), ranked.where("delivery_rank > 1").drop("delivery_rank")


def collapse(
    events: DataFrame, key: str = "business_key", scope: tuple[str, ...] = ("batch_id", "source_table")
) -> DataFrame:
    """events with collapse_rank: the winner of each key (1) has the highest sequence, then event id."""
    order = Window.partitionBy(*scope, key).orderBy(F.desc("source_sequence"), F.desc("event_id"))
    return events.withColumn("collapse_rank", F.row_number().over(order))


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy("source_table", "business_key", "source_sequence")


def high_water_marks(events: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """(source_table, batch_id, batch_max, hwm_before): the highest sequence of earlier batches, 0 at
    first. seed: (source_table, hwm) to start from, as of a snapshot."""
    by_batch = events.groupBy("source_table", "batch_id").agg(F.max("source_sequence").alias("batch_max"))
    before = Window.partitionBy("source_table").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    out = by_batch.withColumn("hwm_before", F.coalesce(F.max("batch_max").over(before), F.lit(0)))
    if seed is not None:
        # a row for each of the four tables
        out = (
            out.join(F.broadcast(seed), "source_table", "left")
            .withColumn("hwm_before", F.greatest("hwm_before", F.coalesce("hwm", F.lit(0))))
            .drop("hwm")
        )
    return out


def late_by_mark(events: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Events at or below their table's mark as of their batch's start (marks above 0 only)."""
    marks = high_water_marks(events) if marks is None else marks
    return (
        events.join(marks, ["source_table", "batch_id"])
        .where("hwm_before > 0 and source_sequence <= hwm_before")
        .drop("batch_max")
    )


def behind_current(store: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Stored events whose sequence is below their key's current one: candidates for replay."""
    now = current.select(F.col(key).alias("business_key"), F.col("_last_source_sequence").alias("curr_seq"))
    return store.join(now, "business_key").where("source_sequence < curr_seq")


def identity_conflicts(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids of events that the store has with another immutable content."""
    old = store.select("event_id", *(F.col(c).alias(f"_{c}") for c in IMMUTABLE))
    differs = ~F.lit(True)
    for c in IMMUTABLE:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return batch.join(old, "event_id").where(differs).select("event_id").distinct()


def to_store(events: DataFrame, seen_at) -> DataFrame:
    """Rows of the event store from unique events; columns that are there already stay."""
    have = set(events.columns)
    out = events if "arrival_batch_id" in have else events.withColumn("arrival_batch_id", F.col("batch_id"))
    for name, value in (
        ("canonical_event_hash", canonical_hash()),
        ("is_late_on_arrival", F.lit(False)),
        ("first_seen_at", seen_at),
        ("last_seen_at", seen_at)
    ):
        if name not in have:
            out = out.withColumn(name, value)
    from tidemark.schemas import STORE

    return out.select(*STORE.names)


def store_upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with rows added; a known event only gets their last_seen_at."""
    new = rows.select("event_id", *(F.col(c).alias(f"_{c}") for c in rows.columns if c != "event_id"))
    both = store.join(new, "event_id", "full_outer")
    pick = [
        F.coalesce("_last_seen_at", "last_seen_at").alias(c)
        if c == "last_seen_at"
        else F.when(F.col("first_seen_at").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
        for c in store.columns
        if c != "event_id"
    ]
    return both.select("event_id", *pick).select(*store.columns)


def store_of(events: DataFrame, seen_at="ingested_timestamp") -> DataFrame:
    """The store that batch after batch of deliveries leaves, in one pass: the first delivery's
    content by batch, and when it was first and last seen."""
    first = Window.partitionBy("event_id").orderBy("batch_id", *_delivery_order())
    every = Window.partitionBy("event_id")
    rows = events.withColumn("canonical_event_hash", canonical_hash()).withColumn("_n", F.row_number().over(first))
    rows = (
        rows.withColumn("first_seen_at", F.min(seen_at).over(every))
        .withColumn("last_seen_at", F.max(seen_at).over(every))
    )
    return to_store(rows.where("_n = 1").drop("_n"), F.col(seen_at))


# Diagnostics


def by_operation(valid: DataFrame) -> DataFrame:
    return valid.groupBy("operation").agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "operation")


def by_source_table(valid: DataFrame) -> DataFrame:
    return (
        valid.groupBy("source_table", "operation")
        .agg(F.count("*").alias("event_count"))
        .orderBy("source_table", "operation")
    )


def sequence_range(valid: DataFrame) -> DataFrame:
    return (
        valid.groupBy("batch_id")
        .agg(
            F.min("source_sequence").alias("min_seq"),
            F.max("source_sequence").alias("max_seq"),
            F.count("*").alias("event_count")
        )
        .orderBy("batch_id")
    )


def update_frequency(valid: DataFrame, k: int = 10) -> DataFrame:
    return (
        valid.where("operation = 'UPDATE'")
        .groupBy("source_table", "business_key")
        .agg(F.count("*").alias("update_count"))
        .orderBy(F.desc("update_count"), "source_table", "business_key")
        .limit(k)
    )


def late_summary(late: DataFrame) -> DataFrame:
    return (
        late.groupBy("source_table", "batch_id")
        .agg(
            F.count("*").alias("late_count"),
            F.min("source_sequence").alias("min_seq"),
            F.max("source_sequence").alias("max_seq")
        )
        .orderBy("source_table", "batch_id")
    )


def by_reason(quarantine: DataFrame) -> DataFrame:
    return (
        quarantine.groupBy("rejection_reason")
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), "rejection_reason")
    )


def batch_metrics(raw: DataFrame) -> DataFrame:
    """(batch_id, source_table, raw, invalid, duplicates, valid_unique): raw is the sum of the rest."""
    rows = ranked_deliveries(
        checked(raw).withColumn("_bad", F.col("rejection_reason") != ""), ("batch_id", "source_table", "_bad")
    )
    return rows.groupBy("batch_id", "source_table").agg(
        F.count("*").alias("raw_events"),
        F.count_if("_bad").alias("invalid_events"),
        F.count_if(~F.col("_bad") & (F.col("delivery_rank") > 1)).alias("duplicate_events"),
        F.count_if(~F.col("_bad") & (F.col("delivery_rank") == 1)).alias("valid_unique_events")
    )


def sequence_collisions(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("source_table", "business_key", "source_sequence")
        .agg(F.count_distinct("event_id").alias("events"))
        .where("events > 1")
    )
