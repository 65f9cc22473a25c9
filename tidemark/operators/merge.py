"""Current state: classification of events against it, the merge, its closed form over all batches,
and its invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators.events import collapse
from tidemark.schemas import KEYS, LEDGER, SNAPSHOT_EVENT, SNAPSHOT_TIME, added_in, payload_schema, state_schema

#: The money column of a table, which must be a decimal.
MONEY = {"subscriptions": "monthly_amount", "invoices": "amount", "payments": "amount"}
APPLIED = ("APPLIED_INSERT", "APPLIED_UPDATE", "APPLIED_DELETE")
SUPERSEDED = "SUPERSEDED_WITHIN_BATCH"


def outcome(found: Column, same: Column, recorded: Column, behind: Column) -> Column:
    """What becomes of a winner, by the first rule that holds."""
    return (
        F.when(found & same & recorded, "ALREADY_APPLIED")
        .when(found & same, "RECOVERED_AFTER_PARTIAL_COMMIT")
        .when(found & behind, "STALE_NOOP")
        .when(F.col("operation").isin("INSERT", "UPDATE", "DELETE"), F.concat(F.lit("APPLIED_"), F.col("operation")))
        .otherwise("UNKNOWN")
    )


def reason(result: Column) -> Column:
    return (
        F.when(result == "ALREADY_APPLIED", "ALREADY_APPLIED_IN_TARGET_AND_LEDGER")
        .when(result == "RECOVERED_AFTER_PARTIAL_COMMIT", "RECOVERED_AFTER_UNRECORDED_TARGET_COMMIT")
        .when(result == "STALE_NOOP", "SOURCE_SEQUENCE_LEQ_TARGET")
        .when(result == SUPERSEDED, "SUPERSEDED_BY_HIGHER_SEQUENCE_EVENT_IN_SAME_BATCH")
    )


def snapshot_state(snapshot: DataFrame, table: str, now: Column) -> DataFrame:
    """Current state that a snapshot starts."""
    have = set(snapshot.columns)
    fields = [
        F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in payload_schema(table).fields
    ]
    return snapshot.select(
        *fields,
        F.col("source_sequence").cast("long").alias("_last_source_sequence"),
        F.lit(SNAPSHOT_EVENT).alias("_last_event_id"),
        F.coalesce(F.col("created_at"), F.lit(SNAPSHOT_TIME)).alias("_last_event_timestamp"),
        F.lit(0).cast("long").alias("_last_batch_id"),
        now.alias("_updated_at"),
        F.lit(False).alias("_is_deleted"),
        F.lit(1).alias("_last_schema_version"),
    )


def apply_batch(
    parsed: DataFrame, state: DataFrame, ledger: DataFrame, table: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """(new state, ledger rows) of one batch: one full outer join of the batch's winners with the
    state. A row of the lower version leaves the fields of a higher one as they are."""
    pk, since = KEYS[table], added_in(table)
    ranked = collapse(parsed, pk, ("source_table",))
    fields = payload_schema(table).names
    win = ranked.where("collapse_rank = 1").drop("collapse_rank")
    win = win.join(ledger.select("event_id", F.lit(True).alias("_recorded")).distinct(), "event_id", "left")
    src = win.select(F.col(pk), *(F.col(c).alias(f"s_{c}") for c in win.columns if c != pk))
    both = state.join(src, pk, "full_outer")
    new = F.col("s_event_id").isNotNull()
    found = F.col("_last_source_sequence").isNotNull()
    same = (F.col("s_event_id") == F.col("_last_event_id")) & (F.col("s_source_sequence") == F.col("_last_source_sequence"))
    ahead = (
        new
        & (~found | (F.col("s_source_sequence") > F.col("_last_source_sequence")))
        & F.col("s_operation").isin("INSERT", "UPDATE", "DELETE")
    )
    image = ahead & (F.col("s_operation") != "DELETE")
    attributes = [
        F.when(image & (F.col("s_schema_version") >= since[f]), F.col(f"s_{f}")).otherwise(F.col(f)).alias(f)
        for f in fields
        if f != pk
    ]
    lineage = {
        "_last_source_sequence": F.col("s_source_sequence"),
        "_last_event_id": F.col("s_event_id"),
        "_last_event_timestamp": F.col("s_event_timestamp"),
        "_last_batch_id": F.col("s_batch_id"),
        "_updated_at": now,
        "_is_deleted": F.col("s_operation") == "DELETE",
        "_last_schema_version": F.col("s_schema_version"),
    }
    state_out = (
        both.where(found | ahead)
        .select(pk, *attributes, *(F.when(ahead, v).otherwise(F.col(c)).alias(c) for c, v in lineage.items()))
        .select(*state_schema(table).names)
    )
    target = state.select(
        pk, F.col("_last_source_sequence").alias("target_sequence_before"), F.col("_last_event_id").alias("_tid")
    )
    audit = win.join(target, pk, "left")
    exists = F.col("target_sequence_before").isNotNull()
    same = (F.col("event_id") == F.col("_tid")) & (F.col("source_sequence") == F.col("target_sequence_before"))
    audit = audit.withColumn(
        "apply_outcome",
        outcome(
            exists,
            same,
            F.coalesce("_recorded", F.lit(False)),
            F.col("source_sequence") <= F.col("target_sequence_before")
        )
    )
    audit = audit.withColumn(
        "target_sequence_after",
        F.when(F.col("apply_outcome").isin(*APPLIED), F.col("source_sequence"))
        .otherwise(F.col("target_sequence_before"))
    )
    none = F.lit(None).cast("long")
    lost = ranked.where("collapse_rank > 1").withColumns(
        {"apply_outcome": F.lit(SUPERSEDED), "target_sequence_before": none, "target_sequence_after": none}
    )
    rows = (
        audit.select(*lost.columns[:0], *[c for c in lost.columns if c != "collapse_rank"])
        .unionByName(lost.drop("collapse_rank"))
    )
    rows = rows.withColumns({"applied_at": now, "reason": reason(F.col("apply_outcome"))})
    return state_out, rows.select(*LEDGER.names)


# The closed form: all batches at once


def outcomes(unique: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every winner and superseded event of every batch with its outcome, from unique events and
    snapshot rows (source_table, business_key, source_sequence). A redelivery that is the target's
    own event counts as already applied; recovery needs a lost ledger and can't arise here."""
    ranked = collapse(unique)
    start = snapshot.select("source_table", "business_key", "source_sequence").withColumns(
        {
            "batch_id": F.lit(0).cast("long"),
            "event_id": F.lit(SNAPSHOT_EVENT),
            "operation": F.lit(SNAPSHOT_EVENT),
            "collapse_rank": F.lit(1)
        }
    )
    rows = ranked.where("collapse_rank = 1").unionByName(start, allowMissingColumns=True)
    before = (
        Window.partitionBy("source_table", "business_key")
        .orderBy("batch_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn(
        "_t",
        F.max(
            F.struct(
                F.col("source_sequence").alias("s"), (-F.col("batch_id")).alias("b"), F.col("event_id").alias("e")
            )
        )
        .over(before)
    )
    rows = rows.where("batch_id > 0").withColumn("target_sequence_before", F.col("_t.s"))
    found = F.col("_t").isNotNull()
    same = (F.col("_t.e") == F.col("event_id")) & (F.col("_t.s") == F.col("source_sequence"))
    rows = (
        rows.withColumn("apply_outcome", outcome(found, same, F.lit(True), F.col("source_sequence") <= F.col("_t.s")))
        .drop("_t")
    )
    lost = ranked.where("collapse_rank > 1").withColumns(
        {"apply_outcome": F.lit(SUPERSEDED), "target_sequence_before": F.lit(None).cast("long")}
    )
    out = rows.unionByName(lost)
    after = (
        F.when(F.col("apply_outcome").isin(*APPLIED), F.col("source_sequence"))
        .otherwise(F.col("target_sequence_before"))
    )
    return out.withColumns({"target_sequence_after": after, "reason": reason(F.col("apply_outcome"))}).drop("collapse_rank")


def ledger_of(results: DataFrame) -> DataFrame:
    """The ledger that outcomes leave: a redelivered event's row is its last batch's."""
    last = Window.partitionBy("event_id").orderBy(F.desc("batch_id"))
    return results.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def state_of(results: DataFrame, snapshot: DataFrame, table: str) -> DataFrame:
    """Current state of one table after all batches: results are outcomes with parsed payload
    columns, snapshot has the payload columns, source_sequence and created_at."""
    pk, since = KEYS[table], added_in(table)
    fields = [f for f in payload_schema(table).names if f != pk]
    applied = results.where(F.col("apply_outcome").isin(*APPLIED)).select(
        F.col("business_key").alias(pk), "source_sequence", "event_id", "event_timestamp", "batch_id", "operation",
        "schema_version", *fields
    )
    have = set(snapshot.columns)
    types = {f.name: f.dataType for f in payload_schema(table).fields}
    start = snapshot.select(
        F.col(pk),
        "source_sequence",
        F.lit(SNAPSHOT_EVENT).alias("event_id"),
        F.coalesce("created_at", F.lit(SNAPSHOT_TIME)).alias("event_timestamp"),
        F.lit(0).cast("long").alias("batch_id"),
        F.lit(SNAPSHOT_EVENT).alias("operation"),
        F.lit(1).alias("schema_version"),
        *((F.col(f) if f in have else F.lit(None)).cast(types[f]).alias(f) for f in fields),
    )
    rows = applied.unionByName(start)
    image = F.col("operation") != "DELETE"
    last = lambda c, when=None: F.max_by(
        c, F.when(when, F.col("source_sequence")) if when is not None else F.col("source_sequence")
    )
    return rows.groupBy(pk).agg(
        *(last(f, image & (F.col("schema_version") >= since[f])).alias(f) for f in fields),
        F.max("source_sequence").alias("_last_source_sequence"),
        last("event_id").alias("_last_event_id"),
        last("event_timestamp").alias("_last_event_timestamp"),
        last("batch_id").alias("_last_batch_id"),
        (last("operation") == "DELETE").alias("_is_deleted"), last("schema_version").alias("_last_schema_version"),
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("batch_id", "source_table", "apply_outcome").agg(F.count("*").alias("events"))


def reconcile(state: DataFrame, key: str) -> DataFrame:
    """One row of what must hold: unique and non-null keys, positive sequences, active + deleted = all."""
    return state.agg(
        F.count("*").alias("total_rows"),
        F.count_distinct(key).alias("distinct_keys"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.count_if(F.col("_last_source_sequence") <= 0).alias("bad_sequences"),
        F.count_if(~F.col("_is_deleted")).alias("active_rows"), F.count_if("_is_deleted").alias("deleted_rows"),
    )


def money_is_decimal(state: DataFrame, table: str) -> bool:
    """Whether the table's money column, if it has one, is an exact decimal."""
    return table not in MONEY or state.schema[MONEY[table]].dataType == T.DecimalType(12, 2)


def active(state: DataFrame) -> DataFrame:
    return state.where("not _is_deleted")


def tombstones(state: DataFrame) -> DataFrame:
    return state.where("_is_deleted")


def reactivated(results: DataFrame) -> DataFrame:
    """Keys with an applied insert or update right after an applied delete, and how often."""
    rows = results.where(F.col("apply_outcome").isin(*APPLIED))
    before = Window.partitionBy("source_table", "business_key").orderBy("source_sequence")
    return (
        rows.withColumn("_b", F.lag("operation").over(before))
        .where("_b = 'DELETE' and operation <> 'DELETE'")
        .groupBy("source_table", "business_key")
        .agg(F.count("*").alias("reactivations"))
    )
