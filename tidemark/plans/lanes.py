"""The batch lanes over a root folder: staging, apply with crash recovery, event store, history, replay.

Layout below the root: raw/snapshot, raw/cdc, staged (valid, quarantine, late, metrics), tables, state.
Each lane has a checkpoint of its own. A batch is read once, all four tables together; it is kept with
persist() while its outputs are written and is recomputed from the input if an executor is lost.
"""

from __future__ import annotations

import json
import shutil
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.events import checked, parse_payload, split_valid
from tidemark.operators import events as ops
from tidemark.operators import history, merge
from tidemark.schemas import HISTORY, KEYS, LEDGER, METRICS, PAYLOADS, QUEUE, REPLAY_AUDIT, STORE, TABLES, state_schema
from tidemark.sources.batches import Batch, Checkpoint, discover, read_events, read_snapshot
from tidemark.sources.tables import Table, TableError

ONE_FILE = ("batch_id", "source_table")


class ReconciliationError(RuntimeError):
    pass


class SimulatedFailure(RuntimeError):
    """Raised at the point that fail_at names, for tests of recovery."""


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc).isoformat())


class Engine:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.raw, self.cdc, self.staged = self.root / "raw", self.root / "raw" / "cdc", self.root / "staged"
        self.staging_checkpoint = Checkpoint(self.root / "state" / "staging")
        self.apply_checkpoint = Checkpoint(self.root / "state" / "apply")

    def table(self, name: str) -> Table:
        return Table(self.spark, str(self.root / "tables" / name))

    def _made(self, name: str, schema: T.StructType, *keys: str) -> Table:
        t = self.table(name)
        t.create(schema, keys)
        return t

    def _ledger(self) -> Table:
        return self._made("applied_events", LEDGER, "event_id")

    def _event_store(self) -> Table:
        return self._made("cdc_event_store", STORE, "event_id")

    def vacuum(self, keep: int = 10) -> int:
        """Delete all tables' versions but the last ones; returns how many folders went."""
        names = [
            *TABLES, "applied_events", "cdc_event_store", "batch_apply_metrics", "subscriptions_history",
            "late_event_queue", "replay_audit"
        ]
        return sum(self.table(n).vacuum(keep) for n in names if self.table(n).exists())

    # Staging

    def process(self, batch: Batch, fail_at: str | None = None) -> dict:
        """Valid, quarantined and late events of a batch as files, and its metrics; late ones stay among the
        valid. A batch that is run again overwrites its outputs."""
        marks = {t: self.staging_checkpoint.mark(t) for t in TABLES}
        tag, now = f"batch_id={batch.batch_id:06d}", _now()
        hwm = F.create_map(*(F.lit(x) for kv in marks.items() for x in kv))[F.col("source_table")]
        rows = checked(read_events(self.spark, str(batch.path))).withColumn("_bad", F.col("rejection_reason") != "")
        rows = (
            ops.ranked_deliveries(rows, ("source_table", "_bad"))
            .withColumn("_kept", ~F.col("_bad") & (F.col("delivery_rank") == 1))
        )
        rows = rows.withColumn("_late", F.col("_kept") & (hwm > 0) & (F.col("source_sequence") <= hwm)).persist()
        try:
            valid = rows.where("_kept")
            seq = F.when(F.col("_kept"), F.col("source_sequence"))
            counts = rows.groupBy("source_table").agg(
                F.count("*").alias("raw_event_count"),
                F.count_if(~F.col("_bad")).alias("valid_event_count"),
                F.count_if("_bad").alias("invalid_event_count"),
                F.count_if(~F.col("_bad") & (F.col("delivery_rank") > 1)).alias("duplicate_event_count"),
                F.count_if("_kept").alias("valid_unique_count"),
                F.count_if(F.coalesce("_late", F.lit(False))).alias("late_event_count"),
                F.coalesce(F.min(seq), F.lit(0)).alias("minimum_sequence"),
                F.coalesce(F.max(seq), F.lit(0)).alias("maximum_sequence"),
            )
            names = counts.columns[1:]
            # A row for each table name; an unknown name only occurs in quarantined events.
            found = {r.source_table: r.asDict() for r in counts.collect()}
            tables = {t: {n: found.get(t, {}).get(n, 0) for n in names} for t in sorted({*TABLES, *(str(x) for x in found)})}
            for t, m in tables.items():
                if m["raw_event_count"] != m["valid_unique_count"] + m["duplicate_event_count"] + m["invalid_event_count"]:
                    raise ReconciliationError(
                        f"batch {batch.batch_id}, {t}: raw is not the sum of unique, duplicate and invalid"
                    )
            envelope = valid.drop("_bad", "_kept", "delivery_rank", "canonical_event_hash", "rejection_reason")
            ops.in_order(envelope.drop("_late")).write.mode("overwrite").json(str(self.staged / "valid" / tag))
            split_valid(
                rows.where("_bad").drop("rejection_reason"), now
            )[1].write.mode("overwrite").json(str(self.staged / "quarantine" / tag))
            ops.in_order(envelope.where("_late").drop("_late")).write.mode("overwrite").json(str(self.staged / "late" / tag))
        finally:
            rows.unpersist()
        total = lambda n: sum(m[n] for m in tables.values())
        doc = {
            "batch_id": batch.batch_id, "status": "SUCCESS", "processed_at": datetime.now(timezone.utc).isoformat(),
            "totals": {
                "raw_events": total("raw_event_count"),
                "valid_unique": total("valid_unique_count"),
                "duplicates": total("duplicate_event_count"),
                "invalid": total("invalid_event_count"),
                "late_events": total("late_event_count")
            },
            "tables": tables,
        }
        path = self.staged / "metrics" / tag / "metrics.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(doc, indent=2))
        if fail_at == "checkpoint":
            raise SimulatedFailure("before the checkpoint")
        self.staging_checkpoint.commit(batch.batch_id, {t: max(marks[t], tables[t]["maximum_sequence"]) for t in TABLES})
        return doc

    def process_pending(self) -> list[dict]:
        return [self.process(b) for b in discover(self.cdc) if not self.staging_checkpoint.is_complete(b.batch_id)]

    def staged_events(self, kind: str) -> DataFrame:
        """valid, quarantine or late events of all staged batches; empty before the first."""
        schema = (
            T.StructType([*split_valid(read_events(self.spark, []), F.lit(""))[1].schema.fields])
            if kind == "quarantine"
            else read_events(self.spark, []).schema
        )
        paths = [str(p) for p in (self.staged / kind).glob("batch_id=*")]
        return (
            self.spark.read.schema(schema)
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "part-*")
            .json(paths)
            if paths
            else self.spark.createDataFrame([], schema)
        )

    def analyze(self) -> dict[str, DataFrame]:
        """The six diagnostics over what is staged; registers v_cdc_valid, v_cdc_quarantine and v_cdc_late."""
        valid, bad, late = (self.staged_events(k) for k in ("valid", "quarantine", "late"))
        for name, df in (("v_cdc_valid", valid), ("v_cdc_quarantine", bad), ("v_cdc_late", late)):
            df.createOrReplaceTempView(name)
        return {
            "events_by_operation": ops.by_operation(valid),
            "events_by_source_table": ops.by_source_table(valid),
            "sequence_range_by_batch": ops.sequence_range(valid),
            "update_frequency_by_key": ops.update_frequency(valid),
            "late_events": ops.late_summary(late),
            "invalid_events_by_reason": ops.by_reason(bad),
        }

    # Current state

    def init_state(self, force: bool = False) -> list[str]:
        """Current-state tables of the snapshot, with the first schema version's columns; returns those made."""
        made = []
        for t in TABLES:
            if self.table(t).exists() and not force:
                continue
            state = merge.snapshot_state(read_snapshot(self.spark, self.raw, t), t, _now())
            later = set(state.columns) & (
                set(PAYLOADS[t, max(v for x, v in PAYLOADS if x == t)].names) - set(PAYLOADS[t, 1].names)
            )
            self.table(t).commit(state.drop(*later), "snapshot", keys=[KEYS[t]])
            made.append(t)
        return made

    def current(self, table: str, active_only: bool = False) -> DataFrame:
        state = self.table(table).read()
        return merge.active(state) if active_only else state

    @staticmethod
    def _wide(state: DataFrame, table: str) -> DataFrame:
        """The state with all columns of the latest schema."""
        missing = {f.name: F.lit(None).cast(f.dataType) for f in state_schema(table).fields if f.name not in state.columns}
        return state.withColumns(missing).select(*state_schema(table).names)

    def apply_events(self, unique: DataFrame, fail_at: str | None = None) -> list[dict]:
        """Merge valid, unique events into all tables, then ledger, event store and metrics, in that order: after
        a crash in between, the same events are told apart by the ledger and the tables' sequences. Events
        whose id the store has with another content are an error before anything is committed. Each table is
        committed against the version that was read, so another writer in between is an error, not a loss."""
        now, unique = _now(), unique.persist()
        counts: list[dict] = []
        try:
            self._check_identities(unique)
            ledger = self._ledger()
            recorded = ledger.pin(unique).df
            # Four at most: the events are valid.
            present = {r.source_table for r in unique.select("source_table").distinct().collect()}

            def one(t: str) -> DataFrame:
                parsed = parse_payload(unique, t)
                pin = self.table(t).pin(parsed)
                new, audit = merge.apply_batch(parsed, self._wide(pin.df, t), recorded, t, now)
                pin.commit(new.select(*pin.df.columns), "merge")
                return audit

            with ThreadPoolExecutor(len(TABLES)) as pool:  # the tables are independent: their jobs share the cluster
                audits = list(pool.map(one, sorted(present)))
            if fail_at == "ledger":
                raise SimulatedFailure("before the ledger")
            if audits:
                audit = reduce(DataFrame.unionByName, audits).persist()
                ledger.upsert(audit, ["event_id"])
                late = audit.select("event_id", (F.col("apply_outcome") == "STALE_NOOP").alias("is_late_on_arrival"))
                self._store(ops.to_store(unique.join(late, "event_id", "left"), now))
                counts = self._count(audit, sorted(present), now)
                audit.unpersist()
        finally:
            unique.unpersist()
        return counts

    def _count(self, audit: DataFrame, tables: list[str], now: Column) -> list[dict]:
        n = lambda *o: F.count_if(F.col("apply_outcome").isin(*o))
        by = audit.groupBy("batch_id", "source_table").agg(
            F.count("*").alias("input_valid_unique_events"),
            n(merge.SUPERSEDED).alias("superseded_events"),
            F.count_if(F.col("apply_outcome") != merge.SUPERSEDED).alias("candidate_winners"),
            n("APPLIED_INSERT").alias("applied_inserts"),
            n("APPLIED_UPDATE").alias("applied_updates"),
            n("APPLIED_DELETE").alias("applied_deletes"),
            n("STALE_NOOP").alias("stale_noops"),
            n("ALREADY_APPLIED").alias("already_applied"),
            n("RECOVERED_AFTER_PARTIAL_COMMIT").alias("recovered_events"),
            F.min("source_sequence").alias("min_sequence"), F.max("source_sequence").alias("max_sequence"),
        )
        sizes = reduce(
            DataFrame.unionByName,
            (
                self.table(t)
                .read()
                .agg(
                    F.count_if(~F.col("_is_deleted")).alias("current_active_rows"),
                    F.count_if("_is_deleted").alias("current_deleted_rows")
                )
                .withColumn("source_table", F.lit(t))
                for t in tables
            )
        )
        # A row for each table.
        rows = by.join(F.broadcast(sizes), "source_table").withColumn("processed_at", now).select(*METRICS.names)
        self._made("batch_apply_metrics", METRICS).upsert(rows, ["batch_id", "source_table"])
        return [r.asDict() for r in rows.collect()]  # a row for each batch and table

    def apply(self, batch: Batch, fail_at: str | None = None) -> list[dict]:
        valid, bad = split_valid(read_events(self.spark, str(batch.path)), _now())
        bad.write.mode("overwrite").parquet(
            str(self.root / "staged" / "apply_quarantine" / f"batch_id={batch.batch_id:06d}")
        )
        counts = self.apply_events(ops.deduplicate(valid, ("source_table",))[0].drop("canonical_event_hash"), fail_at)
        self.reconcile()
        if fail_at == "checkpoint":
            raise SimulatedFailure("before the checkpoint")
        self.complete(batch.batch_id, counts)
        return counts

    def complete(self, batch_id: int, counts: list[dict]) -> None:
        """Set down that a batch is applied, from the counts of apply_events."""
        top = {t: self.apply_checkpoint.mark(t) for t in TABLES}
        for r in counts:
            top[r["source_table"]] = max(top[r["source_table"]], r["max_sequence"])
        self.apply_checkpoint.commit(batch_id, top)

    def apply_pending(self) -> dict[int, list[dict]]:
        done = {b.batch_id: self.apply(b) for b in discover(self.cdc) if not self.apply_checkpoint.is_complete(b.batch_id)}
        self.vacuum()
        return done

    def reconcile(self) -> dict[str, dict]:
        """What must hold of current state and ledger; an error if something doesn't."""
        out = {}
        facts = reduce(
            DataFrame.unionByName,
            (merge.reconcile(self.table(t).read(), KEYS[t]).withColumn("source_table", F.lit(t)) for t in TABLES)
        )
        for row in facts.collect():  # a row for each table
            r = row.asDict()
            t = r.pop("source_table")
            repeated = r["distinct_keys"] != r["total_rows"]
            unsorted = r["active_rows"] + r["deleted_rows"] != r["total_rows"]
            if r["null_keys"] or r["bad_sequences"] or repeated or unsorted:
                raise ReconciliationError(f"{t}: {r}")
            if not merge.money_is_decimal(self.table(t).read(), t):
                raise ReconciliationError(f"{t}: {merge.MONEY[t]} is no decimal(12,2)")
            out[t] = r
        if self.table("applied_events").exists():
            r = (
                self.table("applied_events")
                .read()
                .agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"))
                .first()
                .asDict()
            )
            if r["rows"] != r["events"]:
                raise ReconciliationError(f"applied_events: {r}")
            out["applied_events"] = r
        return out

    def migrate(self, table: str, to_version: int) -> tuple[str, list[str]]:
        """Add the columns of a later payload version; ("ALREADY_MIGRATED", []) if they are there."""
        if (table, to_version) not in PAYLOADS:
            raise ValueError(f"table {table!r} has no schema version {to_version}")
        return self.table(table).add_columns({f.name: f.dataType.simpleString() for f in PAYLOADS[table, to_version].fields})

    # Event store

    def _check_identities(self, events: DataFrame) -> None:
        ids = [r.event_id for r in ops.identity_conflicts(self._event_store().pin(events).df, events).limit(5).collect()]
        if ids:
            raise ops.EventIdentityConflict(f"other content under a known event id, such as {ids}")

    def _store(self, rows: DataFrame) -> None:
        pin = self._event_store().pin(rows)
        pin.commit(ops.store_upsert(pin.df, rows), "touch")

    def build_store(self) -> int:
        """Fill the store from all batches in one pass; returns the unique events offered."""
        paths = [str(b.path) for b in discover(self.cdc)]
        unique = ops.deduplicate(split_valid(read_events(self.spark, paths), _now())[0], ONE_FILE)[0].persist()
        try:
            rows = ops.store_of(unique)
            ids = [r.event_id for r in ops.identity_conflicts(rows, unique).limit(5).collect()]
            if ids:
                raise ops.EventIdentityConflict(f"batches disagree on the content of an event id, such as {ids}")
            self._check_identities(rows)
            self._store(rows)
            return unique.count()
        finally:
            unique.unpersist()

    # History and replay

    def init_history(self, force: bool = False) -> bool:
        t = self.table("subscriptions_history")
        if t.exists() and not force:
            return False
        t.commit(
            history.seed(read_snapshot(self.spark, self.raw, "subscriptions"), _now()),
            "snapshot",
            keys=[KEYS["subscriptions"]]
        )
        return True

    def detect_late(self) -> int:
        """Queue stored subscription events behind their key's current sequence; returns how many are new."""
        store = self._event_store().read().where("source_table = 'subscriptions'")
        late = ops.behind_current(store, self.current("subscriptions"), "subscription_id")
        return self._made("late_event_queue", QUEUE, "event_id").insert_only(history.queue_rows(late, _now()), ["event_id"])

    def replay_late(self, repair_current: bool = False) -> dict[str, int]:
        """Replay what is pending. History is committed before the queue, so that a crash in between leaves
        events pending, and replaying them again gives the same history."""
        queue, hist = self._made("late_event_queue", QUEUE, "event_id"), self.table("subscriptions_history")
        if not hist.exists():
            raise TableError("no history yet; run init-history first")
        due = queue.read().where("replay_status = 'PENDING'")
        pending, key = due.count(), F.col("business_key").alias(KEYS["subscriptions"])
        keys = due.where("source_table = 'subscriptions'").select("event_id", key)
        q, h, s = queue.pin(due), hist.pin(keys), self.table("subscriptions").pin(keys)
        snapshot, store = read_snapshot(self.spark, self.raw, "subscriptions"), self.table("cdc_event_store").read()
        new_q, new_h, new_s, audit = history.replay(q.df, store, snapshot, h.df, s.df, _now(), repair_current)
        audit = audit.persist()
        try:
            h.commit(new_h.select(*HISTORY.names), "replay")
            if repair_current:
                s.commit(new_s, "repair")
            self._made("replay_audit", REPLAY_AUDIT, "replay_id").upsert(audit, ["replay_id"])
            q.commit(new_q, "replay")
            by = {r.status: r["count"] for r in audit.groupBy("status").count().collect()}
        finally:
            audit.unpersist()
        return {
            "total_pending": pending,
            "applied": by.get("APPLIED", 0),
            "conflicts": by.get("CONFLICT", 0),
            "failed": by.get("FAILED", 0)
        }

    def history_of(self, subscription_id: str | None = None) -> DataFrame:
        h = self.table("subscriptions_history").read()
        return h if subscription_id is None else h.where(F.col("subscription_id") == subscription_id)

    def clear(self) -> None:
        """Delete all outputs; the raw input stays."""
        for d in ("staged", "tables", "state"):
            shutil.rmtree(self.root / d, ignore_errors=True)


