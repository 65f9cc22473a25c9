"""Commits that lose nothing and touch few buckets, the guard before them, and the stream against the batch lane."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.events import checked, event_id
from tidemark.operators import history
from tidemark.operators.events import EventIdentityConflict
from tidemark.plans.lanes import Engine
from tidemark.schemas import ENVELOPE, HISTORY, QUEUE, STORE, TABLES, state_schema
from tidemark.sources.tables import BUCKETS, Table, TableError
from tidemark.streaming import apply_stream

KV = "k long, v string"


def test_a_change_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.commit(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")), keys=["k"])
    first = t._entry(1)["parts"]
    assert len(first) == BUCKETS
    rows = spark.createDataFrame([(3, "b"), (2000, "b")], KV)
    touched = {str(r[0]) for r in rows.select(F.pmod(F.xxhash64("k"), F.lit(BUCKETS))).collect()}
    t.upsert(rows, ["k"])
    second = t._entry(2)["parts"]
    assert {b for b in second if second[b] != first.get(b)} == touched and len(touched) <= 2
    assert t.read().count() == 1001 and {r.k for r in t.read().where("v = 'b'").collect()} == {3, 2000}
    assert t.insert_only(spark.createDataFrame([(3, "x"), (2001, "x")], KV), ["k"]) == 1
    t.update_where(F.col("k") == 5, {"v": F.lit("z")})
    t.delete_where(F.col("k") == 6)
    assert sum(t._entry(5)["parts"][b] != t._entry(3)["parts"][b] for b in first) <= 2
    assert {(r.k, r.v) for r in t.read().where("k in (3, 5, 6, 2001)").collect()} == {(3, "b"), (5, "z"), (2001, "x")}
    assert t.vacuum(1) > 0 and t.versions() == [5] and t.read().count() == 1001
    on_disk = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "t").glob("v=*/_bucket=*")}
    assert on_disk == {f for fs in t._entry(5)["parts"].values() for f in fs}


def test_a_writer_in_between_is_an_error_and_not_a_loss(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.commit(spark.createDataFrame([(1, "a")], KV), keys=["k"])
    pin = t.pin(spark.createDataFrame([(1, "b")], KV))
    t.append(spark.createDataFrame([(1, "second writer")], KV))
    with pytest.raises(TableError):
        pin.commit(spark.createDataFrame([(1, "b")], KV), "merge")
    assert {r.v for r in t.read().collect()} == {"a", "second writer"}


def made(spark, rows):
    df = spark.createDataFrame(
        [
            (None, *r[:4], r[4] if len(r) > 4 else "2025-01-01T00:00:00+00:00", "2025-01-02T00:00:00+00:00", *r[5:])
            for r in rows
        ],
        ENVELOPE
    )
    return df.withColumn("event_id", event_id())


def subscription(key, sequence, operation, batch, version, **payload):
    body = json.dumps({"subscription_id": key, **payload})
    return ("subscriptions", operation, key, sequence, "2025-01-01T00:00:00+00:00", batch, version, body)


def laid_out(spark, root, batches):
    (root / "raw" / "snapshot").mkdir(parents=True)
    for t in TABLES:
        (root / "raw" / "snapshot" / f"{t}.jsonl").write_text("")
    one = {
        "subscription_id": "S1", "account_id": "A1", "plan": "P0", "status": "ACTIVE", "monthly_amount": "1.00",
        "renewal_date": "2025-01-01", "source_sequence": 1, "created_at": "2024-01-01"
    }
    (root / "raw" / "snapshot" / "subscriptions.jsonl").write_text(
        "".join(json.dumps(one | {"subscription_id": f"S{i}", "source_sequence": i}) + "\n" for i in range(1, 5))
    )
    for b, rows in batches.items():
        folder = root / "raw" / "cdc" / f"batch_id={b:06d}"
        folder.mkdir(parents=True)
        lines = made(spark, rows).toJSON().collect()
        (folder / "subscriptions.jsonl").write_text("\n".join(lines) + "\n")
        (folder / "manifest.json").write_text(json.dumps({"batch_id": b, "event_count": len(lines)}))
    e = Engine(spark, root)
    e.init_state()
    e.migrate("subscriptions", 2)
    return e


BATCHES = {
    1: [
        subscription(
            "S1", 100, "UPDATE", 1, 2, account_id="A1", plan="P5", status="ACTIVE", billing_cycle="MONTHLY",
            currency="USD"
        ),
        subscription("S2", 101, "UPDATE", 1, 1, account_id="A2", plan="P6", status="ACTIVE"),
        subscription(
            "S2", 102, "UPDATE", 1, 2, account_id="A2", plan="P7", status="ACTIVE", billing_cycle="ANNUAL",
            currency="EUR"
        ),
    ],
    2: [
        subscription("S1", 110, "DELETE", 2, 1),
        subscription("S2", 111, "UPDATE", 2, 1, account_id="A2", plan="P8", status="PAUSED"),
        subscription("S9", 112, "INSERT", 2, 1, account_id="A9", plan="P9", status="ACTIVE"),
    ],
    3: [
        subscription("S1", 105, "UPDATE", 3, 1, account_id="A1", plan="LATE", status="ACTIVE"),
        subscription("S3", 120, "DELETE", 3, 1)
    ],
}


def shown(df, leave=()):
    leave = {*leave, "_updated_at", "applied_at", "processed_at", "first_seen_at", "last_seen_at"}
    return sorted(str(r) for r in df.select(*(c for c in sorted(df.columns) if c not in leave)).collect())


def test_stream_equals_batch(spark, tmp_path):
    batch, stream = laid_out(spark, tmp_path / "b", BATCHES), laid_out(spark, tmp_path / "s", BATCHES)
    assert list(batch.apply_pending()) == [1, 2, 3]
    apply_stream(stream).awaitTermination()  # all three batches in one micro-batch
    for name in ("subscriptions", "applied_events", "cdc_event_store", "batch_apply_metrics"):
        assert shown(batch.table(name).read()) == shown(stream.table(name).read()), name
    s1 = batch.current("subscriptions").where("subscription_id = 'S1'").first()
    assert (s1.plan, s1.billing_cycle, s1._is_deleted) == ("P5", "MONTHLY", True)
    a, b = batch.apply_checkpoint.load(), stream.apply_checkpoint.load()
    assert a["completed_batch_ids"] == b["completed_batch_ids"] == [1, 2, 3] and stream.apply_pending() == {}
    assert all(a["tables"][t]["highest_source_sequence"] == b["tables"][t]["highest_source_sequence"] for t in TABLES)


def test_a_conflicting_event_leaves_every_table_as_it_was(spark, tmp_path):
    e = laid_out(spark, tmp_path / "c", {1: BATCHES[1]})
    e.apply_pending()
    names = ("subscriptions", "applied_events", "cdc_event_store", "batch_apply_metrics")
    before = {n: (e.table(n).versions()[-1], shown(e.table(n).read())) for n in names}
    other = subscription(
        "S1", 100, "UPDATE", 2, 2, account_id="A1", plan="OTHER", status="ACTIVE", billing_cycle="MONTHLY",
        currency="USD"
    )
    with pytest.raises(EventIdentityConflict):
        e.apply_events(made(spark, [other, subscription("S4", 130, "DELETE", 2, 1)]))
    assert before == {n: (e.table(n).versions()[-1], shown(e.table(n).read())) for n in names}


def test_blank_is_any_white_space(spark):
    rows = [subscription(k, 5, "UPDATE", 1, 1, account_id="A", plan="P", status="S") for k in ("\t", "  ", "\x1c", "x\t")]
    reasons = [
        r.rejection_reason
        for r in checked(made(spark, rows)).orderBy(F.length("business_key"), "business_key").collect()
    ]
    assert sum("MISSING_BUSINESS_KEY" in r for r in reasons) == 3


def test_repair_without_a_current_row_fails_that_key(spark):
    rows = [subscription(k, 50, "UPDATE", 1, 1, account_id="A", plan="P", status="S") for k in ("S1", "S2")]
    store = made(spark, rows).withColumnRenamed("batch_id", "arrival_batch_id")
    for f in STORE.fields:
        if f.name not in store.columns:
            store = store.withColumn(f.name, F.lit(None).cast(f.dataType))
    queue = history.queue_rows(store, F.lit("now"))
    fields = (
        "subscription_id string, source_sequence long, created_at string, account_id string, plan string, "
        "status string, monthly_amount string, renewal_date string"
    )
    snapshot = spark.createDataFrame([(k, 1, "t", "A", "P0", "S", "1", "r") for k in ("S1", "S2")], fields)
    state = spark.createDataFrame(
        [("S1", *[None] * (len(state_schema("subscriptions").names) - 1))], state_schema("subscriptions")
    )
    seeded = history.seed(snapshot, F.lit("now"))
    q, h, s, audit = history.replay(
        queue, store.select(*STORE.names), snapshot, seeded, state, F.lit("later"), repair_current=True
    )
    got = {r.business_key: (r.status, r.failure_reason, r.current_state_changed) for r in audit.collect()}
    assert got == {"S1": ("APPLIED", None, True), "S2": ("FAILED", "NO_CURRENT_ROW", False)}
    assert h.select(*HISTORY.names).where("subscription_id = 'S2'").count() == 1 and s.where("plan = 'P'").count() == 1
    assert {r.replay_status for r in q.select(*QUEUE.names).collect()} == {"APPLIED", "FAILED"}
