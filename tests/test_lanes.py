"""Generators, batch lanes with recovery, the stream and the command line, end to end on the tiny scale."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions.events import checked
from tidemark.operators import history
from tidemark.plans.lanes import Engine, SimulatedFailure
from tidemark.schemas import TABLES
from tidemark.sources import generate
from tidemark.sources.batches import discover, read_events
from tidemark.streaming import apply_stream, rates

ATTRIBUTES = ["subscription_id", "plan", "status", "_last_source_sequence", "_last_event_id", "_is_deleted"]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lanes")
    generate.write_snapshot(spark, root / "raw", "tiny", 7)
    generate.write_changes(
        spark,
        root / "raw",
        2,
        "tiny",
        7,
        generate.Defects(duplicate=0.1, late=0.1, malformed_payload=0.1),
        schema_transition_batch=2
    )
    return root


def engine(spark, raw, tmp_path):
    (tmp_path / "raw").symlink_to(raw / "raw")
    return Engine(spark, tmp_path)


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_generator(spark, raw):
    events = generate.changes(spark, 3, "tiny", 7)
    assert (
        rows(events, "*") == rows(
            generate.changes(spark, 3, "tiny", 7).repartition(5), "*"
        ) != rows(generate.changes(spark, 3, "tiny", 8), "*")
    )
    clean = checked(generate.changes(spark, 3, "small", 1, generate.Defects.none()))
    assert (
        clean.where("rejection_reason <> ''").count() == 0
        and clean.count() == 1500 == clean.select("source_sequence").distinct().count()
    )
    broken = checked(generate.changes(spark, 3, "small", 1, generate.Defects(*[0.1] * 8)))
    for r in broken.groupBy("defect").agg(
        F.count_if(F.col("rejection_reason") != "").alias("bad"), F.count("*").alias("n")
    ).collect():
        assert (
            r.bad == (
                r.n
                if r.defect in (
                    "unknown_operation", "missing_key", "malformed_payload", "invalid_sequence", "invalid_timestamp"
                )
                else 0
            )
        )
    batches = discover(raw / "raw" / "cdc")
    assert [b.manifest["event_count"] for b in batches] == [read_events(spark, str(b.path)).count() for b in batches]


def test_staging(spark, raw, tmp_path):
    e = engine(spark, raw, tmp_path)
    with pytest.raises(SimulatedFailure):
        e.process(discover(e.cdc)[0], fail_at="checkpoint")
    done = e.process_pending()
    assert [d["batch_id"] for d in done] == [1, 2] and e.process_pending() == []
    total = lambda k: sum(d["totals"][k] for d in done)
    assert total("raw_events") == total("valid_unique") + total("duplicates") + total("invalid")
    assert total("duplicates") > 0 and total("invalid") > 0 and total("late_events") > 0
    assert (
        [
            e.staged_events(k).count() for k in ("valid", "quarantine", "late")
        ] == [total("valid_unique"), total("invalid"), total("late_events")]
    )
    views = e.analyze()
    assert spark.table("v_cdc_valid").count() == sum(r.event_count for r in views["events_by_operation"].collect())
    assert json.loads((tmp_path / "staged/metrics/batch_id=000002/metrics.json").read_text())["status"] == "SUCCESS"


def test_apply_survives_crashes_then_stream_and_replay(spark, raw, tmp_path):
    e = engine(spark, raw, tmp_path)
    assert e.init_state() == list(TABLES) and e.init_state() == []
    assert (
        e.migrate("subscriptions", 2) == ("MIGRATED_SUCCESS", ["billing_cycle", "currency"])
        and e.migrate("subscriptions", 2)[0] == "ALREADY_MIGRATED"
    )
    first, second = discover(e.cdc)
    with pytest.raises(SimulatedFailure):
        e.apply(first, fail_at="ledger")
    again = e.apply(first)
    assert sum(r["recovered_events"] for r in again) > 0 and not sum(r["applied_updates"] for r in again)
    with pytest.raises(SimulatedFailure):
        e.apply(second, fail_at="checkpoint")
    assert sum(r["already_applied"] for r in e.apply_pending()[2]) > 0
    assert e.apply_pending() == {} and e.reconcile()["accounts"]["null_keys"] == 0
    state = rows(e.current("subscriptions"), *ATTRIBUTES, "billing_cycle", "currency")
    assert e.current("subscriptions").where("billing_cycle is not null").count() > 0
    stored = e.table("cdc_event_store").read().count()
    assert stored == e.table("applied_events").read().count()
    apply_stream(e).awaitTermination()  # all of it once more: nothing changes
    assert state == rows(e.current("subscriptions"), *ATTRIBUTES, "billing_cycle", "currency")
    assert e.build_store() >= stored == e.table("cdc_event_store").read().count()
    assert e.init_history() and not e.init_history()
    queued = e.detect_late()
    assert queued > 0 and e.detect_late() == 0
    r = e.replay_late(repair_current=True)
    assert r["total_pending"] == queued == r["applied"] + r["conflicts"] + r["failed"] and r["applied"] > 0
    assert history.violations(e.history_of()).count() == 0


def test_rates(spark, raw):
    events = read_events(spark, str(raw / "raw" / "cdc")).where("event_timestamp is not null")
    assert (
        rates(events).agg(F.sum("event_count")).first()[0] == events.where(
            F.col("event_timestamp").try_cast("timestamp").isNotNull()
        ).count()
    )


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["--root", str(tmp_path), *a], spark)
    run("run-all", "--batches", "1")
    for c in (
        "init-delta",
        "apply-cdc",
        "show-current --active-only --limit 3",
        "show-applied-events --limit 3",
        "build-event-store",
        "init-history",
        "detect-late-events",
        "replay-late-events",
        "show-history --limit 3",
        "show-replay-queue",
        "migrate-schema"
    ):
        run(*c.split())
    said = capsys.readouterr().out
    assert "late_events" in said and "MIGRATED_SUCCESS" in said and "total_pending" in said
