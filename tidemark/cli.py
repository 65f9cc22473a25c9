"""Command line: python -m tidemark.cli [--root DIR] COMMAND ..."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import pending
from tidemark.plans.lanes import Engine
from tidemark.schemas import TABLES
from tidemark.sources.generate import SCALES, write_changes, write_snapshot
from tidemark.streaming import apply_stream


def _show(df: DataFrame, limit: int) -> None:
    df.show(limit, truncate=False)


def generate_snapshot(e: Engine, a: argparse.Namespace) -> None:
    print(write_snapshot(e.spark, e.raw, a.scale, a.seed))


def generate_cdc(e: Engine, a: argparse.Namespace) -> None:
    for m in write_changes(e.spark, e.raw, a.batches, a.scale, a.seed, schema_transition_batch=a.schema_transition_batch):
        print(f"batch {m['batch_id']}: {m['event_count']} events, defects {m['defects_injected']}")


def process_cdc(e: Engine, a: argparse.Namespace) -> None:
    done = e.process_pending()
    for d in done:
        print(f"batch {d['batch_id']}: {d['totals']}")
    if not done:
        print("nothing pending")


def analyze_cdc(e: Engine, a: argparse.Namespace) -> None:
    for name, df in e.analyze().items():
        print(name)
        _show(df, 100)


def run_all(e: Engine, a: argparse.Namespace) -> None:
    a.schema_transition_batch = None
    for step in (generate_snapshot, generate_cdc, process_cdc, analyze_cdc):
        step(e, a)


def init_delta(e: Engine, a: argparse.Namespace) -> None:
    print(f"made {e.init_state(a.force) or 'nothing: the tables are there'}")


def apply_cdc(e: Engine, a: argparse.Namespace) -> None:
    done = e.apply_pending()
    for b, counts in done.items():
        for c in counts:
            print(f"batch {b}: {c}")
    if not done:
        print("nothing pending")


def apply_cdc_stream(e: Engine, a: argparse.Namespace) -> None:
    apply_stream(e).awaitTermination()


def show_current(e: Engine, a: argparse.Namespace) -> None:
    _show(e.current(a.table, a.active_only), a.limit)


def show_applied_events(e: Engine, a: argparse.Namespace) -> None:
    _show(e.table("applied_events").read().orderBy(F.desc("applied_at"), "source_table", "source_sequence"), a.limit)


def build_event_store(e: Engine, a: argparse.Namespace) -> None:
    print(f"{e.build_store()} unique events offered")


def init_history(e: Engine, a: argparse.Namespace) -> None:
    print("made" if e.init_history(a.force) else "the history is there")


def detect_late_events(e: Engine, a: argparse.Namespace) -> None:
    print(f"{e.detect_late()} events queued")


def replay_late_events(e: Engine, a: argparse.Namespace) -> None:
    print(e.replay_late(a.repair_current))


def show_history(e: Engine, a: argparse.Namespace) -> None:
    _show(e.history_of(a.subscription_id).orderBy("subscription_id", "valid_from_sequence"), a.limit)


def show_replay_queue(e: Engine, a: argparse.Namespace) -> None:
    queue = e.table("late_event_queue").read()
    _show(pending(queue) if a.pending else queue.orderBy("source_sequence", "event_id"), a.limit)


def migrate_schema(e: Engine, a: argparse.Namespace) -> None:
    print(*e.migrate(a.table, a.to_version))


def vacuum(e: Engine, a: argparse.Namespace) -> None:
    print(f"{e.vacuum(a.keep)} folders deleted")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--root", default="data")
    sub = p.add_subparsers(dest="command", required=True)

    def command(run: Callable[[Engine, argparse.Namespace], None], *options: tuple[str, dict]) -> None:
        c = sub.add_parser(run.__name__.replace("_", "-"))
        c.set_defaults(run=run)
        for name, how in options:
            c.add_argument(name, **how)

    whole = lambda n: {"type": int, "default": n}
    flag, limit = {"action": "store_true"}, ("--limit", whole(20))
    made = (("--scale", {"choices": list(SCALES), "default": "tiny"}), ("--seed", whole(42)))
    command(generate_snapshot, *made)
    command(generate_cdc, ("--batches", whole(3)), *made, ("--schema-transition-batch", whole(None)))
    command(process_cdc)
    command(analyze_cdc)
    command(run_all, ("--batches", whole(3)), *made)
    command(init_delta, ("--force", flag))
    command(apply_cdc)
    command(apply_cdc_stream)
    command(show_current, ("--table", {"choices": list(TABLES), "default": "subscriptions"}), limit, ("--active-only", flag))
    command(show_applied_events, limit)
    command(build_event_store)
    command(init_history, ("--force", flag))
    command(detect_late_events)
    command(replay_late_events, ("--repair-current", flag))
    command(show_history, ("--subscription-id", {"default": None}), limit)
    command(show_replay_queue, limit, ("--pending", flag))
    command(
        migrate_schema,
        ("--table", {"choices": ["subscriptions"], "default": "subscriptions"}),
        ("--to-version", whole(2))
    )
    command(vacuum, ("--keep", whole(10)))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(Engine(spark, a.root), a)


if __name__ == "__main__":
    main()
