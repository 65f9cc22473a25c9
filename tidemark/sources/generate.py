"""Seeded snapshots and change batches, made by Spark from row numbers and hashes, so that any size is
written in parallel and the same seed gives the same rows whatever the partitions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.events import event_id
from tidemark.schemas import ENVELOPE, KEYS, TABLES

PREFIX = {"accounts": "ACC", "subscriptions": "SUB", "invoices": "INV", "payments": "PAY"}
SHARE = {"accounts": (0.15, 2), "subscriptions": (0.35, 3), "invoices": (0.30, 2), "payments": (0.20, 2)}
_INDUSTRIES, _COUNTRIES, _PLANS = (
    "retail", "logistics", "health", "energy", "media"
), ("DE", "FR", "JP", "BR", "US"), ("BASIC", "PRO", "ENTERPRISE")
_PRICES = {"BASIC": 29.0, "PRO": 99.0, "ENTERPRISE": 499.0}
_START = "2026-01-01T00:00:00+00:00"
#: Rows a file, and a task, of generated data.
ROWS_A_FILE = 200_000


def _files(rows: int) -> int:
    return -(-rows // ROWS_A_FILE)


@dataclass(frozen=True)
class Scale:
    rows: dict[str, int]
    batch_events: int


SCALES = {
    "tiny": Scale(dict(zip(TABLES, (50, 100, 250, 200))), 40),
    "small": Scale(dict(zip(TABLES, (1_000, 2_000, 5_000, 4_000))), 500),
    "standard": Scale(dict(zip(TABLES, (10_000, 20_000, 50_000, 40_000))), 2_500),
}


@dataclass(frozen=True)
class Defects:
    """Shares of a batch's events that get each defect."""

    duplicate: float = 0.03
    out_of_order: float = 0.03
    late: float = 0.03
    unknown_operation: float = 0.015
    missing_key: float = 0.015
    malformed_payload: float = 0.015
    invalid_sequence: float = 0.01
    invalid_timestamp: float = 0.01

    @staticmethod
    def none() -> Defects:
        return Defects(*[0.0] * 8)


@dataclass(frozen=True)
class _Maker:
    seed: int
    rows: dict[str, int] = field(default_factory=dict)

    def draw(self, salt: str, *of) -> Column:
        """A number from 0 up to 1 for each row."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(salt), *of), F.lit(1_000_000)) / 1_000_000

    def pick(self, salt: str, values: tuple[str, ...], *of) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(self.draw(salt, *of) * len(values)) + 1).cast("int"))

    def number(self, salt: str, n: int, *of) -> Column:
        return (F.floor(self.draw(salt, *of) * n) + 1).cast("long")

    def key(self, table: str, number: Column) -> Column:
        return F.concat(F.lit(f"{PREFIX[table]}-"), F.lpad(number.cast("string"), 9, "0"))

    def fields(self, table: str, n: Column, version: Column) -> dict[str, Column]:
        """Payload of an entity's row number; version is salted in, so that updates change it. Parents, and the
        price that a subscription's invoices and payments copy, follow from the number alone."""
        sub = n if table == "subscriptions" else self.number(
            "inv-sub",
            self.rows["subscriptions"],
            n if table == "invoices" else self.number("pay-inv", self.rows["invoices"], n)
        )
        account = self.key("accounts", self.number("sub-acc", self.rows["accounts"], sub))
        plan = self.pick("plan", _PLANS, sub, version if table == "subscriptions" else F.lit(0))
        price = F.create_map(*(F.lit(x) for kv in _PRICES.items() for x in kv))[plan]
        day = F.date_format(
            F.date_add(F.lit("2026-01-01").cast("date"), self.number("day", 365, n, version).cast("int")),
            "yyyy-MM-dd"
        )
        own = {
            "accounts": {
                "company_name": F.concat(F.lit("Company "), n.cast("string")),
                "industry": self.pick("industry", _INDUSTRIES, n),
                "country": self.pick("country", _COUNTRIES, n),
                "plan_tier": self.pick("tier", _PLANS, n, version)
            },
            "subscriptions": {
                "account_id": account,
                "plan": plan,
                "status": self.pick("status", ("ACTIVE", "ACTIVE", "PAUSED"), n, version),
                "monthly_amount": price,
                "renewal_date": day
            },
            "invoices": {
                "account_id": account,
                "subscription_id": self.key("subscriptions", sub),
                "amount": price,
                "status": self.pick("paid", ("OPEN", "PAID"), n, version),
                "due_date": day
            },
            "payments": {
                "invoice_id": self.key("invoices", self.number("pay-inv", self.rows["invoices"], n)),
                "amount": price,
                "payment_status": self.pick("done", ("SUCCESS", "FAILED"), n, version),
                "processor_ref": F.concat(F.lit("ref-"), F.hex(F.xxhash64(n, version)))
            },
        }[table]
        return {KEYS[table]: self.key(table, n)} | own


def snapshot(spark: SparkSession, scale: str | Scale, seed: int = 42) -> dict[str, DataFrame]:
    size = SCALES[scale] if isinstance(scale, str) else scale
    made, before, out = _Maker(seed, size.rows), 0, {}
    for t in TABLES:
        n = F.col("id") + 1
        out[t] = spark.range(0, size.rows[t], 1, _files(size.rows[t])).select(
            *(v.alias(c) for c, v in made.fields(t, n, F.lit(0)).items()),
            (n + before).alias("source_sequence"),
            F.lit(_START).alias("created_at"),
            F.lit(_START).alias("updated_at")
        )
        before += size.rows[t]
    return out


def write_snapshot(spark: SparkSession, root: str | Path, scale: str = "tiny", seed: int = 42) -> dict:
    folder, size = Path(root) / "snapshot", SCALES[scale]
    for t, df in snapshot(spark, scale, seed).items():
        df.write.mode("overwrite").json(str(folder / f"{t}.jsonl"))
    meta = {
        "scale": scale,
        "seed": seed,
        "counts": size.rows,
        "highest_initial_sequence": sum(size.rows.values()),
        "created_at": datetime.now(timezone.utc).isoformat()
    }
    (folder / "snapshot_metadata.json").write_text(json.dumps(meta, indent=2))
    return meta


def changes(
    spark: SparkSession,
    batches: int,
    scale: str | Scale,
    seed: int = 42,
    defects: Defects = Defects(),
    schema_transition_batch: int | None = None
) -> DataFrame:
    """Events of all batches with a column defect (null: none). A late event arrives one batch after its
    sequence's; an out-of-order one swaps its place in arrival, not its sequence."""
    size = SCALES[scale] if isinstance(scale, str) else scale
    made, first = _Maker(seed, size.rows), sum(size.rows.values())
    counts = {t: max(least, round(size.batch_events * share)) for t, (share, least) in SHARE.items()}
    step, parts, before = sum(counts.values()), [], 0
    for t in TABLES:
        n, total = counts[t], counts[t] * batches
        rows = spark.range(0, total, 1, _files(total)).select(
            (F.floor(F.col("id") / n) + 1).cast("long").alias("b"), F.pmod("id", F.lit(n)).alias("i")
        )
        rows = rows.withColumn("source_sequence", F.lit(first + 1) + (F.col("b") - 1) * step + before + F.col("i"))
        u = made.draw(f"op-{t}", "source_sequence")
        rows = rows.withColumn("operation", F.when(u < 0.25, "INSERT").when(u < 0.88, "UPDATE").otherwise("DELETE"))
        rows = rows.withColumn(
            "_n",
            F.when(F.col("operation") == "INSERT", size.rows[t] + (F.col("b") - 1) * n + F.col("i") + 1)
            .otherwise(made.number(f"key-{t}", size.rows[t], "source_sequence"))
        )
        version = (
            F.when(F.col("b") >= schema_transition_batch, 2).otherwise(1)
            if t == "subscriptions" and schema_transition_batch
            else F.lit(1)
        )
        f = made.fields(t, F.col("_n"), F.col("source_sequence"))
        if t == "subscriptions":
            f |= {
                c: F.when(version >= 2, v)
                for c, v in (
                    ("billing_cycle", made.pick("cycle", ("MONTHLY", "ANNUAL"), "_n")), ("currency", F.lit("EUR"))
                )
            }
        whole, key_only = F.to_json(
            F.struct(*(v.alias(c) for c, v in f.items()))
        ), F.to_json(F.struct(f[KEYS[t]].alias(KEYS[t])))
        parts.append(
            rows.select(
                F.lit(t).alias("source_table"),
                "operation",
                made.key(t, F.col("_n")).alias("business_key"),
                "source_sequence",
                "b",
                version.cast("int").alias("schema_version"),
                F.when(F.col("operation") == "DELETE", key_only).otherwise(whole).alias("payload")
            )
        )
        before += n
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    u, at, kind = made.draw("defect", "source_sequence"), 0.0, F.lit(None).cast("string")
    for name, rate in vars(defects).items():
        kind, at = F.when((u >= at) & (u < at + rate), F.lit(name)).otherwise(kind), at + rate
    events = events.withColumn("defect", kind)
    is_ = lambda name: F.col("defect").eqNullSafe(F.lit(name))
    late = is_("late") & (F.col("b") < batches)
    when = lambda shift: F.date_format(
        F.timestamp_seconds(F.lit(1767225600) + F.col("source_sequence") + shift), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
    )
    events = events.select(
        "source_table",
        F.when(is_("unknown_operation"), "UPSERT").otherwise(F.col("operation")).alias("operation"),
        F.when(is_("missing_key"), "").otherwise(F.col("business_key")).alias("business_key"),
        F.when(is_("invalid_sequence"), -F.col("source_sequence"))
        .otherwise(F.col("source_sequence"))
        .alias("source_sequence"),
        F.when(is_("invalid_timestamp"), "not a time").otherwise(when(0)).alias("event_timestamp"),
        when(F.when(late, step).when(is_("out_of_order"), 3600).otherwise(60)).alias("ingested_timestamp"),
        (F.col("b") + late.cast("int")).alias("batch_id"),
        "schema_version",
        F.when(is_("malformed_payload"), F.concat(F.lit("{broken "), "payload"))
        .otherwise(F.col("payload"))
        .alias("payload"),
        "defect",
    ).withColumn("event_id", event_id())
    copies = F.explode(F.when(is_("duplicate"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return events.withColumn("_copy", copies).drop("_copy").select(*ENVELOPE.names, "defect")


def write_changes(
    spark: SparkSession,
    root: str | Path,
    batches: int = 3,
    scale: str = "tiny",
    seed: int = 42,
    defects: Defects = Defects(),
    schema_transition_batch: int | None = None
) -> list[dict]:
    """cdc/batch_id=NNNNNN/ with the events, in order of arrival, and a manifest; returns the manifests."""
    events, out = changes(spark, batches, scale, seed, defects, schema_transition_batch), []
    facts = events.groupBy("batch_id", "source_table").agg(
        F.count("*").alias("n"),
        F.min("source_sequence").alias("lo"),
        F.max("source_sequence").alias("hi"),
        F.array_sort(F.collect_set("schema_version")).alias("versions"),
        F.array_sort(F.collect_set("defect")).alias("defects")
    ).collect()  # a row for each batch and table
    for b in range(1, batches + 1):
        folder, mine = Path(root) / "cdc" / f"batch_id={b:06d}", [r for r in facts if r.batch_id == b]
        events.where(F.col("batch_id") == b).drop("defect").coalesce(_files(sum(r.n for r in mine))).sortWithinPartitions(
            "ingested_timestamp", "event_id"
        ).write.mode("overwrite").json(str(folder / "events.jsonl"))
        out.append({
            "batch_id": b,
            "created_at": datetime.now(timezone.utc).isoformat(),
            "minimum_source_sequence": min(r.lo for r in mine),
            "maximum_source_sequence": max(r.hi for r in mine),
            "event_count": sum(r.n for r in mine),
            "table_event_counts": {r.source_table: r.n for r in mine},
            "schema_versions": {r.source_table: r.versions for r in mine},
            "defects_injected": sorted({d for r in mine for d in r.defects}),
        })
        (folder / "manifest.json").write_text(json.dumps(out[-1], indent=2))
    return out
