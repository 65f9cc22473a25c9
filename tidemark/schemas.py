"""Schemas, keys and the registry of payload versions."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = ("accounts", "subscriptions", "invoices", "payments")
OPERATIONS = ("INSERT", "UPDATE", "DELETE")
KEYS = {"accounts": "account_id", "subscriptions": "subscription_id", "invoices": "invoice_id", "payments": "payment_id"}
REQUIRED = {
    "accounts": ("account_id", "company_name", "industry", "plan_tier"),
    "subscriptions": ("subscription_id", "account_id", "plan", "status"),
    "invoices": ("invoice_id", "account_id", "subscription_id", "amount", "status"),
    "payments": ("payment_id", "invoice_id", "amount", "payment_status"),
}
SNAPSHOT_EVENT = "SNAPSHOT_INIT"
#: created_at of snapshot rows that have none.
SNAPSHOT_TIME = "2024-01-01T00:00:00+00:00"
_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "decimal(12,2)": T.DecimalType(12, 2)
}


def struct(spec: str) -> T.StructType:
    """A schema from "name type, ...", without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in spec.split(", "))])


ENVELOPE = struct(
    "event_id string, source_table string, operation string, business_key string, source_sequence bigint, "
    "event_timestamp string, ingested_timestamp string, batch_id bigint, schema_version int, payload string"
)
PAYLOADS = {
    ("accounts", 1): struct("account_id string, company_name string, industry string, country string, plan_tier string"),
    ("subscriptions", 1): struct(
        "subscription_id string, account_id string, plan string, status string, "
        "monthly_amount decimal(12,2), renewal_date string"
    ),
    ("subscriptions", 2): struct(
        "subscription_id string, account_id string, plan string, status string, "
        "monthly_amount decimal(12,2), renewal_date string, billing_cycle string, currency string"
    ),
    ("invoices", 1): struct(
        "invoice_id string, account_id string, subscription_id string, amount decimal(12,2), status string, due_date string"
    ),
    ("payments", 1): struct(
        "payment_id string, invoice_id string, amount decimal(12,2), payment_status string, processor_ref string"
    ),
}
LINEAGE = struct(
    "_last_source_sequence bigint, _last_event_id string, _last_event_timestamp string, "
    "_last_batch_id bigint, _updated_at string, _is_deleted boolean, _last_schema_version int"
)
LEDGER = struct(
    "event_id string, source_table string, business_key string, source_sequence bigint, operation string, "
    "batch_id bigint, event_timestamp string, "
    "apply_outcome string, applied_at string, target_sequence_before bigint, target_sequence_after bigint, reason string"
)
METRICS = struct(
    "batch_id bigint, source_table string, input_valid_unique_events bigint, superseded_events bigint, "
    "candidate_winners bigint, applied_inserts bigint, applied_updates bigint, "
    "applied_deletes bigint, stale_noops bigint, already_applied bigint, recovered_events bigint, "
    "current_active_rows bigint, current_deleted_rows bigint, min_sequence bigint, max_sequence bigint, "
    "processed_at string"
)
STORE = struct(
    "event_id string, source_table string, business_key string, source_sequence bigint, operation string, "
    "event_timestamp string, ingested_timestamp string, arrival_batch_id bigint, "
    "schema_version int, payload string, canonical_event_hash string, is_late_on_arrival boolean, "
    "first_seen_at string, last_seen_at string"
)
HISTORY = struct(
    "subscription_id string, account_id string, plan string, status string, monthly_amount decimal(12,2), "
    "renewal_date string, billing_cycle string, currency string, history_version_id string, "
    "valid_from_sequence bigint, valid_to_sequence bigint, valid_from_event_timestamp string, "
    "valid_to_event_timestamp string, is_current boolean, is_deleted boolean, source_event_id string, "
    "source_operation string, schema_version int, arrival_batch_id bigint, history_updated_at string"
)
QUEUE = struct(
    "event_id string, source_table string, business_key string, source_sequence bigint, "
    "arrival_batch_id bigint, schema_version int, detected_at string, late_reason string, "
    "replay_status string, "
    "replay_attempt_count int, last_replay_at string, failure_reason string"
)
REPLAY_AUDIT = struct(
    "replay_id string, event_id string, source_table string, business_key string, source_sequence bigint, "
    "status string, history_versions_before bigint, history_versions_after bigint, "
    "current_sequence_before bigint, current_sequence_after bigint, current_state_changed boolean, "
    "attempt_number int, started_at string, completed_at string, failure_reason string"
)


def is_registered(table: str, version: int) -> bool:
    return (table, version) in PAYLOADS


def payload_schema(table: str, version: int | None = None) -> T.StructType:
    """The payload of a version; without one, the latest, which holds the earlier ones' fields."""
    if table not in KEYS:
        raise ValueError(f"unknown table {table!r}")
    versions = sorted(v for t, v in PAYLOADS if t == table)
    if version is not None and version not in versions:
        raise ValueError(f"table {table!r} has no schema version {version}")
    return PAYLOADS[table, versions[-1] if version is None else version]


def added_in(table: str) -> dict[str, int]:
    """The version that brought each payload field."""
    out: dict[str, int] = {}
    for t, v in sorted(PAYLOADS):
        if t == table:
            for f in PAYLOADS[t, v].names:
                out.setdefault(f, v)
    return out


def state_schema(table: str) -> T.StructType:
    return T.StructType([*payload_schema(table).fields, *LINEAGE.fields])
