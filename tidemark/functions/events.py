"""Column functions over change events: identities, validation rules, payload parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import ENVELOPE, KEYS, OPERATIONS, PAYLOADS, REQUIRED, TABLES, added_in, payload_schema

_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{3}(?:\d{3})?)?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def event_id(table="source_table", key="business_key", sequence="source_sequence", operation="operation") -> Column:
    """Identity of an event; null if a part is (concat_ws would skip it)."""
    parts = [F.col(c).cast("string") for c in (table, key, sequence, operation)]
    return F.sha2(F.concat(parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2], F.lit(":"), parts[3]), 256)


def canonical_hash() -> Column:
    return F.sha2(F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ENVELOPE.names)), 256)


def history_version_id(key: Column, sequence: Column, event: Column) -> Column:
    return F.sha2(F.concat_ws(":", key, sequence.cast("string"), event), 256)


def replay_id(event="event_id") -> Column:
    return F.sha2(F.concat(F.lit("late-replay:"), F.col(event)), 256)


#: Characters that count as blank: white space of any kind and the separators U+001C to U+001F.
_BLANK = r"^[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*$"


def _blank(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).rlike(_BLANK)


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _by_table(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for t, v in values.items():
        out = F.when(F.col("source_table") == t, v).otherwise(out)
    return out


def reasons() -> Column:
    """All failed rules of an event, joined by "; " in a fixed order; empty for a valid event."""
    known = F.coalesce(F.col("source_table").isin(*TABLES), F.lit(False))
    known_op = F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False))
    registered = (
        F.concat_ws(":", "source_table", F.col("schema_version").cast("string"))
        .isin(*(f"{t}:{v}" for t, v in PAYLOADS))
    )
    bad_version = F.col("schema_version").isNull() | (F.col("schema_version") <= 0)
    bad_sequence = F.col("source_sequence").isNull() | (F.col("source_sequence") <= 0)
    names = F.json_object_keys("payload")
    parsed = F.try_parse_json("payload")
    is_object = names.isNotNull() & parsed.isNotNull()
    checked = known & known_op & is_object & ~_blank("payload")
    pk = _by_table({t: F.get_json_object("payload", f"$.{k}") for t, k in KEYS.items()})
    has_pk = _by_table({t: F.array_contains(names, k) for t, k in KEYS.items()})
    values = F.map_values(F.from_json("payload", "map<string,string>"))
    missing = F.array_sort(_by_table({t: F.array_except(F.array(*map(F.lit, r)), names) for t, r in REQUIRED.items()}))
    whole_id = F.length("event_id") == 64
    complete = known & known_op & ~_blank("business_key") & ~bad_sequence
    rules = [
        F.when(_blank("event_id"), "MISSING_EVENT_ID").when(~whole_id, "INVALID_EVENT_ID_FORMAT"),
        F.when(~known, F.concat(F.lit("UNKNOWN_SOURCE_TABLE: '"), _shown("source_table"), F.lit("'"))),
        F.when(~known_op, F.concat(F.lit("UNKNOWN_OPERATION: '"), _shown("operation"), F.lit("'"))),
        F.when(_blank("business_key"), "MISSING_BUSINESS_KEY"),
        F.when(bad_sequence, F.concat(F.lit("INVALID_SOURCE_SEQUENCE: "), _shown("source_sequence"))),
        F.when(F.col("event_timestamp").isNull() | (F.col("event_timestamp") == ""), "MISSING_EVENT_TIMESTAMP").when(
            ~F.col("event_timestamp").rlike(_TIME) | F.col("event_timestamp").try_cast("timestamp").isNull(),
            F.concat(F.lit("UNPARSEABLE_EVENT_TIMESTAMP: '"), "event_timestamp", F.lit("'"))
        ),
        F.when(
            F.col("batch_id").isNull() | (F.col("batch_id") <= 0),
            F.concat(F.lit("INVALID_BATCH_ID: "), _shown("batch_id"))
        ),
        F.when(bad_version, F.concat(F.lit("INVALID_SCHEMA_VERSION: "), _shown("schema_version"))).when(
            known & ~registered,
            F.concat(
                F.lit("UNSUPPORTED_SCHEMA_VERSION: table '"),
                "source_table",
                F.lit("' does not support schema_version "),
                _shown("schema_version")
            )
        ),
        F.when(_blank("payload"), "MISSING_PAYLOAD")
        .when(parsed.isNull(), "MALFORMED_JSON_PAYLOAD")
        .when(~is_object, "PAYLOAD_NOT_A_JSON_OBJECT"),
        F.when(checked & pk.isNotNull() & ~pk.eqNullSafe(F.col("business_key")), "PAYLOAD_KEY_MISMATCH"),
        F.when(
            checked
            & (F.col("operation") == "DELETE")
            & ~has_pk
            & ~F.coalesce(F.array_contains(values, F.coalesce("business_key", F.lit(""))), F.lit(False)),
            F.concat(
                F.lit("DELETE_PAYLOAD_MISSING_PRIMARY_KEY: '"),
                _by_table({t: F.lit(k) for t, k in KEYS.items()}),
                F.lit("'")
            ),
        ),
        F.when(
            checked & (F.col("operation") != "DELETE") & (F.size(missing) > 0),
            F.concat(F.lit("PAYLOAD_MISSING_REQUIRED_FIELDS: ["), F.array_join(missing, ", "), F.lit("]"))
        ),
        F.when(whole_id & complete & (F.col("event_id") != event_id()), "EVENT_ID_MISMATCH"),
    ]
    return F.array_join(F.array_compact(F.array(*rules)), "; ")


def checked(events: DataFrame) -> DataFrame:
    """events with rejection_reason. The rules are evaluated once a row: a generator of one row keeps filters
    on their result above it, which would else be pushed down with all rules spelled out again."""
    return events.select("*", F.inline_outer(F.array(F.struct(reasons().alias("rejection_reason")))))


def split_valid(events: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the quarantine with reason, time and the original event as JSON."""
    both = checked(events)
    bad = both.where("rejection_reason <> ''").withColumns(
        {
            "original_event": F.to_json(F.struct(*ENVELOPE.names)),
            "processing_timestamp": now
            if now is not None
            else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        }
    )
    return both.where("rejection_reason = ''").drop("rejection_reason"), bad.select(
        *ENVELOPE.names, "original_event", "rejection_reason", "processing_timestamp"
    )


def parse_payload(events: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of one table with payload fields as columns, by the latest schema; fields that a row's
    version does not have are null. The key falls back to business_key. keep: further columns that stay."""
    pk = KEYS[table] if table in KEYS else payload_schema(table)
    since = added_in(table)
    rows = events.where(F.col("source_table") == table).withColumn("_p", F.from_json("payload", payload_schema(table)))
    lineage = [
        "event_id", "source_table", "operation", "business_key", "source_sequence", "event_timestamp",
        "ingested_timestamp", "batch_id", "schema_version"
    ]
    fields = [
        F.coalesce(F.col(f"_p.{f}"), F.col("business_key")).alias(f)
        if f == pk
        else F.when(F.col("schema_version") >= since[f], F.col(f"_p.{f}")).alias(f)
        for f in payload_schema(table).names
    ]
    return rows.select(*lineage, *keep, *fields)
