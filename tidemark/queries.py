"""One query for each operator over change events, and the same in SQL of another engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.events import parse_payload, split_valid
from tidemark.operators import events as ops
from tidemark.operators import history, merge
from tidemark.schemas import KEYS, LEDGER, OPERATIONS, PAYLOADS, REQUIRED, TABLES, payload_schema
from tidemark.sources import envelope
from tidemark.sources.tables import Table, scratch

BATCH = ("batch_id", "source_table")
NOW = "2025-01-01T00:00:00+00:00"


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return split_valid(envelope.events(spark, d), F.lit(NOW))[0]


def _unique(spark: SparkSession, d: str) -> DataFrame:
    return ops.deduplicate(_valid(spark, d), BATCH)[0]


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return merge.outcomes(_unique(spark, d), envelope.snapshot(spark, d))


def _state(spark: SparkSession, d: str, table: str) -> DataFrame:
    """Current state of one table after all batches."""
    results = _outcomes(spark, d).where(f"source_table = '{table}'")
    parsed = parse_payload(results, table, ("apply_outcome",)).drop(KEYS[table])
    return merge.state_of(parsed, envelope.snapshot(spark, d, table), table)


def _subscriptions(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d, "subscriptions")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def _state_columns(state: DataFrame, table: str = "subscriptions") -> DataFrame:
    money = merge.MONEY.get(table)
    own = [_cents(c).alias(c.replace("amount", "cents")) if c == money else F.col(c) for c in payload_schema(table).names]
    return state.select(
        *own, "_last_source_sequence", "_last_event_id", "_last_batch_id", "_is_deleted", "_last_schema_version"
    )


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    """The invariants of all four tables, a row each."""
    out = []
    for t in TABLES:
        state = _state(spark, d, t)
        total = state.agg(
            F.sum(_cents(merge.MONEY[t]) if t in merge.MONEY else F.lit(None).cast("long")).alias("money_cents")
        )
        facts = merge.reconcile(state, KEYS[t]).crossJoin(total)  # two rows of one
        out.append(
            facts.withColumns({"source_table": F.lit(t), "money_is_decimal": F.lit(merge.money_is_decimal(state, t))})
        )
    return reduce(DataFrame.unionByName, out)


def _store(spark: SparkSession, d: str) -> DataFrame:
    return ops.store_of(_unique(spark, d))


def _history(spark: SparkSession, d: str) -> DataFrame:
    base = envelope.snapshot(spark, d, "subscriptions")
    return history.build(base, _store(spark, d).where("source_table = 'subscriptions'"), F.lit(NOW))


def _history_columns(h: DataFrame) -> DataFrame:
    cents = F.round(F.col("monthly_amount") * 100).cast("long").alias("monthly_cents")
    return h.select(
        "subscription_id", "account_id", "plan", "status", cents, "renewal_date", "billing_cycle", "currency",
        "history_version_id", "valid_from_sequence", "valid_to_sequence", "is_current", "is_deleted",
        "source_event_id", "source_operation", "schema_version", "arrival_batch_id"
    )


def _collided(spark: SparkSession, d: str) -> DataFrame:
    """Valid events and, for every 100th, another one of its key and sequence."""
    e = _valid(spark, d).select("event_id", "source_table", "business_key", "source_sequence")
    return e.unionByName(e.where("source_sequence % 100 = 1").withColumn("event_id", F.sha2("event_id", 256)))


def _offered(spark: SparkSession, d: str) -> DataFrame:
    """The whole store as a batch, where some events differ: in payload, operation, sequence or version."""
    n = F.col("source_sequence") % 100
    return _store(spark, d).withColumns(
        {
            "payload": F.when(n == 1, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")),
            "operation": F.when(n == 2, "UPDATE").otherwise(F.col("operation")),
            "schema_version": F.when(n == 3, 2).otherwise(F.col("schema_version")),
            "last_seen_at": F.lit(NOW),
        }
    )


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ops.identity_conflicts(_store(spark, d), _offered(spark, d))


def _collapsed(spark: SparkSession, d: str) -> DataFrame:
    return ops.collapse(_unique(spark, d))


def _tampered(spark: SparkSession, d: str) -> DataFrame:
    """History with faults of every kind: by the version's first sequence, intervals are cut short, current
    versions closed, closed ones made current, version ids shared, and versions repeated or moved."""
    h, n = _history(spark, d), F.col("valid_from_sequence")
    h = h.withColumn(
        "valid_to_sequence", F.when(n % 10 == 0, F.col("valid_to_sequence") - 1).otherwise(F.col("valid_to_sequence"))
    )
    h = h.withColumn("is_current", F.when(n % 23 == 0, ~F.col("is_current")).otherwise(F.col("is_current")))
    h = h.withColumn("history_version_id", F.when(n % 31 == 0, "shared").otherwise(F.col("history_version_id")))
    return h.unionByName(
        h.where(n % 41 == 0)
        .withColumns({"history_version_id": F.lit(None).cast("string"), "source_event_id": F.lit("zzz")})
    )


def _queue(spark: SparkSession, d: str) -> DataFrame:
    late = ops.behind_current(
        _store(spark, d).where("source_table = 'subscriptions'"), _subscriptions(spark, d), "subscription_id"
    )
    return history.queue_rows(late, F.lit(NOW))


def _written(df: DataFrame) -> DataFrame:
    """df as a table of the scratch folder, as the replay lane finds its inputs."""
    t = Table(df.sparkSession, scratch(df.sparkSession))
    t.commit(df)
    return t.read()


def _replayed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queue, history, state, audit) after the whole queue is replayed with repair, from the seeded history."""
    base = _written(envelope.snapshot(spark, d, "subscriptions"))
    store = _written(_store(spark, d).where("source_table = 'subscriptions'"))
    state = _written(_subscriptions(spark, d).withColumn("_updated_at", F.lit(NOW)))
    queue = _written(history.queue_rows(ops.behind_current(store, state, "subscription_id"), F.lit(NOW)))
    return history.replay(queue, store, base, _written(history.seed(base, F.lit(NOW))), state, F.lit(NOW), True)


def _changed(spark: SparkSession, d: str, change: Callable[[Table, DataFrame], object]) -> DataFrame:
    """A table of the snapshot's keys in the session's scratch folder, after a change by (k, n, v) rows: every
    fifth key changed, every seventh anew under another one."""
    rows = envelope.snapshot(spark, d).select(
        F.col("business_key").alias("k"), F.col("source_sequence").alias("n"), F.col("status").alias("v")
    )
    t = Table(spark, scratch(spark))
    t.commit(rows, "snapshot", keys=["k"])
    new = rows.where("n % 5 = 0").withColumns({"n": F.col("n") + 1, "v": F.lit("CHANGED")})
    change(t, new.unionByName(rows.where("n % 7 = 0").withColumns({"k": F.concat("k", F.lit("-new")), "v": F.lit("NEW")})))
    return t.read()


def _merged_table(spark: SparkSession, d: str) -> DataFrame:
    """State and ledger tables of subscriptions after the batches up to the third, each merged against what the last
    one left."""
    state, ledger = (Table(spark, scratch(spark)) for _ in range(2))
    state.commit(
        merge.snapshot_state(envelope.snapshot(spark, d, "subscriptions"), "subscriptions", F.lit(NOW)),
        keys=["subscription_id"]
    )
    ledger.create(LEDGER, ["event_id"])
    for batch in (1, 2, 3):
        parsed = parse_payload(_unique(spark, d).where(f"batch_id = {batch}"), "subscriptions")
        pin = state.pin(parsed)
        new, audit = merge.apply_batch(parsed, pin.df, ledger.pin(parsed).df, "subscriptions", F.lit(NOW))
        pin.commit(new, "merge")
        ledger.upsert(audit, ["event_id"])
    return state.read()


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    at = envelope.snapshot(spark, d, "subscriptions").select(
        "subscription_id", (F.lit(1000000) + F.col("source_sequence") * 7).alias("sequence")
    )
    return history.as_of(_history(spark, d), at).select(
        "subscription_id", "sequence", "history_version_id", "plan", "status"
    )


_AUDIT = (
    "replay_id", "event_id", "source_table", "business_key", "source_sequence", "status", "history_versions_before",
    "history_versions_after", "current_sequence_before", "current_sequence_after", "current_state_changed",
    "attempt_number", "failure_reason"
)
_KEEP = ("event_id", "source_table", "business_key", "source_sequence", "batch_id", "ingested_timestamp")
_OUT = (
    "event_id", "source_table", "business_key", "batch_id", "source_sequence", "apply_outcome",
    "target_sequence_before", "target_sequence_after", "reason"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "diag_events_by_operation": lambda s, d: ops.by_operation(_unique(s, d)),
    "diag_events_by_source_table": lambda s, d: ops.by_source_table(_unique(s, d)),
    "diag_sequence_range_by_batch": lambda s, d: ops.sequence_range(_unique(s, d)),
    "diag_update_frequency": lambda s, d: ops.update_frequency(_unique(s, d)),
    "diag_late_events": lambda s, d: ops.late_summary(ops.late_by_mark(_unique(s, d))),
    "diag_invalid_by_reason": lambda s, d: ops.by_reason(split_valid(envelope.events(s, d), F.lit(NOW))[1]),
    "quarantine": lambda s, d: split_valid(envelope.events(s, d), F.lit(NOW))[1].select(
        "event_id", "batch_id", "ingested_timestamp", "rejection_reason"
    ),
    "batch_metrics": lambda s, d: ops.batch_metrics(envelope.events(s, d)),
    "dedup_kept": lambda s, d: _unique(s, d).select(*_KEEP),
    "dedup_dropped": lambda s, d: ops.deduplicate(_valid(s, d), BATCH)[1].select(*_KEEP),
    "collapse_winners": lambda s, d: _collapsed(s, d).where("collapse_rank = 1").select(
        "event_id", "source_table", "business_key", "batch_id"
    ),
    "collapse_superseded": lambda s, d: _collapsed(s, d).where("collapse_rank > 1").select(
        "event_id", "source_table", "business_key", "batch_id"
    ),
    "hwm_progression": lambda s, d: ops.high_water_marks(_unique(s, d)),
    "late_vs_hwm": lambda s, d: ops.late_by_mark(_unique(s, d)).select(
        "event_id", "batch_id", "source_sequence", "hwm_before"
    ),
    "merge_outcomes": lambda s, d: _outcomes(s, d).select(*_OUT),
    "applied_events_ledger": lambda s, d: merge.ledger_of(_outcomes(s, d)).select(*_OUT),
    "apply_outcome_counts": lambda s, d: merge.outcome_counts(_outcomes(s, d)),
    "stale_events": lambda s, d: _outcomes(s, d).where("apply_outcome = 'STALE_NOOP'").select(
        "event_id", "batch_id", "source_sequence", "target_sequence_before"
    ),
    "reactivated_keys": lambda s, d: merge.reactivated(_outcomes(s, d)),
    "merge_current_state": lambda s, d: _state_columns(_subscriptions(s, d)),
    "active_state": lambda s, d: _state_columns(merge.active(_subscriptions(s, d))),
    "tombstones": lambda s, d: _state_columns(merge.tombstones(_subscriptions(s, d))),
    "reconcile_current_state": lambda s, d: merge.reconcile(_subscriptions(s, d), "subscription_id"),
    "event_store": lambda s, d: _store(s, d).select(
        "event_id", "source_table", "business_key", "source_sequence", "arrival_batch_id", "canonical_event_hash",
        "first_seen_at", "last_seen_at"
    ),
    "event_identity_conflicts": _conflicts,
    "sequence_collisions": lambda s, d: ops.sequence_collisions(_collided(s, d)),
    "late_queue_candidates": lambda s, d: ops.behind_current(
        _store(s, d).where("source_table = 'subscriptions'"), _subscriptions(s, d), "subscription_id"
    ).select("event_id", "business_key", "source_sequence", "curr_seq"),
    "scd2_seed": lambda s, d: _history_columns(history.seed(envelope.snapshot(s, d, "subscriptions"), F.lit(NOW))),
    "scd2_history": lambda s, d: _history_columns(_history(s, d)),
    "scd2_invariant_violations": lambda s, d: history.violations(_tampered(s, d)),
    "scd2_drift": lambda s, d: history.drift(_history(s, d), _subscriptions(s, d)),
    "scd2_as_of": _as_of,
    "current_accounts": lambda s, d: _state_columns(_state(s, d, "accounts"), "accounts"),
    "current_invoices": lambda s, d: _state_columns(_state(s, d, "invoices"), "invoices"),
    "current_payments": lambda s, d: _state_columns(_state(s, d, "payments"), "payments"),
    "reconcile_all_tables": _reconciled,
    "late_event_queue": lambda s, d: _queue(s, d).select(
        "event_id", "source_table", "business_key", "source_sequence", "arrival_batch_id", "schema_version",
        "late_reason", "replay_status", "replay_attempt_count"
    ),
    "replay_audit": lambda s, d: _replayed(s, d)[3].select(*_AUDIT),
    "replay_queue": lambda s, d: _replayed(s, d)[0].select(
        "event_id", "replay_status", "replay_attempt_count", "failure_reason"
    ),
    "replay_history": lambda s, d: _history_columns(_replayed(s, d)[1]),
    "replay_repaired_state": lambda s, d: _state_columns(_replayed(s, d)[2]),
    "table_upsert": lambda s, d: _changed(s, d, lambda t, rows: t.upsert(rows, ["k"])),
    "table_insert_only": lambda s, d: _changed(s, d, lambda t, rows: t.insert_only(rows, ["k"])),
    "table_append_columns": lambda s, d: _changed(
        s, d, lambda t, rows: (t.add_columns({"w": "bigint"}), t.append(rows.withColumn("w", F.col("n") * 2)))
    ),
    "table_update_where": lambda s, d: _changed(
        s, d, lambda t, rows: t.update_where(F.col("n") % 3 == 1, {"v": F.lit("UPDATED")})
    ),
    "table_delete_where": lambda s, d: _changed(s, d, lambda t, rows: t.delete_where(F.col("n") % 3 == 1)),
    "table_merge_batches": lambda s, d: _state_columns(_merged_table(s, d)),
}

# The same in SQL

_TABLE_CASE = lambda values: "case source_table " + " ".join(
    f"when '{t}' then {v}" for t, v in values.items()
) + " end"
_PK = _TABLE_CASE({t: f"'{k}'" for t, k in KEYS.items()})
_REGISTERED = ", ".join(f"'{t}:{v}'" for t, v in PAYLOADS)
_SAFE = "case when json_valid(payload) then payload else '{}' end"
_OBJECT = f"(json_valid(payload) and json_type({_SAFE}) = 'OBJECT')"
_NAMES = f"json_keys({_SAFE})"
_CHECKED = f"""
, named as (select *, {_PK} as pk_name, {_NAMES} as names, source_table in {TABLES} as known,
  operation in {OPERATIONS} as known_op, {_OBJECT} as is_object from env),
checked as (select * exclude (pk_name, names, known, known_op, is_object), array_to_string(list_filter([
  case when trim(event_id) = '' then 'MISSING_EVENT_ID' when length(event_id) <> 64 then 'INVALID_EVENT_ID_FORMAT' end,
  case when not known_op then concat('UNKNOWN_OPERATION: ''', operation, '''') end,
  case when trim(business_key) = '' then 'MISSING_BUSINESS_KEY' end,
  case when source_sequence <= 0 then concat('INVALID_SOURCE_SEQUENCE: ', source_sequence) end,
  case when not regexp_matches(event_timestamp, '^\\d{{4}}-\\d\\d-\\d\\dT') then
    concat('UNPARSEABLE_EVENT_TIMESTAMP: ''', event_timestamp, '''') end,
  case when batch_id <= 0 then concat('INVALID_BATCH_ID: ', batch_id) end,
  case when concat(source_table, ':', schema_version) not in ({_REGISTERED}) then
    concat('UNSUPPORTED_SCHEMA_VERSION: table ''', source_table, ''' does not support schema_version ',
    schema_version) end,
  case when not json_valid(payload) then 'MALFORMED_JSON_PAYLOAD' when not is_object then 'PAYLOAD_NOT_A_JSON_OBJECT' end,
  case when known_op and is_object and json_extract_string({_SAFE}, concat('$.', pk_name)) <> business_key then
    'PAYLOAD_KEY_MISMATCH' end,
  case when known_op and is_object and operation <> 'DELETE'
    and not list_has_all(names, req) then concat('PAYLOAD_MISSING_REQUIRED_FIELDS: [',
    array_to_string(list_sort(list_filter(req, lambda x: not list_contains(names, x))), ', '), ']') end,
  case when length(event_id) = 64 and known and known_op and trim(business_key) <> '' and source_sequence > 0
    and event_id <> sha256(concat(source_table, ':', business_key, ':', source_sequence, ':', operation)) then
    'EVENT_ID_MISMATCH' end
  ], lambda x: x is not null), '; ') as rejection_reason
  from (select *, {_TABLE_CASE({t: str(sorted(r)) for t, r in REQUIRED.items()})} as req from named) q),
hashed as (select * exclude (req), sha256(concat_ws('||', event_id, source_table, operation, business_key,
  source_sequence, event_timestamp, ingested_timestamp, batch_id, schema_version, payload)) as canonical_event_hash
  from checked),
ranked as (select *, row_number() over (partition by batch_id, source_table, rejection_reason <> '', event_id
  order by ingested_timestamp nulls last, source_sequence, canonical_event_hash) as delivery_rank from hashed),
uniq as (select * exclude (rejection_reason, delivery_rank) from ranked where rejection_reason = '' and delivery_rank = 1),
snap as ({envelope.SNAPSHOT_SQL})
"""
_MERGED = """
, coll as (select *, row_number() over (partition by batch_id, source_table, business_key
  order by source_sequence desc, event_id desc) as collapse_rank from uniq),
al as (select source_table, business_key, source_sequence, batch_id, event_id, operation, schema_version, payload
  from coll where collapse_rank = 1
  union all select source_table, business_key, source_sequence, 0, 'SNAPSHOT_INIT', 'SNAPSHOT_INIT', null, null from snap),
before as (select *, max(source_sequence) over f as tseq,
  (max({'s': source_sequence, 'b': -batch_id, 'e': event_id}) over f).e as tid from al
  window f as (partition by source_table, business_key order by batch_id rows between unbounded preceding and 1 preceding)),
res as (select event_id, source_table, business_key, batch_id, source_sequence, operation, schema_version,
  payload, tseq as target_sequence_before,
  case when tseq is not null and tid = event_id and tseq = source_sequence then 'ALREADY_APPLIED'
    when tseq is not null and source_sequence
    <= tseq then 'STALE_NOOP' else concat('APPLIED_', operation) end as apply_outcome
  from before where batch_id > 0
  union all select event_id, source_table, business_key, batch_id, source_sequence, operation, schema_version,
    payload, null, 'SUPERSEDED_WITHIN_BATCH' from coll where collapse_rank > 1),
outc as (select *, case when apply_outcome like 'APPLIED%' then source_sequence else target_sequence_before
  end as target_sequence_after,
  case apply_outcome when 'ALREADY_APPLIED' then 'ALREADY_APPLIED_IN_TARGET_AND_LEDGER'
    when 'STALE_NOOP' then 'SOURCE_SEQUENCE_LEQ_TARGET'
    when 'SUPERSEDED_WITHIN_BATCH' then 'SUPERSEDED_BY_HIGHER_SEQUENCE_EVENT_IN_SAME_BATCH' end as reason from res)
"""
_X = lambda c: f"json_extract_string({_SAFE}, '$.{c}')"
_CENTS = "cast(round(cast({} as decimal(12,2)) * 100) as bigint)"


def _state_sql(table: str, name: str) -> str:
    """Current state of one table after all batches, as the relation name."""
    pk, money, fields = KEYS[table], merge.MONEY.get(table), [f for f in payload_schema(table).names if f != KEYS[table]]
    given = (
        {"account_id", "plan", "status", "monthly_amount", "renewal_date"}
        - ({"account_id"} if table == "accounts" else set())
    )
    out = {f: f.replace("amount", "cents") if f == money else f for f in fields}
    image = ", ".join((_CENTS.format(_X(f)) if f == money else _X(f)) + f" as {out[f]}" for f in fields)
    start = ", ".join((_CENTS.format(f) if f == money else f) if f in given else "null" for f in fields)
    late = {f for f in fields if f not in payload_schema(table, 1).names}
    columns = ", ".join(f"{'v' if f in late else 'i'}.{out[f]}" for f in fields)
    last = f"row_number() over (partition by {pk} order by source_sequence desc) as r from {name}_img"
    return f"""
, {name}_img as (select business_key as {pk}, source_sequence, event_id, batch_id, operation, schema_version,
  {image} from outc where source_table = '{table}' and apply_outcome like 'APPLIED%'
  union all select business_key, source_sequence, 'SNAPSHOT_INIT', 0, 'SNAPSHOT_INIT', 1, {start} from snap
    where source_table = '{table}'),
{name}_i as (select *, {last} where operation <> 'DELETE'),
{name}_v as (select *, {last} where operation <> 'DELETE' and schema_version >= 2),
{name}_l as (select *, {last}),
{name} as (select l.{pk}, {columns}, l.source_sequence as _last_source_sequence, l.event_id as _last_event_id,
  l.batch_id as _last_batch_id, l.operation = 'DELETE' as _is_deleted, l.schema_version as _last_schema_version
  from {name}_l l left join {name}_i i on i.{pk} = l.{pk} and i.r = 1 left join {name}_v v on v.{pk} = l.{pk}
    and v.r = 1 where l.r = 1)
"""


_STATE = _state_sql("subscriptions", "state")
_STORED = """
, stored as (select *, batch_id as arrival_batch_id,
  row_number() over (partition by event_id order by batch_id, ingested_timestamp nulls last, source_sequence,
  canonical_event_hash) as r,
    min(ingested_timestamp) over (partition by event_id) as first_seen_at,
      max(ingested_timestamp) over (partition by event_id) as last_seen_at from uniq),
store as (select * exclude (r) from stored where r = 1)
"""
_PRESENT = lambda c: f"list_contains(json_keys({_SAFE}), '{c}')"
_BASE_OR = lambda when: f"operation = 'SNAPSHOT_INIT' or (operation <> 'DELETE' and {when})"


def _carry(c: str, when: str, value: str | None = None) -> str:
    boxed = (
        f"case when operation = 'DELETE' then {{'v': 'CANCELLED'}} when {_BASE_OR(when)} then {{'v': v_{c}}} end"
        if c == "status"
        else f"case when {_BASE_OR(when)} then {{'v': v_{c}}} end"
    )
    return f"last_value({boxed} ignore nulls) over so_far as b_{c}"


_HISTORY = f"""
, hrows as (select business_key as subscription_id, source_sequence, event_id, operation, 0 as arrival_batch_id,
  1 as schema_version, null as payload, account_id as v_account_id, plan as v_plan, status as v_status,
    {_CENTS.format('monthly_amount')} as v_monthly_cents, renewal_date as v_renewal_date,
      cast(null as varchar) as v_billing_cycle, cast(null as varchar) as v_currency
  from (select *, 'SNAPSHOT_INIT' as event_id, 'SNAPSHOT_INIT' as operation from snap) where source_table = 'subscriptions'
  union all select business_key, source_sequence, event_id, operation, arrival_batch_id, schema_version, payload,
    {_X('account_id')}, {_X('plan')}, {_X('status')}, {_CENTS.format(_X('monthly_amount'))}, {_X('renewal_date')},
    {_X('billing_cycle')}, {_X('currency')}
  from store where source_table = 'subscriptions' and business_key in (select business_key from snap)),
carried as (select *, {', '.join(_carry(c, _PRESENT(c)) for c in ('account_id', 'plan', 'status', 'renewal_date'))}, 
    {_carry('monthly_cents', 'v_monthly_cents is not null')}, {_carry('billing_cycle', 'schema_version >= 2')},
    {_carry('currency', 'schema_version >= 2')},
    lead(source_sequence) over o as valid_to_sequence from hrows
  window so_far as (partition by subscription_id order by source_sequence,
    event_id rows between unbounded preceding and current row),
    o as (partition by subscription_id order by source_sequence, event_id)),
hist as (select subscription_id, b_account_id.v as account_id, b_plan.v as plan, b_status.v as status,
  b_monthly_cents.v as monthly_cents, b_renewal_date.v as renewal_date, b_billing_cycle.v as billing_cycle,
  b_currency.v as currency,
    sha256(concat(subscription_id, ':', source_sequence, ':', event_id)) as history_version_id,
      source_sequence as valid_from_sequence, valid_to_sequence, valid_to_sequence is null as is_current,
      operation = 'DELETE' as is_deleted,
    event_id as source_event_id, operation as source_operation, cast(schema_version as int) as schema_version,
      cast(arrival_batch_id as bigint) as arrival_batch_id from carried)
"""
_MARKS = """
, marks as (select source_table, batch_id, batch_max,
  coalesce(max(batch_max) over (partition by source_table order by batch_id rows between unbounded preceding
  and 1 preceding), 0) as hwm_before
  from (select source_table, batch_id, max(source_sequence) as batch_max from uniq group by all)),
late as (select u.*, m.hwm_before from uniq u join marks m using (source_table, batch_id) where hwm_before > 0
  and source_sequence <= hwm_before)
"""
_FAULTS = """
, cut as (select * replace (case when valid_from_sequence % 10 = 0 then valid_to_sequence - 1 else
  valid_to_sequence end as valid_to_sequence, case
  when valid_from_sequence % 23 = 0 then not is_current else is_current end as is_current,
    case when valid_from_sequence % 31 = 0 then 'shared' else history_version_id end as history_version_id) from hist),
tam as (select * from cut union all select * replace (null as history_version_id, 'zzz' as source_event_id)
  from cut where valid_from_sequence % 41 = 0),
marked as (select *, lead(valid_from_sequence) over
  (partition by subscription_id order by valid_from_sequence, source_event_id) as nxt,
  count(*) over (partition by history_version_id) as same_id from tam),
broken as (select subscription_id, max(same_id) > 1 as f1,
  count(distinct valid_from_sequence) < count(*) as f2,
  bool_or(not is_current and (valid_to_sequence is null or valid_to_sequence <= valid_from_sequence)) as f3,
    bool_or(nxt is not null and valid_to_sequence is distinct from nxt) as f4,
      count(*) filter (is_current) <> 1 as f5, bool_or(is_current
      and (valid_to_sequence is not null or nxt is not null)) as f6 from marked group by all)
select subscription_id, rule from broken cross
  join (values ('DUPLICATE_VERSION_ID'), ('DUPLICATE_FROM_SEQUENCE'), ('BAD_CLOSED_INTERVAL'), ('GAP_OR_OVERLAP'),
  ('NOT_ONE_CURRENT'), ('CURRENT_NOT_LAST')) r(rule)
where case rule when 'DUPLICATE_VERSION_ID' then f1 when 'DUPLICATE_FROM_SEQUENCE' then f2
  when 'BAD_CLOSED_INTERVAL' then f3 when 'GAP_OR_OVERLAP' then f4 when 'NOT_ONE_CURRENT' then f5 else f6 end"""
_DUE = """
, due as (select s.event_id, s.business_key, s.source_sequence, s.arrival_batch_id, s.schema_version from store s
  join state t on s.business_key = t.subscription_id where s.source_table = 'subscriptions'
  and s.source_sequence < t._last_source_sequence),
seen as (select business_key, min(source_sequence) as low, count(*) as events, count(*) >
  count(distinct source_sequence) as collides, max(source_sequence) as top from store
  where source_table = 'subscriptions' and business_key in (select business_key from due) group by all),
verdict as (select e.business_key, s.source_sequence as base, e.events + 1 as versions, case
  when s.business_key is not null then 1 end as versions_before, e.top,
    case when s.business_key is null then 'NO_SNAPSHOT' when collides then 'COLLISION'
      when low <= s.source_sequence then 'BEHIND_SNAPSHOT' end as why
  from seen e left join snap s on s.source_table = 'subscriptions' and s.business_key = e.business_key)
"""
_SEED = f"""with snap as ({envelope.SNAPSHOT_SQL}),
  kv as (select business_key as k, source_sequence as n, status as v from snap),
new as (select k, n + 1 as n, 'CHANGED' as v from kv where n % 5 = 0 union all select concat(k, '-new'), n, 'NEW'
  from kv where n % 7 = 0)
"""


def _FACTS(t: str) -> str:  # noqa: N802
    money = (
        f"cast(sum({merge.MONEY[t].replace('amount', 'cents')}) as bigint)"
        if t in merge.MONEY
        else "cast(null as bigint)"
    )
    return f"""select '{t}' as source_table, count(*) as total_rows, count(distinct {KEYS[t]}) as distinct_keys,
      count(*) filter ({KEYS[t]} is null) as null_keys,
      count(*) filter (_last_source_sequence <= 0) as bad_sequences,
  count(*) filter (not _is_deleted) as active_rows, count(*) filter (_is_deleted) as deleted_rows,
    {money} as money_cents, true as money_is_decimal from s_{t}"""


_K = ", ".join(_KEEP)
_O = ", ".join(_OUT)
_V = _CHECKED
_M = _CHECKED + _MERGED
_S = _M + _STATE
_H = _CHECKED + _STORED + _HISTORY
_R = _S + _STORED + _HISTORY + _DUE

ORACLES: dict[str, str] = {
    k: envelope.spelled(envelope.ENVELOPE_SQL, envelope.DUCKDB) + v
    for k, v in {
        "diag_events_by_operation": _V + "select operation, count(*) as event_count from uniq group by all",
        "diag_events_by_source_table": _V + "select source_table, operation, count(*) as event_count from uniq group by all",
        "diag_sequence_range_by_batch": _V
        + (
            "select batch_id, min(source_sequence) as min_seq, max(source_sequence) as max_seq, "
            "count(*) as event_count from uniq group by all"
        ),
        "diag_update_frequency": _V
        + (
            "select source_table, business_key, count(*) as update_count from uniq "
            "where operation = 'UPDATE' group by all order by 3 desc, 1, 2 limit 10"
        ),
        "diag_late_events": _V
        + _MARKS
        + (
            "select source_table, batch_id, count(*) as late_count, min(source_sequence) as min_seq, "
            "max(source_sequence) as max_seq from late group by all"
        ),
        "diag_invalid_by_reason": _V
        + "select rejection_reason, count(*) as event_count from checked where rejection_reason <> '' group by all",
        "quarantine": _V
        + "select event_id, batch_id, ingested_timestamp, rejection_reason from checked where rejection_reason <> ''",
        "batch_metrics": _V
        + (
            "select batch_id, source_table, count(*) as raw_events, "
            "count(*) filter (rejection_reason <> '') as invalid_events, "
            "count(*) filter (rejection_reason = '' and delivery_rank > 1) as duplicate_events, "
            "count(*) filter (rejection_reason = '' and delivery_rank = 1) as valid_unique_events "
            "from ranked group by all"
        ),
        "dedup_kept": _V + f"select {_K} from uniq",
        "dedup_dropped": _V + f"select {_K} from ranked where rejection_reason = '' and delivery_rank > 1",
        "collapse_winners": _M + "select event_id, source_table, business_key, batch_id from coll where collapse_rank = 1",
        "collapse_superseded": _M
        + "select event_id, source_table, business_key, batch_id from coll where collapse_rank > 1",
        "hwm_progression": _V + _MARKS + "select * from marks",
        "late_vs_hwm": _V + _MARKS + "select event_id, batch_id, source_sequence, hwm_before from late",
        "merge_outcomes": _M + f"select {_O} from outc",
        "applied_events_ledger": _M
        + (
            f"select {_O} from (select *, row_number() over (partition by event_id order by batch_id desc) as "
            f"r from outc) where r = 1"
        ),
        "apply_outcome_counts": _M
        + "select batch_id, source_table, apply_outcome, count(*) as events from outc group by all",
        "stale_events": _M
        + "select event_id, batch_id, source_sequence, target_sequence_before from outc where apply_outcome = 'STALE_NOOP'",
        "reactivated_keys": _M
        + (
            "select source_table, business_key, count(*) as reactivations "
            "from (select *, lag(operation) over (partition by source_table, business_key "
            "order by source_sequence) as b from outc where apply_outcome like 'APPLIED%') "
            "where b = 'DELETE' and operation <> 'DELETE' group by all"
        ),
        "merge_current_state": _S + "select * from state",
        "active_state": _S + "select * from state where not _is_deleted",
        "tombstones": _S + "select * from state where _is_deleted",
        "reconcile_current_state": _S
        + (
            "select count(*) as total_rows, count(distinct subscription_id) as distinct_keys, "
            "count(*) filter (subscription_id is null) as null_keys, "
            "count(*) filter (_last_source_sequence <= 0) as bad_sequences, "
            "count(*) filter (not _is_deleted) as active_rows, count(*) filter (_is_deleted) as deleted_rows "
            "from state"
        ),
        "event_store": _V
        + _STORED
        + (
            "select event_id, source_table, business_key, source_sequence, arrival_batch_id, "
            "canonical_event_hash, first_seen_at, last_seen_at from store"
        ),
        "event_identity_conflicts": _V + _STORED + """,
          offered as (select * replace (case when source_sequence % 100 = 1 then concat(payload, ' ') else payload
          end as payload,
  case when source_sequence % 100 = 2 then 'UPDATE' else operation end as operation, case
    when source_sequence % 100 = 3 then 2 else schema_version end as schema_version) from store)
  select distinct o.event_id from offered o join store s on o.event_id = s.event_id
    where (o.source_table, o.business_key, o.source_sequence, o.operation, o.payload, o.schema_version) is distinct
    from (s.source_table, s.business_key, s.source_sequence, s.operation, s.payload, s.schema_version)""",
        "sequence_collisions": _V + """select source_table, business_key, source_sequence,
          count(distinct event_id) as events from (select source_table, business_key, source_sequence, event_id
          from checked where rejection_reason = ''
  union all select source_table, business_key, source_sequence, sha256(event_id) from checked
    where rejection_reason = '' and source_sequence % 100 = 1) group by all having count(distinct event_id) > 1""",
        "late_queue_candidates": _S
        + _STORED
        + (
            "select event_id, business_key, source_sequence, _last_source_sequence as curr_seq from store "
            "join state on business_key = subscription_id where source_table = 'subscriptions' "
            "and source_sequence < _last_source_sequence"
        ),
        "scd2_seed": _H
        + (
            "select * replace (cast(null as bigint) as valid_to_sequence, true as is_current) from hist "
            "where source_event_id = 'SNAPSHOT_INIT'"
        ),
        "scd2_history": _H + "select * from hist",
        "scd2_invariant_violations": _H + _FAULTS,
        "scd2_drift": _S + _STORED + _HISTORY + """select subscription_id, rule
          from (select h.subscription_id, h.valid_from_sequence <> s._last_source_sequence as a,
          h.is_deleted <> s._is_deleted as b,
  not h.is_deleted and (h.plan is distinct from s.plan or h.status is distinct from s.status
    or h.renewal_date is distinct from s.renewal_date or h.monthly_cents is distinct from s.monthly_cents
    or h.billing_cycle is distinct from s.billing_cycle or h.currency is distinct from s.currency) as c
  from hist h join state s on h.subscription_id = s.subscription_id where h.is_current) cross
    join (values ('SEQUENCE'), ('DELETED_FLAG'), ('ATTRIBUTES')) r(rule) where case rule when 'SEQUENCE' then a
    when 'DELETED_FLAG' then b else c end""",
        "scd2_as_of": _H + """select q.subscription_id, q.sequence, h.history_version_id, h.plan, h.status
          from (select business_key as subscription_id, 1000000 + source_sequence * 7 as sequence from snap
          where source_table = 'subscriptions') q
  join hist h on h.subscription_id = q.subscription_id
    and h.valid_from_sequence <= q.sequence and
    (h.valid_to_sequence is null or q.sequence < h.valid_to_sequence)""",
        **{
            f"current_{t}": _M + _state_sql(t, "state") + "select * from state"
            for t in ("accounts", "invoices", "payments")
        },
        "reconcile_all_tables": _M
        + "".join(_state_sql(t, f"s_{t}") for t in TABLES)
        + " union all ".join(_FACTS(t) for t in TABLES),
        "late_event_queue": _R
        + """select event_id, 'subscriptions' as source_table, business_key, source_sequence, arrival_batch_id,
          schema_version,
          'SOURCE_SEQUENCE_BEHIND_TARGET' as late_reason, 'PENDING' as replay_status, 0 as replay_attempt_count from due""",
        "replay_audit": _R + """select sha256(concat('late-replay:', event_id)) as replay_id, event_id,
          'subscriptions' as source_table, business_key, source_sequence, case when why is null then 'APPLIED'
          when why = 'COLLISION' then 'CONFLICT' else 'FAILED' end as status,
  coalesce(versions_before, 0) as history_versions_before, case
    when why is null then versions else coalesce(versions_before, 0) end as history_versions_after,
    coalesce(base, 0) as current_sequence_before, case when why is null then top else coalesce(base, 0)
    end as current_sequence_after,
  why is null as current_state_changed, 1 as attempt_number, why as failure_reason from due
    join verdict using (business_key)""",
        "replay_queue": _R
        + (
            "select event_id, case when why is null then 'APPLIED' "
            "when why = 'COLLISION' then 'CONFLICT' else 'FAILED' end as replay_status, "
            "1 as replay_attempt_count, why as failure_reason from due join verdict using (business_key)"
        ),
        "replay_history": _R + """select * from hist
          where subscription_id in (select business_key from verdict where why is null)
  union all select * replace (cast(null as bigint) as valid_to_sequence, true as is_current) from hist
    where source_event_id = 'SNAPSHOT_INIT' and subscription_id not in
    (select business_key from verdict where why is null)""",
        "replay_repaired_state": _R + """select s.subscription_id, s.account_id, case
          when fixed then h.plan else s.plan end as plan, case when fixed then h.status else s.status
          end as status, case when fixed then h.monthly_cents else s.monthly_cents end as monthly_cents,
  case when fixed then h.renewal_date else s.renewal_date end as renewal_date, case
    when fixed then h.billing_cycle else s.billing_cycle end as billing_cycle, case
    when fixed then h.currency else s.currency end as currency,
  case when fixed then h.valid_from_sequence else s._last_source_sequence end as _last_source_sequence, case
    when fixed then h.source_event_id else s._last_event_id end as _last_event_id, s._last_batch_id,
  case when fixed then h.is_deleted else s._is_deleted end as _is_deleted, case
    when fixed then h.schema_version else s._last_schema_version end as _last_schema_version
  from (select *, subscription_id in (select business_key from verdict where why is null) as fixed from state) s
    left join hist h on h.subscription_id = s.subscription_id and h.is_current and s.fixed""",
        "table_merge_batches": _V.replace("delivery_rank = 1),\nsnap", "delivery_rank = 1 and batch_id <= 3),\nsnap")
        + _MERGED
        + _STATE
        + "select * from state",
    }.items()
} | {
    k: _SEED + v
    for k, v in {
        "table_upsert": "select * from kv where k not in (select k from new) union all select * from new",
        "table_insert_only": "select * from kv union all select * from new where k not in (select k from kv)",
        "table_append_columns": "select *, cast(null as bigint) as w from kv union all select *, n * 2 from new",
        "table_update_where": "select k, n, case when n % 3 = 1 then 'UPDATED' else v end as v from kv",
        "table_delete_where": "select * from kv where n % 3 <> 1",
    }.items()
}
