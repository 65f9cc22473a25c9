"""Change events derived from the driver's `events` table, and snapshots from `customer`.

The text is one SQL query with two tokens, ISO(x) and SHA(x), that the engine at hand spells its way,
so that a second engine can be given the same relation. The rules (every n-th event is a duplicate,
late, malformed, ...) exercise every operator."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ENVELOPE_SQL = """
with a0 as (
  select event_id as n, cast(user_id as bigint) as uid, event_type, cast(value as decimal(12,2)) as amt, ts,
         case user_id % 4 when 0 then 'accounts' when 1 then 'subscriptions'
           when 2 then 'invoices' else 'payments' end as source_table,
         concat(case user_id % 4 when 0 then 'ACC-' when 1 then 'SUB-' when 2 then 'INV-' else 'PAY-' end,
           lpad(cast(user_id as varchar(20)), 6, '0')) as k,
         case user_id % 4 when 0 then 'account_id' when 1 then 'subscription_id'
           when 2 then 'invoice_id' else 'payment_id' end as pk
  from events),
a1 as (
  select *,
    case when n % 50 = 43 then -n else 1000000 + n end as source_sequence,
    case when n % 50 = 7 then 'UPSERT' when event_type = 'signup' then 'INSERT'
      when event_type = 'error' then 'DELETE' else 'UPDATE' end as operation,
    case when n % 50 = 11 then '' else k end as business_key,
    case when n % 50 = 17 then 99 when source_table = 'subscriptions' and n % 5 = 0 then 2 else 1 end as schema_version,
    case when n % 50 = 31 then 'not-a-time' else ISO(ts) end as event_timestamp,
    case event_type when 'view' then 'BASIC' when 'click' then 'PRO' else 'ENTERPRISE' end as plan,
    case when n % 6 = 1 then '' when n % 6 = 2 then ', AMT: null' else
      concat(', AMT: ', cast(amt as varchar(20))) end as amt_json
  from a0),
a2 as (
  select *,
    case
      when n % 50 = 13 then concat('{"', pk, '": "', k, '", broken')
      when n % 50 = 37 then '[1, 2]'
      when operation = 'DELETE' then concat('{"', pk, '": "', k, '"}')
      when n % 50 = 23 then concat('{"', pk, '": "', k, '", "other": 1}')
      else concat('{"', pk, '": "', case when n % 50 = 29 then 'ZZZ-000000' else k end, '"',
        case source_table
          when 'accounts' then concat(', "company_name": "Co ', cast(uid as varchar(20)), '", "industry": "',
            event_type, '", "country": "US", "plan_tier": "', plan, '"')
          when 'subscriptions' then concat(', "account_id": "ACC-', lpad(cast(uid - 1 as varchar(20)), 6, '0'),
            '", "plan": "', plan, '", "status": "', event_type, '"', replace(amt_json, 'AMT', '"monthly_amount"'),
            ', "renewal_date": "2025-01-01"',
               case when schema_version = 2 then concat(', "billing_cycle": "', case
                 when n % 2 = 0 then 'MONTHLY' else 'ANNUAL' end, '", "currency": "USD"') else '' end)
          when 'invoices' then concat(', "account_id": "ACC-', lpad(cast(uid - 2 as varchar(20)), 6, '0'),
            '", "subscription_id": "SUB-', lpad(cast(uid - 1 as varchar(20)), 6, '0'), '", "amount": ',
            cast(amt as varchar(20)), ', "status": "', event_type, '"')
          else concat(', "invoice_id": "INV-', lpad(cast(uid - 1 as varchar(20)), 6, '0'), '", "amount": ',
            cast(amt as varchar(20)), ', "payment_status": "', event_type, '"')
        end, '}')
    end as payload,
    SHA(concat(source_table, ':', business_key, ':', cast(source_sequence as varchar(20)), ':', operation)) as good_id,
    cast(floor(n / 250) as bigint) + 1 + case when n % 41 = 0 then 2 else 0 end as batch0
  from a1),
env as (
  select case when n % 50 = 19 then repeat('0', 64) else good_id end as event_id, source_table, operation, business_key,
         cast(source_sequence as bigint) as source_sequence, event_timestamp,
         ISO(ts + lag_s * interval '1' second) as ingested_timestamp,
         batch0 + lag_b as batch_id, cast(schema_version as int) as schema_version, payload
  from (select *, 0 as lag_s, 0 as lag_b from a2 union all select *, 60, 0 from a2 where n % 33 = 0
    union all select *, 120, 3 from a2 where n % 47 = 0) d)
"""
SNAPSHOT_SQL = """
select case c_custkey % 4 when 0 then 'accounts' when 1 then 'subscriptions'
  when 2 then 'invoices' else 'payments' end as source_table,
       concat(case c_custkey % 4 when 0 then 'ACC-' when 1 then 'SUB-' when 2 then 'INV-' else 'PAY-' end,
         lpad(cast(c_custkey as varchar(20)), 6, '0')) as business_key,
       cast(c_custkey + 1 as bigint) as source_sequence,
       concat('ACC-', lpad(cast(greatest(c_custkey - 1, 0) as varchar(20)), 6, '0')) as account_id,
       case c_custkey % 2 when 0 then 'BASIC' else 'PRO' end as plan,
       'ACTIVE' as status, cast(abs(c_acctbal) as decimal(12,2)) as monthly_amount, '2025-01-01' as renewal_date,
       '2023-12-31T00:00:00.000000+00:00' as created_at
from customer where c_custkey % 3 <> 0
"""
SPARK = {"ISO": "concat(date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+00:00')", "SHA": "sha2({}, 256)"}
DUCKDB = {"ISO": "concat(strftime({}, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00')", "SHA": "sha256({})"}


def spelled(sql: str, dialect: dict[str, str]) -> str:
    """sql with the tokens spelled out (their arguments have balanced brackets)."""
    while m := re.search(r"\b(ISO|SHA)\(", sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = sql[: m.start()] + dialect[m[1]].format(sql[m.end() : i - 1]) + sql[i:]
    return sql


def _spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where the files are too few to give each a part; many files stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _over(sql: str, name: str, rows: DataFrame) -> DataFrame:
    """sql with rows in the place of the table name; the session's views stay as they are."""
    plain = sql.replace("{", "{{").replace("}", "}}")
    return rows.sparkSession.sql(re.sub(rf"\bfrom {name}\b", "from {rows}", plain), rows=rows)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation env. Its clock is UTC whatever the session's time zone: ts has none."""
    return _over(
        spelled(ENVELOPE_SQL, SPARK) + "select * from env",
        "events",
        _spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    )


def snapshot(spark: SparkSession, sf_dir: str, table: str | None = None) -> DataFrame:
    """Snapshot rows of all tables, or of one with its key under its own name."""
    from tidemark.schemas import KEYS

    rows = _over(SNAPSHOT_SQL, "customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    if table is None:
        return rows
    own = rows.where(f"source_table = '{table}'")
    return (own.drop("account_id") if table == "accounts" else own).withColumnRenamed("business_key", KEYS[table])
