"""Queries p1, p2, p3, p5 and p6 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.operators import instants, intervals, key_counts, log_entries, snapshots
from logweave.sources.tables import spread, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lines, events = spread(table(spark, folder, "raw_lines", "source", "line_no", "line")), table(spark, folder, "log_events")
    rules = log_entries.rules_of(lines, events)
    return log_entries.found(log_entries.log_entries(lines, rules=rules)).unionByName(log_entries.found(log_entries.unsplit_entries(events, rules)))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.registry_changes(table(spark, folder, "template_registry"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return key_counts.event_counts(table(spark, folder, "log_events"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.downtime(table(spark, folder, "connectivity_incidents"), table(spark, folder, "runs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    services = table(spark, folder, "services")
    of_events = instants.normalised_event_times(table(spark, folder, "log_events"), services)
    return of_events.unionByName(instants.normalised_record_times(log_entries.json_entries(spread(table(spark, folder, "raw_lines", "source", "line_no", "line"))), services))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p5_found, p6_found)}

SQL = {
    "p2_found": """
with r as (
  select nullif(lower(trim(service_name)), '') s, nullif(lower(trim(template_id)), '') k, cast(snapshot_no as bigint) n, delivered_at d,
         regexp_replace(lower(coalesce(normalized_template, '')), '\\s+', '', 'g') x,
         case when upper(trim(severity_text)) = 'WARN' then 'WARNING'
              when upper(trim(severity_text)) in ('TRACE','DEBUG','INFO','WARNING','ERROR','CRITICAL','FATAL') then upper(trim(severity_text)) else 'INFO' end l
  from template_registry),
cal as (select s, n, row_number() over (partition by s order by n) i from (select distinct s, n from r where s is not null)),
h as (select r.s, r.k, cal.i, r.x, r.l from r join cal on r.s = cal.s and r.n = cal.n where r.k is not null
      qualify row_number() over (partition by r.s, r.k, r.n order by r.d desc nulls last, r.x desc, r.l desc) = 1)
select coalesce(b.s, a.s) service_name, coalesce(b.k, a.k) template_id, c.n snapshot_no,
       case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end change_kind
from (select * from h where i > 1) b full join (select s, k, i + 1 i, x, l from h) a on a.s = b.s and a.k = b.k and a.i = b.i
join cal c on c.s = coalesce(b.s, a.s) and c.i = coalesce(b.i, a.i)
where a.k is null or b.k is null or a.x <> b.x or a.l <> b.l""",
    "p3_found": """
select lower(trim(service_name)) service_name, template_id, count(distinct event_id) n_events
from log_events where template_id is not null and event_id is not null and service_name is not null group by all""",
    "p5_found": """
with t as (
  select i.run_id, lower(trim(i.dependency)) dependency, epoch_us(try_cast(i.down_at as timestamptz)) a,
         case when i.up_at is null then epoch_us(u.finished_at) else epoch_us(try_cast(i.up_at as timestamptz)) end b
  from connectivity_incidents i left join runs u using (run_id)),
m as (select run_id, dependency, a // 1000 s, b // 1000 e from t where b > a),
k as (select *, max(e) over (partition by run_id, dependency order by s, e rows between unbounded preceding and 1 preceding) seen from m where e > s),
g as (select *, sum(case when s <= seen then 0 else 1 end) over (partition by run_id, dependency order by s, e rows unbounded preceding) no from k),
down as (select run_id, dependency, min(s) s, max(e) e from g group by run_id, dependency, no)
select run_id, dependency, 'down' period_kind, s start_ms, e end_ms from down
union all
select * from (select run_id, dependency, 'gap', e, lead(s) over (partition by run_id, dependency order by s) nxt from down) where nxt is not null""",
}
