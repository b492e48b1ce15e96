"""The registered query of the lease queue and its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leases
from . import frames


def lease_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the log of a job for each user: the first enqueues, others claim, beat, complete, fail, cancel or requeue."""
    e = frames.table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").cast("string").alias("queue_id"), "event_type")
    first = e.groupBy("queue_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    i = F.col("event_id")
    action = (
        F.when(F.struct("ts", "event_id") == F.col("f"), "enqueue").when(F.col("event_type") == "click", F.when(i % 3 == 0, "heartbeat").otherwise("claim")).when(F.col("event_type") == "view", F.when(i % 5 == 0, "complete").otherwise("claim"))
        .when(F.col("event_type") == "error", "fail").when(i % 11 == 0, "cancel").when(i % 2 == 0, "requeue").otherwise("fail")
    )
    return e.join(first, "queue_id").select(
        "queue_id", "ts", "event_id", action.alias("action"), F.concat(F.lit("w"), (i % 2).cast("string")).alias("worker"), (F.lit(86_400_000_000) * (1 + i % 4)).alias("lease"), (i % 4 != 0).alias("retryable"),
        F.when(i % 3 == 1, F.col("ts") + 3_600_000_000).alias("available_at"), F.when(i % 7 == 0, 2).cast("int").alias("max_attempts"),
    )


def lease_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.states(lease_log(spark, sf_dir))


QUERIES = {"lease_states": lease_states}
ORACLES = {
    "lease_states": f"""with recursive e as (select event_id as i, epoch_us(ts) as ts, user_id::varchar as q, event_type as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
      log as (select *, case when k = 1 then 'enqueue' when t = 'click' then case when i % 3 = 0 then 'heartbeat' else 'claim' end when t = 'view' then case when i % 5 = 0 then 'complete' else 'claim' end when t = 'error' then 'fail' when i % 11 = 0 then 'cancel' when i % 2 = 0 then 'requeue' else 'fail' end as a,
        'w' || i % 2 as w, 86400000000 * (1 + i % 4) as lease, i % 4 <> 0 as again, case when i % 3 = 1 then ts + 3600000000 end as due, case when i % 7 = 0 then 2 end as most from e),
      walk as (select q, 1::bigint as k, 'queued' as status, 0 as attempt, coalesce(most, {leases.ATTEMPTS}) as max_attempts, null::varchar as worker, null::bigint as expires, coalesce(due, ts) as available, null::bigint as finished, 0 as rejected from log where k = 1
        union all select q, k, case when not ok then status when a = 'requeue' or retry then 'queued' when a in ('claim', 'heartbeat') then 'leased' when a = 'complete' then 'completed' when a = 'cancel' then 'cancelled' else 'dead_letter' end,
          case when not ok then attempt when a = 'requeue' then 0 when a = 'claim' then attempt + 1 else attempt end, case when ok and a = 'requeue' then coalesce(most, max_attempts) else max_attempts end,
          case when not ok then worker when a in ('claim', 'heartbeat') then w end, case when not ok then expires when a in ('claim', 'heartbeat') then ts + lease end, case when ok and (a = 'requeue' or retry) then coalesce(due, ts) else available end,
          case when not ok then finished when a in ('claim', 'heartbeat', 'requeue') or retry then null else ts end, rejected + case when ok then 0 else 1 end
        from (select *, a = 'fail' and again and attempt < max_attempts as retry from (select s.q, l.k, a, w, ts, lease, again, due, most, status, attempt, max_attempts, worker, expires, available, finished, rejected,
          coalesce(case a when 'claim' then (status = 'queued' and available <= ts) or (status = 'leased' and not expires > ts) when 'heartbeat' then status = 'leased' and worker = w and expires > ts
            when 'complete' then status = 'leased' and worker = w when 'fail' then status = 'leased' and worker = w when 'cancel' then status in ('queued', 'leased') when 'requeue' then status = 'dead_letter' end, false) as ok
          from walk s join log l on l.q = s.q and l.k = s.k + 1)))
      select q as queue_id, status, attempt::int as attempt, max_attempts::int as max_attempts, worker, expires as lease_expires_at, available as available_at, finished as finished_at, rejected::int as n_rejected from walk qualify row_number() over (partition by q order by k desc) = 1""",
}
