"""Queries of incremental work, evaluation and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, incremental, retrieval
from . import frames

KEY = ["user_id", "event_type", "day"]


def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.synced(*frames.sync_sides(spark, sf_dir)).select("item_id", "status", "action")


def event_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.idempotent(frames.keyed_events(spark, sf_dir), KEY, ["ts", "event_id"]).select("event_id", "status")


def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.keyed_events(spark, sf_dir)
    out = incremental.merged_candidates(e.select(F.concat_ws(":", "user_id", "event_type").alias("key"), "value", "day"), "key", "value", "day")
    return out.withColumn("refs", F.array_join("refs", ","))


def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.table(spark, sf_dir, "events")
    jobs = e.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("tenant"), F.floor("value").cast("long").alias("priority"), F.col("ts").alias("available_at"),
        F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "leased").otherwise("done").alias("status"), (F.col("ts") + F.expr("interval 1 day")).alias("lease_expires_at"),
    )
    return incremental.claimable(jobs, F.lit("2024-01-20").cast("timestamp"))


def queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.table(spark, sf_dir, "events")
    log = e.select(F.concat_ws(":", "user_id", F.get_json_object("props", "$.k")).alias("job_id"), "ts", "event_id", F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("state"))
    return incremental.queue_states(log)


def delete_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled toxic are deleted; what each store keeps."""
    docs, chunks = frames.documents(spark, sf_dir), frames.chunks(spark, sf_dir).select("doc_id", "chunk_id")
    gone = frames.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    vectors = frames.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    out = None
    for name, left in incremental.propagated(gone, vectors, chunks, docs).items():
        own = left.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def generation_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = frames.chunks(spark, sf_dir).withColumn("config_hash", F.when(F.col("chunk_index") == 0, "v1").otherwise("v2"))
    return incremental.to_clean(incremental.generations(chunks, ["tenant", "namespace", "config_hash"]), ["v2"])


def backfill_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.backfill_batches(frames.documents(spark, sf_dir).select("tenant", "source_id").distinct(), 4)


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.rate_limited(frames.table(spark, sf_dir, "events"), "event_type", "ts", 3600, 3)


#: Judged for a query vector: those whose ids lie so near to its own and that have its label.
NEAR = 200


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours against judged vectors of the same label, for every query vector (id divisible by 20)."""
    vectors = frames.table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0")
    found = retrieval.vector_topk(vectors, queries).withColumnRenamed("vec_id", "item_id")
    near = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"), F.explode(F.sequence(F.col("vec_id") - NEAR, F.col("vec_id") + NEAR)).alias("item_id"))
    judged = near.join(vectors.select(F.col("vec_id").alias("item_id"), "label"), "item_id").where("want = label").select("query_id", "item_id")
    return evaluation.ir_metrics(found, judged, 10)


def latency_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.snapshot(frames.table(spark, sf_dir, "events"), ["event_type"], "value")


def _daily(spark, sf_dir, low, high):
    e = frames.keyed_events(spark, sf_dir).where((F.col("day") >= low) & (F.col("day") < high))
    return e.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))


def eval_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of the second half month against the first."""
    return evaluation.regressions(_daily(spark, sf_dir, "2024-01-01", "2024-01-16"), _daily(spark, sf_dir, "2024-01-16", "2024-02-16"))


RULES = [("mean_click", "click", "lt", 60.0, True, "warning"), ("mean_error", "error", "lte", 40.0, True, "critical"), ("mean_missing", "absent", "gt", 0.0, True, "critical"), ("mean_optional", "absent", "gt", 0.0, False, "info"), ("mean_view", "view", "gte", 10.0, True, "warning")]


def slo_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_id string, signal string, comparator string, threshold double, required boolean, severity string")
    return evaluation.service_levels(rules, _daily(spark, sf_dir, "2024-01-01", "2024-02-16").withColumnRenamed("metric", "name"))


def qa_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = frames.table(spark, sf_dir, "part").withColumn("expected", F.concat_ws(" ", "p_name", "p_type"))
    return evaluation.qa_metrics(parts, "p_name", "expected").select("p_partkey", "contained", "similarity", "anls")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.table(spark, sf_dir, "events").withColumn("reason", F.col("event_type"))
    return evaluation.review_queue(e, "user_id", "value")


def key_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user before and after the middle of the month."""
    e = frames.keyed_events(spark, sf_dir)
    side = lambda df: df.groupBy("user_id").agg(F.collect_set(F.concat_ws("/", "event_type", F.substring("day", 10, 1))).alias("items"))
    out = evaluation.drift(side(e.where("day < '2024-01-16'")), side(e.where("day >= '2024-01-16'")), "user_id", "items")
    return out.select("user_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


QUERIES = {f.__name__: f for f in (sync_apply, event_idempotency, candidate_merge, queue_claim, queue_states, delete_propagation, generation_inventory, backfill_batches, rate_limits, ir_metrics, latency_snapshot, eval_regression, slo_eval, qa_metrics, review_queue, key_drift)}

_ITEM = "user_id || ':' || json_extract_string(props, '$.k')"
_MEANS = lambda where: f"select event_type as metric, round(avg(value), 6) as value from events where {where} group by 1"
ORACLES = {
    "sync_apply": f"""with e as (select {_ITEM} as item_id, ts, event_id, event_type from events), p as (select item_id, max_by(event_type, (ts, event_id)) as t from e where ts < timestamp '2024-01-16' group by 1), c as (select item_id, max_by(event_type, (ts, event_id)) as t from e where ts >= timestamp '2024-01-16' group by 1),
        j as (select coalesce(p.item_id, c.item_id) as item_id, p.t as old, case p.t when 'purchase' then 'deleted' else case when p.t is not null then 'active' end end as was, c.t as new, case c.t when 'error' then 'error' when 'purchase' then 'delete' else case when c.t is not null then 'upsert' end end as op from p full join c on p.item_id = c.item_id)
        select item_id, case op when 'error' then coalesce(was, 'failed') when 'delete' then 'deleted' when 'upsert' then 'active' else 'deleted' end as status,
          case when op = 'error' then 'failed' when op = 'delete' then case when was = 'deleted' then 'unchanged' else 'deleted' end when op = 'upsert' then case when was is null then 'created' when was <> 'active' or old <> new then 'updated' else 'unchanged' end when was <> 'deleted' then 'tombstoned' else 'unchanged' end as action from j""",
    "event_idempotency": """with e as (select *, ts::date as day, sha256(props) as h from events), f as (select *, first_value(h) over w as first_h, row_number() over w as n from e window w as (partition by user_id, event_type, day order by ts, event_id)),
        c as (select *, bool_or(h <> first_h) over (partition by user_id, event_type, day order by ts, event_id rows between unbounded preceding and current row) as clash from f)
        select event_id, case when n = 1 then 'processable' when clash then 'conflict' else 'duplicate' end as status from c""",
    "candidate_merge": "select user_id || ':' || event_type as key, max(value) as priority, string_agg(distinct strftime(ts, '%Y-%m-%d'), ',' order by strftime(ts, '%Y-%m-%d')) as refs, count(*) as n_reports from events group by 1",
    "queue_claim": """with due as (select *, floor(value)::bigint as p from events where (event_type = 'click' and ts <= timestamp '2024-01-20') or (event_type = 'view' and ts + interval 1 day < timestamp '2024-01-20'))
        select user_id as tenant, event_id as job_id, p as priority, ts as available_at from due qualify row_number() over (partition by user_id order by p desc, ts, event_id) = 1""",
    "queue_states": f"select {_ITEM} as job_id, max_by(case event_type when 'error' then 'failed' else event_type end, (ts, event_id)) as state, count(*) filter (event_type = 'error') as failures from events group by 1",
    "delete_propagation": f"""with {frames.CHUNKS}, gone as (select distinct doc_id from labels where toxic = 1) select 'vectors' as store, count(*) as n from embeddings where vec_id not in (select doc_id from gone)
        union all select 'chunks', count(*) from chunks where doc_id not in (select doc_id from gone) union all select 'documents', count(*) from docs where doc_id not in (select doc_id from gone)""",
    "generation_inventory": f"with {frames.CHUNKS} select tenant, namespace, 'v1' as config_hash, count(*) as n_vectors, count(distinct doc_id) as n_documents from chunks where chunk_index = 0 group by all",
    "backfill_batches": f"with {frames.DOCS}, s as (select distinct tenant, source_id from docs) select tenant, source_id, ((row_number() over (partition by tenant order by source_id) - 1) // 4)::int as batch from s",
    "rate_limits": "with c as (select event_type, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) as window_start, count(*) as n from events group by all) select event_type, window_start, least(n, 3) as n_passed, greatest(n - 3, 0) as n_refused from c",
    "ir_metrics": f"""with pairs as (select q.vec_id as query_id, q.label as want, v.vec_id as item_id, v.label, row_number() over (partition by q.vec_id order by floor(list_cosine_similarity(q.embedding::double[], v.embedding::double[]) * 1e6 + 0.5) / 1e6 desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 20 = 0),
        m as (select query_id, count(*) filter (judged) as n, count(*) filter (judged and rank <= 10) as hits, min(rank) filter (judged and rank <= 10) as first from (select *, want = label and abs(item_id - query_id) <= {NEAR} as judged from pairs) group by 1)
        select query_id, floor(hits::double / least(n, 10) * 1e6 + 0.5) / 1e6 as recall, floor(hits::double / 10 * 1e6 + 0.5) / 1e6 as precision, floor(coalesce(1.0::double / first, 0) * 1e6 + 0.5) / 1e6 as reciprocal_rank from m where n > 0""",
    "latency_snapshot": "select event_type, count(*) as n, floor(avg(value) * 1e6 + 0.5) / 1e6 as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by 1",
    "eval_regression": f"""with b as ({_MEANS("ts < timestamp '2024-01-16'")}), c as ({_MEANS("ts >= timestamp '2024-01-16'")}) select metric, b.value as baseline, c.value as current, floor((c.value - b.value) * 1e6 + 0.5) / 1e6 as delta, coalesce(floor((c.value - b.value) * 1e6 + 0.5) / 1e6 < -0.02, true) as regressed from b left join c using (metric)""",
    "slo_eval": f"""with s as ({_MEANS("true")}) select r.rule_id, s.value, case when s.value is null then case when r.required then 'failed' else 'skipped' end
          when (r.c = 'lt' and s.value < r.t) or (r.c = 'lte' and s.value <= r.t) or (r.c = 'gt' and s.value > r.t) or (r.c = 'gte' and s.value >= r.t) then 'ok' else 'failed' end as status, r.severity
        from (values {", ".join(f"('{a}', '{b}', '{c}', {d}::double, {e}, '{f}')" for a, b, c, d, e, f in RULES)}) r(rule_id, signal, c, t, required, severity) left join s on s.metric = r.signal""",
    "qa_metrics": """with a as (select p_partkey, p_name, p_name || ' ' || p_type as e from part), s as (select *, 1 - levenshtein(lower(p_name), lower(e))::double / greatest(length(p_name), length(e)) as s from a)
        select p_partkey, contains(lower(p_name), lower(e)) as contained, floor(s * 1000 + 0.5) / 1000 as similarity, case when s >= 0.5 then floor(s * 1000 + 0.5) / 1000 else 0.0 end as anls from s""",
    "review_queue": "select user_id, max(value) as priority, string_agg(distinct event_type, ',' order by event_type) as reasons, count(*) as n_reports from events group by 1",
    "key_drift": """with e as (select user_id, event_type || '/' || substr(strftime(ts, '%Y-%m-%d'), 10, 1) as i, ts >= timestamp '2024-01-16' as late from events), a as (select user_id, i, bool_or(late) as l, bool_or(not late) as f from e group by all)
        select user_id, coalesce(string_agg(i, ',' order by i) filter (l and not f), '') as added, coalesce(string_agg(i, ',' order by i) filter (f and not l), '') as removed from a group by 1""",
}
