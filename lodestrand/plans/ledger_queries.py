"""Registered queries of the sync ledger and the embedding indexer, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import hashed_embedding
from ..operators import embedding_index, sync
from . import frames

CUT, AT, CONFIG, DIMENSIONS = "2024-01-16", "2024-02-01", "cfg1", 64


def _ledger_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ledger from the last event of each user and key before CUT, and items from the events since."""
    key = F.get_json_object("props", "$.k")
    e = frames.table(spark, sf_dir, "events").withColumn("item_id", F.when(F.col("event_id") % 97 != 0, F.concat_ws(":", F.col("user_id").cast("string"), key)))
    fields = e.select(
        "ts", "event_id", "event_type", "item_id", F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("record_id"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("version"),
        F.sha2("event_type", 256).alias("content_hash"), F.sha2(F.col("user_id").cast("string"), 256).alias("scope_hash"), F.when(F.col("event_id") % 2 == 0, "acl").alias("acl_hash"),
    )
    status = F.when(F.col("event_type") == "purchase", "deleted").when(F.col("event_type") == "error", "failed").otherwise("active")
    before = fields.where((F.col("ts") < CUT) & F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max(F.struct("ts", "event_id", "event_type", "record_id", "version", *sync.HASHES)).alias("m")).select("item_id", "m.*")
    at = F.col("ts").cast("timestamp")
    ledger = before.select(
        "item_id", "record_id", status.alias("status"), F.lit("created").alias("last_action"), "version", *sync.HASHES, at.alias("first_seen_at"), at.alias("last_seen_at"), at.alias("last_changed_at"),
        F.when(status == "deleted", at).alias("deleted_at"), F.when(status == "failed", 2).otherwise(0).cast("long").alias("failure_count"), F.when(status == "failed", "timeout").alias("last_error_code"), F.when(status == "failed", True).alias("retryable"),
    )
    op = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "delete").otherwise("upsert")
    items = fields.where(F.col("ts") >= CUT).select(
        F.col("event_id").alias("seq"), "item_id", op.alias("operation"), F.when(op == "upsert", F.col("record_id")).alias("record_id"), F.when(op != "delete", F.col("version")).alias("version"), *(F.when(op == "upsert", F.col(c)).alias(c) for c in sync.HASHES),
        F.lit(None).cast("timestamp").alias("deleted_at"), F.when(op == "error", "http_500").alias("error_code"), F.when(op == "error", F.col("event_id") % 4 != 0).alias("retryable"),
    )
    return ledger, items


def _run(spark: SparkSession, sf_dir: str) -> sync.Run:
    return sync.applied(*_ledger_sides(spark, sf_dir), F.lit(AT).cast("timestamp"), full=True, complete=True)


def sync_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    rows = _run(spark, sf_dir).ledger
    return rows.select(*(day(c) if c.endswith("_at") else c for c in rows.columns))


def sync_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).metrics


def _stored(chunks: DataFrame) -> DataFrame:
    """Vectors of an earlier run: none for documents divisible by 5, of an older text for those divisible by 7, of a chunk that is gone beside each divisible by 11, and another configuration's."""
    own = chunks.where("doc_id % 5 <> 0").select("chunk_id", "doc_id", "tenant", "namespace", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"), F.lit(CONFIG).alias("config_hash"))
    gone = chunks.where("doc_id % 11 = 0").select(F.concat(F.lit("gone_"), "chunk_id").alias("chunk_id"), "doc_id", "tenant", "namespace", "text_hash", F.lit(CONFIG).alias("config_hash"))
    other = chunks.where("doc_id % 3 = 0").select("chunk_id", "doc_id", "tenant", "namespace", "text_hash", F.lit("cfg0").alias("config_hash"))
    rows = own.unionByName(gone).unionByName(other)
    return rows.select(F.concat_ws("_", "config_hash", "chunk_id").alias("vector_id"), "chunk_id", *embedding_index.KEYS, "config_hash", F.lit(DIMENSIONS).alias("dimensions"), F.array_repeat(F.lit(0.0), DIMENSIONS).alias("embedding"))


def embedding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = frames.chunks(spark, sf_dir)
    return embedding_index.compared(chunks, _stored(chunks), CONFIG)


def embedding_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs one after another: what each made and what the table then holds."""
    chunks = frames.chunks(spark, sf_dir).select("chunk_id", *embedding_index.KEYS, "text")
    out, table = None, _stored(chunks)
    for run in (1, 2):
        done = embedding_index.indexed(chunks, table, hashed_embedding, CONFIG, DIMENSIONS)
        table = done.vectors
        made, held = done.made.agg(F.count("*").alias("n_made")), table.agg(F.count("*").alias("n_vectors"), F.countDistinct("vector_id").alias("n_ids"))
        row = made.withColumn("run", F.lit(run)).join(held.withColumn("run", F.lit(run)), "run")
        out = row if out is None else out.unionByName(row)
    return out.select("run", "n_made", "n_vectors", "n_ids")


QUERIES = {"sync_ledger": sync_ledger, "sync_metrics": sync_metrics, "embedding_states": embedding_states, "embedding_runs": embedding_runs}

_SIDES = f"""e as (select *, case when event_id % 97 <> 0 then user_id || ':' || (props::json->>'$.k') end as item_id from events),
  f as (select ts, event_id, event_type, item_id, 'r' || user_id as record_id, 'v' || event_id % 3 as version, sha256(event_type) as content_hash, sha256(user_id::varchar) as scope_hash, case when event_id % 2 = 0 then 'acl' end as acl_hash from e),
  p as (select * exclude (n), case event_type when 'purchase' then 'deleted' when 'error' then 'failed' else 'active' end as status
        from (select *, row_number() over (partition by item_id order by ts desc, event_id desc) as n from f where ts < '{CUT}' and item_id is not null) where n = 1),
  listed as (select * from f where ts >= '{CUT}'),
  n as (select * exclude (k), case event_type when 'purchase' then 'delete' when 'error' then 'error' else 'upsert' end as op
        from (select *, row_number() over (partition by item_id order by event_id desc) as k from listed where item_id is not null) where k = 1),
  j as (select coalesce(p.item_id, n.item_id) as item_id, p.item_id is not null as was, op, p.status as old, p.record_id as pr, n.record_id as nr, p.version as pv, n.version as nv, p.content_hash as pc, n.content_hash as nc, p.scope_hash as ps, n.scope_hash as ns,
          p.acl_hash as pa, n.acl_hash as na, p.ts as pt, n.event_id as ne,
          op = 'upsert' and not coalesce(p.status = 'active' and p.record_id = n.record_id and p.version = n.version and p.content_hash = n.content_hash and p.scope_hash = n.scope_hash and p.acl_hash is not distinct from n.acl_hash, false) as changed from p full join n using (item_id))"""
ORACLES = {
    "sync_ledger": f"""with {_SIDES}
      select item_id, case op when 'upsert' then nr else pr end as record_id,
        case op when 'upsert' then 'active' when 'error' then 'failed' else 'deleted' end as status,
        case op when 'upsert' then case when not was then 'created' when changed then 'updated' else 'unchanged' end when 'error' then 'failed' else case when old = 'deleted' then 'unchanged' else 'deleted' end end as last_action,
        case when op in ('upsert', 'error') then nv else pv end as version, case op when 'upsert' then nc else pc end as content_hash, case op when 'upsert' then ns else ps end as scope_hash, case op when 'upsert' then na else pa end as acl_hash,
        strftime(coalesce(pt, timestamp '{AT}'), '%Y-%m-%d %H:%M:%S') as first_seen_at, '{AT} 00:00:00' as last_seen_at, strftime(case when changed then timestamp '{AT}' else pt end, '%Y-%m-%d %H:%M:%S') as last_changed_at,
        strftime(case when op = 'upsert' then null when op = 'delete' then timestamp '{AT}' when op = 'error' then case when old = 'deleted' then pt end when old = 'deleted' then pt else timestamp '{AT}' end, '%Y-%m-%d %H:%M:%S') as deleted_at,
        (case when op = 'error' then 1 + case when old = 'failed' then 2 else 0 end else 0 end)::bigint as failure_count,
        case when op = 'error' then 'http_500' when op is null and old = 'failed' then 'timeout' end as last_error_code, case when op = 'error' then ne % 4 <> 0 when op is null and old = 'failed' then true end as retryable
      from j""",
    "sync_metrics": f"""with {_SIDES}
      select count(*) filter (changed) as n_records, count(*) filter ((op = 'delete' and old is distinct from 'deleted') or (op is null and old <> 'deleted')) as n_deleted, count(*) filter (op = 'error') as n_failed,
        count(*) filter ((op = 'upsert' and not changed) or (op is null and old = 'deleted')) as n_skipped, count(*) filter (op is null and old <> 'deleted') as n_tombstoned,
        (select count(*) from listed) as n_listed, (select count(*) from listed where item_id is null) as n_warnings, case when count(*) filter (op = 'error') > 0 then 'partial' else 'succeeded' end as status from j""",
    "embedding_states": "with " + frames.CHUNKS + """ select chunk_id, case when doc_id % 5 = 0 then 'missing' when doc_id % 7 = 0 then 'stale' else 'fresh' end as state from chunks
      union all select 'gone_' || chunk_id, 'gone' from chunks where doc_id % 11 = 0""",
    "embedding_runs": "with " + frames.CHUNKS + """, n as (select count(*) as held, count(*) filter (doc_id % 5 = 0 or doc_id % 7 = 0) as todo, count(*) filter (doc_id % 3 = 0) as other from chunks)
      select 1 as run, todo as n_made, held + other as n_vectors, held + other as n_ids from n union all select 2, 0, held + other, held + other from n""",
}
