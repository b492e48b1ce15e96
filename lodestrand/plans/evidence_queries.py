"""Queries of context order, score maps, stale vectors, keys, request checks and parser results, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import identity_hash
from ..operators import access, context, incremental, ingest, retrieval
from . import frames
from .search_queries import _KEYWORD, _keyword


def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finance first, internal last, trusted sources, and recent ones for every other request."""
    out = context.ordered(_keyword(spark, sf_dir, 30), ["finance"], ["internal"], True, F.col("query_id") % 2 == 0)
    return out.select("query_id", "chunk_id", "place")


def contradiction_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as a candidate of its tenant's request, in the order of its document; some with a marker, at the end or within."""
    d = F.col("doc_id")
    text = F.concat("text", F.when(d % 4 == 0, " Except so").when(d % 4 == 1, " superseded").when((d % 4 == 2) & (F.col("chunk_index") % 2 == 1), " NEVER again").otherwise(""))
    pool = frames.chunks(spark, sf_dir).select(F.col("tenant").alias("query_id"), "doc_id", "chunk_id", text.alias("text"), F.col("chunk_index").alias("rank"))
    return context.contradictions(pool).select("doc_id", "n_chunks", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def _model_scores(candidates: DataFrame) -> DataFrame:
    """Scores as a careless model returns them: twice, not a number, for unknown chunks, and none for request 3."""
    rank = F.col("rank")
    first = candidates.select("query_id", "chunk_id", rank.alias("position"), F.when(rank % 7 == 0, F.lit(float("nan"))).otherwise((rank * 37 % 11) / 7.0).alias("score"))
    again = candidates.where("rank % 5 = 0").select("query_id", "chunk_id", (rank + 100).alias("position"), F.lit(9.0).alias("score"))
    unknown = candidates.where("rank % 9 = 0").select("query_id", F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), (rank + 200).alias("position"), F.lit(1.0).alias("score"))
    return first.unionByName(again).unionByName(unknown).where("query_id <> 3")


def score_map_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _keyword(spark, sf_dir, 30).select("query_id", "chunk_id", "rank")
    return retrieval.reranked_by_scores(pool, _model_scores(pool), 20).select("query_id", "chunk_id", "new_rank", "reranked", F.coalesce("model_score", F.lit(-1.0)).alias("model_score"))


def score_map_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _keyword(spark, sf_dir, 30).select("query_id", "chunk_id", "rank")
    return retrieval.score_map_faults(pool, _model_scores(pool))


def vector_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chunks' vectors of which some are stale, short or of an older configuration, for readers of tenant t1."""
    chunks, d = frames.chunks(spark, sf_dir), F.col("doc_id")
    vectors = chunks.where("chunk_index = 0").select(
        "chunk_id", "doc_id", "tenant", "namespace", F.when(d % 7 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"),
        F.when(d % 11 == 0, 32).otherwise(64).alias("dimensions"), F.when(d % 13 == 0, "c1").otherwise("c2").alias("config_hash"),
    )
    return retrieval.vector_faults(vectors, chunks.where("tenant = 't1'"), 64, {"config_hash": "c2"}).select("chunk_id", F.coalesce("rejection", F.lit("none")).alias("rejection"))


def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order is a path to its part: from the order, and for late lines over the supplier."""
    item = frames.table(spark, sf_dir, "lineitem")
    text = lambda name, c: F.concat(F.lit(f"{name}-"), F.col(c).cast("string"))
    order, supplier, part, own = text("order", "l_orderkey"), text("supplier", "l_suppkey"), text("part", "l_partkey"), F.array(text("chunk", "l_linenumber"), text("chunk", "l_suppkey"))
    edge = lambda depth, relation, source, target: F.struct(F.lit(depth).alias("depth"), F.lit(relation).alias("relation_id"), source.alias("source"), target.alias("target"), own.alias("chunk_ids"))
    short, long = F.array(edge(1, "holds", order, part)), F.array(edge(1, "from", order, supplier), edge(2, "supplies", supplier, part))
    paths = item.select("l_partkey", F.when(F.col("l_linenumber") > 3, 2).otherwise(1).alias("depth"), F.when(F.col("l_linenumber") > 3, long).otherwise(short).alias("edges"))
    return retrieval.preferred_evidence(paths, ["l_partkey"])


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests, with faults of each kind."""
    t, c = F.col("turn"), F.col("conv_id")
    asked = frames.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(c % 11 == 0, "  ").otherwise(F.col("text")).alias("query"), F.when(c % 7 == 0, "vector").when(c % 7 == 1, "keyword").alias("mode"), F.when(c % 13 == 0, " ").otherwise("en").alias("namespace"),
        F.when(c % 17 == 0, "").otherwise("t1").alias("tenant"), F.when(c % 5 == 0, "t2").otherwise("t1").alias("principal_tenant"), F.when(c % 3 == 0, F.array(F.lit("fr"))).otherwise(F.array(F.lit("en"), F.lit("fr"))).alias("principal_namespaces"),
        (t * 40).cast("int").alias("top_k"), F.when(t % 2 == 1, t.cast("int") * 30).alias("pool"),
    )
    return asked.select("conv_id", "turn", F.coalesce(retrieval.request_problem("keyword"), F.lit("none")).alias("problem"))


def embedding_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    fields = {"provider": F.col("p_brand"), "modelName": F.col("p_name"), "dimensions": size, "adapterId": F.when(size % 2 == 0, F.col("p_type")), "chunkerVersion": F.concat(F.lit("v"), size.cast("string"))}
    return frames.table(spark, sf_dir, "part").select("p_partkey", identity_hash(fields).alias("query_hash"), identity_hash(fields, True).alias("index_hash"))


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    text, none = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")), F.lit(None).cast("string")
    n = F.col("n") % 5
    key = incremental.event_key(
        F.lit("Help Desk"), F.when(n == 0, text(" Event #", "event_id")).when(n == 4, ""), F.when(n == 1, text("api_key: abc", "event_id")), F.when(n == 2, text("run/", "user_id")), F.when(n.isin(2, 3), F.lit("")), F.col("event_type"), none,
    )
    return e.select("event_id", key.alias("key"))


def alert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High values as alerts; one for each rule, signal and user class."""
    e = frames.table(spark, sf_dir, "events").where("value > 50")
    key = incremental.alert_key(F.concat(F.lit("High Value/"), (F.col("user_id") % 9).cast("string")), F.lit("latency"), F.when(F.col("value") > 90, "Critical").otherwise(""), F.col("event_type"), F.when(F.col("value") > 90, 90.0).otherwise(50.5))
    return incremental.first_alerts(e.select(key.alias("key"), "ts", "event_id"), "key", ["ts", "event_id"])


def _parsed(spark, sf_dir):
    d = F.col("doc_id")
    kinds = F.array(*map(F.lit, [ingest.LAYOUT_TYPES[0], "text/plain", "application/json", "text/markdown"]))
    return frames.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 19 == 0, "<!-- image --> ![a](b)").when(d % 23 == 0, F.concat(F.lit("a|b\nc|d\nsee below\n"), "text")).when(d % 29 == 0, "a,b,c\nd,e,f\n1,2,3").otherwise(F.col("text")).alias("body"),
        F.element_at(kinds, (d % 4 + 1).cast("int")).alias("content_type"), (d % 3 == 0).alias("has_layout"), F.when(d % 5 == 0, 1).alias("n_tables"), (d % 2).cast("int").alias("n_visuals"),
        (d % 6).cast("int").alias("n_pages"), F.greatest(F.lit(0), d % 6 - d % 4).cast("int").alias("n_pages_with_text"),
    )


def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_quality(_parsed(spark, sf_dir)).select("doc_id", "body_chars", F.array_join("risks", ",").alias("risks"), "quality")


def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_summary(ingest.parse_quality(_parsed(spark, sf_dir)), ["content_type"])


QUERIES = {f.__name__: f for f in (context_order, contradiction_clusters, score_map_rerank, score_map_faults, vector_faults, graph_evidence, request_checks, embedding_identity, event_keys, alert_dedupe, parse_quality, parse_summary)}

_POOL = f"{_KEYWORD}, pool as (select query_id, chunk_id, rank::int as rank from ranked where rank <= 30)"
_SCORES = f"""{_POOL}, given as (select query_id, chunk_id, rank as position, case when rank % 7 = 0 then 'nan'::double else (rank * 37 % 11) / 7.0::double end as score from pool
  union all select query_id, chunk_id, rank + 100, 9.0 from pool where rank % 5 = 0 union all select query_id, 'x' || chunk_id, rank + 200, 1.0 from pool where rank % 9 = 0),
  scores as (select * from given where query_id <> 3)"""
_PART = lambda c, allowed: f"regexp_replace(regexp_replace(lower({c}), '[^{allowed}]+', '_', 'g'), '^_+|_+$', '', 'g')"
_PARSED = f"""p as (select doc_id, coalesce(case when doc_id % 19 = 0 then '<!-- image --> ![a](b)' when doc_id % 23 = 0 then 'a|b' || chr(10) || 'c|d' || chr(10) || 'see below' || chr(10) || text when doc_id % 29 = 0 then 'a,b,c' || chr(10) || 'd,e,f' || chr(10) || '1,2,3' else text end, '') as body,
    ['{ingest.LAYOUT_TYPES[0]}', 'text/plain', 'application/json', 'text/markdown'][doc_id % 4 + 1] as content_type, doc_id % 3 = 0 as layout, doc_id % 5 = 0 as tables, doc_id % 2 as visuals, doc_id % 6 as pages, greatest(0, doc_id % 6 - doc_id % 4) as texted from documents),
  l as (select *, list_filter(list_transform(regexp_split_to_array(body, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') as lines from p),
  m as (select *, list_transform(list_filter(lines, lambda x: contains(x, '|')), lambda x: len(string_split(x, '|'))) as pipes, len(list_filter(lines, lambda x: len(string_split(x, ',')) >= 3)) as listed,
    length(regexp_replace({"".join("regexp_replace(" for _ in ingest.PICTURE_MARKS)}body{"".join(f", '{mark}', ' ', 'g')" for mark in ingest.PICTURE_MARKS)}, '^\\s+|\\s+$', '', 'g')) as body_chars from l),
  r as (select *, [body_chars = 0, content_type = '{ingest.LAYOUT_TYPES[0]}' and not layout,
      not tables and ((len(pipes) >= 2 and len(list_distinct(pipes)) <= 2) or (content_type <> 'application/json' and (listed >= 3 or regexp_matches(body, '{ingest.TABLE_WORDS}')))),
      visuals = 0 and regexp_matches(body, '{ingest.PICTURE_WORDS}'), pages > 0 and texted = 0, pages > 0 and texted::double / pages < 0.8] as f from m),
  q as (select doc_id, content_type, body_chars, f, greatest(0, least(100, 100 - {" - ".join(f"{cost} * f[{i}]::int" for i, cost in enumerate(ingest.RISK_COSTS.values(), 1))} + 5 * layout::int + 5 * tables::int + 5 * visuals + 2 * (pages > 0)::int)) as quality from r)"""
ORACLES = {
    "context_order": f"""with {_POOL}, c as (select pool.*, doc_id, tag_class, captured_at from pool join chunks using (chunk_id))
        select query_id, chunk_id, row_number() over (partition by query_id order by (tag_class = 2)::int desc, (tag_class >= 1)::int, doc_id % 6, case when query_id % 2 = 0 then captured_at end desc nulls last, rank, chunk_id)::int as place from c""",
    "contradiction_clusters": f"""with {frames.CHUNKS}, marked as (select * replace (text || case when doc_id % 4 = 0 then ' Except so' when doc_id % 4 = 1 then ' superseded' when doc_id % 4 = 2 and chunk_index % 2 = 1 then ' NEVER again' else '' end as text) from chunks)
        select doc_id, count(*) as n_chunks, string_agg(chunk_id, ',' order by chunk_index) as chunk_ids from marked where {" or ".join(f"contains(lower(text), ' {t} ')" for t in context.CONTRADICTION_TERMS)} group by 1""",
    "score_map_rerank": f"""with {_SCORES}, u as (select query_id, chunk_id, min_by(score, position) as s from scores where not isnan(score) group by all), j as (select pool.*, s, bool_or(s is not null) over (partition by query_id) as reranked from pool left join u using (query_id, chunk_id)),
        o as (select query_id, chunk_id, row_number() over (partition by query_id order by floor(s * 1e6 + 0.5) desc nulls last, rank, chunk_id)::int as new_rank, reranked, coalesce(floor(s * 1e6 + 0.5) / 1e6, -1.0) as model_score from j where s is not null or not reranked) select * from o where new_rank <= 20""",
    "score_map_faults": f"""with {_SCORES} select query_id, chunk_id, position, code from (select s.*, case when p.chunk_id is null then 'unknown_candidate' when isnan(s.score) then 'invalid_score' end as code from scores s left join pool p using (query_id, chunk_id)) where code is not null""",
    "vector_faults": f"""with {frames.CHUNKS} select chunk_id, case when tenant <> 't1' then 'access_denied_or_missing_chunk' when doc_id % 7 = 0 then 'stale_vector' when doc_id % 11 = 0 then 'vector_dimension_mismatch' when doc_id % 13 = 0 then 'embedding_identity_mismatch' else 'none' end as rejection from chunks where chunk_index = 0""",
    "graph_evidence": """with p as (select l_partkey, case when l_linenumber > 3 then 2 else 1 end as depth, case when l_linenumber = l_suppkey then 1 else 2 end as n_evidence, case when l_linenumber > 3 then '1:from:order-' || l_orderkey || ':supplier-' || l_suppkey || '|2:supplies:supplier-' || l_suppkey || ':part-' || l_partkey else '1:holds:order-' || l_orderkey || ':part-' || l_partkey end as path_key from lineitem)
        select l_partkey, depth, n_evidence, depth as n_edges, path_key from p qualify row_number() over (partition by l_partkey order by depth desc, n_evidence desc, path_key) = 1""",
    "request_checks": f"""select conv_id, turn, case when conv_id % 11 = 0 or trim(coalesce(text, '')) = '' then 'query_required' when conv_id % 7 = 0 then 'mode_not_served' when conv_id % 13 = 0 then 'namespace_required' when conv_id % 17 = 0 then 'tenant_required' when conv_id % 5 = 0 then 'tenant_mismatch'
        when conv_id % 3 = 0 then 'namespace_not_granted' when turn * 40 < 1 or turn * 40 > {retrieval.MOST_TOP_K} then 'top_k_out_of_range' when turn % 2 = 1 and (turn * 30 < turn * 40 or turn * 30 > {retrieval.MOST_POOL}) then 'pool_out_of_range' else 'none' end as problem from conversations""",
    "embedding_identity": """with f as (select p_partkey, '{"provider":"' || p_brand || '","modelName":"' || p_name || '","dimensions":' || p_size || case when p_size % 2 = 0 then ',"adapterId":"' || p_type || '"' else '' end as q, p_size from part) select p_partkey, sha256(q || '}') as query_hash, sha256(q || ',"chunkerVersion":"v' || p_size || '"}') as index_hash from f""",
    "event_keys": f"""select event_id, 'rag_support_event:help_desk:' || case event_id % 5 when 0 then 'event_' || event_id when 1 then 'api_key:_redacted' when 2 then 'run_' || user_id else 'unknown' end || ':' || {_PART("event_type", "0-9a-z._:-")} || ':v1' as key from events""",
    "alert_dedupe": f"""with k as (select 'rag_slo_alert:high_value_' || user_id % 9 || ':latency:' || case when value > 90 then 'critical' else 'unknown' end || ':' || {_PART("event_type", "0-9a-z._-")} || ':' || case when value > 90 then '90' else '50.5' end as key, ts, event_id from events where value > 50)
        select key, min(ts) as ts, min_by(event_id, (ts, event_id)) as event_id, count(*) as n_alerts from k group by 1""",
    "parse_quality": f"with {_PARSED} select doc_id, body_chars, concat_ws(',', {', '.join(f'''case when f[{i}] then '{risk}' end''' for i, risk in enumerate(ingest.RISK_COSTS, 1))}) as risks, quality::int as quality from q",
    "parse_summary": f"with {_PARSED} select content_type, count(*) as n, round(avg(quality), 3) as mean_quality, min(quality)::int as worst, count(*) filter (list_bool_or(f)) as n_at_risk from q group by 1",
}
