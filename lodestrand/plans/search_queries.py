"""Queries of access, planning, retrieval, fusion and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, half_up, safety_flags, terms
from ..functions.vectors import hashed_embedding, max_sim
from ..operators import access, context, planning, retrieval
from ..sources.tables import staged
from . import frames
from .ingest_queries import _FLAGS

PRINCIPAL = access.Principal("u1", "t1", ("en", "fr"), tags=("internal",))


def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.documents(spark, sf_dir).select("doc_id", F.coalesce(access.denial(PRINCIPAL), F.lit("granted")).alias("decision"))


def visible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = access.Filter("t1", "en", PRINCIPAL, trust_tiers=("verified_partner", "generated_or_derived"))
    return access.visible(frames.documents(spark, sf_dir), f).select("doc_id", "trust_tier")


def trust_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = F.array(*map(F.lit, access.TRUST_TIERS))
    pick = lambda shift: F.element_at(tiers, ((F.col("doc_id") + F.lit(shift)) % 6 + 1).cast("int"))
    override = F.when(F.col("doc_id") % 4 == 0, pick(3))
    tier, upgrade = access.resolved_trust(pick(0), pick(2), override)
    return frames.documents(spark, sf_dir).select("doc_id", tier.alias("tier"), upgrade.alias("unsafe_upgrade"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = frames.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(terms(F.col("text")), " ").alias("terms"))


def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of every turn of the conversations (numbered by conversation and turn; of a repeated turn the least text), and of the stated questions."""
    turns = frames.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("question"))
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "question").unionByName(frames.questions(spark).select((-1 - F.col("query_id")).alias("query_id"), "question"))
    plans = planning.planned(asked)
    return planning.budgeted(planning.branches(plans, keep=("route",)), F.col("route")).select("query_id", "branch", "kind", "query", "weight", "top_k", "pool")


def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = frames.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))
    asked = frames.questions(spark).select(F.lit(-1).cast("long").alias("conv_id"), F.col("query_id").alias("turn"), "question")
    plans = planning.planned(asked.unionByName(turns))
    return plans.select("conv_id", "turn", "intent", "route", "direction", F.array_join("source_hints", ",").alias("source_hints"), half_up(F.col("confidence"), 2).alias("confidence"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table, written once for a query's passes over it."""
    return staged(frames.chunks(spark, sf_dir), "chunks")


def _keyword(spark, sf_dir, k, chunks=None):
    chunks = _chunks(spark, sf_dir) if chunks is None else chunks
    return retrieval.ranked(retrieval.keyword_scores(chunks, retrieval.requests_of(frames.requests(spark))), k)


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir, 10).select("query_id", "chunk_id", "score", "rank")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25(_chunks(spark, sf_dir), retrieval.requests_of(frames.requests(spark)))
    return retrieval.ranked(found, 10).select("query_id", "chunk_id", "score", "rank")


def neighbour_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.keyword_scores(_chunks(spark, sf_dir), retrieval.requests_of(frames.requests(spark)))
    return retrieval.ranked(retrieval.neighbour_boost(scored), 20).select("query_id", "chunk_id", "score", "rank")


def freshness_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with even ids are taken to be about freshness."""
    return retrieval.freshness_boost(_keyword(spark, sf_dir, 50), asked=F.col("query_id") % 2 == 0).select("query_id", "chunk_id", "score")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 20, against all."""
    vectors = frames.table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(vectors, vectors.where("vec_id % 20 = 0"))


def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as four patches against a stated query of two vectors."""
    vectors = frames.table(spark, sf_dir, "embeddings")
    patches = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    query = F.array(*(F.array(*(F.lit(1.0 if j % p == 0 else -0.5) for j in range(16))) for p in (2, 3)))
    return vectors.select("vec_id", half_up(max_sim(query, patches), 6).alias("score"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding of each benchmark item, as its counts' largest dimension, their sum and their length."""
    made = hashed_embedding(frames.table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return made.select("item_id", half_up(total, 6).alias("total"), half_up(F.array_max("embedding"), 6).alias("largest"), half_up(F.array_min("embedding"), 6).alias("smallest"))


def _hybrid(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    requests = retrieval.requests_of(frames.requests(spark))
    words = retrieval.ranked(retrieval.keyword_scores(chunks, requests), 80)
    vectors = retrieval.ranked(retrieval.hashed_vector_scores(chunks, requests), 80)
    return words.select("query_id", *retrieval.ORDER, "score", "rank"), vectors


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: keyword and vector rankings of all chunks, fused."""
    words, vectors = _hybrid(spark, sf_dir)
    fused = retrieval.rrf([(words, 1.0), (vectors, 0.8)])
    return retrieval.ranked(fused, 10, order=("best_rank", *retrieval.ORDER)).select("query_id", "doc_id", "chunk_index", "score", "rank")


def planned_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions' planned branches, each searched with its own top_k, and fused by their weights."""
    plans = planning.planned(frames.questions(spark))
    branches = planning.budgeted(planning.branches(plans, keep=("route",)), F.col("route"))
    return retrieval.planned_retrieval(_chunks(spark, sf_dir), branches).select("query_id", "chunk_id", "score", "rank")


def score_norm_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, vectors = _hybrid(spark, sf_dir)
    return retrieval.ranked(retrieval.normalised_sum([(words, 0.6), (vectors, 0.4)]), 10).select("query_id", "doc_id", "chunk_index", "score", "rank")


def connected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    found = retrieval.connected(_keyword(spark, sf_dir, 10, chunks), chunks)
    return found.select("query_id", "doc_id", "chunk_index", "score", "origin")


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = retrieval.requests_of(frames.requests(spark))
    return retrieval.reranked(_keyword(spark, sf_dir, 20), requests).select("query_id", "chunk_id", "rank", "rerank_score")


def diverse_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = retrieval.requests_of(frames.requests(spark))
    pool = retrieval.reranked(_keyword(spark, sf_dir, 50), requests).select("query_id", *retrieval.ORDER, "text_hash", "source_id", "rank", "rerank_score")
    return retrieval.diversified(pool).select("query_id", "chunk_id", "position")


def retrieval_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.diagnosed(_keyword(spark, sf_dir, 10), frames.requests(spark))


def round_robin_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.round_robin(_keyword(spark, sf_dir, 20)).select("query_id", "chunk_id", "place")


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = context.without_repeats(context.optimised(_keyword(spark, sf_dir, 30)).select("query_id", "chunk_id", "text", "place"))
    return context.packed(pool)


def context_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _keyword(spark, sf_dir, 50).withColumn("safety_flags", safety_flags(F.col("text")))
    judged = context.rejections(pool, F.lit("en"), F.lit("2026-06-23").cast("timestamp"), 600, access.TRUST_TIERS[:4])
    return judged.select("query_id", "chunk_id", F.coalesce("rejection", F.lit("none")).alias("rejection"))


def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.gated(context.evidence(_keyword(spark, sf_dir, 5), frames.requests(spark), 3, 3))


QUERIES = {f.__name__: f for f in (access_filter, visible_documents, trust_resolution, query_terms, planned_queries, intent_classify, keyword_topk, bm25_topk, neighbour_boost, freshness_boost, vector_topk, maxsim, hash_embedding, rrf_hybrid, planned_fusion, score_norm_hybrid, connected_chunks, rerank, diverse_rerank, retrieval_diagnosis, round_robin_sources, context_pack, context_rejections, evidence_status)}

_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TERMS = lambda c: f"""(select case when len(k) > 0 then k else e end from (select e, list_filter(e, lambda t: length(t) > 1 and not list_contains({_STOPS}, t)) as k from (select (select coalesce(list(w order by i), []::varchar[]) from (select w, min(i) as i from (select unnest(a) as w, generate_subscripts(a, 1) as i from (select regexp_extract_all(lower({c}), '[a-z0-9]+') as a)) group by w)) as e)))"""
_KEYWORD = f"""{frames.CHUNKS}, {frames.QUERY_ROWS},
  asked as (select query_id, query, {_TERMS("query")} as terms from requests),
  wanted as (select query_id, query, unnest(terms) as term from asked),
  hay as (select *, lower(text || chr(10) || title) as h from chunks),
  weights as (select term, least(2.5, 1 + ln(((select count(*) from chunks) + 1)::double / (count(h) + 1))) as w from (select distinct term from wanted) left join hay on contains(h, term) group by term),
  totals as (select query_id, sum(w) as total from wanted join weights using (term) group by query_id),
  hits as (select query_id, any_value(query) as query, chunk_id, doc_id, chunk_index, any_value(h) as h, sum(w) as matched,
             sum(least((length(h) - length(replace(h, term, ''))) / length(term), 3) * w) as often, bool_or(contains(lower(title), term)) as in_title
           from wanted join weights using (term) join hay on contains(h, term) group by query_id, chunk_id, doc_id, chunk_index),
  scored as (select query_id, chunk_id, doc_id, chunk_index, floor((matched / total + 0.05 * least(often, 10.0) + case when contains(h, lower(query)) then 1.0 else 0.0 end + case when in_title then 0.25 else 0.0 end)::double * 1000 + 0.5) / 1000 as score
             from hits join totals using (query_id)),
  ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index, chunk_id) as rank from scored)"""
_VECTOR = """
  ctok as (select chunk_id, doc_id, chunk_index, unnest(case when len(a) > 0 then a else [substr(sha256(text), 1, 16)] end) as t from (select *, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]*') as a from chunks)),
  qtok as (select query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9_-]*')) as t from requests),
  slot as (select t, ('0x' || substr(sha256(t), 1, 8))::bigint % 64 as d, case when ('0x' || substr(sha256(t), 9, 2))::bigint % 2 = 0 then 1 else -1 end as s from (select t from ctok union select t from qtok)),
  cvec as (select chunk_id, doc_id, chunk_index, d, sum(s)::double as v from ctok join slot using (t) group by all), qvec as (select query_id, d, sum(s)::double as v from qtok join slot using (t) group by all),
  cn as (select chunk_id, sqrt(sum(v * v)) as n from cvec group by 1), qn as (select query_id, sqrt(sum(v * v)) as n from qvec group by 1),
  vscored as (select query_id, chunk_id, doc_id, chunk_index, floor(coalesce(sum(cvec.v * qvec.v), 0) / any_value(cn.n) / any_value(qn.n) * 1e6 + 0.5) / 1e6 as score
              from cvec join qvec using (d) join cn using (chunk_id) join qn using (query_id) group by all having any_value(cn.n) > 0),
  vranked as (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index, chunk_id) as rank from vscored where score > 0)"""

_SQL_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ASKS = lambda p: f"regexp_matches(q, '(?i){p}')".replace("can't", "can''t")
_HINTS = ", ".join(f"case when {_ASKS(p)} then {_SQL_LIST(h)}::varchar[] else []::varchar[] end" for _, h, p in planning.INTENTS)
#: Plans of asked_q(key, q), as planning.planned() makes them.
_PLANS = rf"""
  words as (select *, list_filter(list_transform(list_concat(regexp_extract_all(q, '"([^"]{{2,80}})"', 1), regexp_extract_all(q, '(\b[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*){{0,4}}\b)', 1),
      regexp_extract_all(q, '(\b[A-Za-z]+[-_][A-Za-z0-9_-]+|\b[A-Z]{{2,}}\b|\b[A-Za-z]*\d[A-Za-z0-9._-]*\b)', 1)), lambda t: trim(t)), lambda t: length(t) > 1 and not list_contains({_SQL_LIST(planning.NO_ENTITIES)}, t)) as w,
      regexp_extract_all(lower(q), '[a-z0-9][a-z0-9_-]*') as t,
      list_filter([{", ".join(f"case when {_ASKS(p)} then '{k}' end" for k, p in planning.RELATIONS.items())}], lambda x: x is not null) as relation_kinds, {_ASKS(planning.GRAPH_NEEDED)} as needed from asked_q),
  low_words as (select *, list_slice(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), 1, 8) as low from words),
  high_words as (select *, list_slice(list_filter(t, lambda x, i: list_position(t, x) = i and length(x) > 2 and not list_contains({_SQL_LIST(planning.QUESTION_STOP_WORDS)}, x) and not list_contains(list_transform(low, lambda y: lower(y)), x)), 1, 8) as high,
      case when needed then 'graph_required' when len(relation_kinds) > 0 then 'graph_optional' else 'none' end as route,
      case when not needed and len(relation_kinds) = 0 then 'any' when {_ASKS(planning.INCOMING)} then 'incoming' when {_ASKS(planning.OUTGOING)} then 'outgoing' else 'any' end as direction from low_words),
  plans as (select *, list_filter([case when route <> 'none' then 'relationship' end, {", ".join(f"case when {_ASKS(p)} then '{n}' end" for n, _, p in planning.INTENTS)}], lambda x: x is not null) as intents,
      list_sort(list_distinct(flatten([case when route <> 'none' then ['graph']::varchar[] else []::varchar[] end, {_HINTS}]))) as hints from high_words)"""
_BRANCHES = r"""
  variants as (select key, route, unnest([1, 2, 3, 4]) as ix, unnest(['original', 'low_level', 'high_level', 'graph']) as kind,
      unnest([trim(regexp_replace(q, '\s+', ' ', 'g')), array_to_string(low, ' '), array_to_string(high, ' '), case when route <> 'none' then array_to_string(relation_kinds, ' ') || ' ' || array_to_string(low, ' ') else '' end]) as query,
      unnest([1.0, 0.9, 0.75, case when route = 'graph_required' then 0.95 else 0.8 end])::double as weight from plans),
  first_ones as (select * from variants where trim(query) <> '' qualify row_number() over (partition by key, lower(query) order by ix) = 1),
  numbered as (select *, row_number() over (partition by key order by ix) as branch from first_ones),
  branches as (select key as query_id, branch::int as branch, kind, query, weight, least(ceil(10 * case when kind in ('low_level', 'high_level', 'hyde') then 0.75 when kind = 'graph' and route = 'graph_required' then 1.25 else 1.0 end), 100)::int as top_k from numbered where branch <= 3)"""
_BLOCKS = f"""pool as (select r.query_id, r.chunk_id, c.text, r.rank, floor((r.score + case trust_tier when 'trusted_internal' then 0.3 when 'verified_partner' then 0.2 when 'user_provided' then 0.05 else 0.0 end + case when contains(c.text, '|') then 0.15 else 0.0 end)::double * 1000 + 0.5) / 1000 as context_score
      from ranked r join chunks c using (chunk_id) where rank <= 30),
  placed as (select query_id, chunk_id, row_number() over (partition by query_id order by context_score desc, rank) as place, greatest(1, ceil(length(text) / 4.0))::bigint as tokens,
      list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 3)) as own from pool),
  walk(query_id, place, sets, used, n, chunk_id, tokens, taken) as (
      select query_id, 0::bigint, []::varchar[][], 0::bigint, 0::bigint, ''::varchar, 0::bigint, false from (select distinct query_id from placed)
      union all select query_id, ix, case when fresh then list_append(sets, own) else sets end, used + case when fits then more else 0 end, n + case when fits then 1 else 0 end, chunk, more, fits
      from (select *, fresh and used + more <= 2000 and n < 8 as fits from (select w.query_id, p.place as ix, w.sets, w.used, w.n, p.own, p.chunk_id as chunk, p.tokens as more,
            len(list_filter(w.sets, lambda s: len(list_intersect(p.own, s)) >= 0.9 * len(list_distinct(list_concat(p.own, s))))) = 0 as fresh from walk w join placed p on p.query_id = w.query_id and p.place = w.place + 1)))"""

ORACLES = {
    "planned_queries": f"with {frames.QUESTION_ROWS}, asked_q as (select -1 - query_id as key, question as q from questions union all select conv_id * 1000 + turn, min(coalesce(text, '')) from conversations group by conv_id, turn), {_PLANS}, {_BRANCHES} select *, least(greatest(top_k * 4, 20), 5000)::int as pool from branches",
    "intent_classify": f"""with {frames.QUESTION_ROWS}, asked_q as (select -1::bigint as conv_id, query_id as turn, question as q from questions union all select conv_id, turn, coalesce(text, '') from conversations), {_PLANS}
        select conv_id, turn, coalesce(intents[1], 'general') as intent, route, direction, case when len(hints) = 0 then 'docs' else array_to_string(hints, ',') end as source_hints,
          floor((case when len(intents) = 0 then 0.35 else least(0.95, 0.6 + 0.1 * len(intents)) end)::double * 100 + 0.5) / 100 as confidence from plans""",
    "planned_fusion": f"""with {frames.QUESTION_ROWS}, asked_q as (select query_id as key, question as q from questions), {_PLANS}, {_BRANCHES}, {_KEYWORD.replace(frames.QUERY_ROWS, "requests as (select query_id * 10 + branch as query_id, query from branches)")},
        parts as (select b.query_id, doc_id, chunk_index, chunk_id, rank, floor(weight / (60 + rank) * 1e6 + 0.5) / 1e6 as part from ranked r join branches b on r.query_id = b.query_id * 10 + b.branch where rank <= top_k),
        fused as (select query_id, doc_id, chunk_index, chunk_id, floor(sum(part) * 1e6 + 0.5) / 1e6 as score, min(rank) as best from parts group by all)
        select query_id, chunk_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, best, doc_id, chunk_index, chunk_id) as rank from fused) where rank <= 10""",
    "context_rejections": f"""with {_KEYWORD}, top as (select r.query_id, c.* from ranked r join chunks c using (chunk_id) where rank <= 50)
        select query_id, chunk_id, case when namespace <> 'en' then 'namespace_mismatch' when trust_tier not in ('trusted_internal', 'verified_partner', 'user_provided', 'generated_or_derived') then 'disallowed_trust_tier'
          when epoch_us(timestamp '2026-06-23') - epoch_us(captured_at) > 600 * 86400000000 then 'stale_source' when contains(f, 'possible_prompt_injection') then 'unsafe_prompt_injection' when contains(f, 'secret_like_text') then 'unsafe_secret' else 'none' end as rejection
        from (select *, {_FLAGS} as f from top)""",
    "context_pack": f"with recursive {_KEYWORD}, {_BLOCKS} select query_id, chunk_id, n::int as position, tokens from walk where taken",
    "access_filter": f"""with {frames.DOCS} select doc_id, case when namespace is null then 'missing_resource_scope' when tenant <> 't1' then 'tenant_mismatch' when namespace not in ('en', 'fr') then 'namespace_not_granted'
        when tag_class = 2 then 'tag_not_granted' else 'granted' end as decision from docs""",
    "visible_documents": f"with {frames.DOCS} select doc_id, trust_tier from docs where tenant = 't1' and namespace = 'en' and tag_class < 2 and trust_tier in ('verified_partner', 'generated_or_derived')",
    "trust_resolution": f"""with r as (select doc_id, greatest(doc_id % 6, (doc_id + 2) % 6) as floor_rank, case when doc_id % 4 = 0 then (doc_id + 3) % 6 end as o from documents)
        select doc_id, list_extract({access.TRUST_TIERS!r}, (case when o is not null and o >= floor_rank then o else floor_rank end + 1)::int) as tier, coalesce(o < floor_rank, false) as unsafe_upgrade from r""",
    "query_terms": f"select conv_id, turn, array_to_string({_TERMS('text')}, ' ') as terms from conversations",
    "keyword_topk": f"with {_KEYWORD} select query_id, chunk_id, score, rank::int as rank from ranked where rank <= 10",
    "freshness_boost": f"""with {_KEYWORD}, top as (select r.*, epoch_us(captured_at)::double as t from ranked r join chunks using (chunk_id) where rank <= 50), e as (select *, min(t) over (partition by query_id) as o, max(t) over (partition by query_id) as n from top)
        select query_id, chunk_id, case when query_id % 2 = 0 and n > o then floor((score + (t - o) / (n - o) * 0.2) * 1000 + 0.5) / 1000 else score end as score from e""",
    "neighbour_boost": f"""with {_KEYWORD}, near as (select s.*, c.text, max(s.score) over (partition by s.query_id, s.doc_id order by s.chunk_index range between 1 preceding and 1 following) as best from scored s join chunks c using (chunk_id)),
        b as (select query_id, chunk_id, doc_id, chunk_index, case when len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 and best > score then floor((score + least(0.75, best * 0.4)) * 1000 + 0.5) / 1000 else score end as score from near)
        select query_id, chunk_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index, chunk_id) as rank from b) where rank <= 20""",
    "bm25_topk": f"""with {frames.CHUNKS}, {frames.QUERY_ROWS}, wanted as (select query_id, unnest({_TERMS("query")}) as term from requests),
        split as (select chunk_id, doc_id, chunk_index, regexp_extract_all(lower(text), '[a-z0-9]+') as b, regexp_extract_all(lower(title), '[a-z0-9]+') as t from chunks),
        sized as (select chunk_id, doc_id, chunk_index, len(b) + 2.0 * len(t) as dl from split),
        tok as (select chunk_id, unnest(b) as term, 1.0 as w from split union all select chunk_id, unnest(t), 2.0 from split),
        tf as (select chunk_id, term, sum(w)::double as f from tok where term in (select term from wanted) group by all),
        df as (select term, count(*) as df from tf group by term), a as (select count(*) as n, avg(dl) as avgdl from sized),
        scored as (select query_id, chunk_id, doc_id, chunk_index, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)))::double * 1e6 + 0.5) / 1e6 as score
                   from wanted join tf using (term) join df using (term) join sized using (chunk_id), a group by query_id, chunk_id, doc_id, chunk_index)
        select query_id, chunk_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index, chunk_id) as rank from scored) where rank <= 10""",
    "vector_topk": """with pairs as (select q.vec_id as query_id, v.vec_id, floor(list_cosine_similarity(q.embedding::double[], v.embedding::double[]) * 1e6 + 0.5) / 1e6 as score from embeddings q, embeddings v where q.vec_id % 20 = 0)
        select query_id, vec_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 10""",
    "maxsim": """with p as (select vec_id, unnest(range(0, 4)) as i, embedding::double[] as e from embeddings), q as (select 2 as p, list_transform(range(0, 16), lambda j: case when j % 2 = 0 then 1.0 else -0.5 end::double) as v union all select 3, list_transform(range(0, 16), lambda j: case when j % 3 = 0 then 1.0 else -0.5 end::double)),
        b as (select vec_id, q.p, max(list_cosine_similarity(v, list_slice(e, i * 16 + 1, i * 16 + 16))) as best from p, q group by all)
        select vec_id, floor(sum(best) / 2 * 1e6 + 0.5) / 1e6 as score from b group by vec_id""",
    "hash_embedding": """with a as (select item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_-]*')) as t from benchmark),
        c as (select item_id, ('0x' || substr(sha256(t), 1, 8))::bigint % 64 as d, sum(case when ('0x' || substr(sha256(t), 9, 2))::bigint % 2 = 0 then 1 else -1 end)::double as v from a group by all),
        n as (select item_id, sqrt(sum(v * v)) as n, count(*) as dims from c group by 1)
        select item_id, floor(sum(v / n) * 1e6 + 0.5) / 1e6 as total, floor(max(case when dims < 64 then greatest(v / n, 0) else v / n end) * 1e6 + 0.5) / 1e6 as largest, floor(min(case when dims < 64 then least(v / n, 0) else v / n end) * 1e6 + 0.5) / 1e6 as smallest from c join n using (item_id) group by item_id""",
    "rrf_hybrid": f"""with {_KEYWORD}, {_VECTOR}, parts as (select query_id, doc_id, chunk_index, chunk_id, rank, floor(1.0::double / (60 + rank) * 1e6 + 0.5) / 1e6 as part from ranked where rank <= 80 union all select query_id, doc_id, chunk_index, chunk_id, rank, floor(0.8::double / (60 + rank) * 1e6 + 0.5) / 1e6 from vranked where rank <= 80),
        fused as (select query_id, doc_id, chunk_index, chunk_id, floor(sum(part) * 1e6 + 0.5) / 1e6 as score, min(rank) as best from parts group by all)
        select query_id, doc_id, chunk_index, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, best, doc_id, chunk_index, chunk_id) as rank from fused) where rank <= 10""",
    "score_norm_hybrid": f"""with {_KEYWORD}, {_VECTOR}, parts as (select query_id, doc_id, chunk_index, chunk_id, score / max(score) over (partition by query_id) * 0.6 as part from ranked where rank <= 80 union all select query_id, doc_id, chunk_index, chunk_id, score / max(score) over (partition by query_id) * 0.4 from vranked where rank <= 80),
        fused as (select query_id, doc_id, chunk_index, chunk_id, floor(sum(part)::double * 1000 + 0.5) / 1000 as score from parts group by all)
        select query_id, doc_id, chunk_index, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index, chunk_id) as rank from fused) where rank <= 10""",
    "connected_chunks": f"""with {_KEYWORD}, seeds as (select * from ranked where rank <= 10),
        near as (select s.query_id, c.doc_id, c.chunk_index, c.chunk_id, max(floor(greatest(0.01, s.score * 0.82 - 0.03) * 1000 + 0.5) / 1000) as score from seeds s join chunks c on c.doc_id = s.doc_id and abs(c.chunk_index - s.chunk_index) = 1
                 where not exists (select 1 from seeds t where t.query_id = s.query_id and t.doc_id = c.doc_id and t.chunk_index = c.chunk_index) group by all),
        best as (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index, chunk_id) as n from near)
        select query_id, doc_id, chunk_index, score, 'seed' as origin from seeds union all select query_id, doc_id, chunk_index, score, 'neighbour' from best where n <= 12""",
    "rerank": f"""with {_KEYWORD}, top as (select r.*, trust_tier, list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9]+')) as tok, terms, max(score) over (partition by query_id) as best from ranked r join chunks c using (chunk_id) join asked using (query_id) where rank <= 20)
        select query_id, chunk_id, rank::int as rank, floor((0.34 * score / best + 0.17 * case trust_tier when 'trusted_internal' then 1.0 when 'verified_partner' then 0.9 when 'user_provided' then 0.7 when 'generated_or_derived' then 0.45 when 'external_untrusted' then 0.25 else 0.0 end::double
            + 0.17 * len(list_intersect(tok, terms)) / len(terms)::double + 0.11 / rank::double)::double * 1e6 + 0.5) / 1e6 as rerank_score from top""",
    "retrieval_diagnosis": f"""with {_KEYWORD}, a as (select query_id, count(*) as n, max(score) as best, count(distinct doc_id) as d from ranked where rank <= 10 group by 1),
        b as (select query_id, case when n is null then 'no_candidates' when n < 10 then 'few_candidates' when best < 0.5 then 'weak_scores' when d = 1 then 'single_document' else 'sufficient' end as diagnosis from requests left join a using (query_id))
        select *, case when diagnosis = 'sufficient' then 'none' else 'expanded_pool' end as retry from b""",
    "round_robin_sources": f"""with {_KEYWORD}, top as (select r.*, source_id from ranked r join chunks using (chunk_id) where rank <= 20), t as (select *, row_number() over (partition by query_id, source_id order by rank) as turn, min(rank) over (partition by query_id, source_id) as first_rank from top)
        select query_id, chunk_id, (row_number() over (partition by query_id order by turn, first_rank))::int as place from t""",
    "evidence_status": f"""with {_KEYWORD}, top as (select r.*, source_id, trust_tier from ranked r join chunks using (chunk_id) where rank <= 5),
        a as (select query_id, count(doc_id) as n_blocks, count(*) filter (trust_tier in ('trusted_internal', 'verified_partner', 'user_provided')) as n_trusted, count(distinct source_id) as n_sources from requests left join top using (query_id) group by 1),
        s as (select *, case when n_blocks = 0 then 'no_evidence' when n_blocks < 3 then 'insufficient_citations' when n_trusted < 3 then 'insufficient_trusted_citations' else 'answerable' end as status from a)
        select *, case status when 'answerable' then 'answer' when 'no_evidence' then 'refuse' else 'human_review' end as action from s""",
}
