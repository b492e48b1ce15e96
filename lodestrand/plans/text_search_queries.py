"""Registered queries of the positional index and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import stem_ctes
from ..functions.text import STOP_WORDS
from ..operators import ann, postings, retrieval
from . import frames

#: Stated full-text requests: words, phrases, alternatives, exclusions; stop words alone find nothing.
SEARCHES = [(0, "thand hation"), (1, '"la question"'), (2, "entre deux or schichte"), (3, "note contact -password"), (4, "of the"), (5, '"und der" und los'), (6, "token -note"), (7, "threst or the or ciones para")]


def _index(spark: SparkSession, sf_dir: str) -> postings.Index:
    fields = {"title": F.col("title"), "citation": F.concat_ws(" ", F.lit("source"), "source_id", "namespace"), "body": F.col("text")}
    return postings.built(frames.chunks(spark, sf_dir), fields)


def _best(found: DataFrame) -> DataFrame:
    return retrieval.ranked(found, 20, order=postings.KEY).select("query_id", *postings.KEY, "score", "rank")


def weighted_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = spark.createDataFrame(SEARCHES, "query_id long, query string")
    return _best(postings.full_text(_index(spark, sf_dir), searches))


def bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(postings.bm25_prefix(_index(spark, sf_dir), frames.requests(spark)))


#: Cells, and cells that a query looks into, for the given vectors of 64 dimensions.
CELLS, PROBES, DIMENSIONS = 64, 40, 64


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 20, against the cells of all."""
    vectors = frames.table(spark, sf_dir, "embeddings")
    return ann.searched(ann.indexed(vectors, DIMENSIONS, CELLS), vectors.where("vec_id % 20 = 0"), DIMENSIONS, probes=PROBES)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same held against exact search: whether the mean recall at 10 is 0.9 or more."""
    vectors = frames.table(spark, sf_dir, "embeddings")
    exact = retrieval.vector_topk(vectors, vectors.where("vec_id % 20 = 0"))
    return ann.recall(ann_topk(spark, sf_dir), exact).select("n_queries", (F.col("recall") >= 0.9).alias("reached"))


QUERIES = {"weighted_fts": weighted_fts, "bm25_prefix": bm25_prefix, "ann_topk": ann_topk, "ann_recall": ann_recall}

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_INDEX = (
    frames.CHUNKS
    + """, fields as (select doc_id, chunk_index, lower(title) as title, lower('source ' || source_id || ' ' || namespace) as citation, lower(text) as body,
         regexp_extract_all(lower(title), '[a-z0-9]+') as a, regexp_extract_all(lower('source ' || source_id || ' ' || namespace), '[a-z0-9]+') as b, regexp_extract_all(lower(text), '[a-z0-9]+') as c from chunks),
  occ as (select doc_id, chunk_index, 'title' as field, 1.0 as inverse, 4.0 as w, unnest(a) as term, unnest(range(len(a))) as pos from fields
    union all select doc_id, chunk_index, 'citation', 1 / 0.4, 2.0, unnest(b), unnest(range(len(b))) + len(a) + 1 from fields
    union all select doc_id, chunk_index, 'body', 1 / 0.2, 1.0, unnest(c), unnest(range(len(c))) + len(a) + len(b) + 2 from fields),
  words as (select distinct term as w from occ), """
    + stem_ctes("words", "w as term", "w", "dictionary")
)
_BONUS = "case when q <> '' and contains({hay}, q) then 0.25 else 0 end"


def _weighted_sql() -> str:
    return (
        "with "
        + _INDEX
        + f""", searches(query_id, query) as (values {frames._values(SEARCHES)}),
  parts as (select query_id, unnest(p) as part, unnest(range(len(p))) as clause, p from (select query_id, regexp_extract_all(lower(query), '-?"[^"]*"|[^\\s"]+') as p from searches)),
  wanted as (select query_id, len(list_filter(p[1:clause + 1], lambda x: x = 'or')) as alt, clause, starts_with(part, '-') as negated, regexp_extract_all(part, '[a-z0-9]+') as ts from parts where part <> 'or'),
  asked_words as (select query_id, alt, clause, negated, o as "offset", w from (select *, unnest(ts) as w, unnest(range(len(ts))) as o from wanted) where w not in ({_STOPS})),
  {stem_ctes("asked_words", 'query_id, alt, clause, negated, "offset"', "w", "asked_stems")},
  asked as (select *, count(*) over (partition by query_id, alt, clause) as n_terms, dense_rank() over (partition by query_id, alt, negated order by clause, "offset") as k from asked_stems),
  hits as (select query_id, alt, clause, negated, n_terms, k, "offset", doc_id, chunk_index, pos, inverse from asked join dictionary d on d._s = asked._s join occ on occ.term = d.term),
  standing as (select query_id, alt, clause, negated, doc_id, chunk_index from hits group by query_id, alt, clause, negated, n_terms, doc_id, chunk_index, pos - "offset" having count(*) = n_terms),
  each_one as (select query_id, alt, doc_id, chunk_index, count(distinct clause) filter (not negated) as yes, count(*) filter (negated) as no from standing group by all),
  needed as (select query_id, alt, count(distinct clause) as n, count(distinct k) as terms from asked where not negated group by all),
  kept as (select query_id, alt, doc_id, chunk_index, terms from each_one join needed using (query_id, alt) where yes = n and no = 0),
  entries as (select distinct query_id, alt, doc_id, chunk_index, k, pos, inverse, terms from hits join kept using (query_id, alt, doc_id, chunk_index) where not negated),
  places as (select distinct query_id, alt, doc_id, chunk_index, pos, inverse, terms from entries),
  lasts as (select e.query_id, e.alt, e.doc_id, e.chunk_index, e.pos as stop, e.terms, s.k, max(s.pos) as last from places e join entries s on s.query_id = e.query_id and s.alt = e.alt and s.doc_id = e.doc_id and s.chunk_index = e.chunk_index and s.pos <= e.pos group by all),
  ends as (select query_id, alt, doc_id, chunk_index, stop, min(last) as start from lasts group by query_id, alt, doc_id, chunk_index, stop, terms having count(*) = terms),
  covers as (select * from ends qualify coalesce(start > lag(start) over (partition by query_id, alt, doc_id, chunk_index order by stop), true)),
  sized as (select c.query_id, c.alt, c.doc_id, c.chunk_index, c.start, c.stop, count(*) as n, sum(inverse) as inv from covers c join places p on p.query_id = c.query_id and p.alt = c.alt and p.doc_id = c.doc_id and p.chunk_index = c.chunk_index and p.pos between c.start and c.stop group by all),
  density as (select query_id, alt, doc_id, chunk_index, sum(n / inv / (1 + (stop - start) - (n - 1))) as d from sized group by all),
  best as (select query_id, doc_id, chunk_index, max(d / (d + 1)) as r from density group by all),
  told as (select query_id, lower(query) as q, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) > 1 and t not in ({_STOPS})) as good, regexp_extract_all(lower(query), '[a-z0-9]+') as every from searches),
  scored as (select query_id, doc_id, chunk_index, floor((r + {_BONUS.format(hay="body")} + case when len(list_filter(case when len(good) > 0 then good else every end, lambda t: contains(title || ' ' || citation, t))) > 0 then 0.1 else 0 end) * 1e6 + 0.5) / 1e6 as score from best join told using (query_id) join fields using (doc_id, chunk_index)),
  r as (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index)::int as rank from scored)
  select query_id, doc_id, chunk_index, score, rank from r where rank <= 20"""
    )


def _prefix_sql() -> str:
    return (
        "with "
        + _INDEX
        + f""", {frames.QUERY_ROWS},
  told as (select query_id, lower(query) as q, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) > 1 and t not in ({_STOPS})) as good, regexp_extract_all(lower(query), '[a-z0-9]+') as every from requests),
  asked_words as (select query_id, unnest(list_distinct(case when len(good) > 0 then good else every end)) as w from told),
  {stem_ctes("asked_words", "query_id", "w", "asked_stems")},
  asked as (select distinct query_id, _s as prefix from asked_stems),
  hits as (select query_id, prefix, doc_id, chunk_index, sum(occ.w) as f from asked join dictionary d on starts_with(d._s, prefix) join occ on occ.term = d.term group by all),
  counted as (select *, count(*) over (partition by query_id, prefix) as df from hits),
  lengths as (select doc_id, chunk_index, len(a) + len(b) + len(c) as size from fields),
  total as (select count(*)::double as n, avg(size) as average from lengths),
  scored as (select query_id, doc_id, chunk_index, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * size / average))) as r
             from counted join lengths using (doc_id, chunk_index) cross join total group by all),
  final as (select query_id, doc_id, chunk_index, floor((r + {_BONUS.format(hay="body || chr(10) || title || chr(10) || citation")}) * 1e6 + 0.5) / 1e6 as score from scored join told using (query_id) join fields using (doc_id, chunk_index)),
  r as (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_index)::int as rank from final)
  select query_id, doc_id, chunk_index, score, rank from r where rank <= 20"""
    )


ORACLES = {
    "weighted_fts": _weighted_sql(),
    "bm25_prefix": _prefix_sql(),
    "ann_recall": "select count(*) as n_queries, true as reached from embeddings where vec_id % 20 = 0",
}
