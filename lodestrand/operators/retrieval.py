"""Scored retrieval of chunks for a stated set of requests, and the fusion of rankings.

Requests are stated before the scan. For keyword search the terms of a block of
them become literals of one projection: every chunk is read once and scored for
the whole block, and only scored pairs go on; more requests take more passes.
BM25 joins the tokens of chunks to the wanted terms, however many requests there
are. Rankings keep the best k with row_number() <= k, which Spark prunes in each
partition before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up, occurrences, terms
from ..functions.vectors import hashed_counts, unit

BLOCK = 64
#: Vectors that are compared to a block of queries at once.
PART = 1024
#: Queries of a block that are compared at once: their scores and orders are all that a worker holds beside its best.
ASKED = 256
ORDER = ("doc_id", "chunk_index", "chunk_id")
#: Trust weights of the reranker.
TRUST_WEIGHT = {"trusted_internal": 1.0, "verified_partner": 0.9, "user_provided": 0.7, "generated_or_derived": 0.45, "external_untrusted": 0.25, "unknown": 0.0}


@dataclass(frozen=True)
class Request:
    query_id: int
    text: str
    terms: tuple[str, ...]


def requests_of(queries: DataFrame) -> list[Request]:
    """The requests (query_id, query) with their terms, by query_id."""
    rows = queries.select("query_id", "query", terms(F.col("query")).alias("terms")).collect()
    return [Request(r.query_id, r.query, tuple(r.terms)) for r in sorted(rows, key=lambda r: r.query_id)]


def ranked(scored: DataFrame, k: int, by: str = "query_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def haystack(title: Column, text: Column) -> Column:
    return F.lower(F.concat_ws("\n", text, title))


def term_weights(chunks: DataFrame, requests: list[Request]) -> tuple[int, dict[str, float]]:
    """Chunks in all, and the weight of each term: rarer ones, by substring, weigh more."""
    every = sorted({t for r in requests for t in r.terms})
    hay = chunks.select(haystack(F.col("title"), F.col("text")).alias("h"))
    row = hay.agg(F.count("*").alias("n"), *(F.count_if(F.contains("h", F.lit(t))).alias(f"df{k}") for k, t in enumerate(every))).first()
    return row.n, {t: min(2.5, 1 + float(np.log((row.n + 1) / (row[f"df{k}"] + 1)))) for k, t in enumerate(every)}


def keyword_scores(chunks: DataFrame, requests: list[Request]) -> DataFrame:
    """chunks x requests that share a term: matched weight, capped occurrences, phrase and title. One pass for weights and one for scores for each block of requests."""
    if len(requests) > BLOCK:
        return reduce(DataFrame.unionByName, (keyword_scores(chunks, requests[k : k + BLOCK]) for k in range(0, len(requests), BLOCK)))
    _, weight = term_weights(chunks, requests)
    hay, title = F.col("_h"), F.lower(F.col("title"))
    found = []
    for r in requests:
        total = sum(weight[t] for t in r.terms) or 1.0
        hit = {t: F.contains(hay, F.lit(t)) for t in r.terms}
        add = lambda parts: sum(parts, F.lit(0.0))
        matched = add(F.when(c, weight[t]).otherwise(0.0) for t, c in hit.items())
        often = add(F.when(c, F.least(occurrences(hay, F.lit(t)), F.lit(3)) * weight[t]).otherwise(0.0) for t, c in hit.items())
        in_title = F.lit(False)
        for t in r.terms:
            in_title = in_title | F.contains(title, F.lit(t))
        phrase = F.contains(hay, F.lit(" ".join(r.text.lower().split())))
        score = matched / total + 0.05 * F.least(often, F.lit(10.0)) + F.when(phrase, 1.0).otherwise(0.0) + F.when(in_title, 0.25).otherwise(0.0)
        found.append(F.when(matched > 0, F.struct(F.lit(r.query_id).alias("query_id"), half_up(score, 3).alias("score"))))
    rows = chunks.withColumn("_h", haystack(F.col("title"), F.col("text")))
    return rows.withColumn("_s", F.explode(F.array_compact(F.array(*found)))).select(*chunks.columns, "_s.query_id", "_s.score")


def neighbour_boost(scored: DataFrame) -> DataFrame:
    """Table-like chunks take up to 0.75 of the best adjacent chunk's score, where that scores higher."""
    near = Window.partitionBy("query_id", "doc_id").orderBy("chunk_index").rangeBetween(-1, 1)
    best = F.max("score").over(near)
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: occurrences(x, F.lit("|")) >= 2))
    return scored.withColumn("_best", best).withColumn("score", F.when((lines >= 2) & (F.col("_best") > F.col("score")), half_up(F.col("score") + F.least(F.lit(0.75), F.col("_best") * 0.4), 3)).otherwise(F.col("score"))).drop("_best")


def freshness_boost(scored: DataFrame, at: str = "captured_at", most: float = 0.2, asked: Column | None = None) -> DataFrame:
    """Newer candidates of a request gain up to `most`, in proportion to their age range. `asked`: which requests are about freshness; None: all are. One candidate alone gains nothing."""
    asked = F.lit(True) if asked is None else asked
    t = F.unix_micros(at).cast("double")
    ends = scored.groupBy("query_id").agg(F.min(F.unix_micros(at)).cast("double").alias("_old"), F.max(F.unix_micros(at)).cast("double").alias("_new"))
    span = F.col("_new") - F.col("_old")
    # One row per request.
    return scored.join(F.broadcast(ends), "query_id").withColumn("score", F.when(asked & (span > 0), half_up(F.col("score") + (t - F.col("_old")) / span * most, 3)).otherwise(F.col("score"))).drop("_old", "_new")


def bm25(chunks: DataFrame, requests: list[Request], k1: float = 1.2, b: float = 0.75, title_weight: float = 2.0) -> DataFrame:
    """(query_id, chunk_id, doc_id, chunk_index, score) by BM25 with weighted title and body fields.

    A chunk keeps only the tokens that some request wants, once each with their
    weighted count; these postings are joined to the requests by term.
    """
    wanted = sorted({t for r in requests for t in r.terms})
    split = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    rows = chunks.select(*ORDER, split("text").alias("_b"), split("title").alias("_t"))
    sized = rows.select(*ORDER, (F.size("_b") + title_weight * F.size("_t")).alias("_len"), *(F.filter(c, lambda x: x.isin(wanted)).alias(c) for c in ("_b", "_t")))
    seen = rows.agg(F.count("*").alias("n"), F.avg(F.size("_b") + title_weight * F.size("_t")).alias("avg")).first()
    count = lambda c, t: F.size(F.filter(c, lambda x: x == t))
    tf = F.transform(F.array_distinct(F.concat("_b", "_t")), lambda t: F.struct(t.alias("term"), (count("_b", t) + title_weight * count("_t", t)).alias("f")))
    postings = sized.select(*ORDER, "_len", F.explode(tf).alias("p")).select(*ORDER, "_len", "p.*")
    often = {r.term: r.df for r in postings.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row for each wanted term
    idf = [(q, t, float(np.log(1 + (seen.n - often[t] + 0.5) / (often[t] + 0.5)))) for q, t in ((r.query_id, t) for r in requests for t in r.terms) if t in often]
    asked = chunks.sparkSession.createDataFrame(idf, "query_id long, term string, _idf double")
    part = F.col("_idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("_len") / (seen.avg or 1.0)))
    return postings.join(asked, "term").groupBy("query_id", *ORDER).agg(half_up(F.sum(part), 6).alias("score"))


def hashed_vector_scores(chunks: DataFrame, requests: list[Request], dimensions: int = 64) -> DataFrame:
    """(query_id, chunk keys, score): cosine of hashed-token embeddings, in Arrow batches beside the scan. A token's slot is computed once for each worker."""
    matrix = np.stack([unit(hashed_counts(r.text, dimensions)) for r in requests])
    ids = np.array([r.query_id for r in requests])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([unit(hashed_counts(t, dimensions)) for t in batch.column("text").to_pylist()])
            scores = np.floor(own @ matrix.T * 1e6 + 0.5) / 1e6
            row, q = np.nonzero(scores > 0)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), *(batch.column(c).take(taken) for c in ORDER), pa.array(scores[row, q])], ["query_id", *ORDER, "score"])

    keys = chunks.select(*ORDER, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields if f.name in ORDER)
    return keys.mapInArrow(work, f"query_id long, {kinds}, score double")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", min_score: float = -1.0) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine neighbours.

    Queries travel in blocks of bounded size, one pass over the vectors each. A
    task keeps its k best for each query, so what is shuffled does not grow with
    the vectors but with the tasks. Vectors of another length than the query's are
    not compared; null vectors and ids are left out.
    """

    def pass_over(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            n = len(ids)
            best, owner = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
            for batch in batches:
                for part in (batch.slice(at, PART) for at in range(0, batch.num_rows, PART)):
                    part = part.filter(pc.fill_null(pc.and_(pc.is_valid(part.column(0)), pc.equal(pc.list_value_length(part.column(1)), matrix.shape[1])), False))
                    own, flat = part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten()
                    if not len(own) or flat.null_count:
                        rows = [(i, v) for i, v in zip(own.tolist(), part.column(1).to_pylist()) if None not in v]
                        own, flat = np.array([i for i, _ in rows], np.int64), [x for _, v in rows for x in v]
                    x = np.asarray(flat, np.float64).reshape(len(own), matrix.shape[1])
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    for at in range(0, n, ASKED):
                        here = slice(at, at + ASKED)
                        scores = np.concatenate((best[here], np.floor(matrix[here] @ x.T * 1e6 + 0.5) / 1e6), axis=1)
                        owners = np.concatenate((owner[here], np.broadcast_to(own, (len(scores), len(own)))), axis=1)
                        order = np.lexsort((owners, -scores), axis=1)[:, :k]
                        best[here], owner[here] = np.take_along_axis(scores, order, 1), np.take_along_axis(owners, order, 1)
            keep = (best >= min_score).ravel()
            q = np.repeat(np.arange(n), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][keep]), pa.array(owner.ravel()[keep]), pa.array(best.ravel()[keep])], ["query_id", "vec_id", "score"])

        return work

    narrow = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    found, held = None, []

    def search(rows):
        nonlocal found
        for size in sorted({len(v) for _, v in rows}):
            same = [(i, v) for i, v in rows if len(v) == size]
            m = np.array([v for _, v in same], np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            shared = vectors.sparkSession.sparkContext.broadcast((np.array([i for i, _ in same]), m))
            part = narrow.mapInArrow(pass_over(shared), "query_id long, vec_id long, score double")
            found = part if found is None else found.unionByName(part)

    for r in queries.select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>")).where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).toLocalIterator():
        held.append((r[0], list(r[1])))
        if len(held) == block:
            search(held)
            held = []
    if held:
        search(held)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return ranked(found, k, order=("vec_id",))


def rrf(rankings: list[tuple[DataFrame, float]], key: tuple[str, ...] = ("query_id", *ORDER), k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the rounded terms weight / (k + rank) of all rankings, added and rounded."""
    every = None
    for ranking, weight in rankings:
        part = ranking.select(*key, F.lit(float(weight)).alias("weight"), "rank")
        every = part if every is None else every.unionByName(part)
    return rrf_weighted(every, key, k)


def rrf_weighted(ranked_rows: DataFrame, key: tuple[str, ...] = ("query_id", *ORDER), k: int = 60) -> DataFrame:
    """The same of rows that carry their ranking's weight."""
    part = half_up(F.col("weight") / (F.lit(k) + F.col("rank")), 6)
    return ranked_rows.groupBy(*key).agg(half_up(F.sum(part), 6).alias("score"), F.min("rank").alias("best_rank"))


def planned_retrieval(chunks: DataFrame, branches: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, *ORDER, score, rank): each planned branch (query_id, branch, query, weight, top_k) is searched by keyword, and the branches of a question are fused by their weights."""
    rows = sorted(branches.select("query_id", "branch", "query", "weight", "top_k").collect(), key=lambda r: (r.query_id, r.branch))
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(i, r.query) for i, r in enumerate(rows)], "query_id long, query string")
    plan = spark.createDataFrame([(i, r.query_id, r.weight, r.top_k) for i, r in enumerate(rows)], "query_id long, question long, weight double, top_k int")
    found = ranked(keyword_scores(chunks, requests_of(asked)), max((r.top_k for r in rows), default=0)).select("query_id", *ORDER, "rank")
    # One row for each branch.
    own = found.join(F.broadcast(plan), "query_id").where(F.col("rank") <= F.col("top_k")).select(F.col("question").alias("query_id"), *ORDER, "weight", "rank")
    return ranked(rrf_weighted(own), k, order=("best_rank", *ORDER)).drop("best_rank")


def normalised_sum(rankings: list[tuple[DataFrame, float]], key: tuple[str, ...] = ("query_id", *ORDER)) -> DataFrame:
    """Weighted sum of scores, each divided by its ranking's best for the request."""
    every = None
    for ranking, weight in rankings:
        top = F.max("score").over(Window.partitionBy("query_id"))
        part = ranking.withColumn("part", F.when(top > 0, F.col("score") / top * weight).otherwise(0.0)).select(*key, "part")
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*key).agg(half_up(F.sum("part"), 3).alias("score")).where("score > 0")


def connected(seeds: DataFrame, chunks: DataFrame, reach: int = 1, decay: float = 0.82, step: float = 0.03, most: int = 12) -> DataFrame:
    """Seeds and the chunks beside them in the same document, each with its best score; at most `most` neighbours a request. `seeds` are ranked, so few."""
    moved = seeds.select("query_id", "doc_id", "score", F.col("chunk_index").alias("_at"), F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"))
    near = moved.where("chunk_index <> _at").select("query_id", "doc_id", "chunk_index", half_up(F.greatest(F.lit(0.01), F.col("score") * decay - F.abs(F.col("chunk_index") - F.col("_at")) * step), 3).alias("score"))
    best = near.groupBy("query_id", "doc_id", "chunk_index").agg(F.max("score").alias("score")).join(seeds.select("query_id", "doc_id", "chunk_index"), ["query_id", "doc_id", "chunk_index"], "left_anti")
    found = best.join(chunks.select("doc_id", "chunk_index", "chunk_id"), ["doc_id", "chunk_index"]).select("query_id", *ORDER, "score")
    added = ranked(found, most).drop("rank").withColumn("origin", F.lit("neighbour"))
    return seeds.select("query_id", *ORDER, "score").withColumn("origin", F.lit("seed")).unionByName(added)


def reranked(candidates: DataFrame, requests: list[Request]) -> DataFrame:
    """Candidates with a blended score: base, trust, overlap with the request's terms, and rank."""
    trust = F.lit(0.0)
    for tier, w in TRUST_WEIGHT.items():
        trust = F.when(F.col("trust_tier") == tier, w).otherwise(trust)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    overlap = F.lit(0.0)
    for r in requests:
        overlap = F.when(F.col("query_id") == r.query_id, F.size(F.array_intersect(tokens, F.array(*map(F.lit, r.terms)).cast("array<string>"))) / F.lit(max(1, len(r.terms)))).otherwise(overlap)
    top = F.max("score").over(Window.partitionBy("query_id"))
    base = F.when(top > 0, F.col("score") / top).otherwise(0.0)
    return candidates.withColumn("rerank_score", half_up(0.34 * base + 0.17 * trust + 0.17 * overlap + 0.11 / F.col("rank"), 6))


def diversified(candidates: DataFrame, k: int = 10, same_text: float = 0.18, same_doc: float = 0.08, same_source: float = 0.04, score: str = "rerank_score") -> DataFrame:
    """Greedy choice per request: each pick lowers what shares its text, document or source. Candidates are a ranked pool, which the caller bounds."""
    schema = candidates.withColumn("position", F.lit(0)).schema

    def choose(pdf):
        left = pdf.sort_values([score, *ORDER], ascending=[False, True, True, True]).to_dict("records")
        texts, docs, sources, out = set(), set(), set(), []
        while left and len(out) < k:
            cost = lambda r: same_text * (r["text_hash"] in texts) + same_doc * (r["doc_id"] in docs) + same_source * (r["source_id"] in sources)
            at = max(range(len(left)), key=lambda i: (round(left[i][score] - cost(left[i]), 6), -i))
            pick = left.pop(at)
            out.append(pick | {"position": len(out) + 1})
            texts.add(pick["text_hash"]), docs.add(pick["doc_id"]), sources.add(pick["source_id"])
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return candidates.groupBy("query_id").applyInPandas(choose, schema)


def diagnosed(results: DataFrame, queries: DataFrame, k: int = 10, weak: float = 0.5) -> DataFrame:
    """(query_id, diagnosis, retry): whether a request's ranking should be tried once more, and how."""
    seen = results.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.countDistinct("doc_id").alias("docs"))
    joined = queries.select("query_id").join(seen, "query_id", "left")
    what = F.when(F.col("n").isNull(), "no_candidates").when(F.col("n") < k, "few_candidates").when(F.col("best") < weak, "weak_scores").when(F.col("docs") == 1, "single_document").otherwise("sufficient")
    return joined.select("query_id", what.alias("diagnosis"), F.when(what == "sufficient", "none").otherwise("expanded_pool").alias("retry"))


#: The largest top_k and pool of a request.
MOST_TOP_K, MOST_POOL = 100, 5000


def request_problem(mode: str) -> Column:
    """The first fault of a request (query, mode, namespace, tenant, principal_tenant, principal_namespaces, top_k, pool), null for none.

    A null mode or pool is one that was not stated; any other null is a fault.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    top_k, pool = F.col("top_k"), F.col("pool")
    granted = F.coalesce(F.array_contains("principal_namespaces", F.col("namespace")), F.lit(False))
    return (
        F.when(blank("query"), "query_required")
        .when(F.col("mode").isNotNull() & (F.col("mode") != mode), "mode_not_served")
        .when(blank("namespace"), "namespace_required")
        .when(blank("tenant"), "tenant_required")
        .when(~F.col("tenant").eqNullSafe(F.col("principal_tenant")), "tenant_mismatch")
        .when(~granted, "namespace_not_granted")
        .when(top_k.isNull() | (top_k < 1) | (top_k > MOST_TOP_K), "top_k_out_of_range")
        .when(pool.isNotNull() & ((pool < top_k) | (pool > MOST_POOL)), "pool_out_of_range")
    )


def score_map_faults(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, chunk_id, position, code): scores of a model for chunks that are no candidates, and scores that are no finite number."""
    known = candidates.select("query_id", "chunk_id").distinct().withColumn("_known", F.lit(True))
    score = F.col("score")
    code = F.when(F.col("_known").isNull(), "unknown_candidate").when(~_finite(score), "invalid_score")
    return scores.join(known, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "position", code.alias("code")).where("code is not null")


def _finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) != F.lit(float("inf")))


def reranked_by_scores(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, chunk_id, rank) in the order of a model's scores (query_id, chunk_id, position, score), the k best of a request.

    The first finite score of a chunk counts; chunks without one go. A request
    that got no usable score keeps the order that it had: `reranked` tells.
    """
    usable = scores.where(_finite(F.col("score"))).groupBy("query_id", "chunk_id").agg(F.min_by("score", "position").alias("model_score"))
    joined = candidates.join(usable, ["query_id", "chunk_id"], "left")
    served = joined.withColumn("reranked", F.max(F.col("model_score").isNotNull()).over(Window.partitionBy("query_id")))
    kept = served.where(F.col("model_score").isNotNull() | ~F.col("reranked")).withColumn("model_score", half_up(F.col("model_score"), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("model_score").desc_nulls_last(), "rank", "chunk_id")
    return kept.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def vector_faults(vectors: DataFrame, visible: DataFrame, dimensions: int, identity: dict[str, str] | None = None) -> DataFrame:
    """Each stored vector's chunk_id with the reason why a search must leave it out, null for none.

    `vectors` have (chunk_id, doc_id, tenant, namespace, text_hash, dimensions)
    and the columns that `identity` names; `visible` are the chunks that the
    access filter grants, with the same columns up to text_hash. The first
    reason counts: no visible chunk, a chunk that has changed since, another
    number of dimensions, another model or configuration than the request's.
    """
    same = ("doc_id", "tenant", "namespace", "text_hash")
    now = visible.select("chunk_id", F.struct(*same).alias("_now"))
    stale = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"_now.{c}")) for c in same])
    code = F.when(F.col("_now").isNull(), "access_denied_or_missing_chunk").when(stale, "stale_vector").when(~F.col("dimensions").eqNullSafe(F.lit(dimensions)), "vector_dimension_mismatch")
    for column, wanted in (identity or {}).items():
        code = code.when(~F.col(column).eqNullSafe(F.lit(wanted)), "embedding_identity_mismatch")
    return vectors.join(now, "chunk_id", "left").select("chunk_id", code.alias("rejection"))


def preferred_evidence(paths: DataFrame, by: list[str]) -> DataFrame:
    """Of each key's graph paths the deepest, then that with the most evidence chunks, the most edges, and the first key.

    `paths` have depth and edges, an array of (depth, relation_id, source,
    target, chunk_ids). A maximum of one struct, so partial sums serve hot keys.
    """
    edges = F.col("edges")
    chunk_count = F.size(F.array_distinct(F.flatten(F.transform(edges, lambda e: e["chunk_ids"]))))
    key = F.array_join(F.transform(edges, lambda e: F.concat_ws(":", e["depth"].cast("string"), e["relation_id"], e["source"], e["target"])), "|")
    best = F.min(F.struct((-F.col("depth")).alias("d"), (-chunk_count).alias("c"), (-F.size(edges)).alias("e"), key.alias("key")))
    return paths.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.d")).alias("depth"), (-F.col("b.c")).alias("n_evidence"), (-F.col("b.e")).alias("n_edges"), F.col("b.key").alias("path_key"))
