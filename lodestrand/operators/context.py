"""From ranked chunks to a bounded, citable context, and what may be answered from it."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import trust_rank


def optimised(candidates: DataFrame) -> DataFrame:
    """Candidates with a score that favours trusted sources and tables, and their place by it."""
    bonus = F.when(trust_rank(F.col("trust_tier")) == 0, 0.3).when(trust_rank(F.col("trust_tier")) == 1, 0.2).when(trust_rank(F.col("trust_tier")) == 2, 0.05).otherwise(0.0)
    table = F.when(F.contains("text", F.lit("|")), 0.15).otherwise(0.0)
    scored = candidates.withColumn("context_score", F.floor((F.col("score") + bonus + table) * 1000 + 0.5) / 1000)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("context_score"), "rank")))


def telling_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 3))


def without_repeats(candidates: DataFrame, most_alike: float = 0.9, order: str = "place") -> DataFrame:
    """Candidates less those much like a better one that is kept; greedy, within the ranked pool of a request."""
    schema = candidates.schema

    def choose(pdf):
        kept, sets = [], []
        for row in pdf.sort_values(order).to_dict("records"):
            own = set(w for w in re.findall("[a-z0-9]+", row["text"].lower()) if len(w) > 3)
            if any(len(own & s) >= most_alike * len(own | s) for s in sets):
                continue
            kept.append(row)
            sets.append(own)
        return pd.DataFrame(kept, columns=schema.names)

    return candidates.groupBy("query_id").applyInPandas(choose, schema)


def packed(candidates: DataFrame, most_tokens: int = 2000, most_chunks: int = 8, order: str = "place") -> DataFrame:
    """(query_id, chunk_id, position, tokens): walk in order, skip what does not fit, go on. Candidates are a ranked pool."""
    tokens = F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("long")
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "chunk_id", tokens.alias("tokens")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter("all", lambda _: F.lit(False)).alias("kept"))
    fits = lambda s, x: (s["used"] + x["tokens"] <= most_tokens) & (F.size(s["kept"]) < most_chunks)
    walked = F.aggregate("all", start, lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s))
    rows = lists.select("query_id", F.posexplode(walked["kept"]).alias("i", "c"))
    return rows.select("query_id", "c.chunk_id", (F.col("i") + 1).alias("position"), "c.tokens")


def round_robin(candidates: DataFrame, group: str = "source_id") -> DataFrame:
    """Place by turns: the first of each source, then the second, sources in the order they first appear."""
    own = Window.partitionBy("query_id", group)
    turns = candidates.withColumns({"_turn": F.row_number().over(own.orderBy("rank")), "_first": F.min("rank").over(own)})
    return turns.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_turn", "_first"))).drop("_turn", "_first")


def rejections(candidates: DataFrame, namespace: Column, now: Column, most_age_days: int, tiers: list[str], require_captured: bool = False) -> DataFrame:
    """Candidates with the first reason that keeps them out of the context; null where they may enter. Where no time of capture is required, that of ingest stands in for it."""
    at = F.coalesce("captured_at", "ingested_at") if "ingested_at" in candidates.columns and not require_captured else F.col("captured_at")
    reason = (
        F.when(F.col("namespace") != namespace, "namespace_mismatch").when(~F.col("trust_tier").isin(tiers), "disallowed_trust_tier")
        .when(at.isNull(), "missing_capture_time").when(F.unix_micros(now) - F.unix_micros(at) > most_age_days * 86_400_000_000, "stale_source")
        .when(F.array_contains("safety_flags", "possible_prompt_injection"), "unsafe_prompt_injection").when(F.array_contains("safety_flags", "secret_like_text"), "unsafe_secret")
    )
    return candidates.withColumn("rejection", reason)


def evidence(blocks: DataFrame, queries: DataFrame, least_citations: int = 2, least_trusted: int = 1, lowest_tier: str = "user_provided") -> DataFrame:
    """(query_id, n_blocks, n_trusted, n_sources, status) for every request, those without blocks too."""
    lowest = trust_rank(F.lit(lowest_tier))
    seen = blocks.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.count_if(trust_rank(F.col("trust_tier")) <= lowest).alias("n_trusted"), F.countDistinct("source_id").alias("n_sources"))
    rows = queries.select("query_id").join(seen, "query_id", "left").fillna(0, ["n_blocks", "n_trusted", "n_sources"])
    status = F.when(F.col("n_blocks") == 0, "no_evidence").when(F.col("n_blocks") < least_citations, "insufficient_citations").when(F.col("n_trusted") < least_trusted, "insufficient_trusted_citations").otherwise("answerable")
    return rows.withColumn("status", status)


def gated(summary: DataFrame) -> DataFrame:
    """Whether to answer, refuse or ask a person."""
    return summary.withColumn("action", F.when(F.col("status") == "answerable", "answer").when(F.col("status") == "no_evidence", "refuse").otherwise("human_review"))


def rendered(blocks: DataFrame) -> DataFrame:
    """(query_id, context): labelled blocks in order."""
    label = F.concat(F.lit("["), F.col("position"), F.lit("] "), F.col("chunk_id"), F.lit("\n"), F.col("text"))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", label.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def draft_problems(drafts: DataFrame, blocks: DataFrame, least_citations: int = 1) -> DataFrame:
    """(query_id, problems) of drafts (query_id, answer, citations): empty ones, unknown citations, too few."""
    cited = drafts.select("query_id", F.explode_outer(F.array_distinct("citations")).alias("chunk_id"))
    known = cited.join(blocks.select("query_id", "chunk_id").distinct().withColumn("_k", F.lit(1)), ["query_id", "chunk_id"], "left")
    counts = known.groupBy("query_id").agg(F.count("_k").alias("good"), F.count_if(F.col("chunk_id").isNotNull() & F.col("_k").isNull()).alias("unknown"))
    return drafts.join(counts, "query_id").select("query_id", F.array_compact(F.array(F.when(F.trim("answer") == "", F.lit("empty_answer")), F.when(F.col("unknown") > 0, F.lit("unknown_citation")), F.when(F.col("good") < least_citations, F.lit("insufficient_citations")))).alias("problems"))


#: Words that mark a statement as qualified or withdrawn.
CONTRADICTION_TERMS = ["not", "never", "except", "unless", "deprecated", "superseded"]


def tag_matches(tags: Column, wanted: list[str]) -> Column:
    """How many distinct wanted tags a row carries; no tags: none."""
    none = F.array().cast("array<string>")
    return F.size(F.array_intersect(F.coalesce(tags, none), F.array(*map(F.lit, wanted)).cast("array<string>")))


def ordered(candidates: DataFrame, prefer: list[str] | None = None, avoid: list[str] | None = None, trusted: bool = False, recent: Column | None = None) -> DataFrame:
    """Candidates with their place in the context: more preferred tags, fewer avoided ones, the better trust tier, the later capture, the rank.

    Each key counts only where it is asked for: tags by their lists, trust by
    `trusted`, and time where `recent` holds, a condition that is the same for
    all rows of a request. Rows without a time come after the others.
    """
    keys = []
    if prefer:
        keys.append(F.desc(tag_matches(F.col("tags"), prefer)))
    if avoid:
        keys.append(F.asc(tag_matches(F.col("tags"), avoid)))
    if trusted:
        keys.append(F.asc(trust_rank(F.col("trust_tier"))))
    if recent is not None:
        keys.append(F.when(recent, F.col("captured_at")).desc_nulls_last())
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys, "rank", "chunk_id")))


def contradictions(candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, n_chunks, chunk_ids): the candidates of a document that hold a marker between spaces, in order of rank."""
    low = F.lower(F.col("text"))
    marked = [F.contains(low, F.lit(f" {term} ")) for term in CONTRADICTION_TERMS]
    hit = candidates.where(reduce(Column.__or__, marked))
    own = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    return hit.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_chunks"), F.transform(own, lambda c: c["chunk_id"]).alias("chunk_ids"))
