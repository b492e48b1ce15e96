"""Property-graph operators: lookup, neighbours, bounded traversal, resolution, integrity, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up, normal_name, terms
from ..sources.tables import staged


def entity_matches(entities: DataFrame, requests: list, k: int = 4) -> DataFrame:
    """(query_id, entity_id, score, rank): the share of a request's terms that a name contains."""
    low, found = F.lower("name"), []
    for r in requests:
        hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in r.terms), F.lit(0))
        found.append(F.when(hits > 0, F.struct(F.lit(r.query_id).alias("query_id"), half_up(hits / F.lit(max(1, len(r.terms))), 3).alias("score"))))
    rows = entities.select("entity_id", F.explode(F.array_compact(F.array(*found))).alias("s")).select("s.query_id", "entity_id", "s.score")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id"))).where(F.col("rank") <= k)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, kind, direction) of edges (source, target, kind)."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "kind", F.lit("outgoing").alias("direction"))
    return out.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "kind", F.lit("incoming").alias("direction")))


def first_neighbours(edges: DataFrame, limit: int) -> DataFrame:
    """The first `limit` neighbours of each node by kind and id, which is what a traversal may follow. Spark prunes within partitions before it shuffles."""
    order = Window.partitionBy("node").orderBy("kind", "other", "direction")
    return both_ways(edges).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, direction, kind, n): partial sums before the shuffle, so hubs are no hot key."""
    return both_ways(edges).groupBy("node", "direction", "kind").agg(F.count("*").alias("n"))


def bounded_bfs(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node, depth, path): all nodes within `depth` hops of each seed, with the first path of those that are shortest.

    Every neighbour is followed, also of hubs: only the depth bounds it. Edges are
    read once for each level, as they are, and meet the level before; that is a
    written table, so its size is known and edges move only if it is large.
    """
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other")))
    steps = edges.select(F.inline(ends)).where("node is not null and other is not null")
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"), F.col("node").alias("path"))
    front = reached
    for d in range(1, depth + 1):
        moved = front.join(steps, "node").groupBy("seed", F.col("other").alias("node")).agg(F.min(F.concat(F.col("path"), F.lit(">"), F.col("other"))).alias("path"))
        front = moved.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(d).alias("depth"), "path")
        if d < depth:
            front = staged(front, "graph-level")
        reached = reached.unionByName(front)
    return reached


def bounded_walk(seeds: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 8, most: int = 64, kinds: list[str] | None = None, direction: str = "any") -> DataFrame:
    """(seed, node, depth, place, path): what a walk from each seed visits, at most `most` nodes with the seed.

    A level's nodes are met in the order in which the level before was, and of
    each the first `limit` neighbours by kind and id, of some kinds or one
    direction. A node is visited once, from where it was met first; places number
    the visits. `path` holds the edges (depth, source, target, kind) that lead to
    it, as they stand in the graph. A level of a seed has at most most * limit
    candidates, however large the hubs are.
    """
    own = both_ways(edges)
    if kinds is not None:
        own = own.where(F.col("kind").isin(kinds))
    if direction != "any":
        own = own.where(F.col("direction") == direction)
    order = Window.partitionBy("node").orderBy("kind", "other", "direction")
    steps = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select(F.col("node").alias("_from"), "other", "kind", "direction", "_n")
    none = F.array().cast("array<struct<depth:int,source:string,target:string,kind:string>>")
    visited = seeds.select(F.col("node").alias("seed"), "node").distinct().select("seed", "node", F.lit(0).alias("depth"), F.lit(1).alias("place"), none.alias("path"))
    front = visited
    for d in range(1, depth + 1):
        met = front.select("seed", F.col("node").alias("_from"), "place", "path").join(steps, "_from")
        out = F.col("direction") == "outgoing"
        edge = F.struct(F.lit(d).alias("depth"), F.when(out, F.col("_from")).otherwise(F.col("other")).alias("source"), F.when(out, F.col("other")).otherwise(F.col("_from")).alias("target"), "kind")
        first = met.groupBy("seed", F.col("other").alias("node")).agg(F.min_by(F.struct(F.concat("path", F.array(edge)).alias("path"), "place", "_n"), F.struct("place", "_n")).alias("b"))
        fresh = first.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").join(visited.groupBy("seed").agg(F.count("*").alias("_seen")), "seed")
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("b.place", "b._n"))
        front = fresh.withColumn("place", (F.col("_seen") + rank).cast("int")).where(F.col("place") <= most).select("seed", "node", F.lit(d).alias("depth"), "place", F.col("b.path").alias("path"))
        visited = visited.unionByName(front)
    return visited


def relations(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, direction: str = "any", limit: int = 20) -> DataFrame:
    """(node, other, kind, direction) of the first `limit` edges of each of `nodes` (column node), of some kinds or one direction."""
    own = both_ways(edges)
    if kinds is not None:
        own = own.where(F.col("kind").isin(kinds))
    if direction != "any":
        own = own.where(F.col("direction") == direction)
    order = Window.partitionBy("node").orderBy("kind", "other", "direction")
    return own.join(nodes.select("node").distinct(), "node", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def graph_candidates(
    matches: DataFrame, edges: DataFrame, evidence: DataFrame, depth: int = 2, limit: int = 8, graph_first: bool = False, relation_evidence: DataFrame | None = None, most: int = 64, kinds: list[str] | None = None, direction: str = "any"
) -> DataFrame:
    """(query_id, chunk_id, score, depth, path): the chunks of matched entities (query_id, entity_id, score), of those that a bounded walk reaches from them, and of the relations that it walks.

    `evidence` has (entity_id, chunk_id), `relation_evidence` (source, target,
    kind, chunk_id). Scores fall with each hop to three quarters, not below 0.05;
    with graph_first a walk's chunks score 1 at least and a match's own chunks
    less. A chunk keeps its best score, the shorter path and then the first.
    Matches are a few for each request.
    """
    reached = bounded_walk(matches.select(F.col("entity_id").alias("node")).distinct(), edges, depth, limit, most, kinds, direction)
    walks = matches.select("query_id", F.col("entity_id").alias("seed"), "score").join(reached, "seed")
    score, hops = F.col("score"), F.col("depth")
    own = F.greatest(F.lit(0.05), score * 0.65) if graph_first else score
    far = F.greatest(F.lit(1.0), score + F.lit(0.1) / (hops + 1)) if graph_first else F.greatest(F.lit(0.05), score * F.pow(F.lit(0.75), hops))
    told = F.array_join(F.transform("path", lambda e: F.concat_ws(":", e["depth"].cast("string"), e["kind"], e["source"], e["target"])), "|")
    scored = walks.select("query_id", F.col("node").alias("entity_id"), F.when(hops == 0, own).otherwise(far).alias("score"), "depth", told.alias("told"), F.get("path", F.size("path") - 1).alias("last"))
    found = scored.join(evidence.select("entity_id", "chunk_id"), "entity_id").select("query_id", "chunk_id", "score", "depth", "told")
    if relation_evidence is not None:
        edge = relation_evidence.select(F.struct("source", "target", "kind").alias("_edge"), "chunk_id")
        on_way = scored.where("last is not null").withColumn("_edge", F.struct("last.source", "last.target", "last.kind"))
        found = found.unionByName(on_way.join(edge, "_edge").select("query_id", "chunk_id", "score", "depth", "told"))
    best = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "depth", F.col("told").alias("path"))).alias("b"))
    return best.select("query_id", "chunk_id", half_up(-F.col("b.low"), 6).alias("score"), "b.depth", "b.path")


def with_graph(base: DataFrame, graph_rows: DataFrame, k: int = 10, graph_first: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, origin, rank): base candidates (query_id, chunk_id, score) and graph candidates, each chunk once with its better score; with graph_first walks stand before matches and those before the rest."""
    place = F.when(F.col("depth") > 0, 2).otherwise(1)
    both = base.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("priority")).unionByName(graph_rows.select("query_id", "chunk_id", "score", place.alias("priority")))
    merged = both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max("priority").alias("priority"), F.min("priority").alias("_least"))
    order = ([F.desc("priority")] if graph_first else []) + [F.desc("score"), F.col("chunk_id")]
    out = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    origin = F.when(F.col("priority") == 0, "base").when(F.col("_least") == 0, "both").otherwise("graph")
    return out.select("query_id", "chunk_id", "score", origin.alias("origin"), "rank")


def resolved(entities: DataFrame) -> DataFrame:
    """(entity_id, canonical_id, group_size): entities of one kind and normalised name are one, named by the smallest id."""
    named = entities.select("entity_id", "kind", normal_name(F.col("name")).alias("key"))
    groups = named.groupBy("kind", "key").agg(F.min("entity_id").alias("canonical_id"), F.count("*").alias("group_size"))
    return named.join(groups, ["kind", "key"]).select("entity_id", "canonical_id", "group_size")


def fuzzy_pairs(entities: DataFrame, least: float = 0.55) -> DataFrame:
    """(kind, left_name, right_name, score): distinct normalised names that are much alike.

    score = max(jaccard, 0.72 * containment, plus 0.08 where one begins the
    other). For a threshold t, two names must share at least (t - 0.08) / 0.72 of
    the smaller one's tokens (containment) or 2t / (1 + t) of them (jaccard), so
    one of its rarest tokens is in the other: the join is on those alone, and
    frequent tokens are never a block.
    """
    if least <= 0.08:
        raise ValueError("names without a common token reach 0.08; least must be above that")
    names = entities.select("kind", normal_name(F.col("name")).alias("name")).where("name <> ''").distinct().withColumn("tokens", F.array_distinct(F.split("name", " ")))
    tokens = names.select("kind", "name", F.explode("tokens").alias("token"))
    often = tokens.groupBy("kind", "token").agg(F.count("*").alias("df"))
    sorted_tokens = tokens.join(often, ["kind", "token"]).groupBy("kind", "name").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by"))
    t = least - 0.0005  # scores are rounded to three digits
    share = min((t - 0.08) / 0.72, 2 * t / (1 + t))
    need = F.least(F.greatest(F.ceil(F.lit(share) * F.size("by") - 1e-9), F.lit(1)), F.size("by"))
    rare = sorted_tokens.select("kind", F.col("name").alias("small"), F.size("by").alias("n_small"), F.explode(F.slice("by", F.lit(1), (F.size("by") - need + 1).cast("int"))).alias("t")).select("kind", "small", "n_small", "t.token")
    wide = tokens.join(names.select("kind", "name", F.size("tokens").alias("n_large")), ["kind", "name"]).select("kind", "token", F.col("name").alias("large"), "n_large")
    pairs = rare.join(wide, ["kind", "token"]).where("n_small <= n_large and small <> large").select("kind", F.least("small", "large").alias("left_name"), F.greatest("small", "large").alias("right_name")).distinct()
    a, b = F.array_distinct(F.split("left_name", " ")), F.array_distinct(F.split("right_name", " "))
    both = F.size(F.array_intersect(a, b))
    jaccard, inside = both / F.size(F.array_union(a, b)), both / F.least(F.size(a), F.size(b))
    prefix = F.when(F.startswith("left_name", F.concat("right_name", F.lit(" "))) | F.startswith("right_name", F.concat("left_name", F.lit(" "))), 0.08).otherwise(0.0)
    return pairs.withColumn("score", half_up(F.greatest(jaccard, inside * 0.72 + prefix), 3)).where(F.col("score") >= least)


def integrity(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, n, n_missing_source, n_missing_target, n_self) over all edges."""
    known = entities.select(F.col("entity_id").alias("id"), F.lit(1).alias("_s"))
    a = edges.join(known.withColumnRenamed("id", "source"), "source", "left")
    b = a.join(known.select(F.col("id").alias("target"), F.col("_s").alias("_t")), "target", "left")
    return b.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("_s").isNull()).alias("n_missing_source"), F.count_if(F.col("_t").isNull()).alias("n_missing_target"), F.count_if(F.col("source") == F.col("target")).alias("n_self"))


def approval(relations: DataFrame, allowed_kinds: list[str], least: float = 0.85) -> DataFrame:
    """Relations (kind, confidence, fact_strength, verification) with the status that policy gives them."""
    status = F.when(F.col("verification").isin("unsupported", "contradicted"), "rejected").when((F.col("confidence") >= least) & (F.col("fact_strength") == "explicit") & F.col("kind").isin(allowed_kinds), "approved").otherwise("needs_review")
    return relations.withColumn("status", status)


def pruned(entities: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities less the evidence (array of chunk ids) of chunks that are gone; without any left they are superseded."""
    lost = entities.select("entity_id", F.explode("evidence").alias("chunk_id")).join(gone.select("chunk_id").distinct(), "chunk_id").groupBy("entity_id").agg(F.collect_set("chunk_id").alias("_lost"))
    left = F.when(F.col("_lost").isNull(), F.col("evidence")).otherwise(F.array_except("evidence", "_lost"))
    return entities.join(lost, "entity_id", "left").withColumn("evidence", left).withColumn("status", F.when(F.size("evidence") == 0, "superseded").otherwise(F.col("status"))).drop("_lost")


def recall(found: DataFrame, expected: DataFrame, forbidden: DataFrame, key: list[str]) -> DataFrame:
    """(n_expected, n_found, n_missing, n_extra, n_forbidden) of found rows by key."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(expected.select(*key).distinct(), "n_expected"), count(found.select(*key).distinct(), "n_found"),
        count(expected.select(*key).distinct().join(found, key, "left_anti"), "n_missing"), count(found.select(*key).distinct().join(expected, key, "left_anti"), "n_extra"),
        count(found.select(*key).distinct().join(forbidden, key, "left_semi"), "n_forbidden"),
    ]
    long = None
    for p in parts:
        own = p.select(F.lit(p.columns[0]).alias("metric"), F.col(p.columns[0]).alias("n"))
        long = own if long is None else long.unionByName(own)
    return long


def faithful(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relations (source_name, target_name, term, chunk_id) with whether their chunk names all three."""
    low = F.lower("text")
    ok = F.contains(low, F.lower("source_name")) & F.contains(low, F.lower("target_name")) & F.contains(low, F.lower("term"))
    return relations.join(chunks.select("chunk_id", "text"), "chunk_id", "left").withColumn("faithful", F.coalesce(ok, F.lit(False))).drop("text")


def page_after(rows: DataFrame, cursor: tuple | None, size: int, created: str = "created_at", key: str = "id") -> DataFrame:
    """The next `size` rows after a (created, key) cursor, in that order."""
    if cursor is not None:
        rows = rows.where((F.col(created) > F.lit(cursor[0])) | ((F.col(created) == F.lit(cursor[0])) & (F.col(key) > F.lit(cursor[1]))))
    return rows.orderBy(created, key).limit(size)


def names(question: Column) -> Column:
    """Terms that a question may name entities by."""
    return terms(question)
