"""Queries of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, retrieval
from . import frames, search_queries

#: Fixed requests that name entities.
NAMES = [(0, "red widget"), (1, "small plate ring"), (2, "supplier 000000001"), (3, "asia"), (4, "customer 12")]


#: Fixed requests that name places.
PLACES = [(0, "nation_3 note"), (1, "asia"), (2, "the europe and"), (3, "nowhere at all")]


def graph_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = retrieval.requests_of(spark.createDataFrame(NAMES, "query_id long, query string"))
    return graph.entity_matches(frames.entities(spark, sf_dir), requests)


def graph_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight neighbours of every node."""
    return graph.first_neighbours(frames.edges(spark, sf_dir), 8)


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(frames.edges(spark, sf_dir))


def graph_bfs2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every region, all that is within two hops."""
    seeds = frames.table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.bounded_bfs(seeds, frames.edges(spark, sf_dir))


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved(frames.entities(spark, sf_dir))


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with their types, which overlap."""
    parts = frames.table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.concat_ws(" ", "p_name", "p_type", "p_size").alias("name"))
    return graph.fuzzy_pairs(parts, 0.8)


def graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.integrity(frames.edges(spark, sf_dir), frames.entities(spark, sf_dir))


def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied parts that were found (returned ones) against all ordered ones; late ones are forbidden."""
    items = frames.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_returnflag", "l_discount")
    return graph.recall(items.where("l_returnflag = 'R'"), items.where("l_discount < 0.05"), items.where("l_returnflag = 'A'"), ["source", "target"])


def graph_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword results of requests that name nations and regions, with the chunks of these entities and of those two hops away."""
    requests = retrieval.requests_of(spark.createDataFrame(PLACES, "query_id long, query string"))
    base = retrieval.ranked(retrieval.keyword_scores(frames.chunks(spark, sf_dir), requests), 10)
    places = frames.entities(spark, sf_dir).where("kind in ('nation', 'region')")
    links = frames.edges(spark, sf_dir).where("kind = 'registered_in'")
    second = frames.chunks(spark, sf_dir).where("chunk_index = 1").select(F.concat(F.lit("nation:"), (F.col("doc_id") % 25).cast("string")).alias("source"), "chunk_id")
    walked = second.join(links.where("source like 'nation:%'"), "source").select("source", "target", "kind", "chunk_id")
    reached = graph.graph_candidates(graph.entity_matches(places, requests), links, frames.entity_chunks(spark, sf_dir), relation_evidence=walked, most=7)
    return graph.with_graph(base, reached, 20)


def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every region and every twentieth customer, three hops of at most 40 visits in all, with the edges on the way."""
    seeds = frames.entities(spark, sf_dir).where("kind = 'region' or (kind = 'customer' and try_element_at(split(entity_id, ':'), 2) % 20 = 0)").select(F.col("entity_id").alias("node"))
    rows = graph.bounded_walk(seeds, frames.edges(spark, sf_dir), 3, 8, 40)
    told = F.array_join(F.transform("path", lambda e: F.concat_ws(":", e["depth"].cast("string"), e["kind"], e["source"], e["target"])), "|")
    return rows.select("seed", "node", "depth", "place", told.alias("path"))


def graph_walk_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers along outgoing edges of one kind: where they are registered, and what that is registered in."""
    seeds = frames.entities(spark, sf_dir).where("kind = 'supplier'").select(F.col("entity_id").alias("node"))
    return graph.bounded_walk(seeds, frames.edges(spark, sf_dir), 2, 3, 3, ["registered_in"], "outgoing").select("seed", "node", "depth", "place")


def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is registered in each nation, the first five."""
    nations = frames.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.relations(frames.edges(spark, sf_dir), nations, ["registered_in"], "incoming", 5)


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of orders after a cursor; the page size is the feature."""
    from datetime import datetime

    orders = frames.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    return graph.page_after(orders, (datetime(1995, 6, 1), 100), 50)


QUERIES = {f.__name__: f for f in (graph_entity_match, graph_augmented, graph_walk, graph_walk_outgoing, graph_relations, graph_one_hop, graph_degrees, graph_bfs2, entity_resolution, fuzzy_pairs, graph_integrity, graph_recall, keyset_page)}

_NAMED = frames.NORMAL_NAME
_KEYWORD = search_queries._KEYWORD.replace(frames.QUERY_ROWS, f"requests(query_id, query) as (values {frames._values(PLACES)})")


def _walk_sql(seeds: str, where: str, depth: int, limit: int, most: int) -> str:
    """The levels of a walk, one after another: v<d> holds all visits up to depth d."""
    parts = [
        f"walk_steps as (select node, other, kind, direction, row_number() over (partition by node order by kind, other, direction) as n from both_ways where {where} qualify n <= {limit})",
        f"v0 as (select distinct node as seed, node, 0 as depth, 1 as place, '' as path, null::varchar as s, null::varchar as t, null::varchar as k from ({seeds}))",
    ]
    for d in range(1, depth + 1):
        parts.append(
            f"""m{d} as (select v.seed, st.other as node, v.place, st.n, v.path || case when v.path = '' then '' else '|' end || '{d}:' || st.kind || ':' || case when direction = 'outgoing' then v.node || ':' || st.other else st.other || ':' || v.node end as path,
              case when direction = 'outgoing' then v.node else st.other end as s, case when direction = 'outgoing' then st.other else v.node end as t, st.kind as k from v{d - 1} v join walk_steps st on st.node = v.node where v.depth = {d - 1}
              qualify row_number() over (partition by v.seed, st.other order by v.place, st.n) = 1),
            f{d} as (select *, row_number() over (partition by seed order by place, n) + (select count(*) from v{d - 1} v where v.seed = m{d}.seed) as pl from m{d} where not exists (select 1 from v{d - 1} v where v.seed = m{d}.seed and v.node = m{d}.node)),
            v{d} as (select * from v{d - 1} union all select seed, node, {d}, pl::int, path, s, t, k from f{d} where pl <= {most})"""
        )
    return ", ".join(parts)


ORACLES = {
    "graph_walk": f"with {frames.ENTITIES}, {frames.EDGES}, {frames.BOTH_WAYS}, {_walk_sql("select entity_id as node from entities where kind = 'region' or (kind = 'customer' and split_part(entity_id, ':', 2)::bigint % 20 = 0)", 'true', 3, 8, 40)} select seed, node, depth, place, path from v3",
    "graph_walk_outgoing": f"with {frames.ENTITIES}, {frames.EDGES}, {frames.BOTH_WAYS}, {_walk_sql("select entity_id as node from entities where kind = 'supplier'", "kind = 'registered_in' and direction = 'outgoing'", 2, 3, 3)} select seed, node, depth, place from v2",
    "graph_augmented": f"""with {_KEYWORD}, {frames.ENTITIES}, {frames.EDGES}, {frames.BOTH_WAYS}, {frames.ENTITY_CHUNKS},
        share as (select query_id, entity_id, floor(count(*)::double / len(any_value(terms)) * 1000 + 0.5) / 1000 as score from (select a.query_id, a.terms, w.term, e.entity_id from asked a join wanted w using (query_id) join entities e on e.kind in ('nation', 'region') and contains(lower(e.name), w.term)) group by all),
        matched as (select * from share qualify row_number() over (partition by query_id order by score desc, entity_id) <= 4),
        {_walk_sql("select entity_id as node from matched", "kind = 'registered_in'", 2, 8, 7)},
        walk as (select m.query_id, w.node as entity_id, case when depth = 0 then score else greatest(0.05, score * pow(0.75, depth)) end as score, depth, s, t from matched m join v2 w on w.seed = m.entity_id),
        edge_chunks as (select 'nation:' || doc_id % 25 as s, chunk_id from chunks where chunk_index = 1),
        both_kinds as (select query_id, chunk_id, score from walk join entity_chunks using (entity_id) union all select query_id, chunk_id, score from walk join edge_chunks using (s) where depth > 0),
        g as (select query_id, chunk_id, floor(max(score) * 1e6 + 0.5) / 1e6 as score from both_kinds group by all),
        u as (select query_id, chunk_id, score, 0 as p from ranked where rank <= 10 union all select query_id, chunk_id, score, 1 from g),
        m as (select query_id, chunk_id, max(score) as score, case when max(p) = 0 then 'base' when min(p) = 0 then 'both' else 'graph' end as origin from u group by all)
        select query_id, chunk_id, score, origin, (row_number() over (partition by query_id order by score desc, chunk_id))::int as rank from m qualify rank <= 20""",
    "graph_relations": f"with {frames.EDGES}, {frames.BOTH_WAYS} select node, other, kind, direction from both_ways where starts_with(node, 'nation:') and kind = 'registered_in' and direction = 'incoming' qualify row_number() over (partition by node order by kind, other, direction) <= 5",
    "graph_entity_match": f"""with {frames.ENTITIES}, w(query_id, term, n) as (values (0::bigint, 'red', 2), (0, 'widget', 2), (1, 'small', 3), (1, 'plate', 3), (1, 'ring', 3), (2, 'supplier', 2), (2, '000000001', 2), (3, 'asia', 1), (4, 'customer', 2), (4, '12', 2)),
        s as (select query_id, entity_id, floor(count(*)::double / any_value(n) * 1000 + 0.5) / 1000 as score from w join entities on contains(lower(name), term) group by all)
        select query_id, entity_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, entity_id) as rank from s) where rank <= 4""",
    "graph_one_hop": f"with {frames.EDGES}, {frames.BOTH_WAYS} select node, other, kind, direction from both_ways qualify row_number() over (partition by node order by kind, other, direction) <= 8",
    "graph_degrees": f"with {frames.EDGES}, {frames.BOTH_WAYS} select node, direction, kind, count(*) as n from both_ways group by all",
    "graph_bfs2": f"""with {frames.EDGES}, {frames.BOTH_WAYS}, steps as (select distinct node, other from both_ways),
        d0 as (select 'region:' || r_regionkey as seed, 'region:' || r_regionkey as node, 0 as depth, 'region:' || r_regionkey as path from region),
        d1 as (select seed, other as node, 1 as depth, min(path || '>' || other) as path from d0 join steps using (node) where other <> seed group by seed, other),
        d2 as (select seed, other as node, 2 as depth, min(path || '>' || other) as path from d1 join steps using (node) where not exists (select 1 from d1 x where x.seed = d1.seed and x.node = other) and other <> seed group by seed, other)
        select * from d0 union all select * from d1 union all select * from d2""",
    "entity_resolution": f"with {frames.ENTITIES}, n as (select entity_id, kind, {_NAMED} as key from entities) select entity_id, min(entity_id) over g as canonical_id, count(*) over g as group_size from n window g as (partition by kind, key)",
    "fuzzy_pairs": f"""with n as (select distinct {_NAMED} as name from (select p_name || ' ' || p_type || ' ' || p_size as name from part)), t as (select name, list_distinct(string_split(name, ' ')) as t from n),
        p as (select a.name as left_name, b.name as right_name, len(list_intersect(a.t, b.t)) as both_n, len(a.t) as na, len(b.t) as nb from t a join t b on a.name < b.name)
        select 'part' as kind, left_name, right_name, score from (select *, floor(greatest(both_n::double / (na + nb - both_n), both_n::double / least(na, nb) * 0.72 + case when starts_with(left_name, right_name || ' ') or starts_with(right_name, left_name || ' ') then 0.08 else 0.0 end)::double * 1000 + 0.5) / 1000 as score from p where both_n > 0) where score >= 0.8""",
    "graph_integrity": f"""with {frames.ENTITIES}, {frames.EDGES} select e.kind, count(*) as n, count(*) filter (a.entity_id is null) as n_missing_source, count(*) filter (b.entity_id is null) as n_missing_target, count(*) filter (source = target) as n_self
        from edges e left join entities a on a.entity_id = source left join entities b on b.entity_id = target group by 1""",
    "graph_recall": """with f as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R'), e as (select distinct l_suppkey, l_partkey from lineitem where l_discount < 0.05), x as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A')
        select 'n_expected' as metric, count(*) as n from e union all select 'n_found', count(*) from f union all select 'n_missing', count(*) from (select * from e except select * from f) union all select 'n_extra', count(*) from (select * from f except select * from e)
        union all select 'n_forbidden', count(*) from (select * from f intersect select * from x)""",
    "keyset_page": "select o_orderdate as created_at, o_orderkey as id from orders where (o_orderdate, o_orderkey) > (timestamp '1995-06-01', 100) order by 1, 2 limit 50",
}
