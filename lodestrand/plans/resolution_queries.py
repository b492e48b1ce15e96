"""Queries of entity resolution, page audits and readiness, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, resolution
from . import frames


def _entities(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("customer", "part", "nation", "region")) -> DataFrame:
    """Customers and parts with names of companies, some of them with identifiers, and the places they are registered in."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("entity_id")
    text = lambda *parts: F.concat(*(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    none = F.lit(None).cast("string")
    k, p = F.col("c_custkey"), F.col("p_partkey")
    rows = {
        "customer": lambda t: t.select(
            key("customer", "c_custkey"), F.lit("customer").alias("kind"), text("c_mktsegment", F.lit(" "), k % 50, F.when(k % 3 == 0, ", Inc.").when(k % 3 == 1, " Global").otherwise("")).alias("name"),
            F.create_map(F.lit("cik"), F.when(k % 5 < 2, text(F.lit("00"), "c_nationkey", k % 3)), F.lit("website"), F.when(k % 7 == 0, text(F.lit("https://www.S"), k % 40, F.lit(".com/x")))).alias("metadata"), ((k % 4) / 4).alias("confidence"), (k % 3).alias("evidence_count"),
        ),
        "part": lambda t: t.select(key("part", "p_partkey"), F.lit("part").alias("kind"), text("p_name", F.when(p % 4 == 0, " Bank").when(p % 4 == 1, " Works, L.L.C.").when(p % 4 == 2, " Works").otherwise("")).alias("name"), F.create_map(F.lit("ticker"), none).alias("metadata"), ((p % 4) / 4).alias("confidence"), (p % 3).alias("evidence_count")),
        "nation": lambda t: t.select(key("nation", "n_nationkey"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.create_map(F.lit("ein"), none).alias("metadata"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("evidence_count")),
        "region": lambda t: t.select(key("region", "r_regionkey"), F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.create_map(F.lit("ein"), none).alias("metadata"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("evidence_count")),
    }
    out = None
    for kind in kinds:
        own = rows[kind](frames.table(spark, sf_dir, kind))
        out = own if out is None else out.unionByName(own)
    return out


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four customers are registered in their nation, one of three parts in one of two regions."""
    customer = frames.table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").selectExpr("'customer:' || c_custkey as source", "'nation:' || c_nationkey as target")
    part = frames.table(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("'part:' || p_partkey as source", "'region:' || p_partkey % 2 as target")
    return customer.unionByName(part).withColumn("kind", F.lit("registered_in"))


def identifier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.by_identifier(_entities(spark, sf_dir), _edges(spark, sf_dir))


def full_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolved(_entities(spark, sf_dir), _edges(spark, sf_dir))


def rewired_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after the merges by identifier."""
    e, r = _entities(spark, sf_dir), _edges(spark, sf_dir)
    return resolution.rewired(r, resolution.by_identifier(e, r))


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts whose names are much alike; who belongs to a class says review_classes."""
    return resolution.review_class_pairs(_entities(spark, sf_dir, ("part", "region")), _edges(spark, sf_dir))


def review_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part and region with its class and name."""
    return resolution.review_classes(_entities(spark, sf_dir, ("part", "region")), _edges(spark, sf_dir))


def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents and line numbers as pages; the lines hold texts, images and drawings."""
    line = frames.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "doc_id", "l_linenumber": "page_number"})
    text = F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" \t"), F.repeat("l_returnflag", F.floor(F.col("l_quantity") / 2).cast("int")), F.lit("\n")))
    regions = line.select("doc_id", "page_number", F.when(F.col("l_discount") > 0.05, "page_image").otherwise("text").alias("kind"), text.alias("text"))
    found = layout.page_audit(line.select("doc_id", "page_number").distinct(), regions, line.where("l_tax > 0.04").select("doc_id", "page_number"))
    return found.withColumn("reasons", F.array_join("reasons", ","))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source and language: what the chunks and some vectors, layouts and statuses are ready for."""
    chunks, d = frames.chunks(spark, sf_dir), F.col("doc_id")
    counts = chunks.groupBy("source_id", "namespace").agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_index") == 0).alias("n_body_chunks"), F.count_if(F.col("chunk_index") > 0).alias("n_relationships"), F.count_if(d % 97 == 0).alias("n_layouts"),
        F.count_if(d % 101 == 0).alias("n_ocr_pages"), F.count_if(d % 89 == 0).alias("n_parser_warnings"), F.count_if(d % 83 == 0).alias("n_vectors"), F.count_if(d % 79 == 0).alias("n_entities"),
        F.when(F.max("doc_id") % 3 == 0, "failed").when(F.max("doc_id") % 3 == 1, "partial").alias("post_status"),
    )
    return layout.readiness(counts).withColumn("warnings", F.array_join("warnings", ",")).fillna("", ["post_status"])


QUERIES = {f.__name__: f for f in (identifier_resolution, full_resolution, rewired_edges, review_pairs, review_classes, page_audit, readiness)}

_ENTITIES = f"""ents as (select *, {frames.NORMAL_NAME} as norm from (
    select 'customer:' || c_custkey as entity_id, 'customer' as kind, c_mktsegment || ' ' || c_custkey % 50 || case c_custkey % 3 when 0 then ', Inc.' when 1 then ' Global' else '' end as name, case when c_custkey % 5 < 2 then '00' || c_nationkey || c_custkey % 3 end as cik,
      case when c_custkey % 7 = 0 then 's' || c_custkey % 40 || '.com' end as site, (c_custkey % 4) / 4.0 as confidence, c_custkey % 3 as n from customer
    union all select 'part:' || p_partkey, 'part', p_name || case p_partkey % 4 when 0 then ' Bank' when 1 then ' Works, L.L.C.' when 2 then ' Works' else '' end, null, null, (p_partkey % 4) / 4.0, p_partkey % 3 from part
    union all select 'nation:' || n_nationkey, 'nation', n_name, null, null, 1, 1 from nation union all select 'region:' || r_regionkey, 'region', r_name, null, null, 1, 1 from region)),
  links as (select 'customer:' || c_custkey as source, 'nation:' || c_nationkey as target from customer where c_custkey % 4 <> 0 union all select 'part:' || p_partkey, 'region:' || p_partkey % 2 from part where p_partkey % 3 = 0),
  ids as (select entity_id, 'cik:' || regexp_replace(cik, '^0+([0-9])', '\\1') as identifier from ents where cik is not null union all select entity_id, 'domain:' || site from ents where site is not null),
  reg as (select source as entity_id, string_agg(distinct norm, '|' order by norm) as places from links join ents on entity_id = target group by 1),
  own as (select * from ids join ents using (entity_id) left join reg using (entity_id)),
  shared as (select kind, identifier from own group by all having count(*) > 1 and coalesce(min(places) = max(places), true)),
  chosen as (select * from own join shared using (kind, identifier)),
  stars as (select distinct entity_id as a, min(entity_id) over (partition by kind, identifier) as b from chosen),
  ties as (select a, b from stars union select b, a from stars union select a, a from stars),
  reached as (select a as node, a as other from ties union select node, b from reached join ties on ties.a = other),
  roots as (select node as entity_id, min(other) as root from reached group by node),
  firsts as (select entity_id, kind, confidence, n, min(identifier) as identifier, any_value(places) as places from chosen group by all),
  placed as (select *, coalesce(min(places) over (partition by root) <> max(places) over (partition by root), false) as clash from firsts join roots using (entity_id)),
  grouped as (select *, case when clash then root || chr(10) || identifier else root end as g from placed),
  one as (select entity_id, first_value(entity_id) over (partition by g order by confidence desc, n desc, entity_id) as canonical_id from grouped qualify count(*) over (partition by g) > 1),
  moved as (select coalesce(s.canonical_id, source) as source, coalesce(t.canonical_id, target) as target, coalesce(s.canonical_id <> source, false) or coalesce(t.canonical_id <> target, false) as moved from links left join one s on s.entity_id = source left join one t on t.entity_id = target)"""
ORACLES = {
    "identifier_resolution": f"with recursive {_ENTITIES} select * from one",
    "rewired_edges": f"with recursive {_ENTITIES} select source, target, 'registered_in' as kind, moved from moved",
    "full_resolution": f"""with recursive {_ENTITIES}, rest as (select * from ents where entity_id not in (select entity_id from one where entity_id <> canonical_id) and norm <> ''),
        at2 as (select source as entity_id, string_agg(distinct norm, ',' order by norm) as places from moved join rest on entity_id = target group by 1),
        two as (select entity_id, first_value(entity_id) over w as canonical_id from rest left join at2 using (entity_id) window w as (partition by kind, norm, coalesce(places, '') order by confidence desc, n desc, entity_id) qualify count(*) over (partition by kind, norm, coalesce(places, '')) > 1)
        select e.entity_id, coalesce(two.canonical_id, one.canonical_id, e.entity_id) as canonical_id, case when one.canonical_id is not null then 'identifier' when two.canonical_id is not null then 'name' else 'none' end as merged_by
        from ents e left join one using (entity_id) left join two on two.entity_id = coalesce(one.canonical_id, e.entity_id)""",
    "review_pairs": f"""with recursive {_ENTITIES}, c as (select kind, norm, places, min(entity_id) as id, string_split(norm, ' ') as t from ents left join reg using (entity_id) where kind in ('part', 'region') group by kind, norm, places),
        p as (select a.kind, a.id as left_id, b.id as right_id, a.norm as x, b.norm as y, len(list_intersect(a.t, b.t)) as both_n, len(a.t) as na, len(b.t) as nb, coalesce(len(list_filter(string_split(a.places, '|'), lambda v: not list_contains(string_split(b.places, '|'), v))) > 0, false) as conflict,
          list_sort(list_filter(list_distinct(list_concat(a.t, b.t)), lambda w: (list_contains(a.t, w) <> list_contains(b.t, w)) and list_contains({resolution.QUALIFIERS!r}, w))) as extra from c a join c b on a.kind = b.kind and a.id < b.id),
        s as (select *, case when x = y then 1.0::double else floor(greatest(both_n::double / (na + nb - both_n), both_n::double / least(na, nb) * 0.72::double + case when starts_with(x, y || ' ') or starts_with(y, x || ' ') then 0.08::double else 0.0::double end) * 1000 + 0.5) / 1000 end as score from p)
        select kind, left_id, right_id, score, array_to_string(extra, ',') as material, conflict from s where score >= 0.55 and (score >= 0.82 or len(extra) > 0 or conflict)""",
    "review_classes": f"""with recursive {_ENTITIES} select entity_id, min(entity_id) over (partition by kind, norm, coalesce(places, '')) as class_id, min(entity_id) over (partition by kind, norm) as name_id
        from ents left join reg using (entity_id) where kind in ('part', 'region') and norm <> ''""",
    "page_audit": """with g as (select l_orderkey as doc_id, l_linenumber as page_number, sum(case when l_linestatus = 'O' then floor(l_quantity / 2)::bigint else 0 end)::bigint as n_chars, count(*) filter (l_tax > 0.04) as n_assets, bool_or(l_discount > 0.05) as image from lineitem group by all),
        r as (select *, concat_ws(',', case when n_assets > 0 and n_chars = 0 then 'page_has_visual_asset_without_text' end, case when image and n_chars = 0 then 'page_has_page_image_region_without_text' end,
          case when n_chars = 0 then 'layout_page_without_text' end, case when (n_assets > 0 or image) and n_chars > 0 and n_chars < 20 then 'page_text_below_threshold' end) as reasons from g)
        select doc_id, page_number, n_chars, n_assets, reasons from r where reasons <> ''""",
    "readiness": f"""with {frames.CHUNKS}, c as (select source_id, namespace, count(*) as n_chunks, count(*) filter (chunk_index = 0) as n_body_chunks, count(*) filter (chunk_index > 0) as n_relationships, count(*) filter (doc_id % 97 = 0) as n_layouts, count(*) filter (doc_id % 101 = 0) as n_ocr_pages,
          count(*) filter (doc_id % 89 = 0) as n_parser_warnings, count(*) filter (doc_id % 83 = 0) as n_vectors, count(*) filter (doc_id % 79 = 0) as n_entities, case max(doc_id) % 3 when 0 then 'failed' when 1 then 'partial' else '' end as post_status from chunks group by all)
        select *, n_chunks > 0 as text_ready, n_vectors > 0 as vector_ready, false as visual_ready, n_entities > 0 as graph_ready, n_relationships > 0 as expansion_ready,
          concat_ws(',', case when n_relationships = 0 and n_chunks > 1 then 'connected_chunk_relationships_missing' end, case when n_layouts > 0 and n_relationships = 0 then 'derived_searchable_units_empty' end, case when n_entities = 0 then 'graph_knowledge_empty' end, case when n_ocr_pages > 0 then 'pages_need_ocr' end,
          case when n_parser_warnings > 0 then 'parser_quality_warnings' end, case when post_status <> '' then 'post_ingest_' || post_status end, case when n_vectors = 0 then 'vector_index_empty' end, 'visual_index_empty') as warnings from c""",
}
