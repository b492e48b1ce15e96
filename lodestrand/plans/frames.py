"""The tables of a data folder as the frames that the operators take, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.access import TRUST_TIERS
from ..operators.ingest import char_chunks

#: The stated requests of the search queries.
REQUESTS = [(0, "the thand with hation and threst"), (1, "la question entre aux deux"), (2, "und der schichte von"), (3, "of the"), (4, "los ciones con para"), (5, "erhee thation onsh"), (6, "contact token password")]
#: Questions that exercise the planner.
QUESTIONS = [
    (0, "Who owns Acme Holdings?"), (1, "What is the latest refund policy for EU-West-1 customers?"), (2, "How to configure the \"ingest queue\" for CSV table uploads"),
    (3, "compare Postgres versus SQLite"), (4, "Which subsidiaries of Global_Trust are registered in Delaware"), (5, "why is the deploy broken today"), (6, "hello there"), (7, "Show the figure of the ownership structure and the board members"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, "query_id long, query string")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id long, question string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a namespace, a source, a tenant, a trust tier, tags and a time of capture."""
    none = F.array().cast("array<string>")
    tags = F.when(F.col("doc_id") % 3 == 0, none).when(F.col("doc_id") % 3 == 1, F.array(F.lit("internal"))).otherwise(F.array(F.lit("internal"), F.lit("finance")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("namespace"), F.col("source").alias("source_id"), F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string")).alias("tenant"),
        F.element_at(F.array(*map(F.lit, TRUST_TIERS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("trust_tier"), tags.alias("tags"),
        none.alias("users"), none.alias("teams"), none.alias("roles"), F.concat_ws(" ", F.lit("note"), "lang", "source").alias("title"),
        F.timestamp_micros((F.lit(1704067200) + F.col("doc_id") % 3650 * 86400) * 1000000).alias("captured_at"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return char_chunks(documents(spark, sf_dir))


def entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, chunk_id): the first chunk of a document stands for a nation, and of every third one for a region too."""
    first = chunks(spark, sf_dir).where("chunk_index = 0").select("doc_id", "chunk_id")
    nation = first.select(F.concat(F.lit("nation:"), (F.col("doc_id") % 25).cast("string")).alias("entity_id"), "chunk_id")
    return nation.unionByName(first.where("doc_id % 3 = 0").select(F.concat(F.lit("region:"), (F.col("doc_id") % 5).cast("string")).alias("entity_id"), "chunk_id"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, kind, name) of the property graph in the order tables."""
    parts = None
    for name, key, label in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        own = table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("entity_id"), F.lit(name).alias("kind"), F.col(label).alias("name"))
        parts = own if parts is None else parts.unionByName(own)
    return parts


#: Order lines that one task reduces to supplied parts.
TASK_LINES = 250_000


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind): nations in regions, customers and suppliers in nations, parts that suppliers supply.

    Order lines are dealt over partitions whose number grows with them (files
    tell it without being read), and which Spark does not coalesce by the size of
    two packed numbers: a task's edges, as words, take the same memory at any size.
    """
    link = lambda a, b: (F.concat(F.lit(f"{a[0]}:"), F.col(a[1]).cast("string")).alias("source"), F.concat(F.lit(f"{b[0]}:"), F.col(b[1]).cast("string")).alias("target"))
    nation = table(spark, sf_dir, "nation").select(*link(("nation", "n_nationkey"), ("region", "n_regionkey")), F.lit("registered_in").alias("kind"))
    customer = table(spark, sf_dir, "customer").select(*link(("customer", "c_custkey"), ("nation", "c_nationkey")), F.lit("registered_in").alias("kind"))
    supplier = table(spark, sf_dir, "supplier").select(*link(("supplier", "s_suppkey"), ("nation", "s_nationkey")), F.lit("registered_in").alias("kind"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    lines = lines.repartition(-(-lines.count() // TASK_LINES) or 1, "l_suppkey", "l_partkey")
    supplies = lines.distinct().select(*link(("supplier", "l_suppkey"), ("part", "l_partkey")), F.lit("supplies").alias("kind"))
    return nation.unionByName(customer).unionByName(supplier).unionByName(supplies)


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the key parts and payload hash of the idempotency ledger."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.sha2(F.encode("props", "UTF-8"), 256).alias("payload_hash"), "value")


def sync_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ledger as of 2024-01-16 and the item changes since, by user and key."""
    e = table(spark, sf_dir, "events").withColumn("item_id", F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")))
    last = lambda df: df.groupBy("item_id").agg(F.max(F.struct("ts", "event_id", "event_type", F.sha2("event_type", 256).alias("content_hash"))).alias("m"))
    cut = F.lit("2024-01-16").cast("timestamp")
    before, after = last(e.where(F.col("ts") < cut)), last(e.where(F.col("ts") >= cut))
    previous = before.select("item_id", "m.content_hash", F.when(F.col("m.event_type") == "purchase", "deleted").otherwise("active").alias("status"))
    current = after.select("item_id", F.when(F.col("m.event_type") == "error", "error").when(F.col("m.event_type") == "purchase", "delete").otherwise("upsert").alias("operation"), "m.content_hash")
    return previous, current


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else f"{v}::bigint" for v in r) + ")" for r in rows)


DOCS = f"""docs as (select doc_id, text, lang as namespace, source as source_id, 't' || (doc_id % 2) as tenant,
  list_extract({TRUST_TIERS!r}, (doc_id % 6 + 1)::int) as trust_tier, doc_id % 3 as tag_class, 'note ' || lang || ' ' || source as title,
  make_timestamp((1704067200 + doc_id % 3650 * 86400) * 1000000) as captured_at from documents)"""
CHUNKS = (
    DOCS
    + """, windows as (select *, unnest(range(0, greatest(ceil((length(text) - 1800) / 1620.0), 0)::bigint + 1))::int as chunk_index from docs where length(text) > 0),
  cut as (select * exclude (text), length(text) as n, substr(text, chunk_index * 1620 + 1, 1800) as text from windows),
  hashed as (select *, chunk_index * 1620 as "start", least(chunk_index * 1620 + 1800, n) as "end", sha256(text) as text_hash from cut),
  chunks as (select *, 'chunk_' || sha256(doc_id || ':' || chunk_index || ':' || text_hash) as chunk_id from hashed)"""
)
QUERY_ROWS = f"requests(query_id, query) as (values {_values(REQUESTS)})"
QUESTION_ROWS = f"questions(query_id, question) as (values {_values(QUESTIONS)})"
ENTITIES = """entities as (select 'region:' || r_regionkey as entity_id, 'region' as kind, r_name as name from region
  union all select 'nation:' || n_nationkey, 'nation', n_name from nation union all select 'customer:' || c_custkey, 'customer', c_name from customer
  union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier union all select 'part:' || p_partkey, 'part', p_name from part)"""
EDGES = """edges as (select 'nation:' || n_nationkey as source, 'region:' || n_regionkey as target, 'registered_in' as kind from nation
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'registered_in' from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'registered_in' from supplier
  union all select distinct 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies' from lineitem)"""
ENTITY_CHUNKS = """entity_chunks as (select 'nation:' || doc_id % 25 as entity_id, chunk_id from chunks where chunk_index = 0
  union all select 'region:' || doc_id % 5, chunk_id from chunks where chunk_index = 0 and doc_id % 3 = 0)"""
BOTH_WAYS = "both_ways as (select source as node, target as other, kind, 'outgoing' as direction from edges union all select target, source, kind, 'incoming' from edges)"
NORMAL_NAME = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[’‘'']', '', 'g'), '[.,]', ' ', 'g'),
  '\b(limited liability company|llc|l l c|incorporated|inc|corp|corporation|ltd|limited|gmbh|plc|lp|llp)\b', ' ', 'g'), '\s+', ' ', 'g'))"""
