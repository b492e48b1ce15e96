"""Changes over time: source sync, idempotent events, candidate queues, claims, deletes, generations.

Keyed steps are aggregates with partial sums, or windows that keep a fixed number
of a key's rows, which Spark prunes before it shuffles. Where rows meet their
key's aggregate, that is copied over salts and the rows are dealt over them
(`met`), so a key with a third of all rows does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def synced(previous: DataFrame, current: DataFrame, full: bool = True) -> DataFrame:
    """(item_id, status, action): the ledger after a run.

    previous: item_id, content_hash, status. current: item_id, operation
    (upsert, delete or error), content_hash; unique item_id in both. In full mode
    items that are not seen any more are tombstoned.
    """
    p = previous.select("item_id", F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"))
    both = p.join(current.select("item_id", "operation", "content_hash"), "item_id", "full")
    op, was = F.col("operation"), F.col("old_status")
    changed = was.isNull() | (was != "active") | ~F.col("old_hash").eqNullSafe(F.col("content_hash"))
    action = (
        F.when(op == "error", "failed").when(op == "delete", F.when(was == "deleted", "unchanged").otherwise("deleted"))
        .when(op == "upsert", F.when(was.isNull(), "created").when(changed, "updated").otherwise("unchanged"))
        .when(F.lit(full) & (was != "deleted"), "tombstoned").otherwise("unchanged")
    )
    status = F.when(op == "error", F.coalesce(was, F.lit("failed"))).when(op == "delete", "deleted").when(op == "upsert", "active").when(F.lit(full), "deleted").otherwise(was)
    return both.select("item_id", status.alias("status"), action.alias("action"), F.when(op == "upsert", F.col("content_hash")).otherwise(F.col("old_hash")).alias("content_hash"))


#: Tasks that the rows of one key may be dealt over, and how many rows a key has to have for it where they were counted.
SALTS, HOT = 16, 100_000


def met(rows: DataFrame, groups: DataFrame, on: list[str], by: list[str], size: str | None = None) -> DataFrame:
    """rows with their key's one row of `groups`; `by` are columns that tell the rows of a key apart.

    `size` names the column of groups (a written table, which is read twice) that
    counts a key's rows: only keys of more than HOT are copied then, of which
    there is at most one in HOT rows, so these alone may be broadcast. The copies
    never are: Spark takes their size for that of the groups.
    """
    dealt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if size is not None:
        hot = groups.where(F.col(size) > HOT).select(*on, F.lit(True).alias("_hot"))
        rows, dealt = rows.join(F.broadcast(hot), on, "left"), F.when(F.col("_hot"), dealt).otherwise(0)
        salts = F.when(F.col(size) > HOT, salts).otherwise(F.array(F.lit(0)))
        groups, salts = groups.withColumn("_salts", salts).drop(size), F.col("_salts")
    salted = groups.withColumn("_salt", F.explode(salts)).drop("_salts")
    return rows.withColumn("_salt", dealt).drop("_hot").join(salted.hint("merge"), [*on, "_salt"]).drop("_salt")


def idempotent(events: DataFrame, key: list[str], order: list[str], payload: str = "payload_hash") -> DataFrame:
    """events with status: the first of a key is processable; later ones are duplicates, from the first other payload on conflicts.

    Each payload of a key is reduced to its first event; of these the first is the
    key's, and the second where conflicts begin. Events meet that once.
    """
    firsts = events.groupBy(*key, payload).agg(F.min(F.struct(*order)).alias("_o"), F.count("*").alias("_n"))
    two = firsts.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("_o"))).where("_at <= 2")
    ends = two.groupBy(*key).agg(F.min("_o").alias("_first"), F.max(F.when(F.col("_at") == 2, F.col("_o"))).alias("_clash"))
    sizes = firsts.groupBy(*key).agg(F.sum("_n").alias("_size"))
    judged = staged(ends.join(sizes.hint("merge"), key), "judged-keys")
    out = met(events, judged, key, order, "_size")
    own = F.struct(*(F.col(c) for c in order))
    status = F.when(own == F.col("_first"), "processable").when(F.col("_clash").isNotNull() & (own >= F.col("_clash")), "conflict").otherwise("duplicate")
    return out.withColumn("status", status).drop("_first", "_clash")


def merged_candidates(candidates: DataFrame, key: str, priority: str, refs: str) -> DataFrame:
    """One candidate a key: greatest priority, the set of references, how many reports."""
    return candidates.groupBy(key).agg(F.max(priority).alias("priority"), F.array_sort(F.collect_set(refs)).alias("refs"), F.count("*").alias("n_reports"))


def claimable(jobs: DataFrame, now: Column, by: str = "tenant") -> DataFrame:
    """The job that each tenant's worker would claim: queued and due, or leased and expired; greatest priority, then oldest."""
    due = jobs.where(((F.col("status") == "queued") & (F.col("available_at") <= now)) | ((F.col("status") == "leased") & (F.col("lease_expires_at") < now)))
    best = F.min(F.struct((-F.col("priority")).alias("p"), "available_at", "job_id"))
    return due.groupBy(by).agg(best.alias("b")).select(by, "b.job_id", (-F.col("b.p")).alias("priority"), "b.available_at")


def queue_states(log: DataFrame) -> DataFrame:
    """The state of every job from its log (job_id, ts, event_id, state): the latest entry."""
    return log.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "state")).alias("m"), F.count_if(F.col("state") == "failed").alias("failures")).select("job_id", "m.state", "failures")


def propagated(deleted: DataFrame, vectors: DataFrame, chunks: DataFrame, docs: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """What is left of each table once deleted documents are gone, in the order in which stores are cleaned."""
    gone = deleted.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in (("vectors", vectors), ("chunks", chunks), ("documents", docs))}


def generations(vectors: DataFrame, by: list[str], doc: str = "doc_id") -> DataFrame:
    """Vectors and documents of each generation."""
    return vectors.groupBy(*by).agg(F.count("*").alias("n_vectors"), F.countDistinct(doc).alias("n_documents"))


def to_clean(inventory: DataFrame, keep: list[str], config: str = "config_hash") -> DataFrame:
    return inventory.where(~F.col(config).isin(keep))


def backfill_batches(sources: DataFrame, size: int) -> DataFrame:
    """Sources in batches of `size` within each tenant, by id. Sources are few beside documents."""
    n = F.row_number().over(Window.partitionBy("tenant").orderBy("source_id"))
    return sources.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def rate_limited(requests: DataFrame, client: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Clients and fixed windows with how many requests passed and were refused."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds).cast(requests.schema[ts].dataType)
    counts = requests.groupBy(client, start.alias("window_start")).agg(F.count("*").alias("n"))
    return counts.select(client, "window_start", F.least("n", F.lit(most)).cast("long").alias("n_passed"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("n_refused"))


#: Secrets that an event's key must not carry; what stands before the secret stays.
EVENT_SECRETS = [r"(?i)\b(bearer\s+)[a-z0-9._-]{8,}", r"(?i)\b(api[_-]?key\s*[:=]\s*)[^\s,;]+", r"(?i)\b(token\s*[:=]\s*)[^\s,;]+"]


def key_part(value: Column, allowed: str = "0-9a-z._:-") -> Column:
    """A part of a key: lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), f"[^{allowed}]+", "_"), "^_+|_+$", "")


def event_key(system: Column, event_id: Column, ticket_id: Column, run_id: Column, trace_id: Column, event_type: Column, version: Column) -> Column:
    """The idempotency key of a support event: its own id, else its ticket, else its run and trace, else unknown."""
    trace = F.concat_ws(":", F.nullif(run_id, F.lit("")), F.nullif(trace_id, F.lit("")))
    subject = F.coalesce(F.nullif(F.coalesce(event_id, ticket_id, trace), F.lit("")), F.lit("unknown"))

    def safe(part: Column) -> Column:
        plain = F.trim(F.regexp_replace(part, r"\s+", " "))
        for pattern in EVENT_SECRETS:
            plain = F.regexp_replace(plain, pattern, "$1[REDACTED]")
        return key_part(F.substring(plain, 1, 1000))

    return F.concat_ws(":", F.lit("rag_support_event"), *map(safe, (system, subject, event_type, F.coalesce(version, F.lit("v1")))))


def alert_key(rule: Column, category: Column, severity: Column, signal: Column, threshold: Column) -> Column:
    """The key by which repeated alerts are one; whole thresholds are written without a fraction."""
    written = F.when(threshold == F.floor(threshold), F.floor(threshold).cast("string")).otherwise(threshold.cast("string"))
    parts = [F.coalesce(F.nullif(key_part(F.coalesce(p, F.lit("")), "0-9a-z._-"), F.lit("")), F.lit("unknown")) for p in (rule, category, severity, signal, written)]
    return F.concat_ws(":", F.lit("rag_slo_alert"), *parts)


def first_alerts(alerts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, the columns of `order` of its first alert, n_alerts): what a sink delivers once."""
    return alerts.groupBy(key).agg(F.min(F.struct(*order)).alias("f"), F.count("*").alias("n_alerts")).select(key, "f.*", "n_alerts")
