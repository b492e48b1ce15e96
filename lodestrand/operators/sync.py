"""Source sync with its whole ledger: what a connector's items change, and what the ledger says afterwards.

One full join of two tables with a row for each item; a run's figures are sums
over it. Ledger rows have LEDGER's columns. A run never looks at bodies: content,
access scope and source ACL are compared by hash.

Defined cases: items without an id are left out and counted as warnings; of
several items with one id the last by `seq` counts; null versions and hashes
equal each other; an empty side is an empty side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEDGER = (
    "item_id string, record_id string, status string, last_action string, version string, content_hash string, scope_hash string, acl_hash string, first_seen_at timestamp, "
    "last_seen_at timestamp, last_changed_at timestamp, deleted_at timestamp, failure_count long, last_error_code string, retryable boolean"
)
NAMES = [c.split()[0] for c in LEDGER.split(", ")]
HASHES = ("content_hash", "scope_hash", "acl_hash")


@dataclass(frozen=True)
class Run:
    """`ledger`: LEDGER's columns; `changes`: (item_id, record_id, change) with change one of record, deleted, failed; `metrics`: one row."""

    ledger: DataFrame
    changes: DataFrame
    metrics: DataFrame


def applied(previous: DataFrame, items: DataFrame, at: Column, full: bool = False, complete: bool = False, delete_missing: bool = True) -> Run:
    """A run over items (seq, item_id, operation, record_id, version, content_hash, scope_hash, acl_hash, deleted_at, error_code, retryable).

    An upsert changes its item if that is new, not active, or differs in record,
    version or one of the hashes. Items that a full and complete listing no longer
    names are tombstoned; others that are not named stay as they are.
    """
    named = items.where(F.trim(F.coalesce("item_id", F.lit(""))) != "")
    own = ["operation", "record_id", "version", *HASHES, "deleted_at", "error_code", "retryable"]
    last = named.groupBy("item_id").agg(F.max_by(F.struct(*own), "seq").alias("n"))
    both = previous.select("item_id", F.struct(*NAMES[1:]).alias("p")).join(last, "item_id", "full")
    p, n = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"n.{c}"))
    was, op, listed = F.col("p").isNotNull(), n("operation"), F.col("n").isNotNull()
    same = was & (p("status") == "active")
    for c in ("record_id", "version", *HASHES):
        same = same & p(c).eqNullSafe(n(c))
    changed = (op == "upsert") & ~F.coalesce(same, F.lit(False))
    gone = was & ~listed & (p("status") != "deleted") & F.lit(full and complete and delete_missing)
    upsert, delete, error = F.coalesce(op == "upsert", F.lit(False)), F.coalesce(op == "delete", F.lit(False)), F.coalesce(op == "error", F.lit(False))
    newly = delete & ~F.coalesce(p("status") == "deleted", F.lit(False))
    given = lambda c: F.when(upsert, n(c)).otherwise(p(c))
    value = {
        "item_id": F.col("item_id"),
        "record_id": F.when(upsert, n("record_id")).when(listed, F.coalesce(n("record_id"), p("record_id"))).otherwise(p("record_id")),
        "status": F.when(upsert, "active").when(delete | gone, "deleted").when(error, "failed").otherwise(p("status")),
        "last_action": F.when(upsert, F.when(~was, "created").when(changed, "updated").otherwise("unchanged")).when(newly | gone, "deleted").when(error, "failed").otherwise("unchanged"),
        "version": F.when(upsert, n("version")).when(listed, F.coalesce(n("version"), p("version"))).otherwise(p("version")),
        **{c: given(c) for c in HASHES},
        "first_seen_at": F.coalesce(p("first_seen_at"), at),
        "last_seen_at": at,
        "last_changed_at": F.when(changed, at).otherwise(p("last_changed_at")),
        "deleted_at": F.when(upsert, F.lit(None).cast("timestamp")).when(delete, F.coalesce(n("deleted_at"), at)).when(gone, at).otherwise(p("deleted_at")),
        "failure_count": F.when(error, F.coalesce(p("failure_count"), F.lit(0)) + 1).when(upsert | delete | gone, 0).otherwise(p("failure_count")).cast("long"),
        "last_error_code": F.when(error, n("error_code")).when(upsert | delete, F.lit(None).cast("string")).otherwise(p("last_error_code")),
        "retryable": F.when(error, F.coalesce(n("retryable"), F.lit(True))).when(upsert | delete, F.lit(None).cast("boolean")).otherwise(p("retryable")),
    }
    change = F.when(changed, "record").when(newly | gone, "deleted").when(error, "failed")
    rows = both.select(*(value[c].alias(c) for c in NAMES), change.alias("change"), gone.alias("_gone"), listed.alias("_listed"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    skipped = (F.col("_listed") & (F.col("last_action") == "unchanged") & (F.col("status") == "active")) | (~F.col("_listed") & ~F.col("_gone"))
    sums = rows.agg(
        count(F.col("change") == "record").alias("n_records"), count(F.col("change") == "deleted").alias("n_deleted"), count(F.col("change") == "failed").alias("n_failed"),
        count(skipped).alias("n_skipped"), count(F.col("_gone")).alias("n_tombstoned"),
    )
    heard = items.agg(F.count("*").alias("n_listed"), count(F.trim(F.coalesce("item_id", F.lit(""))) == "").alias("n_warnings"))
    # Two tables of one row each, joined on a constant.
    metrics = sums.withColumn("_one", F.lit(1)).join(heard.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn("status", F.when(F.col("n_failed") > 0, "partial").otherwise("succeeded"))
    return Run(rows.select(*NAMES), rows.where("change is not null").select("item_id", "record_id", "change"), metrics)


def failed(previous: DataFrame, at: Column, error_code: str) -> DataFrame:
    """The ledger after a run whose connector failed: nothing changes but the marks of failure. The caller keeps the cursor."""
    marks = {"last_action": F.lit("failed"), "last_seen_at": at, "failure_count": F.col("failure_count") + 1, "last_error_code": F.lit(error_code), "retryable": F.lit(True)}
    return previous.withColumns(marks).select(*NAMES)


def next_cursor(status: str, previous: str | None, offered: str | None) -> str | None:
    """The cursor from which the next run reads on: the one that the connector offered, or the old one where the run failed."""
    return previous if status == "failed" else offered
