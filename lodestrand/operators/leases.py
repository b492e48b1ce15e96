"""The lease queue as an event-sourced state machine: one fold, over whole logs or as a keyed stream.

A job is queued, leased, completed, cancelled or dead-lettered. Its log has
LOG's columns; times are microseconds, so that leases are sums. An event that the
job's state does not allow is counted and changes nothing, and so is one whose
event_id was seen before, so a replayed log or batch ends in the same states.

Events of a job are folded in the order of (ts, event_id). In a batch they are
one sorted array a job, as long as the job's own log; the stream keeps the
state and the ids of the events it has seen. Null queue ids are left out;
a null worker is no one's; null leases, limits and times take their defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "queue_id string, ts long, event_id long, action string, worker string, lease long, retryable boolean, available_at long, max_attempts int"
STATE = "status string, attempt int, max_attempts int, worker string, lease_expires_at long, available_at long, finished_at long, n_rejected int"
LEASE, ATTEMPTS = 60_000_000, 3
_FIELDS = [c.split()[0] for c in LOG.split(", ")][1:]
_STATES = [c.split()[0] for c in STATE.split(", ")]


def _step(s: Column, e: Column) -> Column:
    """The state after one event."""
    action, status = e["action"], s["status"]
    mine = (status == "leased") & (s["worker"] == e["worker"])
    live = s["lease_expires_at"] > e["ts"]
    allowed = (
        F.when(action == "enqueue", status.isNull())
        .when(action == "claim", ((status == "queued") & (s["available_at"] <= e["ts"])) | ((status == "leased") & ~live))
        .when(action == "heartbeat", mine & live)
        .when(action.isin("complete", "fail"), mine)
        .when(action == "cancel", status.isin("queued", "leased"))
        .when(action == "requeue", status == "dead_letter")
    )
    ok = F.coalesce(allowed, F.lit(False))
    retry = (action == "fail") & F.coalesce(e["retryable"], F.lit(False)) & (s["attempt"] < s["max_attempts"])
    queued = action.isin("enqueue", "requeue") | retry
    leased = action.isin("claim", "heartbeat")
    now = F.when(queued, "queued").when(leased, "leased").when(action == "complete", "completed").when(action == "cancel", "cancelled").otherwise("dead_letter")
    made = {
        "status": now,
        "attempt": F.when(action.isin("enqueue", "requeue"), 0).when(action == "claim", s["attempt"] + 1).otherwise(s["attempt"]),
        "max_attempts": F.when(action.isin("enqueue", "requeue"), F.coalesce(e["max_attempts"], s["max_attempts"], F.lit(ATTEMPTS))).otherwise(s["max_attempts"]),
        "worker": F.when(leased, e["worker"]),
        "lease_expires_at": F.when(leased, e["ts"] + F.coalesce(e["lease"], F.lit(LEASE))),
        "available_at": F.when(queued, F.coalesce(e["available_at"], e["ts"])).otherwise(s["available_at"]),
        "finished_at": F.when(~queued & ~leased, e["ts"]),
    }
    kinds = dict(c.split() for c in STATE.split(", "))
    return F.struct(*(F.when(ok, v).otherwise(s[n]).cast(kinds[n]).alias(n) for n, v in made.items()), F.when(ok, s["n_rejected"]).otherwise(s["n_rejected"] + 1).cast("int").alias("n_rejected"))


def states(log: DataFrame) -> DataFrame:
    """(queue_id, STATE) of every job from its whole log; an event_id counts once, by its first time."""
    own = log.where(F.col("queue_id").isNotNull()).groupBy("queue_id", "event_id").agg(F.min(F.struct(*(c for c in _FIELDS if c != "event_id"))).alias("e"))
    events = own.groupBy("queue_id").agg(F.sort_array(F.collect_list(F.struct("e.ts", "event_id", *(f"e.{c}" for c in _FIELDS if c not in ("ts", "event_id"))))).alias("log"))
    none = F.struct(*(F.lit(0 if c.startswith("n_rejected") else None).cast(c.split()[1]).alias(c.split()[0]) for c in STATE.split(", ")))
    return events.select("queue_id", F.aggregate("log", none, _step).alias("s")).select("queue_id", "s.*")


def expired(jobs: DataFrame, at: Column) -> DataFrame:
    """Jobs whose lease has run out at a time (microseconds): what another worker may claim."""
    return jobs.where((F.col("status") == "leased") & (F.col("lease_expires_at") <= at))


def stepped(state: dict, event: dict) -> dict:
    """The same step on one event, for the stream."""
    s, action, ts = dict(state), event["action"], event["ts"]
    held = s["status"] == "leased" and s["worker"] is not None and s["worker"] == event["worker"]
    live = s["lease_expires_at"] is not None and s["lease_expires_at"] > ts
    allowed = {
        "enqueue": s["status"] is None, "claim": s["status"] == "queued" and s["available_at"] <= ts or s["status"] == "leased" and not live, "heartbeat": held and live,
        "complete": held, "fail": held, "cancel": s["status"] in ("queued", "leased"), "requeue": s["status"] == "dead_letter",
    }.get(action, False)
    if not allowed:
        return s | {"n_rejected": s["n_rejected"] + 1}
    if action in ("claim", "heartbeat"):
        return s | {"status": "leased", "attempt": s["attempt"] + (action == "claim"), "worker": event["worker"], "lease_expires_at": ts + (LEASE if event["lease"] is None else event["lease"]), "finished_at": None}
    s |= {"worker": None, "lease_expires_at": None, "finished_at": ts}
    if action in ("enqueue", "requeue"):
        most = event["max_attempts"] if event["max_attempts"] is not None else s["max_attempts"] if s["max_attempts"] is not None else ATTEMPTS
        return s | {"status": "queued", "attempt": 0, "max_attempts": most, "available_at": ts if event["available_at"] is None else event["available_at"], "finished_at": None}
    if action == "fail" and event["retryable"] and s["attempt"] < s["max_attempts"]:
        return s | {"status": "queued", "available_at": ts if event["available_at"] is None else event["available_at"], "finished_at": None}
    return s | {"status": {"complete": "completed", "cancel": "cancelled", "fail": "dead_letter"}[action]}


def states_stream(log: DataFrame, late: str = "1 minute") -> DataFrame:
    """The streaming form: after each batch the state of every job that it touched, and `lease_expired` once a lease runs out by the watermark.

    `log` has LOG's columns. Events of a job must come in order across batches;
    those behind the watermark are dropped, as in any stream with one.
    """
    kinds = STATE.split(", ")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        current = dict.fromkeys(_STATES) | {"n_rejected": 0}
        seen: list[int] = []
        if state.exists:
            *values, seen = state.get
            current = dict(zip(_STATES, values))
        timed_out = state.hasTimedOut
        if not timed_out:
            rows = [r for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
            for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
                if r["event_id"] in seen:
                    continue
                seen = [*seen, int(r["event_id"])]
                current = stepped(current, {k: None if v is None else int(v) if k in ("ts", "lease", "available_at", "max_attempts") else v for k, v in r.items()})
        state.update((*(current[n] for n in _STATES), seen))
        if current["status"] == "leased" and not timed_out:
            state.setTimeoutTimestamp(max(current["lease_expires_at"] // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{"queue_id": key[0], **current, "lease_expired": timed_out and current["status"] == "leased"}])

    timed = log.where(F.col("queue_id").isNotNull()).withColumn("_at", F.timestamp_micros("ts")).withWatermark("_at", late)
    return timed.groupBy("queue_id").applyInPandasWithState(fold, f"queue_id string, {STATE}, lease_expired boolean", f"{', '.join(kinds)}, seen array<long>", "update", "EventTimeTimeout")
