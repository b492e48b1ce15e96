"""Evaluation and operation reports: retrieval metrics, answers, regressions, service levels, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up
from ..sources.tables import staged


def ir_metrics(results: DataFrame, relevant: DataFrame, k: int, item: str = "item_id") -> DataFrame:
    """(query_id, recall, precision, reciprocal_rank) of rankings (query_id, item, rank) against (query_id, item)."""
    hits = results.where(F.col("rank") <= k).join(relevant.select("query_id", item).distinct(), ["query_id", item])
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    total = relevant.groupBy("query_id").agg(F.countDistinct(item).alias("n"))
    rows = total.join(found, "query_id", "left").fillna(0, ["hits"])
    return rows.select("query_id", half_up(F.col("hits") / F.least(F.col("n"), F.lit(k)), 6).alias("recall"), half_up(F.col("hits") / F.lit(k), 6).alias("precision"), half_up(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def ranked_values(cases: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, rank, n): every value that is not null with its 1-based place in its group and the group's size.

    Values are dealt by ranges of (group, value) and sorted there; places within a
    range and the counts of the ranges before it make the rank. A group that holds
    most rows is many ranges, and no task holds a group's values.
    """
    at = F.monotonically_increasing_id()
    rows = cases.where(F.col(value).isNotNull()).select(*(F.col(c).alias(c) for c in by), F.col(value).alias("value"))
    n = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by, "value").sortWithinPartitions(*by, "value")
    held = staged(dealt.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "ranked-values")
    counts = held.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", *by, (before - F.col("_first") + 1).alias("_offset"), F.sum("_n").over(group).alias("n"))
    return held.join(offsets, ["_part", *by]).select(*by, "value", (F.col("_at") + F.col("_offset")).alias("rank"), "n")


def snapshot(cases: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Counts, mean and the p50, p95 and p99 (discrete) of a value; `by` without nulls."""
    means = cases.groupBy(*by).agg(F.count("*").alias("n"), half_up(F.avg(value), 6).alias("mean"))
    # The place of a discrete percentile, at least the first.
    place = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * p - 1e-9))
    at = ranked_values(cases, by, value).groupBy(*by).agg(*(F.max(F.when(F.col("rank") == place(p), F.col("value"))).alias(f"p{round(100 * p)}") for p in shares))
    return means.join(at, by, "left")


def regressions(baseline: DataFrame, current: DataFrame, most_drop: float = 0.02, on: str = "metric") -> DataFrame:
    """(metric, baseline, current, delta, regressed); a metric that is gone counts as regressed."""
    joined = baseline.select(on, F.col("value").alias("baseline")).join(current.select(on, F.col("value").alias("current")), on, "left")
    delta = half_up(F.col("current") - F.col("baseline"), 6)
    return joined.select(on, "baseline", "current", delta.alias("delta"), (F.col("current").isNull() | (delta < -most_drop)).alias("regressed"))


def service_levels(rules: DataFrame, signals: DataFrame) -> DataFrame:
    """(rule_id, value, status): ok, failed, or skipped where an optional signal is missing."""
    v, t, c = F.col("value"), F.col("threshold"), F.col("comparator")
    holds = F.when(c == "eq", v == t).when(c == "neq", v != t).when(c == "lt", v < t).when(c == "lte", v <= t).when(c == "gt", v > t).when(c == "gte", v >= t).otherwise(F.lit(False))
    joined = rules.join(signals.select(F.col("name").alias("signal"), "value"), "signal", "left")
    return joined.select("rule_id", "value", F.when(v.isNull(), F.when(F.col("required"), "failed").otherwise("skipped")).when(holds, "ok").otherwise("failed").alias("status"), "severity")


def answer_similarity(predicted: Column, expected: Column) -> Column:
    """Edit similarity of two texts, lower-cased."""
    a, b = F.lower(F.trim(predicted)), F.lower(F.trim(expected))
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def qa_metrics(answers: DataFrame, predicted: str, expected: str, least: float = 0.5) -> DataFrame:
    """answers with contained, similarity and ANLS (similarity, or 0 under `least`)."""
    similar = answer_similarity(F.col(predicted), F.col(expected))
    return answers.withColumns({"contained": F.contains(F.lower(predicted), F.lower(expected)), "similarity": half_up(similar, 3), "anls": F.when(similar >= least, half_up(similar, 3)).otherwise(0.0)})


def relaxed_number(predicted: Column, expected: Column, tolerance: float = 0.05) -> Column:
    """Whether a number is within a share of the expected one."""
    return F.when(expected == 0, predicted == 0).otherwise(F.abs(predicted - expected) <= tolerance * F.abs(expected))


def token_recall(produced: Column, reference: Column) -> Column:
    """Share of the reference's tokens, with repeats, that the produced text holds."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    want, have = words(reference), words(produced)
    count = lambda where, w: F.size(F.filter(where, lambda x: x == w))
    hits = F.aggregate(F.array_distinct(want), F.lit(0), lambda s, w: s + F.least(count(want, w), count(have, w)))
    return F.when(F.size(want) == 0, 1.0).otherwise(hits / F.size(want))


def review_queue(items: DataFrame, key: str, priority: str) -> DataFrame:
    """One review a key, with the greatest priority and all reasons."""
    return items.groupBy(key).agg(F.max(priority).alias("priority"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.count("*").alias("n_reports"))


def drift(before: DataFrame, after: DataFrame, key: str, items: str) -> DataFrame:
    """(key, added, removed) between two arrays of each key."""
    both = before.select(key, F.col(items).alias("_a")).join(after.select(key, F.col(items).alias("_b")), key, "full")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("_a", none), F.coalesce("_b", none)
    return both.select(key, F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"))
