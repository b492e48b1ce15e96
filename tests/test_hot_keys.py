"""Keyed steps on keys that hold most rows: results against plain loops, and plans that split them."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestrand.operators import evaluation, incremental, planning, resolution, retrieval
from lodestrand.plans import frames


def test_idempotency_of_a_hot_key(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.7 else f"k{r.randrange(40)}", k, r.choice("aab")) for k in range(1500)]
    r.shuffle(rows)
    got = {x.t: x.status for x in incremental.idempotent(spark.createDataFrame(rows, "k string, t long, payload_hash string"), ["k"], ["t"]).collect()}
    first, clashed, want = {}, {}, {}
    for k, t, p in sorted(rows, key=lambda x: x[1]):
        if k not in first:
            first[k], want[t] = p, "processable"
            continue
        clashed[k] = clashed.get(k, False) or p != first[k]
        want[t] = "conflict" if clashed[k] else "duplicate"
    assert got == want
    events = spark.createDataFrame(rows, "k string, t long, payload_hash string")
    with_salt = incremental.met(events, events.groupBy("k").agg(F.count("*").alias("n")), ["k"], ["t"])
    assert with_salt.count() == 1500 and "_salt" in with_salt._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_of_a_hot_group(spark):
    r = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in r.integers(0, 300, 4000)] + [("few", 3.0), ("few", 1.0), ("few", None), ("one", 7.0), ("none", None)]
    got = {x.g: x for x in evaluation.snapshot(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v").collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    assert [got["hot"][c] for c in ("p50", "p95", "p99")] == [hot[1999], hot[3799], hot[3959]]
    assert (got["few"].n, got["few"].p50, got["few"].p99) == (3, 1.0, 3.0) and got["one"].p50 == 7.0 and got["none"].p50 is None
    ranked = evaluation.ranked_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").where("g = 'hot'").collect()
    assert sorted(x["rank"] for x in ranked) == list(range(1, 4001)) and [x.value for x in sorted(ranked, key=lambda x: x["rank"])] == hot


def test_salted_copies_are_never_broadcast(spark, monkeypatch):
    events = spark.range(3000).selectExpr("if(id < 900, 'hot', 'k' || id) as k", "id as t", "if(id % 7 = 5, 'b', 'a') as payload_hash")
    groups = events.groupBy("k").agg(F.count("*").alias("n"))
    for joined in (incremental.met(events, groups, ["k"], ["t"]), resolution._spread(events.selectExpr("k", "'e' || t as entity_id"), groups, ["k"])):
        assert joined.count() == 3000 and "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    # Of counted keys only the hot ones are copied; the statuses stay the same.
    monkeypatch.setattr(incremental, "HOT", 500)
    assert incremental.met(events, groups, ["k"], ["t"], "n").count() == 3000
    got = {r.t: r.status for r in incremental.idempotent(events, ["k"], ["t"]).collect()}
    assert got == {t: "processable" if t == 0 or t >= 900 else "conflict" if t >= 5 else "duplicate" for t in range(3000)}


def test_order_lines_are_dealt_by_their_number(spark, monkeypatch):
    few = frames.edges(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(frames, "TASK_LINES", 100)
    many = frames.edges(spark, "/root/testdata/sf0.001")
    n = -(-frames.table(spark, "/root/testdata/sf0.001", "lineitem").count() // 100)
    sizes = many.where("kind = 'supplies'").groupBy(F.spark_partition_id()).count().collect()
    assert sorted(many.collect()) == sorted(few) and n > 10 and len(sizes) > n // 2 and max(r["count"] for r in sizes) < 200


def test_branches_need_no_shuffle(spark):
    plans = planning.planned(spark.createDataFrame([(1, "Who owns Acme?"), (2, "acme"), (3, "")], "query_id long, question string"))
    made = planning.branches(plans, keep=("route",))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in made.where("query_id = 2").collect()] == [(2, 1, "original", "acme", 1.0, "none")]
    assert [(r.branch, r.kind, r.route) for r in made.where("query_id = 1").collect()] == [(1, "original", "graph_required"), (2, "low_level", "graph_required"), (3, "high_level", "graph_required")]


def test_neighbours_are_the_same_in_parts_of_a_block(spark, monkeypatch):
    r = np.random.default_rng(5)
    v = spark.createDataFrame([(i, r.integers(-2, 3, 8).astype(float).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    whole = retrieval.vector_topk(v, v, 5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(retrieval, "ASKED", 7)
    assert retrieval.vector_topk(v, v, 5).orderBy("query_id", "rank").collect() == whole and len(whole) == 1500
