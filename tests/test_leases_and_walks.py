"""The lease queue in batch and as a stream, and budgeted walks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import graph, leases
from lodestrand.operators.ingest import SIGNALS, TYPES
from lodestrand.functions.text import REDACTIONS, bounded, of_words, redacted, redaction

MINUTE = 60_000_000
#: A stream has no watermark before 1970, and takes nothing at that moment.
START = 30_000_000 * MINUTE


def log(spark, *events):
    """Events (queue, minute, id, action, and what differs from the defaults)."""
    rows = [(q, t * MINUTE, i, a, o.get("worker", "w"), o.get("lease", 10 * MINUTE), o.get("retryable", True), o.get("available_at"), o.get("max_attempts")) for q, t, i, a, o in events]
    return spark.createDataFrame(rows, leases.LOG)


def test_transitions(spark):
    got = {
        r.queue_id: r
        for r in leases.states(
            log(
                spark,
                ("done", 0, 1, "enqueue", {}), ("done", 1, 2, "claim", {}), ("done", 5, 3, "heartbeat", {}), ("done", 14, 4, "complete", {}), ("done", 15, 5, "cancel", {}),
                ("stolen", 0, 1, "enqueue", {}), ("stolen", 1, 2, "claim", {"worker": "a"}), ("stolen", 5, 3, "claim", {"worker": "b"}), ("stolen", 11, 4, "claim", {"worker": "b"}), ("stolen", 12, 5, "heartbeat", {"worker": "a"}), ("stolen", 13, 6, "complete", {"worker": "a"}),
                ("dead", 0, 1, "enqueue", {"max_attempts": 2}), ("dead", 1, 2, "claim", {}), ("dead", 2, 3, "fail", {"available_at": 9 * MINUTE}), ("dead", 3, 4, "claim", {}), ("dead", 9, 5, "claim", {}), ("dead", 10, 6, "fail", {}),
                ("again", 0, 1, "enqueue", {}), ("again", 1, 2, "claim", {}), ("again", 2, 3, "fail", {"retryable": False}), ("again", 3, 4, "requeue", {"max_attempts": 7}),
                ("late", 0, 1, "enqueue", {}), ("late", 1, 2, "claim", {}), ("late", 30, 3, "heartbeat", {}),
                ("lost", 0, 1, "claim", {}), ("odd", 0, 1, "enqueue", {}), ("odd", 0, 2, "enqueue", {}), ("odd", 1, 3, "dance", {}), ("odd", 2, 4, "cancel", {}), (None, 0, 1, "enqueue", {}),
            )
        ).collect()
    }
    show = {k: (r.status, r.attempt, r.n_rejected) for k, r in got.items()}
    assert show == {"done": ("completed", 1, 1), "stolen": ("leased", 2, 3), "dead": ("dead_letter", 2, 1), "again": ("queued", 0, 0), "late": ("leased", 1, 1), "lost": (None, None, 1), "odd": ("cancelled", 0, 2)}
    assert got["stolen"].worker == "b" and got["stolen"].lease_expires_at == 21 * MINUTE and got["again"].max_attempts == 7 and got["dead"].finished_at == 10 * MINUTE and got["done"].worker is None
    jobs = leases.states(log(spark, ("late", 0, 1, "enqueue", {}), ("late", 1, 2, "claim", {})))
    assert leases.expired(jobs, F.lit(11 * MINUTE)).count() == 1 and leases.expired(jobs, F.lit(10 * MINUTE)).count() == 0
    assert leases.states(spark.createDataFrame([], leases.LOG)).count() == 0


def random_log(n, jobs, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        action = "enqueue" if i < jobs else r.choice(["claim", "claim", "heartbeat", "complete", "fail", "cancel", "requeue", "requeue", "other"])
        out.append((f"q{i if i < jobs else r.randrange(jobs)}", START + (i // 2) * MINUTE, i, action, r.choice(["a", "b", None]), r.choice([MINUTE, 5 * MINUTE, 50 * MINUTE, None]), r.choice([True, True, False, None]), r.choice([None, START + (i // 2 + 3) * MINUTE]), r.choice([None, 2, 9])))
    return out


def test_batch_equals_the_step_by_step_fold(spark):
    rows = random_log(600, 12, 3)
    want = {}
    for q, *values in rows:
        event = dict(zip([c.split()[0] for c in leases.LOG.split(", ")][1:], values))
        want[q] = leases.stepped(want.get(q, dict.fromkeys([c.split()[0] for c in leases.STATE.split(", ")]) | {"n_rejected": 0}), event)
    twice = spark.createDataFrame(rows + rows[::3], leases.LOG).repartition(5)
    assert {r.queue_id: {k: v for k, v in r.asDict().items() if k != "queue_id"} for r in leases.states(twice).collect()} == want


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    rows = random_log(240, 6, 8)
    for k in range(0, 240, 80):
        # The last part of each batch comes again with the next one.
        spark.createDataFrame(rows[max(0, k - 15) : k + 80], leases.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            if not r.lease_expired:
                seen[r.queue_id] = {k: v for k, v in r.asDict().items() if k not in ("queue_id", "lease_expired")}

    stream = spark.readStream.schema(leases.LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    leases.states_stream(stream, "365 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    want = {r.queue_id: {k: v for k, v in r.asDict().items() if k != "queue_id"} for r in leases.states(spark.createDataFrame(rows, leases.LOG)).collect()}
    assert seen == want


def test_stream_tells_expired_leases(spark, tmp_path):
    parts = [[("q", 0, 1, "enqueue"), ("q", MINUTE, 2, "claim")], [("z", 500 * MINUTE, 3, "enqueue")], [("z", 501 * MINUTE, 4, "cancel")]]
    for part in parts:
        spark.createDataFrame([(q, START + t, i, a, "w", 10 * MINUTE, None, None, None) for q, t, i, a in part], leases.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    told = []
    stream = spark.readStream.schema(leases.LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = leases.states_stream(stream, "1 minute").writeStream.outputMode("update").foreachBatch(lambda b, _: told.extend(r.queue_id for r in b.where("lease_expired").collect()))
    query.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert told == ["q"]


def test_walks_keep_order_budget_and_path(spark):
    edges = spark.createDataFrame([("a", f"b{k}", "x") for k in range(5)] + [("b0", "c0", "x"), ("b1", "c0", "x"), ("b1", "c1", "y"), ("c9", "b2", "x"), ("c0", "d", "x"), ("a", "a", "x")], "source string, target string, kind string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    rows = {r.node: r for r in graph.bounded_walk(seeds, edges, 3, 8, 64).collect()}
    assert {k: r.depth for k, r in rows.items()} == {"a": 0, **{f"b{k}": 1 for k in range(5)}, "c0": 2, "c1": 2, "c9": 2, "d": 3}
    assert [(e.depth, e.source, e.target, e.kind) for e in rows["c9"].path] == [(1, "a", "b2", "x"), (2, "c9", "b2", "x")] and [e.source for e in rows["d"].path] == ["a", "b0", "c0"]
    assert [n for n, _ in sorted(((r.node, r.place) for r in rows.values()), key=lambda x: x[1])] == ["a", "b0", "b1", "b2", "b3", "b4", "c0", "c1", "c9", "d"]
    few = {r.node for r in graph.bounded_walk(seeds, edges, 3, 8, 7).collect()}
    assert few == {"a", "b0", "b1", "b2", "b3", "b4", "c0"}
    assert {r.node for r in graph.bounded_walk(seeds, edges, 3, 8, 64, ["x"], "outgoing").collect()} == {"a", "b0", "b1", "b2", "b3", "b4", "c0", "d"}


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_searches_in_breadth_follow_every_neighbour(spark, depth):
    r = random.Random(4)
    edges = [(f"n{k}", "hub", "x") for k in range(40)] + [("hub", "far", "x"), ("far", "hub", "y"), ("far", "far", "x"), (None, "hub", "x"), ("far", None, "x")]
    edges += [(f"n{r.randrange(40)}", f"m{r.randrange(60)}", r.choice("xy")) for _ in range(90)]
    near = {}
    for a, b, _ in edges:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for seed in ("hub", "m1", "alone"):
        found = front = {seed: (0, seed)}
        for d in range(1, depth + 1):
            met = sorted((f"{path}>{o}", o) for node, (_, path) in front.items() for o in near.get(node, ()) if o not in found)
            front = {o: (d, path) for path, o in reversed(met)}
            found = found | front
        want |= {(seed, node): v for node, v in found.items()}
    seeds = spark.createDataFrame([("hub",), ("m1",), ("alone",)], "node string")
    got = graph.bounded_bfs(seeds, spark.createDataFrame(edges, "source string, target string, kind string"), depth).collect()
    assert {(x.seed, x.node): (x.depth, x.path) for x in got} == want and len(got) == len(want)
    assert depth == 0 or sum(k[0] == "hub" and v[0] == 1 for k, v in want.items()) == 41


def test_graph_candidates_take_relation_chunks(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x")], "source string, target string, kind string")
    matches = spark.createDataFrame([(0, "a", 0.8)], "query_id long, entity_id string, score double")
    own = spark.createDataFrame([("a", "ca"), ("c", "cc")], "entity_id string, chunk_id string")
    between = spark.createDataFrame([("a", "b", "x", "cab"), ("b", "c", "x", "cc"), ("b", "a", "x", "no")], "source string, target string, kind string, chunk_id string")
    got = {r.chunk_id: (r.score, r.depth) for r in graph.graph_candidates(matches, edges, own, relation_evidence=between).collect()}
    assert got == {"ca": (0.8, 0), "cab": (0.6, 1), "cc": (0.45, 2)}
    assert {r.chunk_id for r in graph.graph_candidates(matches, edges, own, relation_evidence=between, direction="incoming").collect()} == {"ca"}


@pytest.mark.parametrize("text,found", [("éuser_id=5", 1), ("xuser_id=5", 0), ("user_id=5", 1), ("card: 4111 1111 1111 1111", 2), ("Bearer abc", 1)])
def test_word_bounds_are_those_of_ascii(spark, text, found):
    assert "(?<=" in bounded(r"\bx") and spark.createDataFrame([(text,)], "t string").select(redacted(F.col("t"), ["user_id", "payment", "auth_secret"] + (["phone"] if found == 2 else []))[1]).first()[0] == min(found, 1)


def test_redaction_finds_what_its_patterns_find_in_linear_time(spark):
    texts = ["a@b.co_x@y.zz", "a@b a@b.c a@b.cde%q@w.er", "@x.yy z@@x.yy", "é@x.yy éa@x.yy", "user_id=4, USERID : x-user id=9 _user_id=1", "card 1 cc:4111 1111 1111 1111 xcard=4111111111111111", "+1 555 123 4567a@b.co 12345678 9", "[REDACTED:email] password = [REDACTED:auth_secret] Bearer\tx.y api-key:\n\nz xapikey=1", "", "a.b" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out, n = F.col("t"), F.lit(0)
    for name, pattern in REDACTIONS:
        n = n + F.regexp_count(out, F.lit(bounded(pattern)))
        out = F.regexp_replace(out, bounded(pattern), f"[REDACTED:{name}]")
    plain = {r.i: (r.o, r.n) for r in rows.where("length(t) < 1000").select("i", out.alias("o"), n.alias("n")).collect()}
    began = time.time()
    got = {r.i: (r.r.out, r.r.n) for r in rows.select("i", redaction(F.col("t")).alias("r")).collect()}
    assert time.time() - began < 20  # the run of 300,000 address characters took minutes
    assert got == plain | {len(texts) - 1: (texts[-1], 0)}


def test_whole_words_are_found_as_by_their_pattern(spark):
    texts = ["owns", "owned by", "xowns", "owns_", "éownsé", "co-owns.", "shareholders", "the parent company", "policy\nrefund", "ownership percentage", "owned  by", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in [*SIGNALS.values(), *(p for _, _, p in TYPES if p)]:
        assert "(?=[" in of_words(pattern) and rows.where(F.rlike("t", F.lit(of_words(pattern))) != F.rlike("t", F.lit(bounded(pattern)))).count() == 0
