"""Full-text index, approximate neighbours, sync ledger, embedding indexer, chunker and resolution on literal rows."""

import random
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions.vectors import hashed_embedding
from lodestrand.operators import ann, chunking, embedding_index, ingest, postings, resolution, retrieval, sync

DATA = "/root/testdata/sf0.01"


# Words

#: Words and stems of the published algorithm's own examples.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
    "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "a": "a",
}


def test_stems(spark):
    rows = postings.stemmed(spark.createDataFrame([(w,) for w in STEMS], "term string")).collect()
    assert {r.term: r.stem for r in rows} == STEMS


# Full text

TEXTS = [
    (1, 0, "Refund policy", "src a", "The refunds are paid within thirty days of the purchase"),
    (1, 1, "Refund policy", "src a", "Purchase orders and returned goods. Thirty days later no refund is paid"),
    (2, 0, "Shipping", "src b", "Shipping takes days, refunding takes longer"),
    (3, 0, None, None, None),
    (4, 0, "Days", "days", "days days days thirty"),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, chunk_index int, t string, c string, b string")
    return postings.built(rows, {"title": F.col("t"), "citation": F.col("c"), "body": F.col("b")})


def found(spark, index, *queries):
    out = {}
    for r in postings.full_text(index, spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")).collect():
        out.setdefault(r.query_id, {})[(r.doc_id, r.chunk_index)] = r.score
    return [out.get(k, {}) for k in range(len(queries))]


def test_full_text_words_phrases_alternatives_and_exclusions(spark, index):
    got = found(spark, index, "refund", '"thirty days"', "refund -thirty", "shipping or goods", "of the", '"days of purchase"', '"paid days"', "refund shipping policy", "")
    keys = [set(x) for x in got]
    assert keys == [{(1, 0), (1, 1), (2, 0)}, {(1, 0), (1, 1)}, {(2, 0)}, {(2, 0), (1, 1)}, set(), set(), set(), set(), set()]
    # Stop words keep their place: "of the" lies between, so the phrase with both matches and that with one does not.
    assert set(found(spark, index, '"days of the purchase"')[0]) == {(1, 0)}


def test_cover_density_prefers_near_terms_and_titles(spark, index):
    near, far = found(spark, index, "thirty days")[0][(1, 0)], found(spark, index, "paid purchase")[0][(1, 1)]
    assert near > far
    one = spark.createDataFrame([([(3, 0, 5.0), (4, 1, 5.0), (9, 0, 1.0), (14, 1, 5.0)], 2)], "e array<struct<pos:int,term:int,inverse:double>>, n int")
    d = one.select(postings.cover_density(F.col("e"), F.col("n"))).first()[0]
    assert d == pytest.approx(2 / 10 / 1 + 2 / 6 / (1 + 4) + 2 / 6 / (1 + 4))


def test_bm25_prefix_takes_any_term_and_beginnings_of_stems(spark, index):
    rows = postings.bm25_prefix(index, spark.createDataFrame([(0, "ship"), (1, "refunded"), (2, "zzz")], "query_id long, query string")).collect()
    got = {k: {(r.doc_id, r.chunk_index) for r in rows if r.query_id == k} for k in range(3)}
    assert got == {0: {(2, 0)}, 1: {(1, 0), (1, 1), (2, 0)}, 2: set()}


def test_index_files_hold_ranges_of_terms(spark, index):
    plan = postings.occurrences_of(index, spark.createDataFrame([("days",)], "term string"))
    assert plan.count() == 8 and "PushedFilters" in index.occurrences.where("term = 'days'")._jdf.queryExecution().executedPlan().toString()


def test_segments_hold_whole_chunks_sorted_by_term(spark):
    rows = spark.createDataFrame([(k, c, "Title b", None, f"b a{k} the b\u00e9 c") for k in range(20) for c in range(2)], "doc_id long, chunk_index int, t string, c string, b string")
    made = postings.built(rows, {"title": F.col("t"), "citation": F.col("c"), "body": F.col("b")}, most_chunks=10)
    held = made.occurrences.withColumn("file", F.input_file_name())
    assert held.groupBy("doc_id", "chunk_index").agg(F.countDistinct("file").alias("n")).where("n <> 1").count() == 0 and held.select("file").distinct().count() > 1
    for file in [r.file for r in held.select("file").distinct().collect()]:
        order = [(r.term, r.doc_id, r.chunk_index, r.pos) for r in spark.read.parquet(file).collect()]
        assert order == sorted(order)
    one = made.occurrences.where("doc_id = 3 and chunk_index = 1").orderBy("pos").collect()
    assert [(r.term, r.field, r.pos) for r in one] == [("title", "title", 0), ("b", "title", 1), ("b", "body", 4), ("a3", "body", 5), ("the", "body", 6), ("b", "body", 7), ("c", "body", 8)]


# Approximate neighbours


def test_ann_recall_and_its_growth_with_probes(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    exact = retrieval.vector_topk(vectors, queries).cache()
    made = ann.indexed(vectors, 64, 64)
    few, many, all_cells = (ann.recall(ann.searched(made, queries, 64, probes=p), exact).first().recall for p in (4, 40, 64))
    assert few < many and many >= 0.9 and all_cells == 1.0


def test_ann_finds_clusters_with_few_probes(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(20, 16))
    rows = [(k, (centers[k % 20] + 0.1 * r.normal(size=16)).tolist()) for k in range(2000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0")
    got = ann.searched(ann.indexed(vectors, 16, 32), queries, 16, probes=4)
    assert ann.recall(got, retrieval.vector_topk(vectors, queries)).first().recall >= 0.9


def test_ann_splits_a_hot_cell_and_handles_odd_vectors(spark):
    same = [(k, [1.0, 0.0]) for k in range(300)] + [(1000 + k, [0.0, 1.0]) for k in range(30)]
    odd = [(None, [1.0, 0.0]), (2000, None), (2001, [1.0]), (2002, [None, 1.0]), (2003, [0.0, 0.0])]
    vectors = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>")
    made = ann.indexed(vectors, 2, 2, part=50)
    assert max(r.parts for r in made.sizes.collect()) >= 6
    rows = ann.searched(made, vectors.where("vec_id % 20 = 0 or vec_id = 2002"), 2, k=3, probes=1, part=7).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(by[0]) == [(1, 0), (2, 1), (3, 2)] and sorted(by[1000]) == [(1, 1000), (2, 1001), (3, 1002)] and 2002 not in by and len(by) == 15 + 2
    assert ann.searched(ann.indexed(vectors.limit(0), 2), vectors, 2).count() == 0 and ann.searched(made, vectors.limit(0), 2).count() == 0


# Sync


def ledger(spark, *rows):
    t = datetime(2024, 1, 1)
    base = ("r", "active", "created", "v1", "c", "s", None, t, t, t, None, 0, None, None)
    return spark.createDataFrame([(i, *(over.get(n, b) for n, b in zip(sync.NAMES[1:], base))) for i, over in rows], sync.LEDGER)


ITEMS = "seq long, item_id string, operation string, record_id string, version string, content_hash string, scope_hash string, acl_hash string, deleted_at timestamp, error_code string, retryable boolean"


def test_sync_changes(spark):
    old = ledger(spark, *((k, {}) for k in ("same", "content", "version", "acl", "gone", "del", "err")), ("dead", {"status": "deleted"}), ("again", {"status": "deleted"}), ("failing", {"status": "failed", "failure_count": 2}))
    up = lambda n, k, **o: (n, k, "upsert", "r", o.get("version", "v1"), o.get("content", "c"), "s", o.get("acl"), None, None, None)
    items = [
        up(1, "same"), up(2, "content", content="old"), up(3, "content", content="new"), up(4, "version", version="v2"), up(5, "acl", acl="a"), up(6, "new"), up(7, "again"), up(8, "failing"),
        (9, "del", "delete", *[None] * 8), (10, "dead", "delete", *[None] * 8), (11, "err", "error", *[None] * 6, "boom", False), (12, "  ", "delete", *[None] * 8), (13, None, "delete", *[None] * 8),
    ]
    at = F.lit("2024-02-01").cast("timestamp")
    run = sync.applied(old, spark.createDataFrame(items, ITEMS), at, full=True, complete=True)
    rows = {r.item_id: r for r in run.ledger.collect()}
    assert {k: r.last_action for k, r in rows.items()} == {"same": "unchanged", "content": "updated", "version": "updated", "acl": "updated", "new": "created", "again": "updated", "failing": "updated", "del": "deleted", "dead": "unchanged", "err": "failed", "gone": "deleted"}
    assert rows["content"].content_hash == "new" and rows["again"].status == "active" and rows["again"].deleted_at is None and rows["failing"].failure_count == 0
    assert rows["err"].failure_count == 1 and rows["err"].retryable is False and rows["gone"].deleted_at == datetime(2024, 2, 1) and rows["same"].last_changed_at == datetime(2024, 1, 1)
    assert {(r.item_id, r.change) for r in run.changes.collect()} == {(k, "record") for k in ("content", "version", "acl", "new", "again", "failing")} | {("del", "deleted"), ("gone", "deleted"), ("err", "failed")}
    m = run.metrics.first()
    assert (m.n_records, m.n_deleted, m.n_failed, m.n_tombstoned, m.n_listed, m.n_warnings, m.status) == (6, 2, 1, 1, 13, 2, "partial")
    # The same listing again changes nothing but the failing item's count.
    again = sync.applied(run.ledger, spark.createDataFrame(items, ITEMS), at, full=True, complete=True)
    assert {r.change for r in again.changes.collect()} == {"failed"}
    # In delta mode, and after a listing that is not complete, nothing is tombstoned.
    for full, complete in ((False, True), (True, False)):
        assert sync.applied(old, spark.createDataFrame(items, ITEMS), at, full, complete).ledger.where("item_id = 'gone'").first().status == "active"


def test_a_failed_run_keeps_entries_and_cursor(spark):
    old = ledger(spark, ("a", {}), ("b", {"status": "deleted", "failure_count": 4}))
    rows = {r.item_id: r for r in sync.failed(old, F.lit("2024-02-01").cast("timestamp"), "timeout").collect()}
    assert rows["a"].status == "active" and rows["a"].failure_count == 1 and rows["b"].failure_count == 5 and rows["b"].last_error_code == "timeout" and rows["a"].content_hash == "c"
    assert sync.next_cursor("failed", "p", "q") == "p" and sync.next_cursor("partial", "p", "q") == "q"
    none = sync.applied(old.limit(0), spark.createDataFrame([], ITEMS), F.current_timestamp())
    assert none.ledger.count() == 0 and none.metrics.first().status == "succeeded"


# Embeddings

CHUNKS = "chunk_id string, doc_id long, tenant string, namespace string, text_hash string, text string"
NO_VECTORS = "vector_id string, chunk_id string, doc_id long, tenant string, namespace string, text_hash string, config_hash string, dimensions int, embedding array<double>"


def test_embeddings_are_made_once(spark):
    chunks = spark.createDataFrame([("c1", 1, "t", "n", "h1", "one"), ("c2", 1, "t", "n", "h2", "two"), ("c2", 1, "t", "n", "h2", "two"), (None, 1, "t", "n", "h", "x")], CHUNKS)
    seen = []

    def embed(rows):
        seen.append(sorted(r.chunk_id for r in rows.select("chunk_id").collect()))
        return hashed_embedding(rows, dimensions=8)

    one = embedding_index.indexed(chunks, spark.createDataFrame([], NO_VECTORS), embed, "cfg", 8)
    two = embedding_index.indexed(chunks, one.vectors, embed, "cfg", 8)
    moved = spark.createDataFrame([("c1", 1, "t", "n", "h9", "other"), ("c3", 2, "t", "n", "h3", "three")], CHUNKS)
    three = embedding_index.indexed(moved, two.vectors, embed, "cfg", 8)
    assert seen == [["c1", "c2"], [], ["c1", "c3"]]
    assert {r.vector_id: r.text_hash for r in three.vectors.collect()} == {"cfg_c1": "h9", "cfg_c3": "h3"}
    other = embedding_index.indexed(moved, three.vectors, lambda d: hashed_embedding(d, dimensions=4), "new", 8)
    assert {r.code for r in other.warnings.collect()} == {"dimension_mismatch"} and other.vectors.count() == 2
    bad = embedding_index.indexed(moved, three.vectors, lambda d: d.withColumn("embedding", F.lit(None).cast("array<double>")), "new", 8)
    assert {r.code for r in bad.warnings.collect()} == {"missing_embedding"}


def test_embedding_stream_replays_without_change(spark, tmp_path):
    held = {"table": spark.createDataFrame([], NO_VECTORS)}
    counts = []

    def embed(rows):
        counts.append(rows.count())
        return hashed_embedding(rows, dimensions=8)

    step = embedding_index.index_each_batch(lambda: held["table"], lambda df: held.update(table=df), embed, "cfg", 8)
    for k in range(2):
        spark.createDataFrame([(f"c{k}{i}", k, "t", "n", f"h{i}", f"text {i}") for i in range(3)], CHUNKS).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    first = sorted(tuple(r)[:6] for r in held["table"].collect())
    step(spark.read.parquet(str(tmp_path / "in")), 99)
    assert len(first) == 6 and sorted(tuple(r)[:6] for r in held["table"].collect()) == first and sum(counts) == 6


# Chunker


def spans(spark, text, regions=(), **policy):
    docs = spark.createDataFrame([(1, text, "z")], "doc_id long, text string, _n string").drop("_n")
    layout = spark.createDataFrame([(1, *r) for r in regions], "doc_id long, kind string, start int, end int") if regions else None
    rows = chunking.chunked(docs, layout, chunking.Policy(**policy)).orderBy("chunk_index").collect()
    assert all(r.text == text[r.start : r.end] for r in rows)
    return [(r.start, r.end, r.protected) for r in rows]


def test_protected_ranges_are_kept_whole_and_united(spark):
    text = "".join(chr(97 + k % 26) for k in range(1000))
    size = dict(most=300, overlap=0, least=50, boundary="character")
    assert spans(spark, text, [("table", 400, 500), ("table_caption", 480, 560), ("figure", 560, 600), ("paragraph", 0, 900)], **size) == [(0, 300, False), (300, 400, False), (400, 600, True), (600, 900, False), (900, 1000, False)]
    # A range beyond the limit is cut, its parts protected; ranges are cut to the body, and others ignored.
    assert spans(spark, text, [("table", 100, 500), ("equation", 950, 5000), ("table", 2000, 3000), ("table", 7, 7), ("table", None, 5)], **size) == [(0, 100, False), (100, 400, True), (400, 500, True), (500, 800, False), (800, 950, False), (950, 1000, True)]


def test_small_windows_merge_back_or_forward_but_not_two_protected(spark):
    text = "a" * 20 + "b" * 100 + "c" * 20 + "d" * 20 + "e" * 100
    size = dict(most=150, overlap=0, least=50, boundary="character")
    assert spans(spark, text, [("table", 20, 120)], **size) == [(0, 120, True), (120, 260, False)]
    assert spans(spark, text, [("table", 120, 140), ("figure", 141, 160)], **size) == [(0, 141, True), (141, 260, True)]
    assert spans(spark, "a" * 20 + "b" * 20, [("table", 0, 20), ("table", 21, 40)], most=30, overlap=0, least=25, boundary="character") == [(0, 21, True), (21, 40, True)]


def test_separators_furniture_and_limits(spark):
    paragraphs = "\n\n".join(["x" * 90, "y" * 90, "z" * 90, "12", "w" * 200])
    assert spans(spark, paragraphs, most=200, overlap=0, least=50) == [(0, 184, False), (184, 280, False), (280, 480, False)]
    assert spans(spark, "word " * 100, [("table", 0, 200), ("table", 203, 500)], most=600, least=120) == [(0, 203, True), (203, 500, True)]
    assert spans(spark, " \n\t ") == [] and spans(spark, "page 3 of 7") == [] and spans(spark, "ünï €") == [(0, 5, False)]
    docs = spark.createDataFrame([(1, "x" * 5000), (2, None), (3, "short")], "doc_id long, text string")
    tight = chunking.Policy(most=100, overlap=0, most_chunks=10)
    assert [tuple(r) for r in chunking.rejected(docs, None, tight).collect()] == [(1, 50)] and {r.doc_id for r in chunking.chunked(docs, None, tight).collect()} == {3}


def test_chunker_and_validation_are_linear(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "para graph é\n\n" * (n // 14))], "doc_id long, text string")
        layout = spark.range(n // 5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("table").alias("kind"), (F.col("id") * 5000).cast("int").alias("start"), (F.col("id") * 5000 + 900).cast("int").alias("end"))
        policy = chunking.Policy(most_chunks=1 << 30)
        began = time.time()
        chunks = chunking.chunked(docs, layout, policy).select("doc_id", "chunk_id", "start", "end", "text", "text_hash")
        assert ingest.chunk_problems(chunks, docs).count() == 0
        return time.time() - began

    seconds(100_000)
    small, large = seconds(1_000_000), seconds(4_000_000)
    assert large < 10 * max(small, 0.5)


def test_chunk_problems(spark):
    docs = spark.createDataFrame([(1, "é" * 3000 + "abc")], "doc_id long, text string")
    rows = spark.createDataFrame([("ok", 1, 2999, 3002, "éab"), ("shifted", 1, 3000, 3002, "éa"), ("far", 1, 9000, 9002, "xx"), ("turned", 1, 5, 2, "x"), ("orphan", 7, 0, 1, "x"), ("twice", 1, 0, 1, "é"), ("twice", 1, 0, 1, "é"), ("hash", 1, 3000, 3001, "a")], "chunk_id string, doc_id long, start int, end int, text string")
    chunks = rows.withColumn("text_hash", F.when(F.col("chunk_id") == "hash", "0").otherwise(F.sha2(F.encode("text", "UTF-8"), 256)))
    assert sorted(tuple(r) for r in ingest.chunk_problems(chunks, docs).collect()) == [("far", "range_mismatch"), ("hash", "hash_mismatch"), ("orphan", "missing_document"), ("shifted", "range_mismatch"), ("turned", "range_mismatch"), ("twice", "duplicate_id")]


# Resolution


def entities(spark, rows):
    return spark.createDataFrame([(i, "company", n, m, 0.5, 1) for i, n, m in rows], "entity_id string, kind string, name string, metadata map<string,string>, confidence double, evidence_count int")


NO_EDGES = "source string, target string, kind string"


def test_linked_identifier_groups_are_one(spark):
    rows = [("a", "A", {"cik": "1"}), ("b", "B", {"cik": "001", "lei": "x"}), ("d", "D", {"lei": "X"}), ("f", "F", {"lei": "x", "duns": "9"}), ("g", "G", {"duns": "9"}), ("h", "H", {"duns": "8"}), ("p", "P", {}), ("q", "Q", {})]
    none = spark.createDataFrame([], NO_EDGES)
    got = dict(resolution.by_identifier(entities(spark, rows), none).collect())
    assert got == {k: "a" for k in "abdfg"}
    # Where the chain links two places, it is not merged whole; identifiers whose own members disagree are no groups at all.
    edges = spark.createDataFrame([("a", "p", "registered_in"), ("g", "q", "registered_in")], NO_EDGES)
    assert dict(resolution.by_identifier(entities(spark, rows), edges).collect()) == {"a": "a", "b": "a", "f": "f", "g": "f"}


def test_components_of_long_chains_and_hubs(spark):
    r = random.Random(4)
    chain = [(f"n{k:05d}", f"n{k + 1:05d}") for k in range(200)]
    hub = [("h0", f"h{k}") for k in range(1, 1500)]
    rows = chain + hub + [("x", "x"), ("y2", "y1")]
    r.shuffle(rows)
    got = dict(resolution.components(spark.createDataFrame(rows, "a string, b string")).collect())
    assert {got[f"n{k:05d}"] for k in range(201)} == {"n00000"} and {got[f"h{k}"] for k in range(1500)} == {"h0"} and got["y2"] == "y1" and "x" not in got


def test_review_pairs_are_linear_in_copies(spark):
    rows = [(f"e{k:04d}", "Main Branch", {}) for k in range(400)] + [(f"p{k:04d}", f"Place {k}x", {}) for k in range(400)]
    edges = spark.createDataFrame([(f"e{k:04d}", f"p{k:04d}", "registered_in") for k in range(400)], NO_EDGES)
    found = resolution.review_pairs(entities(spark, rows).where("entity_id < 'p'").unionByName(entities(spark, rows).where("entity_id >= 'p'").withColumn("kind", F.lit("place"))), edges).where("kind = 'company'").collect()
    assert len(found) == 399 and all(r.left_id == "e0000" and r.conflict and r.score == 1.0 for r in found)
    classes = resolution.review_classes(entities(spark, rows), edges).where("entity_id like 'e%'")
    assert classes.select("class_id").distinct().count() == 400 and classes.select("name_id").distinct().count() == 1
