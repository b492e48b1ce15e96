"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its sixteen 4-bit segments,
a point of a small integer lattice. The Manhattan distance of two such points
never exceeds the Hamming distance of the fingerprints, so a range join of
radius 2 on a unit grid finds every pair within 2 bits. It is done by halves:
each point goes to its own cell and to the cells one step away, and two points
within distance 2 always meet in a cell. Inside a cell the fingerprints are
compared exactly, and a spanning forest of the true links leaves it, never all
pairs. Links are then closed to components by alternating star contractions.

Equal fingerprints are merged before all this, so a group of copies of any
size is one point. A point makes at most 33 small rows. A cell holds distinct
fingerprints only; a crowded one is compared through one-bit neighbours, in
n log n, instead of by pairs.

Defined cases: a null or empty text, or one of white space, has fingerprint 0
and is linked like any other. Fewer than three words form one shingle. Repeated
rows and equal ids give one row each. A null id is never the smallest of its
component; a component with no other id has a null component_id. An empty table
gives no rows. A text of any length is hashed whole, in blocks. Columns besides
id and text are not read, but for the choice of one row among several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, discard, slices, written

SEED, SHINGLE, RADIUS, SEGMENTS, WIDTH = 42, 3, 2, 16, 4
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Up to so many fingerprints of a cell are compared pair by pair.
DENSE = 1024
#: Rows of two numbers that a file of a table of links holds, about, where there are more than FEWEST_FILES of them.
LINKS_A_FILE, FEWEST_FILES = 500_000, 8


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the XXH64 of a text's word shingles, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *also): the fingerprint of every row, as a signed long, beside columns of longs that go along."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), *map(batch.column, also)], ["doc_id", "fp", *also])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *also)
    return source.mapInArrow(work, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in also)]))


def _counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the segments of each fingerprint, one row each."""
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH)
    return np.bitwise_count((fp.view(np.uint64)[:, None] >> shifts) & np.uint64(2**WIDTH - 1)).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's grid cell and the cells one step away; a coordinate takes 3 bits of the cell's key."""
    step = np.int64(1) << (3 * np.arange(SEGMENTS, dtype=np.int64))
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(whole), 20_000):
            fp = whole[at : at + 20_000]
            counts = _counts(fp)
            home = counts @ step
            keys, owners = [home], [fp]
            for k in range(SEGMENTS):
                for move, inside in ((1, counts[:, k] < WIDTH), (-1, counts[:, k] > 0)):
                    keys.append(home[inside] + move * step[k])
                    owners.append(fp[inside])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["cell", "fp"])


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n points with links a-b: the smallest point that each one reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def links(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints that differ in at most 2 bits."""
    n, bits = len(fp), fp.view(np.uint64)
    if n <= DENSE:
        a, b = np.nonzero(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius, 1))
    else:
        # Within 2 bits means: some word is equal to or one flip away from both.
        mine, flips = np.arange(n), [np.uint64(0), *(np.uint64(1) << np.arange(64, dtype=np.uint64))]
        passes, found = 1 + n * 65 // 4_000_000, []
        for part in range(passes):
            keys, owners = [], []
            for flip in flips:
                x = bits ^ flip
                take = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == part
                keys.append(x[take])
                owners.append(mine[take])
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            same = key[1:] == key[:-1]
            found.append((owner[:-1][same], owner[1:][same]))
        a, b = (np.concatenate(x) for x in zip(*found))
    if not len(a):
        return fp[:0], fp[:0]
    label = _smallest(n, a, b)
    inner = np.nonzero(label != np.arange(n))[0]
    return fp[inner], fp[label[inner]]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: the exact links within each cell. One cell's fingerprints are held at a time."""
    cell_left, left = None, []

    def closed() -> tuple[np.ndarray, np.ndarray]:
        fp = np.unique(np.concatenate(left)) if left else np.empty(0, np.int64)
        return links(fp) if len(fp) > 1 else (fp[:0], fp[:0])

    def out(pairs: list) -> pa.RecordBatch:
        a, b = ([x[k] for x in pairs if len(x[0])] or [np.empty(0, np.int64)] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        cell, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(cell):
            continue
        starts = np.concatenate(([0], np.nonzero(cell[1:] != cell[:-1])[0] + 1, [len(cell)]))
        pairs = []
        if cell_left is not None and cell[0] != cell_left:
            pairs.append(closed())
            left = []
        sizes = np.diff(starts)
        last = len(sizes) - 1
        for k in np.nonzero(sizes > 1)[0].tolist() + ([0] if sizes[0] == 1 and left else []):
            if k == 0 and left and last > 0:
                left.append(fp[: starts[1]])
                pairs.append(closed())
                left = []
            elif k != last and not (k == 0 and left):
                pairs.append(links(np.unique(fp[starts[k] : starts[k + 1]])))
        if last > 0:
            left = []
        left.append(fp[starts[last] :].copy())
        cell_left = cell[-1]
        yield out(pairs)
    yield out([closed()])


def near_links(nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """(a, b) between distinct fingerprints of `nodes` (column fp) that span every component of the 2-bit graph."""
    cells = nodes.select("fp").mapInArrow(_cells, "cell long, fp long")
    dealt = cells.repartition("cell") if partitions is None else cells.repartition(partitions, "cell")
    return dealt.sortWithinPartitions("cell").mapInArrow(_verified, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges (a, b), for every node that has one.

    Alternating large-star and small-star steps: each replaces edges by edges to
    the smallest neighbour, and stops when a round changes none. Smallest
    neighbours are written before they are joined, so that both sides of a join
    are dealt by it alone and Spark can split the edges of a hub.
    """
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m"))
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # Every table of a round has at most twice the first one's rows; files are few where links are few.
    files = max(FEWEST_FILES, edges.count() // LINKS_A_FILE)
    kept = lambda df, name: written(df.coalesce(files), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = kept(least(both).select("a", F.least("a", "m").alias("m")), "low")
        large = kept(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        first = kept(least(large), "first")
        small = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(first.select("a", F.col("m").alias("b")))
        after = kept(small.distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for used in (edges, low, large, first):
            discard(used)
        edges = after
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root, *also): one row per row of docs; root, a fingerprint, tells components apart."""
    marked = written(fingerprints(docs, doc_id, text, also), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    edges = components(near_links(nodes))
    roots = written(edges.select("node", "root").unionByName(edges.select(F.col("root").alias("node"), "root").distinct()), "roots")
    linked = written(roots.withColumnRenamed("node", "fp").join(nodes, "fp"), "linked")
    # Both sides of each join are tables, dealt by it alone: Spark splits the largest component, and a fingerprint that many rows share.
    named = linked.join(written(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "named"), "root").select("fp", "root", "component_id")
    every = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    classes = written(every, "classes")
    for used in (nodes, edges, roots, linked):
        discard(used)
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "root", *also)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs, with the smallest id of its near-duplicate component."""
    return grouped(docs, doc_id, text).drop("root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: that of the smallest id (a null one last), of rows that share it the one with the smallest fingerprint, then the smallest hash of the row.

    Rows are chosen by narrow columns first; the texts of docs are shuffled once,
    to meet the choice. Rows that are equal in all columns count as one; columns
    of maps do not tell rows apart.
    """
    hashed = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row_hash, name = F.xxhash64(*hashed), F.coalesce(F.col(doc_id).cast("string"), F.lit("none"))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_hash.alias("_hash"))
    found = written(grouped(narrow, also=("_hash",)), "groups")
    counted = found.groupBy("root", "doc_id", "fp", "_hash").agg(F.count("*").alias("n"))
    best = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "_hash", "n")).alias("c"))
    chosen = written(best.select(F.coalesce(F.col("c.doc_id").cast("string"), F.lit("none")).alias("_name"), F.col("c._hash").alias("_hash"), F.col("c.n").alias("_n")), "chosen")
    discard(found)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), name.alias("_name"), row_hash.alias("_hash"))
    # The choice is the narrow side, and hashed there, so that texts are not sorted.
    single = rows.join(chosen.where("_n = 1").hint("shuffle_hash"), ["_name", "_hash"], "left_semi")
    if not chosen.where("_n > 1").isEmpty():
        single = single.unionByName(rows.join(chosen.where("_n > 1").hint("shuffle_hash"), ["_name", "_hash"], "left_semi").dropDuplicates(["_name", "_hash"]))
    return single.select("_row.*")
