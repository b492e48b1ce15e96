"""Merkle manifest of a dataset: a tree for each language over its documents, and a tree over the languages.

A node is the SHA-256 of its children's digests as hex text, `fanout` children in
a row; the last run of a level may be shorter, even one. Levels are reduced in
superblocks: nodes are bucketed by index / fanout ** levels, one Arrow group
collapses `levels` levels of a bucket, and the bucket roots are the nodes of the
next superblock, until every tree has one. Then the way back: the proof of a
bucket's root is joined to its members, whose own proof within the bucket is
computed again and put before it. So no proof of a document is ever shuffled or
stored; a document's row is (tree, index, id, digests).

Places of documents: rows are dealt by ranges of (tree, id, leaf, number), sorted
and written, so that a place within a file and the counts before it make the
index. Counts are one row for each tree of each range. A language that holds most
of the rows is spread over ranges like any other.
A bucket holds at most fanout ** levels nodes (4096).

Defined cases: null columns are hashed as `-`; rows with a null id come first;
rows of one id stand by their leaf digest, and equal rows side by side, each with
a place and proof of its own; a null language is a tree before the others; texts
are hashed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

FANOUT, LEVELS = 2, 12
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range, about; it sets the number of ranges and nothing else.
ROWS_A_RANGE = 1_000_000

Path = tuple[tuple[str, str], ...]


def node(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value with its length in bytes before it, `-` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """SHA-256 of a document's columns; `changed` stand in for columns."""
    return F.sha2(F.encode(F.concat(*(field(changed.get(c, F.col(c))) for c in LEAF_COLUMNS)), "UTF-8"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, number, leaf, tampered): tampered is the leaf with n_chars + 1 where 7 divides the checksum of the id, null elsewhere."""
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", F.monotonically_increasing_id().alias("number"), leaf().alias("leaf"), F.when(chosen, leaf(n_chars=F.col("n_chars") + 1)).alias("tampered"))


def placed(rows: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """rows (tree, ...) with `index`, their place in the tree by `order`, and `size`, the tree's rows."""
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(max(1, ranges), "tree", *order).sortWithinPartitions("tree", *order)
    held = written(dealt.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "merkle-places")
    counts = held.groupBy("_part", "tree").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    by_tree = Window.partitionBy("tree").orderBy("_part")
    before = F.coalesce(F.sum("n").over(by_tree.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", "tree", "first", before.alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    # A row for each tree of each range: as many as ranges and trees together. The join is not broadcast, since trees may be many; a tree's rows spread by range.
    offsets = counts.select("_part", "tree", (F.col("before") - F.col("first")).alias("_offset"), "size")
    out = held.join(offsets, ["_part", "tree"]).withColumn("index", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")
    out._written_at = held._written_at
    return out


def collapse(nodes: list[str], levels: int, fanout: int) -> tuple[str, list[Path]]:
    """The root that `levels` levels make of a bucket's nodes, and each node's path: the siblings to its left and right, level by level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    groups = [[k] for k in range(len(nodes))]
    for _ in range(levels):
        above, merged = [], []
        for run in range(0, len(nodes), fanout):
            part = nodes[run : run + fanout]
            for k in range(len(part)):
                sides = ("".join(part[:k]), "".join(part[k + 1 :]))
                for leaf_at in groups[run + k]:
                    paths[leaf_at].append(sides)
            above.append(node("".join(part)))
            merged.append([x for g in groups[run : run + fanout] for x in g])
        nodes, groups = above, merged
    return nodes[0], [tuple(p) for p in paths]


def depth(size: int, fanout: int) -> int:
    """Levels until one node is left of `size`."""
    out = 0
    while size > 1:
        size, out = -(-size // fanout), out + 1
    return out


def folded(digest: str, path: Path) -> str:
    for left, right in path:
        digest = node(left + digest + right)
    return digest


def path_text(path: Path) -> str:
    return "".join(left + right for left, right in path)


def _stored(path: Path) -> str:
    return ";".join(f"{left},{right}" for left, right in path)


def _read(text: str) -> Path:
    return tuple(tuple(x.split(",")) for x in text.split(";")) if text else ()


def _bucket(levels: int, fanout: int) -> Column:
    return F.floor(F.col("index") / F.lit(fanout**levels)).cast("long").alias("bucket")


def parents(nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """(tree, index, size, digest) of the bucket roots of nodes (tree, index, size, digest)."""

    def up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("index")
        size = int(ordered["size"].iloc[0])
        root, _ = collapse(ordered["digest"].tolist(), min(levels, depth(size, fanout)), fanout)
        return pd.DataFrame({"tree": [key[0]], "index": [key[1]], "size": [-(-size // fanout**levels)], "digest": [root]})

    rows = nodes.select("tree", "index", "size", "digest", _bucket(levels, fanout))
    return rows.groupBy("tree", "bucket").applyInPandas(up, "tree string, index long, size long, digest string")


def descended(nodes: DataFrame, above: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """(tree, index, root, path) of nodes, whose buckets' roots have (tree, index, root, path) in `above`."""

    def down(key: tuple, group: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("index")
        _, paths = collapse(ordered["digest"].tolist(), min(levels, depth(int(ordered["size"].iloc[0]), fanout)), fanout)
        rest = _read(top["path"].iloc[0])
        return pd.DataFrame({"tree": key[0], "index": ordered["index"], "root": top["root"].iloc[0], "path": [_stored(p + rest) for p in paths]})

    return _met(nodes, above, levels, fanout).applyInPandas(down, "tree string, index long, root string, path string")


def _met(nodes: DataFrame, above: DataFrame, levels: int, fanout: int):
    rows = nodes.withColumn("bucket", _bucket(levels, fanout))
    return rows.groupBy("tree", "bucket").cogroup(above.withColumnRenamed("index", "bucket").groupBy("tree", "bucket"))


def proven(nodes: DataFrame, above: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """Every leaf's proof, folded back to the root: (doc_id, leaf, subroot, root, proof, folded_root) of placed leaves and their buckets' (root, subroot, path)."""

    def down(key: tuple, group: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("index")
        own = ordered["digest"].tolist()
        bucket, paths = collapse(own, min(levels, depth(int(ordered["size"].iloc[0]), fanout)), fanout)
        rest = _read(top["path"].iloc[0])
        upper, memo = path_text(rest), {}

        def to_root(digest: str, path: Path) -> str:
            low = folded(digest, path)
            if low not in memo:
                memo[low] = folded(low, rest)
            return memo[low]

        out = ordered[["doc_id"]].copy()
        out["leaf"], out["subroot"], out["root"] = own, top["subroot"].iloc[0], top["root"].iloc[0]
        out["proof_sha256"] = [node(path_text(p) + upper) for p in paths]
        out["folded_root"] = [to_root(own[k] if changed is None or changed != changed else changed, p) for k, (changed, p) in enumerate(zip(ordered["tampered"].tolist(), paths))]
        return out

    ids = next(f.dataType.simpleString() for f in nodes.schema.fields if f.name == "doc_id")
    return _met(nodes, above, levels, fanout).applyInPandas(down, f"doc_id {ids}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def superblocks(nodes: DataFrame, levels: int, fanout: int) -> list[DataFrame]:
    """nodes, their bucket roots, theirs, and so on until every tree has one; each but the first written."""
    out = [nodes]
    while True:
        out.append(written(parents(out[-1], levels, fanout), "merkle-roots"))
        if (out[-1].agg(F.max("size")).first()[0] or 0) <= 1:
            return out


def manifest(docs: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document; folded_root starts from the tampered leaf where there is one."""
    held = written(leaves(docs), "merkle-leaves")
    rows = held.count()
    nodes = placed(held, ["doc_id", "leaf", "number"], max(-(-rows // ROWS_A_RANGE), min(rows // 5000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    nodes = nodes.select("tree", "index", "size", "doc_id", F.col("leaf").alias("digest"), "tampered")
    steps = superblocks(nodes, levels, fanout)
    # The trees' roots are the leaves of one tree more.
    trees = placed(steps[-1].select(F.col("tree").alias("name"), F.lit("").alias("tree"), "digest"), ["name"], 1)
    top = superblocks(trees, levels, fanout)
    above = top[-1].select("tree", "index", F.col("digest").alias("root"), F.lit("").alias("path"))
    for own in reversed(top[:-1]):
        lower = descended(own, above, levels, fanout)
        above = written(lower, "merkle-paths")
    names = trees.select("name", "index", F.col("digest").alias("subroot"))
    # From here on the trees are the languages'; each one's top node carries the path through the tree of trees.
    above = names.join(above.drop("tree"), "index").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("index"), "subroot", "root", "path")
    above = written(above, "merkle-tops")
    for own in reversed(steps[1:-1]):
        subroots = above.select("tree", "subroot").distinct()
        above = written(descended(own, above, levels, fanout).join(subroots, "tree"), "merkle-paths")
    return proven(nodes, above, levels, fanout).withColumn("verified", F.col("folded_root") == F.col("root"))
