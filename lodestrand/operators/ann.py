"""Approximate nearest neighbours by an inverted file.

Centroids are fitted in one task on a bounded sample (`SAMPLE` vectors, chosen by
a hash of their ids); they are `cells` times the dimensions, and the only thing
that travels through the driver. Every vector is then put into the cell of its
nearest centroid, and cells are written in parts of at most about `PART` vectors.
A query goes to the `probes` cells whose centroids are nearest to it and meets
each of their parts, in blocks of about `PART` queries; scores there are exact
cosines. A cell that holds a third of all vectors, or is asked by a third of all
queries, is so many parts and blocks, each a group of its own. What leaves a group
is the k best for each query in it.

Defined cases: null ids, null vectors and vectors with a null or of another
length than `dimensions` are left out on either side; zero vectors have a cosine
of 0 with all; an empty side gives no rows; repeated ids are separate vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .retrieval import ranked

SAMPLE, PART, ROUNDS = 50_000, 4096, 8


@dataclass(frozen=True)
class CellIndex:
    """`cells`: (cell, part, vec_id, v), v of unit length; `sizes`: (cell, parts)."""

    centroids: np.ndarray
    cells: DataFrame
    sizes: DataFrame


def usable(vectors: DataFrame, dimensions: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that can be compared, at unit length."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    whole = rows.where(F.col("vec_id").isNotNull() & (F.size("v") == dimensions) & ~F.exists("v", lambda x: x.isNull()))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("_n", length).select("vec_id", F.when(F.col("_n") > 0, F.transform("v", lambda x: x / F.col("_n"))).otherwise(F.col("v")).alias("v"))


def matrix_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fitted(points: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: centroids of unit length. A cell that runs empty takes the point that fits its own centroid least."""
    cells = min(cells, len(points))
    centroids = points[np.linspace(0, len(points) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest, best = nearest_cells(points, centroids, 1)
        nearest, best = nearest[:, 0], best[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        empty = np.flatnonzero(np.bincount(nearest, minlength=cells) == 0)
        sums[empty] = points[np.argsort(best, kind="stable")[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centroids


def nearest_cells(points: np.ndarray, centroids: np.ndarray, probes: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The probes nearest centroids of each point and their cosines, in blocks of points."""
    found, scores = [], []
    for at in range(0, len(points), block):
        s = points[at : at + block] @ centroids.T
        take = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        found.append(take)
        scores.append(np.take_along_axis(s, take, 1))
    return (np.concatenate(found), np.concatenate(scores)) if found else (np.zeros((0, probes), int), np.zeros((0, probes)))


def centroids_of(points: DataFrame, dimensions: int, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids fitted in one task on at most about `sample` points."""
    n = points.count()
    share = min(1.0, sample / max(1, n))
    chosen = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(i, v) for f in frames for i, v in zip(f["vec_id"], f["v"])]
        if rows:
            rows.sort(key=lambda r: (r[0], *r[1]))
            yield pd.DataFrame({"v": list(fitted(np.array([v for _, v in rows], np.float64), cells))})

    made = chosen.repartition(1).mapInPandas(fit, "v array<double>").collect()
    return np.array([r.v for r in made], np.float64).reshape(len(made), dimensions)


def celled(points: DataFrame, centroids: np.ndarray, probes: int, key: str) -> DataFrame:
    """(cell, key, v) for each of a point's nearest cells."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, _ = nearest_cells(matrix_of(batch.column(1)), shared.value, probes)
                take = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["cell", key, "v"])

    return points.mapInArrow(work, f"cell int, {key} long, v array<double>")


def indexed(vectors: DataFrame, dimensions: int, cells: int = 256, part: int = PART, vec_id: str = "vec_id", embedding: str = "embedding") -> CellIndex:
    """Put every vector into its cell and write the cells."""
    points = usable(vectors, dimensions, vec_id, embedding)
    centroids = centroids_of(points, dimensions, cells)
    rows = staged(celled(points, centroids, 1, "vec_id") if len(centroids) else points.limit(0).select(F.lit(0).alias("cell"), "vec_id", "v"), "ann-cells")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    return CellIndex(centroids, rows, sizes)


def searched(index: CellIndex, queries: DataFrame, dimensions: int, k: int = 10, probes: int = 8, part: int = PART, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of each query (vec_id, embedding) among the cells that it probes."""
    if not len(index.centroids):
        return index.cells.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    asked = celled(usable(queries, dimensions, vec_id, embedding), index.centroids, probes, "query_id")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("blocks"))
    # A row for each cell; cells are a parameter.
    plan = F.broadcast(index.sizes.join(blocks, "cell"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = index.cells.join(plan, "cell").withColumn("part", dealt("vec_id", "parts")).select("cell", "part", each("blocks").alias("block"), "vec_id", "v")
    ask = asked.join(plan, "cell").withColumn("block", dealt("query_id", "blocks")).select("cell", each("parts").alias("part"), "block", "query_id", "v")

    def meet(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not vectors.num_rows or not wanted.num_rows:
            return kind.empty_table()
        ids, x = vectors.column("vec_id").to_numpy(), matrix_of(vectors.column("v").combine_chunks())
        out = []
        for at in range(0, wanted.num_rows, 512):
            some = wanted.slice(at, 512)
            scores = np.floor(matrix_of(some.column("v").combine_chunks()) @ x.T * 1e6 + 0.5) / 1e6
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
            out.append(pa.table([np.repeat(some.column("query_id").to_numpy(), order.shape[1]), ids[order].ravel(), np.take_along_axis(scores, order, 1).ravel()], schema=kind))
        return pa.concat_tables(out)

    group = ("cell", "part", "block")
    found = own.groupBy(*group).cogroup(ask.groupBy(*group)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return ranked(found, k, order=("vec_id",))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, recall): the mean share of the exact neighbours that were found."""
    hit = found.select("query_id", "vec_id").distinct().withColumn("_hit", F.lit(1))
    each = exact.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("_r"))
    return each.agg(F.count("*").alias("n_queries"), F.avg("_r").alias("recall"))
