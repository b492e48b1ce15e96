"""The embedding indexer: only chunks whose vector is missing or out of date are embedded.

A vector is known by the hash of the model's identity and its chunk
(`<config_hash>_<chunk_id>`), and carries the hash of the text that it was made
from. So a run is a join of keys and hashes; texts are read only of the chunks
that are embedded, and running again, or replaying a batch, changes nothing.

Stored vectors have STORED's columns. Vectors of other configurations stay;
vectors of this one whose chunk is gone are removed where the run sees all chunks.

Defined cases: chunks without an id are left out; repeated chunk ids count once,
by the least text hash; a null embedding is a `missing_embedding` warning, one of
another length a `dimension_mismatch`, and the stored vector of such a chunk is
removed, since it no longer fits the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

KEYS = ("doc_id", "tenant", "namespace", "text_hash")
STORED = ("vector_id", "chunk_id", *KEYS, "config_hash", "dimensions", "embedding")


@dataclass(frozen=True)
class Indexed:
    """`vectors`: the table after the run; `made`: vectors of this run; `warnings`: (chunk_id, code)."""

    vectors: DataFrame
    made: DataFrame
    warnings: DataFrame


def one_each(chunks: DataFrame) -> DataFrame:
    """chunk_id and the compared columns, one row for each chunk."""
    return chunks.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min_by(F.struct(*KEYS), "text_hash").alias("k")).select("chunk_id", "k.*")


def compared(chunks: DataFrame, vectors: DataFrame, config_hash: str) -> DataFrame:
    """(chunk_id, state) of all chunks and all vectors of this configuration: missing, stale, fresh or gone."""
    now = one_each(chunks).select("chunk_id", F.struct(*KEYS).alias("now"))
    held = vectors.where(F.col("config_hash") == config_hash).groupBy("chunk_id").agg(F.min(F.struct(*KEYS)).alias("held"))
    same = F.lit(True)
    for c in KEYS:
        same = same & F.col(f"now.{c}").eqNullSafe(F.col(f"held.{c}"))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("now").isNull(), "gone").when(same, "fresh").otherwise("stale")
    return now.join(held, "chunk_id", "full").select("chunk_id", state.alias("state"))


def indexed(chunks: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame], config_hash: str, dimensions: int, whole: bool = True) -> Indexed:
    """A run over chunks (chunk_id, KEYS, text). `embed` adds the column embedding to rows with a text. whole: chunks are all there are, so that vectors of others go."""
    states = staged(compared(chunks, vectors, config_hash), "embedding-states")
    wanted = states.where(F.col("state").isin("missing", "stale")).select("chunk_id")
    # Of a repeated chunk id the row with the least text hash; only rows that are embedded are gathered.
    todo = chunks.join(wanted, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min_by(F.struct(*KEYS, "text"), "text_hash").alias("k")).select("chunk_id", "k.*")
    made = staged(embed(todo), "embedding-made")
    code = F.when(F.col("embedding").isNull(), "missing_embedding").when(F.size("embedding") != dimensions, "dimension_mismatch")
    judged = made.withColumn("code", code)
    good = judged.where("code is null").select(F.concat_ws("_", F.lit(config_hash), "chunk_id").alias("vector_id"), "chunk_id", *KEYS, F.lit(config_hash).alias("config_hash"), F.lit(dimensions).alias("dimensions"), "embedding")
    outdated = states.where(F.col("state").isin("stale", *(["gone"] if whole else []))).select("chunk_id", F.lit(config_hash).alias("config_hash"))
    kept = vectors.select(*STORED).join(outdated, ["chunk_id", "config_hash"], "left_anti").select(*STORED)
    return Indexed(kept.unionByName(good), good, judged.where("code is not null").select("chunk_id", "code"))


def index_each_batch(load: Callable[[], DataFrame], save: Callable[[DataFrame], None], embed: Callable[[DataFrame], DataFrame], config_hash: str, dimensions: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that brings the vectors of a batch's chunks up to date; a replayed batch finds them fresh."""

    def apply(batch: DataFrame, _: int) -> None:
        save(staged(indexed(batch, load(), embed, config_hash, dimensions, whole=False).vectors, "embedding-table"))

    return apply
