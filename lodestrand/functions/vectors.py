"""Vector expressions and the hashed-token embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9][a-z0-9_-]*")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a side is all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def max_sim(query: Column, patches: Column) -> Column:
    """Late interaction: mean over query vectors of their best cosine with any patch."""
    best = F.transform(query, lambda q: F.array_max(F.transform(patches, lambda p: cosine(q, p))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(query), F.lit(1))


@lru_cache(maxsize=200_000)
def slot_of(token: str, dimensions: int) -> tuple[int, int]:
    """Dimension and sign of a token, from its SHA-256."""
    digest = hashlib.sha256(token.encode()).hexdigest()
    return int(digest[:8], 16) % dimensions, 1 if int(digest[8:10], 16) % 2 == 0 else -1


def hashed_counts(text: str | None, dimensions: int = 64) -> np.ndarray:
    """Signed token counts of a text; the embedding is this over its length."""
    out = np.zeros(dimensions)
    tokens = TOKEN.findall((text or "").lower())
    for token in tokens or [hashlib.sha256((text or "").encode()).hexdigest()[:16]]:
        at, sign = slot_of(token, dimensions)
        out[at] += sign
    return out


def unit(v: np.ndarray) -> np.ndarray:
    size = float(np.sqrt((v * v).sum()))
    return v / size if size else v


def hashed_embedding(rows: DataFrame, text: str = "text", dimensions: int = 64) -> DataFrame:
    """rows with column embedding; a map over Arrow batches, without a shuffle."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [unit(hashed_counts(t, dimensions)).tolist() for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names, "embedding"])

    return rows.mapInArrow(work, f"{fields}, embedding array<double>")


#: The fields of an embedding's identity, in order; the last four matter for the index only.
IDENTITY = ["provider", "modelName", "dimensions", "adapterId", "configId", "preprocessingVersion", "chunkingPolicyId", "chunkingPolicyVersion", "chunkerVersion"]


def identity_hash(fields: dict[str, Column], whole_index: bool = False) -> Column:
    """SHA-256 of the JSON of an embedding's identity; null fields are left out, and so are those of the index unless asked for."""
    names = IDENTITY if whole_index else IDENTITY[:5]
    return F.sha2(F.encode(F.to_json(F.struct(*[fields[n].alias(n) for n in names if n in fields])), "UTF-8"), 256)
