"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (3 to 6, with
word boundaries) hashed into a fixed table; a text is the mean of its words; a
two-class softmax reads it. Embeddings and softmax are trained together in
numpy on a bounded sample of labelled rows, so a misspelling or a new ending
shares the vectors of the n-grams it keeps.

With a linear output layer the score of a text is a mean of word scores, and
every word has one number. Scoring tasks keep a bounded table of them, so a
frequent word is hashed once. The corpus is neither shuffled nor gathered: the
driver receives at most `SAMPLE_ROWS` labelled texts, one of each id, as their
distinct words and counts, cut from the labels that have a document by a hash
order of ids that does not depend on partitions.

Training reads only rows outside the held-out fold. Defined cases: texts of any
length train and are scored whole; null and empty texts have no words and get the score of the bias; unlabelled rows are
scored only; a doc_id with several label rows takes the largest; repeated rows
are scored one by one, and of several texts of a doc_id the smallest trains; with no labels of either class every score is the base
rate; a null doc_id is not held out; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Reuse
from .shared import as_bytes, slices

#: Training takes so many labelled rows at most, each a whole text; so does scoring.
SAMPLE_ROWS = 6000
#: The model's size.
BUCKETS, DIM, GRAMS = 1 << 17, 6, (3, 4, 5, 6)
FOLDS = 5
FOLD_CASE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them, apart from what stands inside a word for a letter."""
    return (text or b"").translate(FOLD_CASE).split()


def grams(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of all words, and where each word's begin. Every word has at least one."""
    chars = np.frombuffer("".join(f"<{w.decode('utf-8', 'replace')}>" for w in tokens).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w.decode("utf-8", "replace")) + 2 for w in tokens])
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    at = np.arange(len(chars))
    owners, hashes = [], []
    rolled = np.zeros(len(chars), np.uint64)
    for k in range(max(GRAMS)):
        left = max(0, len(chars) - k)
        rolled[:left] = rolled[:left] * np.uint64(0x100000001B3) + chars[k:] + np.uint64(k + 1)
        if k + 1 in GRAMS:
            whole = at + k < ends
            owners.append(owner[whole])
            mixed = (rolled[whole] ^ (rolled[whole] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            hashes.append((mixed >> np.uint64(64 - 17)).astype(np.int64) % BUCKETS)
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return found[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(tokens)))))


def grams_by_parts(tokens: list[bytes], most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """grams() of many words, a part at a time: only the bucket numbers of all of them are held, as 32-bit numbers."""
    found, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for k in range(0, len(tokens), most):
        ids, starts = grams(tokens[k : k + most])
        found.append(ids.astype(np.int32))
        sizes.append(np.diff(starts))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


@dataclass
class Model:
    gram_scores: np.ndarray
    bias: float

    def word_scores(self, tokens: list[bytes]) -> np.ndarray:
        ids, starts = grams(tokens)
        sums = np.concatenate(([0.0], np.cumsum(self.gram_scores[ids], dtype=np.float64)))
        return (sums[starts[1:]] - sums[starts[:-1]]) / np.diff(starts)


@dataclass
class Sample:
    """Labelled texts as counts of words: text k has the words ids[starts[k] : starts[k + 1]] of the vocabulary."""

    doc_ids: list[int]
    labels: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    vocabulary: list[bytes]


def fit(sample: Sample, steps: int = 700, batch: int = 64, rate: float = 0.05) -> Model:
    """Joint training of n-gram embeddings and softmax by Adagrad on shuffled batches of texts."""
    y = sample.labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        base = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(base / (1 - base))))
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM
    weights, bias = rng.uniform(-0.5, 0.5, DIM), 0.0
    seen_v, seen_w, seen_b = np.full(BUCKETS, 1e-8), np.full(DIM, 1e-8), 1e-8
    bags = [(sample.ids[a:b], sample.counts[a:b] / max(1, sample.counts[a:b].sum())) for a, b in zip(sample.starts, sample.starts[1:])]
    ids, starts = grams_by_parts(sample.vocabulary)
    for _ in range(-(-steps * batch // len(y))):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            doc = np.repeat(np.arange(len(part)), [len(bags[k][0]) for k in part])
            word, share = (np.concatenate([bags[k][j] for k in part]) for j in (0, 1))
            distinct, inverse = np.unique(word, return_inverse=True)
            sizes = starts[distinct + 1] - starts[distinct]
            flat = ids[np.repeat(starts[distinct] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            owner = np.repeat(np.arange(len(distinct)), sizes)
            sums = np.stack([np.bincount(owner, vectors[flat, d], len(distinct)) for d in range(DIM)], 1) / np.maximum(sizes, 1)[:, None]
            hidden = np.stack([np.bincount(doc, share * sums[inverse, d], len(part)) for d in range(DIM)], 1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ weights * SCALE + bias, -40, 40)))
            g = p - y[part]
            # Back through the averages; gradients of a bucket add up.
            per_word = np.bincount(inverse, share * g[doc], len(distinct)) / np.maximum(sizes, 1)
            per_gram = np.bincount(flat, per_word[owner], BUCKETS)
            touched = np.nonzero(per_gram)[0]
            down = per_gram[touched, None] * (weights * SCALE)[None, :]
            seen_v[touched] += (down**2).mean(1)
            vectors[touched] -= rate * down / np.sqrt(seen_v[touched])[:, None]
            dw, db = g @ hidden * SCALE, g.sum()
            seen_w += dw**2
            seen_b += db**2
            weights -= rate * dw / np.sqrt(seen_w)
            bias -= rate * db / np.sqrt(seen_b)
    return Model((vectors @ weights * SCALE).astype(np.float32), float(bias))


#: Logits of a mean of many words are small; this factor takes the place of a long training.
SCALE = 20.0


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, y, text) of at most `most` labelled rows outside the held-out fold, one of each id, half of them of each class where there are enough: the first in a hash order of ids."""
    marked = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
        .where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS != 0)
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Ids are made distinct within partitions before they are shuffled, so a repeated id is no hot key.
    usable = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for y in (0, 1):
        some = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    # The broadcast side is at most `most` rows of two numbers.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def bagged(sample: DataFrame) -> Sample:
    """The sample by doc_id. Tasks count, so a long text reaches the driver as its vocabulary, in Arrow columns, where each word is held once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counted = [Counter(words(t)) for t in as_bytes(batch.column("text"))]
            columns = [pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *columns], ["doc_id", "y", "words", "counts"])

    rows = sample.mapInArrow(work, "doc_id long, y int, words array<binary>, counts array<int>").toArrow()
    rows = rows.take(pc.sort_indices(rows.column("doc_id")))
    sizes = pc.list_value_length(rows.column("words")).to_numpy()
    own = pc.list_flatten(rows.column("words")).combine_chunks().dictionary_encode()
    return Sample(
        rows.column("doc_id").to_pylist(), rows.column("y").to_numpy(), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
        own.indices.to_numpy().astype(np.int32), pc.list_flatten(rows.column("counts")).to_numpy(), own.dictionary.to_pylist(),
    )


def train(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    return fit(bagged(training_sample(docs, labels, **columns)))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = Reuse(64 << 20), shared.value
        for batch in slices(batches, "text"):
            logits = []
            for t in as_bytes(batch.column("text")):
                tokens = words(t)
                found = list(map(table.young.get, tokens))
                if None in found:
                    made = {w: table.old.get(w) for w, x in zip(tokens, found) if x is None}
                    new = [w for w, x in made.items() if x is None]
                    if new:
                        made.update(zip(new, own.word_scores(new).tolist()))
                    for w, x in made.items():
                        table.put(w, x, 160)
                    found = [made[w] if x is None else x for w, x in zip(tokens, found)]
                logits.append(sum(found) / max(1, len(found)) + own.bias)
            score = 1 / (1 + np.exp(-np.clip(np.array(logits), -40, 40)))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(d) for d in ids.to_pylist()]), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
