"""Token ids in training order: fixed-stride shards under a keyed permutation.

Every document is cut into sequences of `length` ids, the last one padded. A
sequence is numbered by a hash of its document's id and text and of its part, so
the order does not hang on how files or tasks hold the rows. A keyed Feistel
network, walked in cycles until it lands below n_shards * 2**place_bits, takes
that number to the sequence's place in training order. The high part of a place
is its shard: places are dealt to ranges by arithmetic, without a sample, and
one task writes the whole of a shard, or of several next to each other
(`shards_a_task`), in order, one file of records of fixed stride (`record_type`)
for each. The slot of a sequence is its rank among all
places. The length of a shard's file says how many records it holds, so a reader
finds any slot with one table of lengths and a multiplication, reads on from
there in sequence, and can resume anywhere (`resumed`).

Texts are tokenised a run of rows at a time: cut where a space precedes anything
but white space, where tokens never cross, so that each distinct word of the run
reaches the tokenizer once. With a pattern for which `words_start_at_space` finds
that untrue, texts are encoded whole. Texts are tokenised once and sequences shuffled once, unpadded, whatever keys or
copies the documents hold; nothing else is written, and the driver receives a
total of bytes and a length for each shard. A lost executor costs its tasks.

Records end in a line feed, since Spark's text writer ends them so; readers skip
it with the stride. Shards hold about `per_shard` sequences each, which must stay
under 2 GB for `records`, which reads them whole; others can seek.

Defined cases: null and empty texts are one sequence, an end mark and padding;
rows with equal or null ids keep all their sequences; equal rows have equal
numbers and stand side by side; a text of any length is tokenised whole, its
sequences spread over all shards; an empty table gives no sequences and no
shards; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices

LENGTH, PER_SHARD, KEY, ROUNDS = 512, 4096, 0x5EED, 4
#: Places of a shard, as a power of two: far more than sequences, so that two seldom share one. Shards and places together stay below 2**61 (`place_bits`).
PLACE_BITS = 40
#: Bytes of records that a task writes, about, once there are more than TASKS of its size.
TASK_BYTES, TASKS = 256 << 20, 200
#: Bytes of text that one token takes, about; it sets the number of shards and nothing else.
BYTES_PER_TOKEN = 3
#: Bytes of text, about, whose distinct words are encoded together.
RUN_BYTES = 8 << 20
SPACE = 0x20
#: Bytes that can start a character other than white space, and none that is (all white space beyond ASCII starts with one of the four).
WORD_BYTES = np.array([b > SPACE and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def feistel(index: Column, half_bits: int, key: int = KEY) -> Column:
    """A permutation of 0 .. 2**(2 * half_bits) - 1, from built-in functions."""
    mask = (1 << half_bits) - 1
    left, right = F.shiftright(index, half_bits), index.bitwiseAND(F.lit(mask))
    for k in range(ROUNDS):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(key + k)).bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, half_bits).bitwiseOR(right)


def slots(sequences: DataFrame, n: int, index: str = "index", key: int = KEY) -> DataFrame:
    """sequences with column slot, a permutation of 0 .. n - 1: the Feistel image, walked on while it is n or more."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    out = sequences.withColumn("slot", feistel(F.col(index).cast("long"), half, key))
    # The domain is below 4n (8 at least), so a walk that is still outside after 400 steps has a chance under 1e-49; it fails.
    step = lambda s: F.when(s["v"] >= n, F.struct(feistel(s["v"], half, key).alias("v"))).otherwise(s)
    walked = F.aggregate(F.when(F.col("slot") >= n, F.sequence(F.lit(1), F.lit(400))).otherwise(F.array().cast("array<int>")), F.struct(F.col("slot").alias("v")), lambda s, _: step(s), lambda s: s["v"])
    return out.withColumn("slot", walked).withColumn("slot", F.when(F.col("slot") < n, F.col("slot")).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long")))


class Coder:
    """Byte-level BPE of whole runs of texts: each distinct word of a run is encoded once, all new words in one call."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.local = self.words_start_at_space()

    def ids_of(self, text: bytes) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text.decode()), "<u2")

    def words_start_at_space(self) -> bool:
        """Whether a space before a character other than white space starts a token, whatever stands before it."""
        lefts = ["It's", "don't", "a1b2", "...", "x,y", "É", "42%", "a ", "b \n", "\n\n", "\t", "  ", "ß\r\n", "\u00a0", "\u3000 ", "'"]
        rights = [" It's", " 's", " 1", " ...", " ,x", " É", " %\n", " a ", " ß\t", " 'll", " _"]
        alone = {x: self.coder.encode_ordinary(x) for x in lefts + rights}
        return all(self.coder.encode_ordinary(a + b) == alone[a] + alone[b] for a in lefts + rights for b in rights)

    def word_bounds(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words start: at a space before a character other than white space, and where a text starts; then the end of the data."""
        at = np.zeros(len(data), bool)
        if self.local and len(data):
            at[:-1] = (data[:-1] == SPACE) & WORD_BYTES[data[1:]]
            at[starts[starts > 0] - 1] = False  # the space that ends a text says nothing about the next one
        at[starts[starts < len(data)]] = True
        return np.append(np.flatnonzero(at), len(data))

    def encoded_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct words, and at which place of them each word's are."""
        offsets, data = parts_of(words)
        first, second = offsets[:-1], np.minimum(offsets[:-1] + 1, len(data) - 1)
        # Words that start with a space follow one another as they would in a text; those that start a text stand alone.
        joins = (data[first] == SPACE) & WORD_BYTES[data[second]] & (np.diff(offsets) > 1) & self.local
        bounds, joined = parts_of(words.filter(pa.array(joins)))
        ids = self.ids_of(joined.tobytes())
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), bounds, side="right")
        single = [self.ids_of(w) for w in words.filter(pa.array(~joins)).to_pylist()]
        ends = np.append(ends, ends[-1] + np.cumsum([len(x) for x in single], dtype=np.int64))
        return binaries(2 * ends, np.concatenate([ids, *single])), np.where(joins, np.cumsum(joins) - 1, np.cumsum(~joins) - 1 + joins.sum())

    def encode_many(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, pa.Array]:
        """Numbers of ids and ids of each whole text, an end mark last; null is taken as empty."""
        offsets, data = parts_of(pc.fill_null(texts, "").cast(pa.large_binary()))
        bounds = self.word_bounds(data, offsets[:-1])
        words = binaries(bounds, data).dictionary_encode()
        known, place = self.encoded_words(words.dictionary)
        at, ids = parts_of(known.take(pa.array(place[words.indices.to_numpy()])))
        ends = at[np.searchsorted(bounds, offsets[1:])] // 2
        n = np.diff(ends, prepend=0) + 1
        return n, binaries(2 * np.append(0, np.cumsum(n)), np.insert(ids.view("<u2"), ends, end_id)).cast(pa.binary())


def parts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0 on, and bytes of a column of large binaries without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets - offsets[0], np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


CODERS: dict[tuple[str, str], Coder] = {}


def coder_of(ranks_path: str, pattern: str) -> Coder:
    """The coder of this worker process, whose tasks share it."""
    if (ranks_path, pattern) not in CODERS:
        CODERS.clear()
        CODERS[ranks_path, pattern] = Coder(ranks_path, pattern)
    return CODERS[ranks_path, pattern]


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(number, doc_id, n_tokens, ids): byte-level BPE ids as little-endian unsigned 16-bit integers, an end mark last; number is a hash of id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks_path, pattern)
        for batch in slices(batches, "text", RUN_BYTES):
            n, ids = coder.encode_many(batch.column("text"), end_id)
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("doc_id"), pa.array(n, pa.int64()), ids], ["number", "doc_id", "n_tokens", "ids"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    source = own.select(F.xxhash64("doc_id", "text").alias("number"), "doc_id", "text")
    return source.mapInArrow(work, "number long, doc_id long, n_tokens long, ids binary")


def shards_for(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, text: str = "text") -> int:
    """How many shards of about per_shard sequences the texts fill."""
    row = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("rows")).first()
    return max(1, round(((row.bytes or 0) / BYTES_PER_TOKEN / length + row.rows / 2) / per_shard))


def place_bits(shards: int) -> int:
    """The power of two of a shard's places: PLACE_BITS up to two million shards, fewer beyond, so that a place is a positive long."""
    bits = min(PLACE_BITS, 61 - max(1, shards - 1).bit_length())
    if bits < 24:
        raise ValueError("too many shards: raise per_shard")
    return bits


def in_training_order(sequences: DataFrame, shards: int, key: int = KEY) -> DataFrame:
    """sequences (number, part, ...) with shard and place instead of number."""
    bits = place_bits(shards)
    rest = [c for c in sequences.columns if c != "number"]
    numbered = sequences.select(F.pmod(F.xxhash64("number", "part"), F.lit(shards << bits)).alias("index"), *rest)
    return slots(numbered, shards << bits, key=key).select(F.shiftright("slot", bits).cast("int").alias("shard"), F.col("slot").alias("place"), *rest)


def shards_a_task(shards: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> int:
    """How many neighbouring shards a task writes: one while there are few, then as many as make TASK_BYTES."""
    return max(1, min(shards // TASKS, TASK_BYTES // (per_shard * record_type(length).itemsize)))


def placed(docs: DataFrame, ranks_path: str, pattern: str, shards: int, end_id: int = 50256, length: int = LENGTH, key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, place, doc_id, part, n_tokens, ids) of every sequence, not padded; places ascend in training order."""
    tokens = tokenised(docs, ranks_path, pattern, end_id, doc_id, text)
    parts = tokens.select("number", "doc_id", "n_tokens", "ids", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / length) - 1).cast("int"))).alias("part"))
    cut = parts.select(
        "number", "doc_id", "part", F.least(F.lit(length), F.col("n_tokens") - F.col("part") * length).cast("int").alias("n_tokens"),
        F.substring("ids", F.col("part") * (2 * length) + 1, F.lit(2 * length)).alias("ids"),
    )
    return in_training_order(cut, shards, key)


def record_type(length: int = LENGTH) -> np.dtype:
    """A record of a shard as numpy reads it; `has_id` is 0 where doc_id is null."""
    return np.dtype([("doc_id", ">i8"), ("part", ">i4"), ("n_tokens", ">u2"), ("has_id", "u1"), ("ids", "<u2", length), ("end", "u1")])


def written_shards(sequences: DataFrame, path: str, shards: int, end_id: int = 50256, length: int = LENGTH, per_task: int = 1) -> None:
    """Write one file of fixed-stride records for each shard, under path/shard=k; per_task shards, next to each other, share a task."""
    number = lambda c, size: F.unhex(F.lpad(F.hex(c), 2 * size, "0"))
    pad = F.unhex(F.lit(np.array([end_id], "<u2").tobytes().hex() * length))
    record = F.concat(
        number(F.coalesce("doc_id", F.lit(0).cast("long")), 8), number(F.col("part"), 4), number(F.col("n_tokens"), 2), number(F.col("doc_id").isNotNull().cast("int"), 1),
        "ids", F.substring(pad, F.lit(1), F.lit(2 * length) - F.octet_length("ids")),
    )
    dealt = sequences.repartitionById(-(-shards // per_task), F.floor(F.col("shard") / per_task).cast("int"))
    ordered = dealt.sortWithinPartitions("shard", "place", "doc_id", "part", "ids")
    # Bytes pass through a string column untouched.
    ordered.select("shard", record.cast("string").alias("value")).write.partitionBy("shard").text(path)


def manifest(spark: SparkSession, path: str, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(shard, first slot, sequences) of every shard that has any, from the lengths of the files; the contents are not read."""
    files = spark.read.format("binaryFile").schema(FILES).load(path).select("shard", "length").orderBy("shard").collect() if holds_files(spark, path) else []
    out, first = [], 0
    for r in files:
        n = r.length // record_type(length).itemsize
        out.append((r.shard, first, n))
        first += n
    return out


FILES = "path string, modificationTime timestamp, length long, content binary, shard int"


def holds_files(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any("shard=" in f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))


def records(spark: SparkSession, path: str, length: int = LENGTH, from_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, part, n_tokens, ids) of the sequences from a slot on, read from the shards; shards before it are not opened."""
    stride, ids_at = record_type(length).itemsize, record_type(length).fields["ids"][1]
    starts = [x for x in manifest(spark, path, length) if x[1] + x[2] > from_slot]
    if not starts:
        return spark.createDataFrame([], "slot long, shard int, byte_offset long, doc_id long, part int, n_tokens int, ids binary")
    # One row for each shard.
    firsts = F.broadcast(spark.createDataFrame(starts, "shard int, first long, n int"))
    files = spark.read.format("binaryFile").schema(FILES).load(path).where(F.col("shard") >= starts[0][0]).select("shard", "content")
    at = files.join(firsts, "shard").select("shard", "first", "content", F.explode(F.sequence(F.greatest(F.lit(from_slot) - F.col("first"), F.lit(0)), F.col("n").cast("long") - 1)).alias("k"))
    rows = at.select("shard", (F.col("first") + F.col("k")).alias("slot"), (F.col("k") * stride).alias("byte_offset"), F.substring("content", (F.col("k") * stride + 1).cast("int"), F.lit(stride)).alias("r"))
    value = lambda start, size: F.conv(F.hex(F.substring("r", start + 1, size)), 16, -10).cast("long")
    return rows.select(
        "slot", "shard", "byte_offset", F.when(value(14, 1) == 1, value(0, 8)).alias("doc_id"), value(8, 4).cast("int").alias("part"), value(12, 2).cast("int").alias("n_tokens"),
        F.substring("r", ids_at + 1, 2 * length).alias("ids"),
    )


def materialised(docs: DataFrame, path: str, ranks_path: str, pattern: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards of docs under path, then give their records back."""
    shards = shards_for(docs, length, per_shard, text)
    written_shards(placed(docs, ranks_path, pattern, shards, length=length, key=key, doc_id=doc_id, text=text), path, shards, length=length, per_task=shards_a_task(shards, length, per_shard))
    return records(docs.sparkSession, path, length)


def resumed(spark: SparkSession, path: str, from_slot: int, length: int = LENGTH) -> DataFrame:
    """Sequences from a slot on, in order."""
    return records(spark, path, length, from_slot).orderBy("slot")
