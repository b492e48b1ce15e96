"""Benchmark decontamination: an FM-index for each shard of training text.

A task tokenises a shard of about 4 MB, replaces words that occur in no test
phrase by a separator, and builds an FM-index over the rest: a suffix order, its
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All
test phrases (10-word windows) are searched backward together through wavelet
ranks; what is left of their intervals is located by stepping to a sampled
position. The occurrences of a document are merged to removal spans.

The test phrases travel in blocks of `BLOCK_BYTES` of benchmark text, held as
arrays: the words as numbers, the starts of distinct windows and their items.
A pass over the shards takes up to `PASS_BLOCKS` blocks; a benchmark beyond that
takes more passes. Nothing is shuffled and a shard is the unit of recovery.
Separators are ordered by position, so suffixes that many copies share end at
the next unknown word.

Defined cases: null or wordless documents have no words and no hits; null or
wordless items have no windows; items of fewer than 10 words are one window;
windows that several items share count for each; rows with one item_id are one
item, a null item_id shows as an empty string; repeated document rows are
judged one by one; an empty benchmark leaves every document clean; a text beyond
the size of a shard is a shard of its own, searched whole; other columns pass
through `cleaned` unchanged, whose texts hold no window any more, those included
that cutting brought together.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, discard, slices, written

WINDOW = 10
BLOCK_BYTES, PASS_BLOCKS = 16 << 20, 4
#: So many patterns are searched at once.
PATTERNS = 1 << 16
SAMPLE = 16
#: Separators become spaces and A-Z lower case; bytes of characters beyond ASCII are parts of words.
FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def window_numbers(sequence: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of `length` from the starts, equal for equal windows: numbers of halves are paired, as binary digits of the length ask."""
    number, size, at, whole = sequence.astype(np.int64), 1, 0, np.zeros(len(starts), np.int64)
    while True:
        if length & size:
            # Windows lie inside the sequence, so starts + at does too.
            whole = np.unique(whole * (int(number.max(initial=0)) + 1) + number[starts + at], return_inverse=True)[1]
            at += size
        if (size := size * 2) > length:
            return whole
        half = size // 2
        follows = np.concatenate((number[half:], np.zeros(min(half, len(number)), np.int64)))
        number = np.unique(number * (int(number.max(initial=0)) + 1) + follows, return_inverse=True)[1]


class Phrases:
    """One block of test phrases: words as symbols 1.., and by length the starts of the distinct windows with the items that hold each."""

    def __init__(self, items: Iterator[tuple[str, list[bytes]]] | list[tuple[str, list[bytes]]]):
        self.symbols: dict[bytes, int] = {}
        names: dict[str, int] = {}
        parts, owners, first, starts = [], [], 0, defaultdict(list)
        for item, own in items:
            ids = np.fromiter((self.symbols.setdefault(w, len(self.symbols) + 1) for w in own), np.int32, len(own))
            if len(ids):
                m = min(len(ids), WINDOW)
                begin = np.arange(first, first + len(ids) - m + 1)
                starts[m].append((begin, np.full(len(begin), names.setdefault(item, len(names)), np.int32)))
                parts.append(ids)
                first += len(ids)
        self.sequence, self.items = np.concatenate(parts) if parts else np.zeros(0, np.int32), list(names)
        #: length -> (starts of distinct windows, where each one's items begin, their numbers)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m, found in sorted(starts.items()):
            begin, owner = (np.concatenate(x) for x in zip(*found))
            number = window_numbers(self.sequence, begin, m)
            pair, at = np.unique(number * len(names) + owner, return_index=True)
            number = pair // len(names)
            new = np.nonzero(np.diff(number, prepend=-1))[0]
            self.by_length[m] = begin[at[new]], np.append(new, len(pair)), (pair % len(names)).astype(np.int32)

    def patterns(self, m: int) -> Iterator[tuple[int, np.ndarray]]:
        """The distinct windows of length m, in parts: the number of the first, and one row of symbols each."""
        begin = self.by_length[m][0]
        for k in range(0, len(begin), PATTERNS):
            yield k, self.sequence[begin[k : k + PATTERNS, None] + np.arange(m)].astype(np.int64)

    def holders(self, m: int, pattern: int) -> list[str]:
        _, where, owners = self.by_length[m]
        return [self.items[k] for k in owners[where[pattern] : where[pattern + 1]]]


class WaveletMatrix:
    """rank(symbol, i): how often a symbol stands among the first i of a sequence, for arrays of both."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        n, seq = len(sequence), sequence
        for level in range(levels - 1, -1, -1):
            ones = (seq >> level) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(n - int(ones.sum()))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][i >> 6] + np.bitwise_count(self.bits[k][i >> 6] & low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(i), i
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = self._ones(k, start), self._ones(k, end)
            start, end = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, end - b)
        return end - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in ascending order; zeros are separators, each smaller than all words and than later zeros."""
    n = len(text)
    zero = text == 0
    separators = np.nonzero(zero)[0]
    order = np.concatenate((separators, np.nonzero(~zero)[0][np.argsort(text[~zero], kind="stable")]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    sorted_text = text[order]
    new = np.concatenate(([True], (sorted_text[1:] != sorted_text[:-1]) | (sorted_text[1:] == 0)))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # Only groups of suffixes that are still equal are sorted again, by what follows twice as far.
    step = 1
    starts = np.nonzero(new)[0]
    sizes = np.diff(np.concatenate((starts, [n])))
    slots = np.nonzero(np.repeat(sizes > 1, sizes))[0]
    while len(slots):
        here = order[slots]
        group, follows = rank[here], rank[np.minimum(here + step, n)]
        by = np.argsort(group * (n + 1) + follows + 1, kind="stable")
        here, group, follows = here[by], group[by], follows[by]
        order[slots] = here
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (follows[1:] != follows[:-1])))
        first = np.nonzero(new)[0]
        sizes = np.diff(np.concatenate((first, [len(slots)])))
        rank[here] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of symbols that ends in a separator (0)."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_order(text)
        before = text[order - 1]
        before[order == 0] = 0
        self.n, self.bwt = len(text), before
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        self.ranks = WaveletMatrix(before, max(1, int(n_symbols).bit_length()))
        # Positions after a separator are sampled too: no walk has to cross one.
        self.sampled = (before == 0) | (order % SAMPLE == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, lo, hi) for the patterns, all of one length, that occur: their rows are [lo, hi)."""
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            lo, hi = self.first[symbol] + self.ranks.rank(symbol, lo), self.first[symbol] + self.ranks.rank(symbol, hi)
            keep = hi > lo
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(left := np.nonzero(~self.sampled[at])[0]):
            symbol = self.bwt[at[left]]
            at[left] = self.first[symbol] + self.ranks.rank(symbol, at[left])
            steps[left] += 1
        return self.samples[self.sample_at[at]] + steps


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """For the documents of a shard, given as words: starts of their words in the shard, a hit mark per word, and the items found in each."""
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    marks, items = np.zeros(starts[-1] + 1, np.int32), [set() for _ in texts]
    known = np.concatenate([np.array(list(map(phrases.symbols.get, t, repeat(0))), np.int64) for t in texts]) if texts else np.empty(0, np.int64)
    opens = np.zeros(len(known) + 1, bool)
    opens[starts] = True
    # A run of unknown words is one separator, and so is the end of a document.
    here = np.nonzero(known)[0]
    if len(here):
        gap = np.concatenate(([False], (here[1:] != here[:-1] + 1) | opens[here[1:]]))
        at = np.arange(len(here)) + np.cumsum(gap)
        text = np.zeros(at[-1] + 2, np.int64)
        text[at] = known[here]
        place = np.zeros(len(text), np.int64)
        place[at] = here
        index = FMIndex(text, len(phrases.symbols))
        for m in phrases.by_length:
            for low, patterns in phrases.patterns(m):
                found, lo, hi = index.search(patterns)
                if not len(found):
                    continue
                sizes = hi - lo
                which = np.repeat(found, sizes)
                rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
                word = place[index.locate(rows)]
                np.add.at(marks, word, 1)
                np.add.at(marks, word + m, -1)
                doc = np.searchsorted(starts, word, "right") - 1
                for d, p in np.unique(np.stack((doc, which), axis=1), axis=0).tolist():
                    items[d].update(phrases.holders(m, low + p))
    return starts, np.cumsum(marks)[:-1] > 0, items


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of true."""
    edges = np.nonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))[0]
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark as blocks of phrases of about `most` bytes of text (or one item). Rows come one partition of the benchmark at a time."""
    rows = ((r[0] or "", bytes(r[1] or b"")) for r in benchmark.select(F.col(item_id).cast("string"), F.encode(F.col(text), "UTF-8")).toLocalIterator())
    ended = False

    def of_one_block() -> Iterator[tuple[str, list[bytes]]]:
        nonlocal ended
        size = 0
        for item, data in rows:
            yield item, words(data)
            size += len(data)
            if size >= most:
                return
        ended = True

    while not ended:
        yield Phrases(of_one_block())


def passes(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[list]:
    """Broadcast blocks of phrases, grouped as one pass takes them."""
    sent = [benchmark.sparkSession.sparkContext.broadcast(p) for p in blocks(benchmark, item_id, text, block_bytes)]
    return [sent[k : k + PASS_BLOCKS] for k in range(0, len(sent), PASS_BLOCKS)]


def search_all(texts: list[list[bytes]], shared: list) -> tuple[list[np.ndarray], list[set[str]]]:
    """Hit marks of the words and items found, of each document of a shard, over some blocks."""
    every, named = None, [set() for _ in texts]
    for block in shared:
        starts, hit, items = search_shard(texts, block.value)
        every = hit if every is None else every | hit
        for own, more in zip(named, items):
            own |= more
    return [every[a:b] for a, b in zip(starts, starts[1:])], named


def _scan(rows: DataFrame, groups: list[list]) -> DataFrame:
    """rows (row, text) with n_words, spans (merged [start, end) word numbers, flat) and items. The text goes on to a next pass only."""
    out = rows.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = out.schema

    def pass_over(shared: list, last: bool) -> Callable:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                texts = [words(t) for t in as_bytes(batch.column("text"))]
                hits, items = search_all(texts, shared)
                spans, named = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for k in [k for k, found in enumerate(items) if found]:
                    own = hits[k].copy()
                    for a, b in zip(spans[k][::2], spans[k][1::2]):
                        own[a:b] = True
                    spans[k] = [x for run in runs(own) for x in run]
                    named[k] = sorted(items[k] | set(named[k]))
                text = pa.nulls(len(texts), batch.column("text").type) if last else batch.column("text")
                columns = [batch.column("row"), text, pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_words", "spans", "items"])

        return work

    for k, shared in enumerate(groups):
        out = out.mapInArrow(pass_over(shared, k == len(groups) - 1), schema)
    return out


def _n_hit() -> Column:
    return F.aggregate(F.transform(F.col("spans"), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans): one row per document."""
    found = _scan(docs.select(F.col(doc_id).alias("row"), F.col(text).alias("text")), passes(benchmark, item_id, item_text, block_bytes))
    return found.select(
        F.col("row").alias("doc_id"), "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (_n_hit() > 0).alias("contaminated"), "spans",
    )


def without_words(text: str, spans: list[int]) -> str:
    """The text less its words in [start, end) word numbers, with what stands between them."""
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data)]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode()


def _cut(docs: DataFrame, shared: list, text: str) -> DataFrame:
    """docs without the windows of some blocks, cut until none is left; a document that loses its last word goes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            where = batch.schema.get_field_index(text)
            own = [words(t) for t in as_bytes(batch.column(where))]
            todo, made = list(range(len(own))), {}
            while todo:
                hits, _ = search_all([own[k] for k in todo], shared)
                todo = [(k, hit) for k, hit in zip(todo, hits) if hit.any()]
                for k, hit in todo:
                    made[k] = without_words(made[k] if k in made else batch.column(where)[k].as_py(), [x for run in runs(hit) for x in run])
                    own[k] = words(made[k].encode())
                todo = [k for k, _ in todo if own[k]]
            if made:
                texts = [made.get(k, x) for k, x in enumerate(batch.column(where).to_pylist())]
                batch = batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.column(where).type))
                batch = batch.filter(pa.array([k not in made or bool(own[k]) for k in range(len(own))]))
            yield batch

    return docs.mapInArrow(work, docs.schema)


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the removal spans cut out of their texts, until no window is left; a document that loses its last word goes."""
    groups = passes(benchmark, item_id, item_text, block_bytes)
    if len(groups) == 1:
        return _cut(docs, groups[0], text)
    # A cut for one group may bring together a window of another: go round until a whole round finds nothing.
    while True:
        for shared in groups:
            docs, before = written(_cut(docs, shared, text), "cut"), docs
            discard(before)
        if _scan(docs.select(F.lit(0).alias("row"), F.col(text).alias("text")), groups).where(F.size("items") > 0).isEmpty():
            return docs
