"""Periodic runs of words, found by the runs theorem.

A run is a maximal stretch of words that repeats its first `period` words at
least `min_exponent` times and is at least `min_length` words long. Every run
holds, in one of the two orders of its words, a Lyndon root that is the longest
Lyndon word at the place where it begins. So a text has at most two roots to try
at each word:

- suffixes are ranked by prefix doubling, all texts of an Arrow slice at once,
  each text with an end mark that is smaller than its words;
- the longest Lyndon word at i ends where the next smaller rank stands; in the
  reversed order, where the next greater rank stands. The reversed order turns
  the order of all suffixes about, end mark included, so one ranking serves both;
- a root of length p extends to the right by the common prefix of i and i + p,
  and to the left by that of the reversed text: range minima of LCP arrays, from
  a sparse table over blocks.

The leftmost root of a run of this size is followed by at least `least_match`
words that the next p-shifted words equal, so texts whose windows of that many
words (rounded down to a power of two) are all distinct hold no run and stop
after the first rounds of the ranking; the filter loses nothing.

A text is one row, and rows are independent: no shuffle, whatever sources or
copies they belong to, and a lost executor costs its tasks. Slices are about 4 MB
of text; memory is linear in a slice or in a longer text alone (about 300 bytes a
word at the peak), time O(n log n).

Defined cases: a null or empty text has no words, no run and an empty collapsed
text; a null doc_id is kept; equal rows have equal results; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, slices

MIN_LENGTH, MIN_EXPONENT = 24, 3
BLOCK = 32


def least_match(min_length: int, min_exponent: int) -> int:
    """The least common prefix of i and i + p at the leftmost root of a run: max(min_length, min_exponent * p) - 2p + 1 over all p."""
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    return min(max(min_length, min_exponent * p) - 2 * p + 1 for p in range(1, max(2, min_length)))


def suffix_ranks(symbols: np.ndarray, seen: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every suffix, and classes of positions whose first `seen` symbols are equal (seen: a power of two).

    Every text ends in a symbol that occurs once, so compared windows never pass its end.
    """
    n = len(symbols)
    left = np.argsort(symbols)
    key = symbols[left]
    rank, early, width = np.zeros(n, np.int64), None, 0
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        own = rank[left]
        group = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        base = np.repeat(group, np.diff(np.append(group, len(own))))
        rank[left] = own + np.repeat(first, size) - base
        left = left[np.repeat(size > 1, size)]
        width = width * 2 or 1
        if width == seen:
            early = rank.copy()
        if not len(left):
            return rank, rank if early is None else early
        key = rank[left] * n + rank[left + width]
        order = np.argsort(key)
        left, key = left[order], key[order]


def next_beyond(ranks: list[int], greater: bool) -> list[int]:
    """For each place the next one with a smaller (greater) rank; len(ranks) where there is none."""
    n = len(ranks)
    after = [n] * n
    values = [*ranks, 1 << 62 if greater else -1]
    for i in range(n - 2, -1, -1):
        j, v = i + 1, values[i]
        if greater:
            while values[j] < v:
                j = after[j]
        else:
            while values[j] > v:
                j = after[j]
        after[i] = j
    return after


class Least:
    """Minima of ranges: minima within blocks from either side, and a sparse table over the blocks."""

    def __init__(self, values: np.ndarray):
        self.values = np.append(values, np.full(-len(values) % BLOCK, np.iinfo(np.int32).max, np.int32)).astype(np.int32)
        grid = self.values.reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while 2 ** len(self.table) <= len(grid):
            half, last = 2 ** (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of values[low .. high], both included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.behind[low], self.ahead[high])
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            x, y = a[wide] + 1, b[wide]
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = wide[level == k]
                row = self.table[k]
                out[at] = np.minimum(out[at], np.minimum(row[a[at] + 1], row[b[at] - 2**k]))
        near = np.flatnonzero(a == b)
        if len(near):
            x, y = low[near], high[near]
            best = self.values[x]
            for _ in range(BLOCK - 1):
                x = np.minimum(x + 1, y)
                best = np.minimum(best, self.values[x])
            out[near] = best
        return out


class Prefixes:
    """Longest common prefixes of any two suffixes: an LCP array under range minima."""

    def __init__(self, symbols: np.ndarray):
        self.rank, _ = suffix_ranks(symbols, 1)
        n = len(symbols)
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        before = np.concatenate(([-1], order[:-1]))[self.rank].tolist()
        s, found, k = symbols.tolist(), [0] * n, 0
        for i, j in enumerate(before):
            if j < 0:
                k = 0
                continue
            while s[i + k] == s[j + k]:
                k += 1
            found[i] = k
            if k:
                k -= 1
        lcp = np.empty(n, np.int32)
        lcp[self.rank] = found
        self.least = Least(lcp)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least.over(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def together(texts: list[np.ndarray], codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of word codes one after another, each in symbols of its own with an end mark that is the least of them, and where they begin."""
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    out = np.empty(starts[-1], np.int64)
    for k, t in enumerate(texts):
        out[starts[k] : starts[k + 1] - 1] = t + (k * (codes + 1) + 1)
        out[starts[k + 1] - 1] = k * (codes + 1)
    return out, starts


def runs_of(texts: list[np.ndarray], codes: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text of word codes below `codes`, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    seen = 1 << least_match(min_length, min_exponent).bit_length() - 1
    symbols, starts = together(texts, codes)
    if not len(symbols):
        return out
    rank, early = suffix_ranks(symbols, seen)
    shared = np.concatenate(([0], np.cumsum(np.bincount(early, minlength=len(early))[early] > 1)))
    some = np.flatnonzero(shared[starts[1:]] > shared[starts[:-1]])
    if not len(some):
        return out
    # Only texts in which a window comes twice go on.
    keep = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in some])
    rank, early = rank[keep].tolist(), early[keep]
    here, n = np.arange(len(keep)), len(keep)
    ends = np.append(early, -1)
    at, period = [], []
    for greater in (False, True):
        after = np.array(next_beyond(rank, greater))
        root = np.flatnonzero(early == ends[after])
        at.append(root)
        period.append(after[root] - here[root])
    at, period = np.concatenate(at), np.concatenate(period)
    if not len(at):
        return out
    texts = [texts[k] for k in some]
    symbols, starts = together(texts, codes)
    owner = np.searchsorted(starts, at, side="right") - 1
    with_root = np.unique(owner)
    texts = [texts[k] for k in with_root]
    symbols, moved = together(texts, codes)
    owner_now = np.searchsorted(with_root, owner)
    at = at - starts[owner] + moved[owner_now]
    ahead = Prefixes(symbols).common(at, at + period)
    backward, _ = together([t[::-1] for t in texts], codes)
    begin, end = moved[owner_now], moved[owner_now + 1] - 1
    inner = np.flatnonzero(at > begin)
    behind = np.zeros(len(at), np.int64)
    mirror = lambda x: begin[inner] + end[inner] - 1 - x
    behind[inner] = Prefixes(backward).common(mirror(at[inner] - 1), mirror(at[inner] + period[inner] - 1)) if len(inner) else 0
    length = behind + period + ahead
    good = length >= np.maximum(min_length, min_exponent * period)
    rows = np.unique(np.stack((owner_now[good], (at - behind - begin)[good], period[good], length[good])), axis=1)
    for k, start, p, size in rows.T.tolist():
        out[some[with_root[k]]].append((start, size, p))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Which of n words stay when every run keeps its first period only; None: all."""
    if not runs:
        return None
    edge = np.zeros(n + 1, np.int64)
    for start, size, p in runs:
        edge[start + p] += 1
        edge[start + size] -= 1
    return np.flatnonzero(np.cumsum(edge[:n]) == 0)


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every text by start and period, and the text with each run cut to its first period, words joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, "text"):
            words = [(t or b"").split() for t in as_bytes(batch.column("text"))]
            code: dict[bytes, int] = {}
            texts = [np.array([code.setdefault(w, len(code)) for w in ws], np.int64) for ws in words]
            runs = runs_of(texts, len(code), min_length, min_exponent)
            short = []
            for ws, own in zip(words, runs):
                kept = kept_words(len(ws), own)
                short.append(b" ".join(ws if kept is None else [ws[k] for k in kept.tolist()]))
            rows = pa.array([[{"start": a, "length": b, "period": c} for a, b, c in own] for own in runs], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), rows, pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first by start, then period; null for none."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def with_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which about a tenth of the texts, chosen by a checksum of their id, turn periodic from some word on.

    With h = crc32(decimal id) and g = h / 10 rounded down, texts with h % 10 = 0
    and n > 0 words are rewritten as words joined by a space: every word i from
    a = g % n on becomes word a + (i - a) % p, with p = 1 + (n - a) / (3 + g % 8)
    rounded down. Texts without an id stay.
    """
    h = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8"))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10).cast("long")
    n = F.size("_words").cast("long")
    made = docs.withColumn("_words", F.when(h % 10 == 0, words))
    made = made.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + g % 8)).cast("long"))
    source = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    turned = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_words", source(i))), " ")
    return made.withColumn(text, F.when(F.col("_a").isNotNull(), turned).otherwise(F.col(text))).drop("_words", "_a", "_p")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: how many runs, the strongest, and SHA-256 of the runs' lines and of the collapsed text."""
    rows = found(docs, doc_id, text).withColumn("_best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    best = lambda c: F.col(f"_best.{c}").alias(c)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best("start"), best("length"), best("period"),
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(F.transform("runs", line), ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
