"""URL filters: a sort-merge range join of urls with nested host rules.

A host written backwards by labels (`www.example.net` -> `net.example.www.`)
makes every rule host a prefix, and the hosts under it the interval
[`net.example.`, `net.example/`), because `/` follows `.`. Two such intervals
nest or are disjoint. Urls and the starts of rule intervals are dealt to ranges
of keys and sorted; a sweep keeps a stack of the hosts whose interval is open,
each with its paths, and a url looks only at that stack: once for each length
that a path of an open host has, however many paths it has.

Range bounds come from a sample of about `SAMPLE_PER_RANGE` keys a range, taken
row by row; a rule is repeated in each range that its interval meets. Keys end
in a hash of url and row, so one host with a third of all rows spreads over many
ranges. Nothing is broadcast but the bounds: the rules may be as many as the
urls.

Defined cases: a null url, or one without `://`, has an empty host and path and
no rule; repeated rows are judged one by one; a rule host matches whole labels
only; of rules that fit, the longest rule string wins, and of equally long ones
the smallest string; rows without a rule get `default`; a null or empty rule is
ignored; urls and rules of any length are read whole; empty tables give no rows
or no rules; other columns than id and url are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled per range, to choose the bounds.
SAMPLE_PER_RANGE = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


class OpenHost:
    """A rule host whose interval is open: its paths, each with the smallest rule, and their lengths, longest first."""

    def __init__(self, end: str):
        self.end, self.paths, self.lengths = end, {}, []

    def add(self, path: str, rule: str, action: str) -> None:
        if path not in self.paths or (rule, action) < self.paths[path]:
            self.paths[path] = rule, action
        self.lengths = []

    def best(self, path: str) -> tuple[str, str] | None:
        self.lengths = self.lengths or sorted(set(map(len, self.paths)), reverse=True)
        return next((found for n in self.lengths if n <= len(path) and (found := self.paths.get(path[:n]))), None)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, rules first, longer interval first): each url with the best rule of the open stack."""
    stack: list[OpenHost] = []
    at = None
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("page_id", "url", "rule", "action")}
        for part, key, end, path, rule, action, page_id, url in zip(*(batch.column(k).to_pylist() for k in COLUMNS)):
            if part != at:
                stack, at = [], part
            while stack and stack[-1].end <= key:
                stack.pop()
            if end is not None:
                if not stack or stack[-1].end != end:
                    stack.append(OpenHost(end))
                stack[-1].add(path, rule, action)
                continue
            fits = [found for s in stack if (found := s.best(path))]
            best = min(fits, key=lambda f: (-len(f[0]), f[0])) if fits else (None, None)
            for k, v in zip(out, (page_id, url, *best)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), *(pa.array(out[k], pa.string()) for k in ("url", "rule", "action"))], list(out))


COLUMNS = ("part", "key", "end", "path", "rule", "action", "page_id", "url")


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """ranges - 1 keys at most that split a sample of the keys evenly. Each row is sampled by itself, so no task gathers more than its share."""
    n = keys.count() if ranges > 1 else 0
    if not n:
        return []
    sample = sorted(r.key for r in keys.sample(min(1.0, SAMPLE_PER_RANGE * ranges / n), seed=5).collect())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []


def dealer(bounds: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives rows the number of their range; a rule's row is repeated in every range that its interval meets, open from the start of the later ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ends = batch.column("key").to_pylist(), batch.column("end").to_pylist()
            first = [bisect_right(bounds, k) for k in keys]
            last = [f if e is None else bisect_right(bounds, e) for f, e in zip(first, ends)]
            row = pa.array([k for k, (f, t) in enumerate(zip(first, last)) for _ in range(f, t + 1)], pa.int64())
            part = [p for f, t in zip(first, last) for p in range(f, t + 1)]
            key = [k if p == f else "" for k, f, t in zip(keys, first, last) for p in range(f, t + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(key, pa.string()), *(batch.column(c).take(row) for c in COLUMNS[2:])], list(COLUMNS))

    return work


def filtered(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", ranges: int | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page. `rules`: columns rule (`host/path`) and action (block or allow)."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    keyed = narrow.select(
        F.concat(reversed_host(host), F.lit("\u0001"), F.hex(F.xxhash64("url", "page_id"))).alias("key"), path.alias("path"), "page_id", "url"
    )
    bounds = _bounds(keyed.select("key"), ranges)

    own = rules.where("rule is not null and rule <> ''").select("rule", "action", F.substring_index("rule", "/", 1).alias("h"))
    low = reversed_host(F.translate("h", UPPER, LOWER))
    own = own.where("h <> ''").select(
        "rule", "action", low.alias("low"), F.regexp_replace(low, "\\.$", "/").alias("end"),
        F.expr("substring(rule, length(h) + 1)").alias("path"),
    )
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    starts = own.select(F.col("low").alias("key"), "end", "path", "rule", "action", no_id.alias("page_id"), none.alias("url"))
    urls = keyed.select("key", none.alias("end"), "path", none.alias("rule"), none.alias("action"), "page_id", "url")
    numbered = starts.unionByName(urls).mapInArrow(dealer(bounds), "part int, key string, end string, path string, rule string, action string, page_id long, url string")
    dealt = numbered.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", F.col("end").desc_nulls_last())
    swept = dealt.mapInArrow(sweep, "page_id long, url string, rule string, action string")
    host, path = host_and_path(F.col("url"))
    return swept.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
