"""The whole chunker: protected layout ranges, windows between and within them, furniture, merging, ids.

Ranges of tables, captions, figures and equations are united by gaps and islands
in a window over a document's regions; of what is left, and of ranges beyond the
limit, windows are made by characters or by separators. Everything on a text is a
chain of built-in expressions on one row: windows are an array of structs, and
separators and small windows are folds over such arrays. A text is cut once into
blocks of BLOCK characters, and every slice is put together from the blocks that
it touches, so that the time is linear in the text.

Defined cases: null and blank bodies have no chunk; regions that are null, empty
or begin beyond the body are ignored, their ends are cut to it; a document with
more than `most_chunks` windows is rejected whole (`rejected`). Positions count
code points, white space is that of ASCII, and it is preserved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safety_flags
from .ingest import BLOCK, LEAST_CHARS, MOST_CHARS, OVERLAP, furniture, pieces, slice_of

#: Kinds of regions that are kept whole.
PROTECTED_KINDS = ("table", "table_caption", "figure", "figure_caption", "equation")
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
SPAN, PIECE = "array<struct<start:int,end:int>>", "struct<start:int,end:int,protected:boolean,text:string>"


@dataclass(frozen=True)
class Policy:
    """`boundary`: character, line or paragraph."""

    most: int = MOST_CHARS
    overlap: int = OVERLAP
    least: int = LEAST_CHARS
    most_chunks: int = 1500
    boundary: str = "paragraph"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def islands(regions: DataFrame) -> DataFrame:
    """(doc_id, islands): the union of each document's protected ranges (doc_id, kind, start, end), in order."""
    good = regions.where(F.col("kind").isin(*PROTECTED_KINDS) & (F.col("start") >= 0) & (F.col("end") > F.col("start")))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    numbered = good.select("doc_id", "start", "end", fresh.alias("_fresh")).withColumn("_isle", F.sum("_fresh").over(order))
    united = numbered.groupBy("doc_id", "_isle").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"))
    return united.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("islands"))


def segments(ranges: Column, size: Column) -> Column:
    """The body as array of (start, end, protected): ranges and what lies between them."""
    span = lambda a, b, p: F.struct(a.cast("int").alias("start"), F.least(b, size).cast("int").alias("end"), F.lit(p).alias("protected"))
    behind = lambda i: F.coalesce(F.get(ranges, i)["end"], F.lit(0))
    both = F.flatten(F.transform(ranges, lambda r, i: F.array(span(behind(i - 1), r["start"], False), span(r["start"], r["end"], True))))
    return F.filter(F.concat(both, F.array(span(behind(F.size(ranges) - 1), size, False))), lambda s: s["start"] < s["end"])


def by_characters(start: Column, end: Column, policy: Policy) -> Column:
    step = max(1, policy.most - policy.overlap)
    last = F.greatest(F.ceil((end - start - policy.most) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((start + i * step).cast("int").alias("start"), F.least(start + i * step + policy.most, end).cast("int").alias("end")))


def by_separator(text: Column, start: Column, policy: Policy) -> Column:
    """Parts between separators packed to windows: one that would pass the limit closes the window where it begins, if that is long enough, and the next one starts `overlap` before."""
    separator = SEPARATORS[policy.boundary]
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))

    def step(s: Column, size: Column) -> Column:
        begin, end = s["at"], s["at"] + size
        full = (end - s["start"] > policy.most) & (s["end"] - s["start"] >= policy.least)
        back = F.greatest(s["start"], begin - policy.overlap) if policy.overlap else begin
        return F.struct(
            F.when(s["start"] < 0, begin).when(full, back).otherwise(s["start"]).alias("start"), end.alias("end"), (end + len(separator)).alias("at"),
            F.when((s["start"] >= 0) & full, F.concat(s["out"], one(s["start"], begin))).otherwise(s["out"]).alias("out"),
        )

    zero = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("end"), start.cast("int").alias("at"), F.array().cast(SPAN).alias("out"))
    sizes = F.transform(F.split(text, separator, -1), lambda p: F.length(p))
    packed = F.aggregate(sizes, zero, step, lambda s: F.concat(s["out"], one(s["start"], s["end"])))
    return F.flatten(F.transform(packed, lambda w: F.when(w["end"] - w["start"] > policy.most, by_characters(w["start"], w["end"], policy)).otherwise(one(w["start"], w["end"]))))


def windows(parts: Column, blocks: Column, policy: Policy) -> Column:
    """The windows (start, end, protected, text) of all segments but blank ones."""

    def of(s: Column) -> Column:
        whole = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        cut = by_characters(s["start"], s["end"], policy) if policy.boundary == "character" else by_separator(slice_of(blocks, s["start"], s["end"]), s["start"], policy)
        spans = F.when(s["end"] - s["start"] <= policy.most, whole).otherwise(cut)
        return F.transform(spans, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), s["protected"].alias("protected"), slice_of(blocks, w["start"], w["end"]).alias("text")))

    return F.filter(F.flatten(F.transform(parts, of)), lambda w: F.rlike(w["text"], F.lit("[^ \\t\\n\\x0B\\f\\r]")))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$", "")


def merged(parts: Column, blocks: Column, policy: Policy) -> Column:
    """Windows of fewer than `least` characters joined to the one before or, failing that, the one after, where both fit, are not both protected, and have nothing but white space between them."""
    none = F.lit(None).cast(PIECE)

    def fits(a: Column, b: Column) -> Column:
        size = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
        gap = F.when(a["end"] < b["start"], slice_of(blocks, a["end"], b["start"])).otherwise("")
        return F.coalesce(~(a["protected"] & b["protected"]) & (size <= policy.most) & (trimmed(gap) == ""), F.lit(False))

    def joined(a: Column, b: Column) -> Column:
        start, end = F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"])
        return F.struct(start.alias("start"), end.alias("end"), (a["protected"] | b["protected"]).alias("protected"), slice_of(blocks, start, end).alias("text"))

    def taken(s: Column, x: Column) -> Column:
        """What waits for the next window meets it; then that is judged."""
        wait = s["wait"]
        meets = wait.isNotNull() & fits(wait, x)
        now = F.struct(
            F.when(wait.isNotNull() & ~meets, F.concat(s["out"], F.array(wait))).otherwise(s["out"]).alias("out"),
            F.when(meets, joined(wait, x)).otherwise(x).alias("x"),
        )
        return bound(now, judged)

    def judged(t: Column) -> Column:
        return bound(F.struct(t["out"].alias("out"), t["x"].alias("x"), F.get(t["out"], F.size(t["out"]) - 1).alias("last"), (F.length(trimmed(t["x"]["text"])) < policy.least).alias("small")), settled)

    def settled(t: Column) -> Column:
        back = t["small"] & t["last"].isNotNull() & fits(t["last"], t["x"])
        out = F.when(back, F.concat(F.slice(t["out"], 1, F.greatest(F.size(t["out"]) - 1, F.lit(0))), F.array(joined(t["last"], t["x"])))).when(t["small"], t["out"]).otherwise(F.concat(t["out"], F.array(t["x"])))
        return F.struct(out.alias("out"), F.when(t["small"] & ~back, t["x"]).otherwise(none).alias("wait"))

    zero = F.struct(F.array().cast(f"array<{PIECE}>").alias("out"), none.alias("wait"))
    return F.aggregate(parts, zero, taken, lambda s: F.when(s["wait"].isNotNull(), F.concat(s["out"], F.array(s["wait"]))).otherwise(s["out"]))


def windowed(docs: DataFrame, regions: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """docs without their text but with `windows`, the final windows of each body."""
    rest = [c for c in docs.columns if c != "text"]
    body = docs.where(F.rlike("text", F.lit("[^ \\t\\n\\x0B\\f\\r]")))
    if regions is not None:
        body = body.join(islands(regions), "doc_id", "left")
    ranges = F.filter(F.coalesce(F.col("islands"), F.array().cast(SPAN)), lambda r: r["start"] < F.col("_n")) if regions is not None else F.array().cast(SPAN)
    out = body.withColumn("_n", F.length("text")).select(*rest, pieces(F.col("text"), BLOCK).alias("_blocks"), segments(ranges, F.col("_n")).alias("_segments"))
    out = out.select(*rest, "_blocks", windows(F.col("_segments"), F.col("_blocks"), policy).alias("_windows"))
    telling = F.filter("_windows", lambda w: ~furniture(w["text"], policy.least))
    # Beside a field that is not deterministic, filters on the windows stay above; pushed down, they would cut the body again for every window.
    held = out.select(*rest, merged(telling, F.col("_blocks"), policy).alias("windows"), F.monotonically_increasing_id().alias("_row"))
    return held.where(F.col("_row") >= 0).drop("_row")


def chunked(docs: DataFrame, regions: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """One row for each chunk: docs' columns, chunk_index, start, end, protected, text, text_hash, chunk_id, tokens, safety_flags, locator."""
    rows = windowed(docs, regions, policy).where(F.size("windows") <= policy.most_chunks)
    rest = [c for c in docs.columns if c != "text"]
    out = rows.select(*rest, F.posexplode("windows").alias("chunk_index", "_w")).select(*rest, "chunk_index", "_w.*")
    out = out.withColumn("text_hash", F.sha2(F.encode("text", "UTF-8"), 256))
    return out.withColumns(
        {
            "chunk_id": F.concat(F.lit("chunk_"), F.sha2(F.encode(F.concat_ws(":", "doc_id", "chunk_index", "text_hash"), "UTF-8"), 256)),
            "tokens": F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("long"),
            "safety_flags": safety_flags(F.col("text"), policy.most),
            "locator": F.concat(F.lit("chars "), F.col("start"), F.lit("-"), F.col("end")),
        }
    )


def rejected(docs: DataFrame, regions: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """(doc_id, n_windows) of the documents that would make too many chunks."""
    return windowed(docs, regions, policy).where(F.size("windows") > policy.most_chunks).select("doc_id", F.size("windows").alias("n_windows"))
