"""Secret scans: base patterns, and sliding-window entropy over candidate strings.

Everything is a projection of built-in expressions: no user function, no shuffle,
one task per input split.

A pattern's matches have no positions in Spark, but the text split by the pattern
gives the gaps between them; running sums of the lengths of gaps and matches are
the positions, in code points. Sums run over blocks of about the square root of
the count, so a text of a million matches stays cheap.

Base spans are the matches of `KINDS` that are long enough. For the others they
are blanked, kind after kind, and what is left is searched for runs of token
characters. A window of `WINDOW` characters slides over each run. A fold keeps
the counts of the window's characters (a letter for each, A for none), takes the
leaving one out and the entering one in, and with them updates the sum of
c * log2 c, from which the entropy follows, and the counts of each class of
characters. Those decide which alphabet the window uses (hex, one case with digits, or mixed) and so which entropy it
must reach. Overlapping hot windows make one span. Sums are integers (millionths
of a bit), so no order of additions changes a verdict. Runs on the allow-list are
passed over.

Defined cases: a null or empty text has no span; null ids pass through; repeated
rows are scanned one by one; whole texts are scanned, whatever their length;
columns other than the id and the text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:long,kind:int,end:long>"


@dataclass(frozen=True)
class Kind:
    """A base pattern; a match counts if `group` of it has at least `least` characters."""

    name: str
    pattern: str
    group: int
    least: int


#: Of assign the first letter is looked at first, which spares time. Of hex and access only matches that are long enough are looked for: runs of their characters are maximal, so nothing else can match inside a short one.
KINDS = (
    Kind("assign", r"""(?=[PpSsTtAa])(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", "[0-9a-f]{32,}", 0, 32),
)
#: The kind of added spans comes after the base kinds.
ADDED = "entropy"
WINDOW = 20
CANDIDATE = Kind("candidate", r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW, 0, WINDOW)
#: Characters of candidates, by class.
CLASSES = {"digit": "0123456789", "low_hex": "abcdef", "low": "ghijklmnopqrstuvwxyz", "up_hex": "ABCDEF", "up": "GHIJKLMNOPQRSTUVWXYZ", "mark": "+/_=-"}
ALPHABET = "".join(CLASSES.values())
#: Candidates that are no secrets: UUIDs, placeholders, letters or digits in sequence. And what stands before public data.
ALLOWED = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|sample|placeholder|changeme|x{6}|0123456789|1234567890|abcdefghij|^sha(256|384|512)-"
ALLOWED_BEFORE = "base64,"


@dataclass(frozen=True)
class Alphabet:
    """A window of these classes alone, with at least so many characters of each group, is hot from `bits` of entropy a character."""

    name: str
    classes: tuple[str, ...]
    least: tuple[tuple[tuple[str, ...], int], ...]
    bits: float


ALPHABETS = (
    Alphabet("hex", ("digit", "low_hex"), ((("digit",), 3), (("low_hex",), 3)), 3.0),
    Alphabet("HEX", ("digit", "up_hex"), ((("digit",), 3), (("up_hex",), 3)), 3.0),
    Alphabet("lower", ("digit", "low_hex", "low"), ((("digit",), 3), (("low_hex", "low"), 3)), 3.4),
    Alphabet("upper", ("digit", "up_hex", "up"), ((("digit",), 3), (("up_hex", "up"), 3)), 3.4),
    Alphabet("mixed", tuple(CLASSES), ((("digit",), 2), (("low_hex", "low"), 2), (("up_hex", "up"), 2)), 3.7),
)


def parts_of_sum() -> list[int]:
    """c * log2 c in millionths of a bit, for c = 0 .. WINDOW."""
    return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 1)]


def most_sum(bits: float) -> int:
    """Entropy is log2 W - sum / W; the largest sum that leaves it at `bits`."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(steps: Column) -> Column:
    """Running sums of an array of integers."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    width = lambda xs: F.ceil(F.sqrt(F.size(xs))).cast("int")
    cut = lambda xs: bound(width(xs), lambda w: F.transform(F.sequence(F.lit(1), F.size(xs), w), lambda at: F.slice(xs, at, w)))
    before = lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, 1, i)))
    within = lambda block, offset: F.transform(block, lambda _, i: offset + total(F.slice(block, 1, i + 1)))
    summed = lambda blocks: F.flatten(F.zip_with(blocks, bound(F.transform(blocks, total), before), within))
    return bound(steps, lambda xs: F.when(F.size(xs) > 0, bound(cut(xs), summed)).otherwise(F.array().cast("array<long>")))


def pieces(text: Column, kind: Kind) -> Column:
    """The text as array of (gap, hit, counts): what stands before each match, and the match; after the last match hit is null. Empty where nothing matches: such a text is passed over once and not copied."""
    long_enough = lambda m: F.length(F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m) >= kind.least
    piece = lambda g, m: F.struct(g.alias("gap"), m.alias("hit"), F.coalesce(long_enough(m), F.lit(False)).alias("counts"))
    paired = lambda hits: F.when(F.size(hits) > 0, F.zip_with(F.split(text, kind.pattern, -1), hits, piece)).otherwise(F.array().cast("array<struct<gap:string,hit:string,counts:boolean>>"))
    return bound(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), paired)


def starts(found: Column) -> Column:
    """Where the match of each piece begins."""
    hit = lambda i: F.coalesce(F.length(F.get(found, i)["hit"]), F.lit(0))
    return running(F.transform(found, lambda p, i: (F.length(p["gap"]) + hit(i - 1)).cast("long")))


def base_spans(found: Column, number: int) -> Column:
    span = lambda p, s: F.when(p["counts"], F.struct(s.alias("start"), F.lit(number).alias("kind"), (s + F.length(p["hit"])).alias("end")))
    return F.when(F.exists(found, lambda p: p["counts"]), F.array_compact(F.zip_with(found, starts(found), span))).otherwise(F.array().cast(f"array<{SPAN}>"))


def blanked(text: Column, kind: Kind) -> Column:
    """The text with the matches of a kind that count turned to spaces of the same length."""
    shown = lambda p: F.concat(p["gap"], F.when(p["counts"], F.repeat(F.lit(" "), F.length(p["hit"]))).otherwise(F.coalesce(p["hit"], F.lit(""))))
    return bound(pieces(text, kind), lambda found: F.when(F.size(found) > 0, F.array_join(F.transform(found, shown), "")).otherwise(text))


def weight_of(name: str) -> int:
    """The unit of a class in a window's packed counts, five bits a class."""
    return 1 << 5 * list(CLASSES).index(name)


def is_hot(total: Column, packed: Column) -> Column:
    """Whether a window with this sum of c * log2 c and these packed class counts reaches the entropy of an alphabet that holds it."""
    out = F.lit(False)
    number = lambda n: F.shiftright(packed, 5 * list(CLASSES).index(n)).bitwiseAND(F.lit(31))
    for a in ALPHABETS:
        fits = (total <= most_sum(a.bits)) & (packed.bitwiseAND(F.lit(sum(31 * weight_of(n) for n in CLASSES if n not in a.classes))) == 0)
        for group, least in a.least:
            fits = fits & (sum((number(n) for n in group[1:]), number(group[0])) >= least)
        out = out | fits
    return out


def hot_stretches(token: Column) -> Column:
    """(start, end) of the stretches of a token that hot windows cover, by a fold over its characters."""
    sums = F.array(*map(F.lit, parts_of_sum()))
    weights = F.array(*(F.lit(weight_of(n)) for n, chars in CLASSES.items() for _ in chars))
    slots = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    leaving = lambda xs: F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), xs), 1, F.greatest(F.size(xs), F.lit(1)))
    weight = lambda k: F.when(k > 0, F.element_at(weights, k)).otherwise(0)
    step = lambda i, o: F.struct(i.alias("into"), o.alias("out"), (F.element_at(weights, i) - weight(o)).alias("weight"))
    steps = bound(slots, lambda xs: F.zip_with(xs, leaving(xs), step))
    part = lambda c: F.element_at(sums, c + 1)
    count_at = lambda counts, k: F.ascii(F.substring(counts, k, F.lit(1))) - 65
    put = lambda counts, k, c: F.overlay(counts, F.char(c + 65), k, F.lit(1))
    closed = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def left(s: Column, x: Column) -> Column:
        """Counts and sum without the character that leaves the window."""
        taken = lambda n: F.struct(put(s["counts"], x["out"], n - 1).alias("counts"), (s["sum"] + part(n - 1) - part(n)).alias("sum"))
        return F.when(x["out"] > 0, bound(count_at(s["counts"], x["out"]), taken)).otherwise(F.struct(s["counts"].alias("counts"), s["sum"].alias("sum")))

    def entered(t: Column, x: Column) -> Column:
        """And with the one that enters."""
        return bound(count_at(t["counts"], x["into"]), lambda n: F.struct(put(t["counts"], x["into"], n + 1).alias("counts"), (t["sum"] + part(n + 1) - part(n)).alias("sum")))

    def stepped(s: Column, x: Column) -> Column:
        """One character further. A hot window lengthens the open stretch or, beyond it, closes it and opens another."""
        at, packed = s["at"] + 1, s["packed"] + x["weight"]

        def noted(t: Column) -> Column:
            beyond = lambda this: this & (at - WINDOW > s["end"])
            return bound(
                (at >= WINDOW) & is_hot(t["sum"], packed),
                lambda this: F.struct(
                    at.alias("at"), t["counts"].alias("counts"), t["sum"].alias("sum"), packed.alias("packed"), F.when(beyond(this), at - WINDOW).otherwise(s["start"]).alias("start"), F.when(this, at).otherwise(s["end"]).alias("end"),
                    F.when(beyond(this) & (s["end"] > 0), F.concat(s["spans"], closed(s))).otherwise(s["spans"]).alias("spans"),
                ),
            )

        return bound(bound(left(s, x), lambda t: entered(t, x)), noted)

    zero = F.struct(
        F.lit(0).alias("at"), F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("packed"),
        F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )
    return F.aggregate(steps, zero, stepped, lambda s: F.when(s["end"] > 0, F.concat(s["spans"], closed(s))).otherwise(s["spans"]))


def added_spans(found: Column, number: int) -> Column:
    """Spans of hot stretches in the candidates that are not allowed."""
    wanted = lambda p: p["counts"] & ~F.rlike(p["hit"], F.lit(ALLOWED)) & ~F.endswith(p["gap"], F.lit(ALLOWED_BEFORE))
    spans = lambda p, s: F.when(wanted(p), F.transform(hot_stretches(p["hit"]), lambda h: F.struct((s + h["start"]).alias("start"), F.lit(number).alias("kind"), (s + h["end"]).alias("end"))))
    return F.when(F.exists(found, lambda p: p["counts"]), F.flatten(F.array_compact(F.zip_with(found, starts(found), spans)))).otherwise(F.array().cast(f"array<{SPAN}>"))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of spans (start, kind, end) in code points, by start and kind; kinds number KINDS in order, ADDED last."""
    # Each step binds what the next reads more than once; Spark keeps such projections apart.
    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = out.select("doc_id", "_t", *(pieces(F.col("_t"), k).alias(f"_p{i}") for i, k in enumerate(KINDS)))
    out = out.select("doc_id", "_t", *(base_spans(F.col(f"_p{i}"), i).alias(f"_s{i}") for i in range(len(KINDS))))
    out = out.select("doc_id", "_t", F.array_sort(F.concat(*(f"_s{i}" for i in range(len(KINDS))))).alias("base"))
    rest = F.col("_t")
    for kind in KINDS:
        rest = blanked(rest, kind)
    out = out.select("doc_id", "base", F.when(F.size("base") > 0, rest).otherwise(F.col("_t")).alias("_rest"))
    out = out.select("doc_id", "base", pieces(F.col("_rest"), CANDIDATE).alias("_c"))
    # Beside a field that is not deterministic, filters on the spans stay above; pushed down, they would scan the text again at each use of a step.
    held = out.select("doc_id", "base", added_spans(F.col("_c"), len(KINDS)).alias("added"), F.monotonically_increasing_id().alias("_at"))
    return held.where(F.col("_at") >= 0).drop("_at")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(n) for n in (*(k.name for k in KINDS), ADDED)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with base secrets blanked."""
    rest = F.coalesce(F.col(text), F.lit(""))
    for kind in KINDS:
        rest = blanked(rest, kind)
    return docs.select(F.col(doc_id).alias("doc_id"), rest.alias("text"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: base spans by kind, their digest, and all spans."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    rows = scanned(docs, doc_id, text)
    return rows.select(
        "doc_id", *(count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)), F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias(f"n_{ADDED}"),
    )
