"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text, so the plan is a
scan, a projection and nothing else: no user function, no shuffle, one task per
input split however the rows are spread over sources.

Defined cases: a null or empty text has no words, all measures 0 and fails the
base rule; repeated rows are judged one by one; a null doc_id passes through;
columns other than the id and the text are left alone (`keep` selects which to
carry). Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"

#: Frequent short words of the four corpus languages.
STOP_WORDS = {
    "en": "the be to of and that have with in is it for was on are as by this at from an a or not".split(),
    "fr": "le la les de des du et un une en que qui dans pour par sur est au aux avec pas ne".split(),
    "de": "der die das und ein eine den dem des von zu mit in im ist nicht auf für sich auch".split(),
    "es": "el la los las de del y que en un una por con para es se al no su lo".split(),
}


def stop_forms() -> list[str]:
    """The stop words as they stand in a text: lower case, capitalised, upper case."""
    return sorted({form for words in STOP_WORDS.values() for w in words for form in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """Reject where `measure` lies outside [least, most]; None leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table of the method. Base rules come on top of it.
RULES = (
    Rule("too_long", "n_words", most=1_000_000),
    Rule("word_length", "mean_word_chars", least=2.5, most=12.0),
    Rule("symbols", "symbols_per_word", most=0.10),
    Rule("shouting", "exclamations_per_word", most=0.10),
    Rule("stop_words", "stop_word_share", least=0.02),
    Rule("repeated_lines", "dup_line_share", most=0.40),
)


def count_of(whole: Column, chars: str) -> Column:
    """Occurrences of any of chars. Plain replacements: each is one pass, and a text without the character is not copied."""
    rest = whole
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(whole) - F.length(rest)).cast("long")


def windows(words: Column) -> Column:
    """Every 3-word window as a struct beside its position; the last two are cut short and hold nulls."""
    n = F.greatest(F.size(words), F.lit(1))
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"), F.sequence(F.lit(1), n).alias("i"))


def repeats(ordered: Column) -> Column:
    """Positions of the windows that equal a neighbour in sorted order, ascending."""
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["i"], y["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))


def covered(starts: Column) -> Column:
    """How many words three-word windows at these ascending starts cover: three each, less what the next covers too."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda total, g: total + g).cast("long")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, in table order."""
    broken = []
    for r in rules:
        m = F.col(r.measure)
        out = F.lit(False)
        if r.least is not None:
            out = out | (m < r.least)
        if r.most is not None:
            out = out | (m > r.most)
        broken.append(F.when(out, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base verdict and rule verdict of every document.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, broken_rules and kept to the columns in `keep`.
    """
    stops = stop_forms()
    # Each step binds an array that the next one reads more than once; Spark keeps such projections apart.
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = out.select(
        *keep,
        count_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        count_of(F.col("_t"), "!").alias("n_exclaimed"),
        F.filter(F.split("_t", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("_lines"),
    )
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_sorted": F.sort_array(windows(F.col("_words"))),
        }
    ).drop("_words", "_lines")
    out = out.withColumn("_starts", repeats(F.col("_sorted"))).drop("_sorted")
    out = out.withColumn("n_repeat_words", covered(F.col("_starts"))).drop("_starts")
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    out = out.withColumns(
        {
            "mean_word_chars": per_word("word_chars"),
            "symbols_per_word": per_word("n_symbols"),
            "exclamations_per_word": per_word("n_exclaimed"),
            "stop_word_share": per_word("n_stop_words"),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "base_failed": (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        }
    )
    return out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        verdict(rules).alias("broken_rules"),
        (~F.col("base_failed") & (F.size(verdict(rules)) == 0)).alias("kept"),
    )


def accepted(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with their own columns."""
    own = docs.columns
    marked = judge(docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in own))), text, ("_row",), rules)
    # Beside a field that is not deterministic the filter stays above the projections; pushed down, it would spell out every measure again at each of their uses.
    held = marked.select("_row", "kept", F.monotonically_increasing_id().alias("_at"))
    return held.filter(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")
