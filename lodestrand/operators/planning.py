"""Questions to planned queries: keywords, intent, graph route and budget, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded

#: Words without weight in questions, and capitalised words that name nothing.
QUESTION_STOP_WORDS = "a about an and are as at be by can does for from how i in is it of on or our should that the their this to what when where which who why with".split()
NO_ENTITIES = "A An And Are Can Does For From How In Is It Of On Or Our Should That The This To What When Where Which Who Why With".split()
#: Patterns of relation kinds, of questions that need the graph, and of intents with their source hints.
RELATIONS = {
    "owns": r"\bown(?:s|ed|ership)?\b|\bparent\b|\bsubsidiar", "controls": r"\bcontrol(?:s|led)?\b", "manages": r"\bmanage(?:s|d|ment)?\b",
    "beneficiary_of": r"\bbeneficiar(?:y|ies)\b", "trustee_of": r"\btrustee\b", "director_of": r"\bdirector\b|\bboard\b", "signatory_of": r"\bsignator(?:y|ies)\b|\bsigned by\b",
    "guarantees": r"\bguarantee(?:s|d)?\b", "owes": r"\bowes?\b|\bdebt\b|\bliabilit", "member_of": r"\bmember(?:s|ship)?\b", "registered_in": r"\bregistered\b|\bjurisdiction\b", "formed_on": r"\bformed\b|\bincorporated\b|\bformation\b",
}
GRAPH_NEEDED = r"\bwho\s+owns\b|\bwhat\s+owns\b|\bowned\s+by\b|\bparent(?:\s+company|\s+entity)?\b|\bsubsidiar(?:y|ies)\b|\bcontrol(?:s|led)?\s+by\b|\bbeneficiar(?:y|ies)\b|\btrustee\b|\bownership\s+(?:structure|tree|chain|graph)\b"
INCOMING = r"\bwho\s+owns\b|\bwhat\s+owns\b|\bowned\s+by\b|\bcontrol(?:s|led)?\s+by\b|\bmanaged\s+by\b"
OUTGOING = r"\b(?:what|which)\s+(?:companies|entities|subsidiar(?:y|ies)|assets)\s+(?:does|do)\b.+\bown\b|\bsubsidiar(?:y|ies)\s+of\b|\bcontrols?\s+(?:companies|entities|subsidiar(?:y|ies)|assets)\b"
INTENTS = [
    ("freshness", ["recent", "incidents"], r"\b(?:latest|recent|current|today|yesterday|last\s+(?:week|month|quarter|year)|newest)\b"),
    ("policy", ["docs"], r"\b(?:policy|policies|allowed|allow|deny|forbidden|rule|rules|compliance|refund|sla)\b"),
    ("troubleshooting", ["support", "tickets"], r"\b(?:error|fail(?:ed|ing)?|cannot|can't|unable|broken|issue|bug|troubleshoot|fix|why\s+(?:is|are|did|does|can't|cannot))\b"),
    ("comparison", [], r"\b(?:compare|versus|vs\.?|difference|different|better|worse|between)\b"),
    ("definition", ["docs"], r"\b(?:what\s+is|define|meaning|explain|overview)\b"),
    ("procedural", ["docs"], r"\b(?:how\s+to|steps?|procedure|runbook|setup|configure|deploy|install)\b"),
    ("table", ["tables"], r"\b(?:table|spreadsheet|row|column|cell|sheet|csv|xlsx)\b"),
    ("visual", ["visuals"], r"\b(?:image|visual|figure|chart|diagram|screenshot|page\s+image)\b"),
]
MOST_KEYWORDS = 8


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?i)" + bounded(pattern)))


def _distinct_by_case(found: Column) -> Column:
    """Entries that no earlier one equals but for case."""
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def low_level_keywords(question: Column) -> Column:
    """Quoted phrases, capitalised runs and identifiers."""
    quoted = F.regexp_extract_all(question, F.lit('"([^"]{2,80})"'), F.lit(1))
    names = F.regexp_extract_all(question, F.lit(bounded(r"(\b[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*){0,4}\b)")), F.lit(1))
    ids = F.regexp_extract_all(question, F.lit(bounded(r"(\b[A-Za-z]+[-_][A-Za-z0-9_-]+|\b[A-Z]{2,}\b|\b[A-Za-z]*\d[A-Za-z0-9._-]*\b)")), F.lit(1))
    kept = F.filter(F.concat(quoted, names, ids), lambda t: (F.length(F.trim(t)) > 1) & ~F.trim(t).isin(NO_ENTITIES))
    return F.slice(_distinct_by_case(F.transform(kept, lambda t: F.trim(t))), 1, MOST_KEYWORDS)


def high_level_keywords(question: Column, low_level: Column) -> Column:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9][a-z0-9_-]*)"), F.lit(1)))
    own = F.transform(low_level, lambda t: F.lower(t))
    return F.slice(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(QUESTION_STOP_WORDS) & ~F.array_contains(own, t)), 1, MOST_KEYWORDS)


def planned(questions: DataFrame, question: str = "question") -> DataFrame:
    """questions with keywords, relation kinds, graph route, direction, intents, source hints and confidence."""
    q = F.col(question)
    kinds = F.array_compact(F.array(*(F.when(matches(q, p), F.lit(k)) for k, p in RELATIONS.items())))
    out = questions.withColumns({"low_level": low_level_keywords(q), "relation_kinds": kinds})
    needed = matches(q, GRAPH_NEEDED)
    out = out.withColumns(
        {
            "high_level": high_level_keywords(q, F.col("low_level")),
            "route": F.when(needed, "graph_required").when(F.size("relation_kinds") > 0, "graph_optional").otherwise("none"),
            "direction": F.when(~needed & (F.size("relation_kinds") == 0), "any").when(matches(q, INCOMING), "incoming").when(matches(q, OUTGOING), "outgoing").otherwise("any"),
        }
    )
    intents = F.array_compact(F.array(F.when(F.col("route") != "none", F.lit("relationship")), *(F.when(matches(q, p), F.lit(name)) for name, _, p in INTENTS)))
    hints = F.flatten(F.array(F.when(F.col("route") != "none", F.array(F.lit("graph"))).otherwise(F.array().cast("array<string>")), *(F.when(matches(q, p), F.array(*map(F.lit, h)).cast("array<string>")).otherwise(F.array().cast("array<string>")) for _, h, p in INTENTS)))
    out = out.withColumns({"intents": intents, "_hints": F.array_sort(F.array_distinct(hints))})
    return out.withColumns(
        {
            "intent": F.coalesce(F.get("intents", 0), F.lit("general")),
            "source_hints": F.when(F.size("_hints") == 0, F.array(F.lit("docs"))).otherwise(F.col("_hints")),
            "confidence": F.when(F.size("intents") == 0, F.lit(0.35)).otherwise(F.least(F.lit(0.95), F.lit(0.6) + F.size("intents") * F.lit(0.1))),
        }
    ).drop("_hints")


def branches(plans: DataFrame, question: str = "question", most: int = 3, key: str = "query_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, branch, kind, query, weight, and the columns of `keep`) of plans, one row for each query_id: the question and its keyword and graph variants, distinct by text, the first `most`."""
    variant = lambda kind, text, weight: F.struct(F.lit(kind).alias("kind"), text.alias("query"), weight.cast("double").alias("weight"))
    low, high = F.array_join("low_level", " "), F.array_join("high_level", " ")
    made = F.filter(
        F.array(
            variant("original", F.trim(F.regexp_replace(question, r"\s+", " ")), F.lit(1.0)), variant("low_level", low, F.lit(0.9)), variant("high_level", high, F.lit(0.75)),
            variant("graph", F.when(F.col("route") != "none", F.concat_ws(" ", F.array_join("relation_kinds", " "), low)).otherwise(F.lit("")), F.when(F.col("route") == "graph_required", 0.95).otherwise(0.8)),
        ), lambda b: F.trim(b["query"]) != "",
    )
    # A question's variants are told apart in its own row: nothing is shuffled. A lambda binds them, which are read several times.
    lower = lambda b: F.lower(b["query"])
    first = F.get(F.transform(F.array(made), lambda m: F.slice(F.filter(m, lambda b, i: F.array_position(F.transform(m, lower), lower(b)) == i + 1), 1, most)), 0)
    rest = [c for c in keep if c != key]
    return plans.select(key, *rest, F.posexplode(first).alias("_at", "b")).select(key, (F.col("_at") + 1).alias("branch"), "b.*", *rest)


def rewritten(plans: DataFrame, rewrite: Callable[[str], str | None], kind: str, weight: float, most_chars: int = 1200, question: str = "question", key: str = "query_id") -> DataFrame:
    """One branch per question from a caller's function (a model, or hypothetical answers); where it fails or returns nothing there is none."""

    def safe(texts):
        def one(t):
            try:
                return (rewrite(t) or "")[:most_chars] or None
            except Exception:  # the planned branches stand without it
                return None

        return texts.map(one)

    made = F.pandas_udf(safe, "string")
    return plans.select(key, F.lit(0).alias("branch"), F.lit(kind).alias("kind"), made(F.col(question)).alias("query"), F.lit(weight).alias("weight")).where("query is not null")


def budgeted(planned_branches: DataFrame, route: Column, top_k: int = 10) -> DataFrame:
    """Branches with their own top_k and candidate pool: keyword variants get less, required graph branches more."""
    share = F.when(F.col("kind").isin("low_level", "high_level", "hyde"), 0.75).when((F.col("kind") == "graph") & (route == "graph_required"), 1.25).otherwise(1.0)
    k = F.least(F.ceil(F.lit(top_k) * share), F.lit(100)).cast("int")
    return planned_branches.withColumns({"top_k": k, "pool": F.least(F.greatest(k * 4, F.lit(20)), F.lit(5000))})
