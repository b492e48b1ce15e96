"""A positional inverted index, and full-text search over it.

Chunks are dealt evenly over segments, and every token of every field becomes an
occurrence (term, doc_id, chunk_index, field, pos) in its chunk's segment, which
one task sorts by term and writes. So texts are shuffled, not their tokens; a
term's occurrences stand together in each segment; and a term that holds a large
part of all tokens is as evenly spread as the chunks. Fields follow one another in one count of positions with a gap
between them, so phrases do not span fields. A dictionary (term, stem, prefixes
by lookup) is the only place where words are stemmed.

Searches state any number of queries. Their clauses are rows; they meet the
dictionary first and then, by term, the occurrences. Nothing is collected: what
is small (clauses, wanted terms, hits) is written once, so that it is computed
once, and Spark knows its size and leaves the occurrences where they are.

Defined cases: null fields have no tokens; a query without a usable term finds
nothing; repeated queries are answered by their ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import stem_steps
from ..functions.text import STOP_WORDS, half_up, terms
from ..sources.tables import staged

KEY = ("doc_id", "chunk_index")
#: The weights of the fields in BM25, and in cover density.
BM25_WEIGHTS = {"title": 4.0, "citation": 2.0, "body": 1.0}
COVER_WEIGHTS = {"title": 1.0, "citation": 0.4, "body": 0.2}
#: What a phrase in the text and a term in a title add.
PHRASE_BONUS, TITLE_BONUS = 0.25, 0.1
K1, B = 1.2, 0.75
#: Chunks of one segment: their occurrences are sorted in the memory of a task.
SEGMENT_CHUNKS = 4_096


@dataclass(frozen=True)
class Index:
    """`texts`: KEY, title, citation, body, n_tokens; `occurrences`: KEY, term, field, pos; `dictionary`: term, stem."""

    texts: DataFrame
    occurrences: DataFrame
    dictionary: DataFrame
    fields: tuple[str, ...]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def stemmed(words: DataFrame, word: str = "term") -> DataFrame:
    """words with the column stem; meant for tables of distinct words."""
    whole = word
    for step in stem_steps("spark"):
        # A lambda binds what each step reads many times; as columns on columns the steps would multiply.
        whole = f"get(transform(array({whole}), w -> {step}), 0)"
    return words.withColumn("stem", F.when(F.length(word) > 2, F.expr(whole)).otherwise(F.col(word)))


def built(chunks: DataFrame, fields: dict[str, Column], most_chunks: int = SEGMENT_CHUNKS) -> Index:
    """The index of chunks (KEY, ...), whose fields are expressions over their columns, in order of position."""
    names = tuple(fields)
    texts = chunks.select(*KEY, *(c.alias(n) for n, c in fields.items()))
    texts = staged(texts.withColumn("n_tokens", sum((F.size(tokens(F.col(n))) for n in names[1:]), F.size(tokens(F.col(names[0]))))), "index-texts")
    # An empty token between two fields takes the place left free, so that a token's place is its own in the whole array.
    parts = [part for n in names for part in (tokens(F.col(n)), F.array(F.lit("")))][:-1]
    sizes = [F.size(tokens(F.col(n))).alias(f"_size{k}") for k, n in enumerate(names[:-1])]
    segments = max(1, -(-texts.count() // most_chunks))
    cut = texts.repartition(segments, *KEY).select(*KEY, *sizes, F.concat(*parts).alias("_terms"))
    rows = cut.select(*KEY, *(f"_size{k}" for k in range(len(sizes))), F.posexplode("_terms").alias("pos", "term")).where("term <> ''")
    field, end = F.lit(names[-1]), F.lit(0)
    ends = []
    for k in range(len(sizes)):
        end = end + F.col(f"_size{k}") + 1
        ends.append(end)
    for name, end in reversed(list(zip(names, ends))):
        field = F.when(F.col("pos") < end, F.lit(name)).otherwise(field)
    dealt = rows.select(*KEY, "term", field.alias("field"), "pos").sortWithinPartitions("term", *KEY, "pos")
    occurrences = staged(dealt, "index-occurrences")
    dictionary = staged(stemmed(occurrences.select("term").distinct()), "index-terms")
    return Index(texts, occurrences, dictionary, names)


def clauses(queries: DataFrame) -> DataFrame:
    """(query_id, alternative, clause, negated, n_terms, offset, stem) of queries (query_id, query).

    Words must all occur, "quoted words" as a phrase, -words must not, and `or`
    parts alternatives. Stop words are left out, but keep their place in a phrase.
    """
    parts = F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit('-?"[^"]*"|[^\\s"]+'), F.lit(0))
    rows = queries.select("query_id", parts.alias("_parts")).select("query_id", "_parts", F.posexplode("_parts").alias("clause", "_part"))
    alternative = F.size(F.filter(F.slice("_parts", 1, F.col("clause") + 1), lambda p: p == "or"))
    rows = rows.select("query_id", alternative.alias("alternative"), "clause", F.startswith("_part", F.lit("-")).alias("negated"), F.col("_part")).where("_part <> 'or'")
    found = F.transform(tokens(F.col("_part")), lambda t, i: F.struct(t.alias("term"), i.alias("offset")))
    rows = rows.withColumn("_terms", F.filter(found, lambda t: ~t["term"].isin(STOP_WORDS))).where(F.size("_terms") > 0)
    out = rows.select("query_id", "alternative", "clause", "negated", F.size("_terms").alias("n_terms"), F.explode("_terms").alias("t")).select("query_id", "alternative", "clause", "negated", "n_terms", "t.offset", "t.term")
    return staged(stemmed(out).drop("term"), "index-clauses")


def occurrences_of(index: Index, wanted: DataFrame) -> DataFrame:
    """Occurrences that wanted (term, ...) names, beside its other columns, written once. Occurrences are the large side and stay where they are if wanted, as written, is small."""
    return staged(index.occurrences.join(staged(wanted, "index-wanted"), "term"), "index-hits")


def matched(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks (query_id, alternative, KEY) that fulfil an alternative of the asked clauses, and all hits of clause terms."""
    hits = occurrences_of(index, asked.join(index.dictionary, "stem"))
    group = ["query_id", "alternative", *KEY]
    # A phrase stands at a place where each of its terms occurs at its offset.
    standing = hits.groupBy(*group, "clause", "negated", "n_terms", (F.col("pos") - F.col("offset")).alias("_place")).agg(F.count("*").alias("_n")).where("_n = n_terms")
    each = standing.select(*group, "clause", "negated").distinct().groupBy(*group).agg(F.count_if(~F.col("negated")).alias("_yes"), F.count_if("negated").alias("_no"))
    needed = asked.where(~F.col("negated")).select("query_id", "alternative", "clause").distinct().groupBy("query_id", "alternative").agg(F.count("*").alias("_needed"))
    kept = each.join(needed, ["query_id", "alternative"]).where("_yes = _needed and _no = 0").select(*group)
    return kept, hits


def cover_density(entries: Column, n_terms: Column) -> Column:
    """The sum over minimal covers of a sorted array (pos, term, inverse weight): mean weight over one and the other words within.

    A cover is a shortest stretch that holds every term. n / sum(1 / weight) of its
    hits, over one plus the places in it that are no hits.
    """
    last = lambda s, e: F.transform(s["last"], lambda p, k: F.when(k == e["term"], e["pos"]).otherwise(p))

    def step(s: Column, e: Column) -> Column:
        def seen(places: Column) -> Column:
            start = F.array_min(places)
            inside = F.filter(entries, lambda x: (x["pos"] >= start) & (x["pos"] <= e["pos"]))
            size = F.size(F.array_distinct(F.transform(inside, lambda x: x["pos"])))
            inverse = F.aggregate(inside, F.struct(F.lit(-1).alias("pos"), F.lit(0.0).alias("sum")), lambda a, x: F.struct(x["pos"].alias("pos"), (a["sum"] + F.when(x["pos"] == a["pos"], 0.0).otherwise(x["inverse"])).alias("sum")), lambda a: a["sum"])
            noise = (e["pos"] - start) - (size - 1)
            return F.struct(places.alias("last"), F.greatest(start, s["start"]).alias("start"), (s["rank"] + F.when(start > s["start"], size / inverse / (1 + noise)).otherwise(0.0)).alias("rank"))

        return F.get(F.transform(F.array(last(s, e)), seen), 0)

    zero = F.struct(F.array_repeat(F.lit(-1), n_terms).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("rank"))
    return F.aggregate(entries, zero, step, lambda s: s["rank"])


def full_text(index: Index, queries: DataFrame, weights: dict[str, float] = COVER_WEIGHTS) -> DataFrame:
    """(query_id, KEY, score) of the chunks that a query's words, phrases and exclusions select: cover density d as d / (d + 1), and bonuses."""
    asked = clauses(queries)
    kept, hits = matched(index, asked)
    group = ["query_id", "alternative", *KEY]
    positive = asked.where(~F.col("negated")).select("query_id", "alternative", "clause", "offset")
    # The place of a term among its alternative's: alternatives have a handful.
    order = positive.groupBy("query_id", "alternative").agg(F.sort_array(F.collect_set(F.struct("clause", "offset"))).alias("_order"))
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("field") == name, 1 / w).otherwise(weight)
    entry = F.struct("pos", (F.array_position("_order", F.struct("clause", "offset")) - 1).cast("int").alias("term"), weight.alias("inverse"))
    own = hits.where(~F.col("negated")).join(kept, group, "left_semi").join(order, ["query_id", "alternative"])
    # One chunk's hits: no more than it has tokens.
    gathered = own.groupBy(*group).agg(F.sort_array(F.collect_list(entry)).alias("_entries"), F.first(F.size("_order")).alias("_n"))
    density = gathered.select(*group, cover_density(F.col("_entries"), F.col("_n")).alias("_d"))
    best = density.groupBy("query_id", *KEY).agg(F.max(F.col("_d") / (F.col("_d") + 1)).alias("_rank"))
    return with_bonuses(index, best, queries, title=TITLE_BONUS, haystack=["body"])


def with_bonuses(index: Index, found: DataFrame, queries: DataFrame, title: float, haystack: list[str]) -> DataFrame:
    """found (query_id, KEY, _rank) with a bonus where the haystack holds the query as it stands, or a title one of its terms. Only texts of found chunks are looked at."""
    own = queries.select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("_query"), terms(F.coalesce("query", F.lit(""))).alias("_words"))
    rows = staged(found, "index-found").join(staged(own, "index-queries"), "query_id").join(index.texts, list(KEY))
    text = F.lower(F.concat_ws("\n", *haystack))
    titles = F.lower(F.concat_ws(" ", *(n for n in index.fields if n != "body")))
    score = F.col("_rank") + F.when((F.col("_query") != "") & F.contains(text, F.col("_query")), PHRASE_BONUS).otherwise(0.0)
    if title:
        score = score + F.when(F.exists("_words", lambda w: F.contains(titles, w)), title).otherwise(0.0)
    return rows.select("query_id", *KEY, half_up(score, 6).alias("score"))


def bm25_prefix(index: Index, queries: DataFrame, weights: dict[str, float] = BM25_WEIGHTS) -> DataFrame:
    """(query_id, KEY, score) by BM25 over three weighted fields, where each term of a query stands for all stems that begin with its own; any term will do."""
    words = queries.select("query_id", F.explode(terms(F.coalesce("query", F.lit("")))).alias("term"))
    asked = staged(stemmed(words).select("query_id", F.col("stem").alias("prefix")).distinct(), "index-prefixes")
    # Every stem under each of its beginnings meets the wanted ones by equality: a table of words, not of occurrences.
    beginnings = index.dictionary.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda n: F.left("stem", n))).alias("prefix"))
    hits = occurrences_of(index, beginnings.join(asked, "prefix"))
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("field") == name, w).otherwise(weight)
    often = staged(hits.groupBy("query_id", "prefix", *KEY).agg(F.sum(weight).alias("_f")), "index-frequencies")
    spread = staged(often.groupBy("query_id", "prefix").agg(F.count("*").alias("_df")), "index-spread")
    seen = index.texts.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avg")).first()
    n, average = seen.n, seen.avg or 1.0
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
    rows = often.join(spread, ["query_id", "prefix"]).join(index.texts.select(*KEY, "n_tokens"), list(KEY))
    part = idf * F.col("_f") * (K1 + 1) / (F.col("_f") + K1 * (1 - B + B * F.col("n_tokens") / average))
    scored = rows.groupBy("query_id", *KEY).agg(F.sum(part).alias("_rank"))
    return with_bonuses(index, scored, queries, title=0.0, haystack=["body", *(f for f in index.fields if f != "body")])
