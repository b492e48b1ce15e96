"""From raw records to chunks: normalisation, windows, flags, neighbours, statistics, parsing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import of_words, safety_flags
from .access import trust_rank

MOST_CHARS, OVERLAP, LEAST_CHARS = 1800, 180, 120
#: Characters of the blocks from which slices are put together.
BLOCK = 2048
#: What short windows look like that carry no information.
FURNITURE = [r"^[\d\s.()-]+$", r"^[_\-=\s]{3,}$", r"(?i)^page\s+\d+(?:\s+of\s+\d+)?$", r"(?i)^\d+\.?\s+table of contents(?:\s*\|.*)?$", r"(?i)^\d+\s+part\s+[ivxlcdm]+\s+item\s+\d+[a-z]?$"]
#: Signals of a document's type, and the types in the order in which they are tried.
SIGNALS = {
    "cap_table_terms": r"\b(cap table|capitalization table|fully diluted|shares outstanding|ownership percentage)\b",
    "entity_formation_terms": r"\b(incorporat|formation|articles of organization|certificate of formation|registered in)\b",
    "financial_metric_terms": r"\b(revenue|ebitda|assets|liabilities|cash flow|balance sheet|income statement)\b",
    "ownership_terms": r"\b(ownership|owns|owned by|shareholder|member interest|subsidiar|parent company)\b",
    "support_policy_terms": r"\b(refund|support|escalat|ticket|customer|policy)\b",
    "trust_terms": r"\b(trustee|beneficiar|settlor|grantor|trust deed|deed of trust)\b",
}
TYPES = [
    ("shareholder_agreement", None, r"\b(shareholder agreement|stockholder agreement)\b"),
    ("operating_agreement", None, r"\b(operating agreement|limited liability company agreement|llc agreement)\b"),
    ("incorporation", "entity_formation_terms", r"\b(articles|certificate|incorporat|formation)\b"),
    ("trust_deed", "trust_terms", None), ("cap_table", "cap_table_terms", None),
    ("financial_statement", "financial_metric_terms", None), ("support_policy", "support_policy_terms", None),
]


def pieces(text: Column, size: int) -> Column:
    """The text cut into runs of `size` characters, in one pass over it; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def slice_of(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start .. end of the text that was cut into pieces of BLOCK; only the blocks that the slice touches are looked at."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.floor((F.greatest(end, start + 1) - 1) / BLOCK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(blocks, first + 1, count), ""), (start % BLOCK).cast("int") + 1, (end - start).cast("int"))


def char_chunks(docs: DataFrame, most: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per window of `most` characters that overlaps the one before; the last ends with the body. Empty bodies have none.

    A body is cut once into runs of the step between windows, and a window is put
    together from the runs it covers, so the time is linear in the body.
    """
    step = max(1, most - overlap)
    n = F.length("text")
    last = F.greatest(F.ceil((n - most) / step), F.lit(0)).cast("int")
    rest = [c for c in docs.columns if c != "text"]
    cut = docs.where(n > 0).select(*rest, last.alias("_last"), pieces(F.col("text"), step).alias("_runs"))
    follow = lambda i: [F.substring(F.coalesce(F.get("_runs", i + k), F.lit("")), 1, min(step, most - k * step)) for k in range(1, -(-most // step))]
    made = F.transform(F.slice("_runs", 1, F.col("_last") + 1), lambda run, i: F.concat(run, *follow(i)))
    rows = cut.select(*rest, F.posexplode(made).alias("chunk_index", "text"))
    rows = rows.withColumn("start", F.col("chunk_index") * step).withColumn("end", F.col("start") + F.length("text")).withColumn("text_hash", F.sha2(F.encode("text", "UTF-8"), 256))
    return rows.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.sha2(F.encode(F.concat_ws(":", "doc_id", "chunk_index", "text_hash"), "UTF-8"), 256)))


def line_locators(chunks: DataFrame, most: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, locator): the 1-based lines that the windows of char_chunks begin and end in.

    Line feeds are counted within each window and added up over a document's
    windows, of which only numbers are shuffled; no window looks at the body again.
    """
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    counted = chunks.select("doc_id", "chunk_index", feeds(F.substring("text", 1, max(1, most - overlap))).alias("_step"), feeds(F.col("text")).alias("_own"))
    before = F.coalesce(F.sum("_step").over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return counted.select("doc_id", "chunk_index", F.concat(F.lit("lines:"), before, F.lit("-"), before + F.col("_own")).alias("locator"))


def furniture(text: Column, least: int = LEAST_CHARS) -> Column:
    """Whether a window is short and only a page number, a rule, a contents line or the like."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\f\x0B]+", " "), r"\n+", " "))
    like = flat == ""
    for pattern in FURNITURE:
        like = like | F.rlike(flat, F.lit(pattern))
    return (F.length(F.trim(text)) < least) & like


def packed(docs: DataFrame, separator: str = "\n\n", most: int = MOST_CHARS, overlap: int = OVERLAP, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, chunk_index, start, end, text): parts between separators packed to windows; a part beyond `most` is cut by characters.

    The next window begins where the last ended less `overlap`, not before the last one's start. A short window joins the one before it where both fit.
    """

    def windows_of(body: str) -> list[tuple[int, int]]:
        parts, at = [], 0
        for piece in body.split(separator):
            parts.append((at, at + len(piece)))
            at += len(piece) + len(separator)
        out, start, end = [], None, None
        for a, b in parts:
            if start is None:
                start = a
            elif b - start > most and end - start >= least:
                out.append((start, end))
                start = min(max(start, end - overlap), a)
            end = b
        if start is not None and end > start:
            out.append((start, end))
        cut = []
        for a, b in out:
            while b - a > most:
                cut.append((a, a + most))
                a += max(1, most - overlap)
            cut.append((a, b))
        merged: list[tuple[int, int]] = []
        for a, b in cut:
            if merged and (b - a < least or merged[-1][1] - merged[-1][0] < least) and b - merged[-1][0] <= most and not body[merged[-1][1] : a].strip():
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def work(frames):
        for frame in frames:
            rows = [(d, k, a, b, t[a:b]) for d, t in zip(frame["doc_id"], frame["text"]) if t for k, (a, b) in enumerate(windows_of(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id long, chunk_index int, start long, end long, text string")


def neighbours(chunks: DataFrame, weight: float = 0.82) -> DataFrame:
    """Next and previous relations between the chunks of a document."""
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    near = chunks.select("doc_id", "chunk_id", F.lag("chunk_id").over(by).alias("previous"), F.lead("chunk_id").over(by).alias("next"))
    ends = near.select("doc_id", F.col("chunk_id").alias("from_chunk"), F.explode(F.array(F.struct(F.lit("next").alias("kind"), F.col("next").alias("to_chunk")), F.struct(F.lit("previous").alias("kind"), F.col("previous").alias("to_chunk")))).alias("e"))
    return ends.where("e.to_chunk is not null").select("doc_id", "from_chunk", "e.to_chunk", "e.kind", F.lit(weight).alias("weight"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """Counts by namespace and trust tier."""
    flagged = F.size(safety_flags(F.col("text"))) > 0
    return chunks.groupBy("namespace", "trust_tier").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("source_id").alias("n_sources"), F.count_if(flagged).alias("n_flagged")
    )


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_type, confidence, signals) from the patterns above, in title and body."""
    low = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    found = F.array_compact(F.array(*(F.when(F.rlike("_low", F.lit(of_words(p))), F.lit(s)) for s, p in SIGNALS.items())))
    shown = docs.select("doc_id", low.alias("_low")).withColumn("signals", found)
    kind = None
    for name, signal, pattern in TYPES:
        test = F.lit(True)
        if signal:
            test = test & F.array_contains("signals", signal)
        if pattern:
            test = test & F.rlike(F.col("_low"), F.lit(of_words(pattern)))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    out = shown.withColumn("doc_type", kind.otherwise("generic_document"))
    sure = F.when(F.col("doc_type") == "generic_document", F.lit(0.45)).otherwise(F.least(F.lit(0.95), F.lit(0.65) + F.size("signals") * F.lit(0.06)))
    return out.select("doc_id", "doc_type", sure.alias("confidence"), F.array_join("signals", ",").alias("signals"))


def normalised(records: DataFrame, allowed_tiers: list[str], namespaces: list[str]) -> DataFrame:
    """records with checksum and reason: the first rule that rejects each, null where it is accepted."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = (
        F.when(blank("doc_id"), "missing_id").when(blank("source_id"), "missing_source").when(blank("text"), "empty_body")
        .when(~F.col("namespace").isin(namespaces), "namespace_not_declared").when(~F.col("trust_tier").isin(allowed_tiers), "trust_tier_not_allowed")
    )
    return records.withColumns({"checksum": F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256), "reason": reason, "trust_rank": trust_rank(F.col("trust_tier"))})


def upserted(stored: DataFrame, incoming: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """Stored rows with incoming ones in place of those of the same key, or the other way round."""
    old, new = (stored, incoming) if overwrite else (incoming, stored)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def chunk_problems(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(chunk_id, problem): chunks without document, with a repeated id, a wrong slice or a wrong hash.

    A body meets the spans of its chunks once, as one list, and is cut into blocks
    once; slices are compared by hash. So the time is linear in bodies and chunks.
    """
    own = F.sha2(F.encode("text", "UTF-8"), 256)
    spans = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", "start", "end", "text_hash", own.alias("own"))).alias("_spans"))
    parents = docs.select("doc_id", pieces(F.coalesce("text", F.lit("")), BLOCK).alias("_blocks"), F.lit(True).alias("_known"))
    joined = spans.join(parents, "doc_id", "left")
    wrong = lambda s: (s["start"] < 0) | (s["end"] < s["start"]) | (F.sha2(F.encode(slice_of(F.col("_blocks"), s["start"], s["end"]), "UTF-8"), 256) != s["own"])
    problems = lambda s: F.array_compact(
        F.array(
            F.when(F.col("_known").isNull(), F.lit("missing_document")).when(wrong(s), F.lit("range_mismatch")),
            F.when(s["own"] != s["text_hash"], F.lit("hash_mismatch")),
        )
    )
    judged = joined.select(F.explode(F.filter(F.transform("_spans", lambda s: F.struct(s["chunk_id"].alias("chunk_id"), problems(s).alias("problems"))), lambda x: F.size(x["problems"]) > 0)).alias("x"))
    found = judged.select("x.chunk_id", F.explode("x.problems").alias("problem"))
    repeated = chunks.groupBy("chunk_id").agg(F.count("*").alias("_n")).where("_n > 1")
    return found.unionByName(repeated.select("chunk_id", F.lit("duplicate_id").alias("problem")))


def html_text(html: Column) -> Column:
    """Markup to searchable text, by a chain of replacements."""
    out = html
    for pattern, by in (
        (r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>", " "), (r"(?s)<!--.*?-->", " "),
        (r"(?i)</?(p|div|section|article|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|br|nav|header|footer)\b[^>]*>", "\n"), (r"<[^>]*>", " "),
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def delimited_rows(texts: DataFrame, delimiter: str = ",") -> DataFrame:
    """(doc_id, row, cells): records of delimited text with quotes, trimmed cells joined by ' | '; blank rows go."""
    field = re.compile(rf'(?:"((?:[^"]|"")*)"|([^{re.escape(delimiter)}\n"]*))({re.escape(delimiter)}|\n|\Z)')

    def records(body: str):
        row, at, body = [], 0, body.replace("\r\n", "\n").replace("\r", "\n")
        while at <= len(body):
            m = field.match(body, at)
            if m is None:  # a stray quote: take the rest of the line as it is
                end = body.find("\n", at)
                end = len(body) if end < 0 else end
                value, mark, after = body[at:end], "\n", end + 1
            else:
                value = m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2)
                mark, after = m.group(3), m.end()
            row.append(value.strip())
            if mark != delimiter:
                if any(row):
                    yield " | ".join(row)
                row = []
                if after >= len(body):
                    return
            at = after

    def work(frames):
        for frame in frames:
            rows = [(d, k, r) for d, t in zip(frame["doc_id"], frame["text"]) if t for k, r in enumerate(records(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "row", "cells"])

    return texts.select("doc_id", "text").mapInPandas(work, "doc_id long, row int, cells string")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, line, kind, text): headings, table rows and other lines of Markdown."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).where(F.trim("text") != "")
    rule = F.rlike("text", F.lit(r"^ *\|?[ :-]*-[ :|-]*\|[ :|-]*$"))
    kind = F.when(F.rlike("text", F.lit("^#{1,6} ")), "heading").when(rule, "table_rule").when(F.contains("text", F.lit("|")), "table_row").otherwise("paragraph")
    cells = F.array_join(F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), " | ")
    return lines.select("doc_id", "line", kind.alias("kind"), F.when(kind == "table_row", cells).otherwise(F.trim(F.regexp_replace("text", "^#{1,6} ", ""))).alias("text"))


#: Types that need a layout, types whose commas are syntax, texts that speak of tables or pictures, marks of pictures.
LAYOUT_TYPES = ["application/pdf", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
MARKUP_TYPES = ["application/json", "application/x-ndjson", "application/yaml", "application/xml", "text/xml"]
TABLE_WORDS = r"(?i)\b(cap table|capitalization table|balance sheet|income statement|row total|column total)\b"
PICTURE_WORDS = r"(?i)\b(fig\.?|figure|chart|diagram|screenshot)\s*\d*\b|\b(see|shown|pictured|displayed)\s+(below|above|in|as)\b|\b(see|shown)\s+(the\s+)?(figure|chart|diagram|screenshot|image)\b"
PICTURE_MARKS = [r"(?i)<!--\s*(?:image|figure|picture|page image|diagram|chart)?\s*-->", r"(?i)<img\b[^>]*>", r"!\[[^\]]*\]\([^)]+\)", r"(?i)&nbsp;"]
#: What each risk costs of 100 points.
RISK_COSTS = {"empty_body": 50, "layout_missing_for_complex_document": 20, "table_structure_missing": 15, "visual_assets_missing": 15, "ocr_likely_needed": 35, "low_page_text_coverage": 15}


def parse_quality(parsed: DataFrame, least_coverage: float = 0.8) -> DataFrame:
    """Parser results with body_chars, risks and quality (0 to 100).

    `parsed` has body, content_type, has_layout, n_tables, n_visuals, n_pages
    and n_pages_with_text; a null body is an empty one, a null count is 0.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    layout, kind = F.coalesce(F.col("has_layout"), F.lit(False)), F.coalesce(F.col("content_type"), F.lit(""))
    plain = body
    for mark in PICTURE_MARKS:
        plain = F.regexp_replace(plain, mark, " ")
    chars = F.length(F.regexp_replace(plain, r"^\s+|\s+$", ""))
    lines = F.filter(F.transform(F.split(body, "\r?\n"), lambda line: F.trim(line)), lambda line: line != "")
    parts = F.transform(F.filter(lines, lambda line: F.contains(line, F.lit("|"))), lambda line: F.size(F.split(line, "[|]")))
    piped = (F.size(parts) >= 2) & (F.size(F.array_distinct(parts)) <= 2)
    listed = F.size(F.filter(lines, lambda line: F.size(F.split(line, ",")) >= 3)) >= 3
    tabular = piped | (~kind.isin(MARKUP_TYPES) & (listed | F.rlike(body, F.lit(TABLE_WORDS))))
    pages, with_text = count("n_pages"), count("n_pages_with_text")
    found = {
        "empty_body": F.col("body_chars") == 0,
        "layout_missing_for_complex_document": kind.isin(LAYOUT_TYPES) & ~layout,
        "table_structure_missing": tabular & (count("n_tables") == 0),
        "visual_assets_missing": F.rlike(body, F.lit(PICTURE_WORDS)) & (count("n_visuals") == 0),
        "ocr_likely_needed": (pages > 0) & (with_text == 0),
        "low_page_text_coverage": (pages > 0) & (with_text / F.nullif(pages, F.lit(0)) < least_coverage),
    }
    risks = F.array_compact(F.array(*[F.when(condition, F.lit(risk)) for risk, condition in found.items()]))
    cost = F.aggregate(F.col("risks"), F.lit(0), lambda total, risk: total + F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in RISK_COSTS.items() for v in pair]), risk), F.lit(0)))
    bonus = F.when(layout, 5).otherwise(0) + F.when(count("n_tables") > 0, 5).otherwise(0) + F.when(count("n_visuals") > 0, 5).otherwise(0) + F.when(pages > 0, 2).otherwise(0)
    return parsed.withColumn("body_chars", chars).withColumn("risks", risks).withColumn("quality", F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost + bonus)))


def parse_summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """For each group of judged parser results: how many, their mean quality, the worst, and how many have a risk."""
    return judged.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 3).alias("mean_quality"), F.min("quality").alias("worst"), F.count_if(F.size("risks") > 0).alias("n_at_risk"))
