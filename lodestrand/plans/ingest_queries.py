"""Queries of normalisation, chunking, flags, parsing and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REDACTIONS, half_up, redaction, safety_flags
from ..operators import ingest
from . import frames


def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.chunks(spark, sf_dir).select("doc_id", "chunk_index", "start", "end", "text_hash", "chunk_id")


def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = ingest.packed(frames.table(spark, sf_dir, "documents"), "\n")
    return packed.select("doc_id", "chunk_index", "start", "end", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_hash"))


def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.neighbours(frames.chunks(spark, sf_dir))


def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by kind and how many chunks were looked at."""
    chunks, docs = frames.chunks(spark, sf_dir), frames.documents(spark, sf_dir)
    found = ingest.chunk_problems(chunks, docs).groupBy("problem").agg(F.count("*").alias("n"))
    return found.unionByName(chunks.agg(F.count("*").alias("n")).select(F.lit("checked").alias("problem"), "n"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line locators of all windows."""
    return ingest.line_locators(frames.chunks(spark, sf_dir))


def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = frames.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.groupBy("doc_id").agg(F.count_if(ingest.furniture(F.col("text"))).alias("n_furniture"), F.count("*").alias("n_lines"))


def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.chunks(spark, sf_dir).select("chunk_id", F.array_join(safety_flags(F.col("text")), ",").alias("flags"))


def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five classes, in order."""
    found = frames.table(spark, sf_dir, "documents").select("doc_id", redaction(F.coalesce("text", F.lit(""))).alias("r"))
    return found.select("doc_id", F.sha2(F.encode("r.out", "UTF-8"), 256).alias("redacted_sha256"), F.col("r.n").alias("n_redacted"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.index_stats(frames.chunks(spark, sf_dir))


def doc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.classified(frames.documents(spark, sf_dir))
    return found.withColumn("confidence", half_up(F.col("confidence"), 2))


def corpus_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.normalised(frames.documents(spark, sf_dir), ["trusted_internal", "verified_partner", "user_provided", "generated_or_derived"], ["en", "fr", "de"])
    return out.select("doc_id", "checksum", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "pages").select("page_id", F.sha2(F.encode(ingest.html_text(F.coalesce("html", F.lit(""))), "UTF-8"), 256).alias("text_sha256"))


def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.delimited_rows(frames.table(spark, sf_dir, "documents"), "|")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum(F.length("cells")).alias("n_chars"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.markdown_blocks(frames.table(spark, sf_dir, "documents")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (char_chunks, packed_chunks, chunk_neighbours, chunk_validation, chunk_lines, furniture, safety, redact_pii, index_stats, doc_classify, corpus_normalize, html_text, delimited_rows, markdown_blocks)}

_FLAGS = r"""array_to_string(list_filter([
    case when contains(lower(text), 'ignore previous instructions') or contains(lower(text), 'ignore all previous instructions') or contains(lower(text), 'system prompt') or contains(lower(text), 'developer message')
      or contains(lower(text), 'reveal your instructions') or contains(lower(text), 'do not obey') then 'possible_prompt_injection' end,
    case when regexp_matches(text, '(?i)(api[_-]?key|bearer[\t\n\r ]+[a-z0-9._-]{12,}|password[\t\n\r ]*=|sk_live_[a-z0-9]+)') or regexp_matches(text, 'BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY') then 'secret_like_text' end,
    case when regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') then 'sensitive_personal_data' end], lambda x: x is not null), ',')"""
_SIGNALS = ", ".join(f"case when regexp_matches(low, '{p}') then '{s}' end" for s, p in ingest.SIGNALS.items())
_TYPES = " ".join("when " + " and ".join(([f"list_contains(s, '{g}')"] if g else []) + ([f"regexp_matches(low, '{p}')"] if p else [])) + f" then '{n}'" for n, g, p in ingest.TYPES)


def _redaction_sql() -> str:
    """One common table expression a class: the text so far and how many matches there were."""
    steps, last = ["r0 as (select doc_id, coalesce(text, '') as t, 0 as n from documents)"], "r0"
    for k, (name, pattern) in enumerate(REDACTIONS, 1):
        steps.append(f"r{k} as (select doc_id, regexp_replace(t, '{pattern}', '[REDACTED:{name}]', 'g') as t, n + len(regexp_extract_all(t, '{pattern}')) as n from {last})")
        last = f"r{k}"
    return f"with {', '.join(steps)} select doc_id, sha256(t) as redacted_sha256, n::bigint as n_redacted from {last}"


ORACLES = {
    "char_chunks": f'with {frames.CHUNKS} select doc_id, chunk_index, "start"::int as "start", "end"::int as "end", text_hash, chunk_id from chunks',
    "chunk_neighbours": f"""with {frames.CHUNKS}, n as (select doc_id, chunk_id as from_chunk, lag(chunk_id) over d as p, lead(chunk_id) over d as q from chunks window d as (partition by doc_id order by chunk_index))
        select doc_id, from_chunk, q as to_chunk, 'next' as kind, 0.82::double as weight from n where q is not null union all select doc_id, from_chunk, p, 'previous', 0.82 from n where p is not null""",
    "chunk_validation": f"with {frames.CHUNKS} select 'checked' as problem, count(*) as n from chunks",
    "chunk_lines": f"""with {frames.CHUNKS}, l as (select c.doc_id, chunk_index, substr(d.text, 1, "start"::int) as a, substr(d.text, 1, "end"::int) as b from chunks c join documents d using (doc_id))
        select doc_id, chunk_index, 'lines:' || (length(a) - length(replace(a, chr(10), '')) + 1) || '-' || (length(b) - length(replace(b, chr(10), '')) + 1) as locator from l""",
    "furniture": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t from documents), f as (select *, trim(regexp_replace(regexp_replace(t, '[ \t\f\x0B]+', ' ', 'g'), '\n+', ' ', 'g')) as s from l)
        select doc_id, count(*) filter (length(trim(t)) < 120 and (s = '' or regexp_matches(s, '^[0-9\t\n\x0B\f\r .()-]+$') or regexp_matches(s, '^[_\-=\t\n\x0B\f\r ]{3,}$') or regexp_matches(s, '(?i)^page[\t\n\r ]+[0-9]+(?:[\t\n\r ]+of[\t\n\r ]+[0-9]+)?$')
            or regexp_matches(s, '(?i)^[0-9]+\.?[\t\n\r ]+table of contents(?:[\t\n\r ]*\|.*)?$') or regexp_matches(s, '(?i)^[0-9]+[\t\n\r ]+part[\t\n\r ]+[ivxlcdm]+[\t\n\r ]+item[\t\n\r ]+[0-9]+[a-z]?$'))) as n_furniture, count(*) as n_lines from f group by doc_id""",
    "safety": f"with {frames.CHUNKS} select chunk_id, {_FLAGS} as flags from chunks",
    "redact_pii": _redaction_sql(),
    "index_stats": f"with {frames.CHUNKS} select namespace, trust_tier, count(*) as n_chunks, count(distinct doc_id) as n_documents, count(distinct source_id) as n_sources, count(*) filter ({_FLAGS} <> '') as n_flagged from chunks group by all",
    "doc_classify": f"""with {frames.DOCS}, l as (select doc_id, lower(title || chr(10) || coalesce(text, '')) as low from docs), s as (select *, list_filter([{_SIGNALS}], lambda x: x is not null) as s from l), k as (select *, case {_TYPES} else 'generic_document' end as doc_type from s)
        select doc_id, doc_type, floor((case when doc_type = 'generic_document' then 0.45 else least(0.95, 0.65 + 0.06 * len(s)) end)::double * 100 + 0.5) / 100 as confidence, array_to_string(s, ',') as signals from k""",
    "corpus_normalize": f"""with {frames.DOCS} select doc_id, sha256(coalesce(text, '')) as checksum, case when trim(coalesce(source_id, '')) = '' then 'missing_source' when trim(coalesce(text, '')) = '' then 'empty_body'
        when namespace not in ('en', 'fr', 'de') then 'namespace_not_declared' when trust_tier in ('external_untrusted', 'unknown') then 'trust_tier_not_allowed' else 'accepted' end as reason from docs""",
    "html_text": r"""with a as (select page_id, regexp_replace(coalesce(html, ''), '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>', ' ', 'g') as t from pages),
        b as (select page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(p|div|section|article|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|br|nav|header|footer)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') as t from a),
        c as (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from b),
        d as (select page_id, regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g') as t from c)
        select page_id, sha256(regexp_replace(t, '^[ \n]+|[ \n]+$', '', 'g')) as text_sha256 from d""",
    "markdown_blocks": r"""with l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as t from documents)
        select doc_id, case when regexp_matches(t, '^#{1,6} ') then 'heading' when regexp_matches(t, '^ *\|?[ :-]*-[ :|-]*\|[ :|-]*$') then 'table_rule' when contains(t, '|') then 'table_row' else 'paragraph' end as kind, count(*) as n from l where trim(t) <> '' group by all""",
}
