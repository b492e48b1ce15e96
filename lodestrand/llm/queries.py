"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, merkle, pii, preferences, quality, runs, scan_sql, secret_scan, simhash, token_shards, toxicity, urls
from .shared import shared_folder, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("broken_rules")


#: The rules of op2: host/path and action.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return urls.filtered(table(spark, sf_dir, "pages"), rules)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.formatted(preferences.swapped_responses(table(spark, sf_dir, "conversations")))
    sha = lambda c: F.sha2(F.encode(F.col(c), "UTF-8"), 256).alias(f"{c}_sha256")
    mask = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["n_chars"].cast("string"), m["train"].cast("int").cast("string"))), ",").alias(c)
    return pairs.select("conv_id", "n_prompt_turns", sha("prompt"), sha("chosen"), mask("chosen_mask"), sha("rejected"), mask("rejected_mask"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards, then read them back in slot order."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    rows = token_shards.materialised(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scored(docs, toxicity.train(docs, labels))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.with_repeats(table(spark, sf_dir, "documents")))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_preference_format": op4_preference_format,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_shards": op7_token_shards,
    "op8_toxicity": op8_toxicity,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scans": op12_secret_scans,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op12_secret_scans": scan_sql.secret_sql(),
    "op13_merkle_manifest": scan_sql.MERKLE_SQL,
    "op2_url_filters": r"""
        with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        parts as (select page_id, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
        rules(rule, action, h, p) as (values ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
        best as (select page_id, max_by(rule, length(rule)) as rule, max_by(action, length(rule)) as action
                 from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
        select page_id, host, path, rule, coalesce(action, 'allow') as verdict from parts left join best using (page_id)""",
    "op4_preference_format": r"""
        with t as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        last as (select conv_id, max(i) as li, max_by(text, i) as answer from t where role = 'assistant' group by conv_id),
        pair as (select a.conv_id, a.li, b.answer from last a join last b on b.conv_id = xor(a.conv_id, 1)),
        both_sides as (select conv_id, i, role, text as chosen, case when i = li then answer else text end as rejected from t join pair using (conv_id)),
        cut as (select *, coalesce(min(case when chosen <> rejected then i end) over (partition by conv_id) - 1, count(*) over (partition by conv_id)) as n from both_sides),
        r as (select *, '<|' || role || '|>' || chr(10) || chosen || chr(10) as c, '<|' || role || '|>' || chr(10) || rejected || chr(10) as j, ':' || case when role = 'assistant' then '1' else '0' end as m from cut)
        select conv_id, any_value(n)::int as n_prompt_turns, sha256(coalesce(string_agg(c, '' order by i) filter (i <= n), '')) as prompt_sha256,
               sha256(coalesce(string_agg(c, '' order by i) filter (i > n), '')) as chosen_sha256, coalesce(string_agg(length(c) || m, ',' order by i) filter (i > n), '') as chosen_mask,
               sha256(coalesce(string_agg(j, '' order by i) filter (i > n), '')) as rejected_sha256, coalesce(string_agg(length(j) || m, ',' order by i) filter (i > n), '') as rejected_mask
        from r group by conv_id""",
    "op1_quality_rules": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words, coalesce(text, '') as text from documents),
        pos as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
        win as (select doc_id, i, word || ' ' || lead(word, 1) over d || ' ' || lead(word, 2) over d as g from pos window d as (partition by doc_id order by i)),
        rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win where g is not null) where n > 1),
        cov as (select doc_id, count(distinct i + k) as n_repeat_words from rep cross join (values (0), (1), (2)) o(k) group by doc_id),
        lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines, count(*) as n_lines
                  from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
        stops as (select doc_id, count(*) as n_stop from pos where word in (STOPS) group by doc_id),
        m as (select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, length(regexp_replace(text, '[^!]', '', 'g')) as n_bang,
                     coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_stop, 0) as n_stop
              from w left join cov using (doc_id) left join lines using (doc_id) left join stops using (doc_id)),
        j as (select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed, greatest(n_words, 1) as d from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and n_words <= 1000000 and word_chars / d >= 2.5 and word_chars / d <= 12.0 and n_symbols / d <= 0.10
               and n_bang / d <= 0.10 and n_stop / d >= 0.02 and n_dup_lines / greatest(n_lines, 1) <= 0.40 as kept
        from j""".replace("\\\\", "\\").replace("STOPS", ", ".join(f"'{w}'" for w in quality.stop_forms())),
}
