"""Registered queries of the whole chunker and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from . import frames

#: Regions derived from a body's length n: kind, where it begins (a share of n), its size, and which documents have it.
REGIONS = [("table", 5, 700, 3), ("table_caption", 4, 300, 3), ("figure", 2, 2500, 4), ("paragraph", 3, 400, 2), ("equation", 7, 40, 5), ("figure_caption", 1, 100, 6)]


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), F.floor(F.col("n") / share).cast("int").alias("start"), F.lit(size).alias("size"), (F.col("doc_id") % every == 0).alias("has")) for kind, share, size, every in REGIONS))
    return docs.select("doc_id", F.explode(F.filter(made, lambda r: r["has"])).alias("r")).select("doc_id", "r.kind", "r.start", (F.col("r.start") + F.col("r.size")).alias("end"))


def _chunks(spark: SparkSession, sf_dir: str, boundary: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = chunking.chunked(docs, layout_regions(spark, sf_dir), chunking.Policy(boundary=boundary))
    return made.select("doc_id", "chunk_index", "start", "end", "protected", "text_hash", "chunk_id", "tokens", "locator")


def protected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph windows around and within protected ranges."""
    return _chunks(spark, sf_dir, "paragraph")


def protected_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "line")


def protected_char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "character")


QUERIES = {"protected_chunks": protected_chunks, "protected_line_chunks": protected_line_chunks, "protected_char_chunks": protected_char_chunks}


def _sql(separator: str | None) -> str:
    regions = " union all ".join(f"select doc_id, '{kind}' as kind, n // {share} as s, n // {share} + {size} as e from docs where doc_id % {every} = 0" for kind, share, size, every in REGIONS)
    kinds = ", ".join(f"'{k}'" for k in chunking.PROTECTED_KINDS)
    p, ws = chunking.Policy(), "[ \\t\\n\\x0B\\f\\r]"
    step = p.most - p.overlap
    cut = lambda a, b: f"list_transform(range(0, greatest(ceil(({b} - {a} - {p.most}) / {step}.0), 0)::bigint + 1), lambda i: {{'s': {a} + i * {step}, 'e': least({a} + i * {step} + {p.most}, {b})}})"
    full = f"x.at + x.len - acc.s > {p.most} and acc.e - acc.s >= {p.least}"
    full = full.replace("x.at", "acc.at")
    fold = f"""list_reduce(list_prepend({{'s': -1::bigint, 'e': 0::bigint, 'at': s, 'len': 0::bigint, 'out': []::struct(s bigint, e bigint)[]}},
        list_transform(string_split(substr(text, s + 1, e - s), {separator}), lambda q: {{'s': 0::bigint, 'e': 0::bigint, 'at': 0::bigint, 'len': length(q)::bigint, 'out': []::struct(s bigint, e bigint)[]}})),
        lambda acc, x: {{'s': case when acc.s < 0 then acc.at when {full} then greatest(acc.s, acc.at - {p.overlap}) else acc.s end, 'e': acc.at + x.len, 'at': acc.at + x.len + length({separator}), 'len': 0::bigint,
          'out': case when acc.s >= 0 and {full} then list_append(acc.out, {{'s': acc.s, 'e': acc.at}}) else acc.out end}})"""
    packed = f"select doc_id, s, e, protected, text, list_append(f.out, {{'s': f.s, 'e': f.e}}) as ws from (select *, {fold} as f from large)" if separator else f"select doc_id, s, e, protected, text, {cut('s', 'e')} as ws from large"
    fits = lambda a, b: f"(not ({a}.p and {b}.p) and greatest({a}.e, {b}.e) - least({a}.s, {b}.s) <= {p.most} and ({a}.e >= {b}.s or not regexp_matches(substr(text, {a}.e + 1, greatest({b}.s - {a}.e, 0)), '[^ \\t\\n\\x0B\\f\\r]')))"
    join = lambda a, b: f"{{'s': least({a}.s, {b}.s), 'e': greatest({a}.e, {b}.e), 'p': {a}.p or {b}.p}}"
    small = lambda x: f"length(regexp_replace(substr(text, {x}.s + 1, {x}.e - {x}.s), '^{ws}+|{ws}+$', '', 'g')) < {p.least}"
    kind = "struct(s bigint, e bigint, p boolean)"
    return (
        f"""with recursive docs as (select doc_id, text, length(text)::bigint as n from documents where regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')),
  regions as ({regions}),
  good as (select doc_id, s, e from regions join docs using (doc_id) where kind in ({kinds}) and e > s and s < n),
  reach as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as r from good),
  isles as (select doc_id, isle, min(s) as s, max(e) as e from (select *, sum(case when r is null or s > r then 1 else 0 end) over (partition by doc_id order by s, e rows unbounded preceding) as isle from reach) group by doc_id, isle),
  edges as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before, row_number() over (partition by doc_id order by s desc) as back from isles),
  segments as (select doc_id, s, e, true as protected from isles union all select doc_id, before, s, false from edges union all select doc_id, e, n, false from edges join docs using (doc_id) where back = 1 union all select doc_id, 0, n, false from docs where doc_id not in (select doc_id from isles)),
  cut as (select doc_id, s::bigint as s, least(e, n)::bigint as e, protected, text from segments join docs using (doc_id) where s < least(e, n)),
  large as (select * from cut where e - s > {p.most}),
  made as (select doc_id, protected, unnest(ws) as w, text from ({packed}) union all select doc_id, protected, {{'s': s, 'e': e}}, text from cut where e - s <= {p.most}),
  split as (select doc_id, protected, unnest(case when w.e - w.s > {p.most} then {cut("w.s", "w.e")} else [{{'s': w.s, 'e': w.e}}] end) as w, text from made),
  shown as (select doc_id, protected, w.s as s, w.e as e, substr(text, w.s + 1, w.e - w.s) as t, text from split),
  flat as (select *, trim(regexp_replace(regexp_replace(t, '[ \\t\\f\\x0B]+', ' ', 'g'), '\\n+', ' ', 'g')) as z from shown where regexp_matches(t, '[^ \\t\\n\\x0B\\f\\r]')),
  telling as (select * from flat where not (length(trim(t)) < {p.least} and (z = '' or regexp_matches(z, '^[0-9\\s\\x0B.()-]+$') or regexp_matches(z, '^[_\\-=\\s\\x0B]{{3,}}$') or regexp_matches(z, '(?i)^page\\s+[0-9]+(?:\\s+of\\s+[0-9]+)?$')
     or regexp_matches(z, '(?i)^[0-9]+\\.?\\s+table of contents(?:\\s*\\|.*)?$') or regexp_matches(z, '(?i)^[0-9]+\\s+part\\s+[ivxlcdm]+\\s+item\\s+[0-9]+[a-z]?$')))),
  lists as (select doc_id, any_value(text) as text, list({{'s': s, 'e': e, 'p': protected}} order by s, e) as ws from telling group by doc_id),
  numbered as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as k, len(ws) as size from lists),
  walk as (select doc_id, 0 as k, []::{kind}[] as out, null::{kind} as wait from lists
    union all select doc_id, k, case when back then list_append(out[:len(out) - 1], {join("out[len(out)]", "x")}) when small then out else list_append(out, x) end, case when small and not back then x end
    from (select *, small and len(out) > 0 and coalesce({fits("out[len(out)]", "x")}, false) as back
      from (select *, {small("x")} as small
        from (select a.doc_id, n.k, text, case when a.wait is not null and {fits("a.wait", "n.w")} then {join("a.wait", "n.w")} else n.w end as x, case when a.wait is not null and not {fits("a.wait", "n.w")} then list_append(a.out, a.wait) else a.out end as out
          from walk a join numbered n on n.doc_id = a.doc_id and n.k = a.k + 1 join lists l on l.doc_id = a.doc_id)))),
  done as (select doc_id, case when wait is not null then list_append(out, wait) else out end as ws from walk qualify row_number() over (partition by doc_id order by k desc) = 1),
  final as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from done where len(ws) <= {p.most_chunks}),
  hashed as (select doc_id, i::int as chunk_index, w.s::int as s, w.e::int as e, w.p as protected, substr(text, w.s + 1, w.e - w.s) as t from final join docs using (doc_id))
  select doc_id, chunk_index, s as start, e as "end", protected, sha256(t) as text_hash, 'chunk_' || sha256(doc_id || ':' || chunk_index || ':' || sha256(t)) as chunk_id, greatest(1, ceil(length(t) / 4.0))::bigint as tokens, 'chars ' || s || '-' || e as locator from hashed"""
    )


ORACLES = {"protected_chunks": _sql("(chr(10) || chr(10))"), "protected_line_chunks": _sql("chr(10)"), "protected_char_chunks": _sql(None)}
