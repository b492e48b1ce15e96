"""DuckDB SQL of the secret scan and the Merkle manifest."""

from __future__ import annotations

from . import secret_scan

MERKLE_SQL = r"""
        with recursive bytes as (select doc_id, lang, n_chars, text, source, coalesce(doc_id::varchar, '') as s from documents),
        crc as (select *, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i::int, 1))::bigint)),
                  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, _: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)) as c from bytes),
        parts as (select doc_id, lang, doc_id is not null and xor(c, 4294967295) % 7 = 0 as chosen,
                  coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as a,
                  coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as n, coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as n1, coalesce(strlen(text) || ':' || text, '-') as t from crc),
        leaves as (select doc_id, coalesce('=' || lang, '') as tree, sha256(a || n || t) as leaf, case when chosen then sha256(a || n1 || t) else sha256(a || n || t) end as start from parts),
        placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from leaves),
        nodes as (select 0 as level, tree, i, n, leaf as h from placed
                  union all select level + 1, tree, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by level, tree, i // 2),
        subroots as (select tree, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from nodes where n = 1),
        tops as (select 0 as level, i, n, h from subroots
                 union all select level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by i)) from tops where n > 1 group by level, i // 2),
        lows as (select tree, max(level) as height from nodes group by tree),
        every as (select tree, level, i, n, h from nodes where n > 1 union all select tree, height + level, t.i, t.n, t.h from tops t cross join lows where t.n > 1),
        walk as (select p.doc_id, p.tree, p.i as place, 0 as level, p.i as i, p.start as h, '' as proof, s.i as si, height from placed p join lows using (tree) join subroots s using (tree)
                 union all select w.doc_id, w.tree, w.place, w.level + 1, case when w.level + 1 = height then w.si else w.i // 2 end,
                   sha256(case when e.h is null then w.h when w.i % 2 = 0 then w.h || e.h else e.h || w.h end), w.proof || coalesce(e.h, ''), w.si, w.height
                 from walk w join (select distinct tree, level from every) x on x.tree = w.tree and x.level = w.level left join every e on e.tree = w.tree and e.level = w.level and e.i = xor(w.i, 1)),
        ends as (select * from walk qualify row_number() over (partition by tree, place order by level desc) = 1),
        root as (select h as root from tops where n = 1)
        select p.doc_id, p.leaf, s.h as subroot, root, sha256(proof) as proof_sha256, e.h as folded_root, e.h = root as verified
        from placed p join ends e on e.tree = p.tree and e.place = p.i join subroots s on s.tree = p.tree cross join root"""


def _either(word: str) -> str:
    """A pattern for a word in either case, without case folding."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secret_sql() -> str:
    """The scan with windows counted one by one."""
    words = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [rf"""({words})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    patterns[0] = patterns[0].replace('\\"', '"')
    pieces = lambda name, source, pattern: f"""{name} as (select doc_id, i, gap, hit, sum(length(gap)) over w + coalesce(sum(length(hit)) over (w rows between unbounded preceding and 1 preceding), 0) as s
            from (select doc_id, unnest(string_split_regex(t, '{pattern}')) as gap, unnest(regexp_extract_all(t, '{pattern}')) as hit, unnest(range(length(string_split_regex(t, '{pattern}')))) as i from {source})
            window w as (partition by doc_id order by i))"""
    ctes, texts = ["t0 as (select doc_id, coalesce(text, '') as t from documents)"], "t0"
    for k, (kind, p) in enumerate(zip(secret_scan.KINDS, patterns)):
        long_enough = f"length(regexp_extract(hit, '{p}', {kind.group})) >= {kind.least}" if kind.group else f"length(hit) >= {kind.least}"
        ctes.append(pieces(f"p{k}", "t0", p))
        ctes.append(f"b{k} as (select doc_id, s, {k} as kind, s + length(hit) as e from p{k} where hit is not null and {long_enough})")
        ctes.append(pieces(f"q{k}", texts, p))
        ctes.append(f"t{k + 1} as (select doc_id, string_agg(gap || case when hit is not null and {long_enough} then repeat(' ', length(hit)) else coalesce(hit, '') end, '' order by i) as t from q{k} group by doc_id)")
        texts = f"t{k + 1}"
    w, classes = secret_scan.WINDOW, secret_scan.CLASSES
    sums = ", ".join(map(str, secret_scan.parts_of_sum()))
    count = lambda names: "sum(case when " + " or ".join(f"contains('{classes[n]}', ch)" for n in names) + " then c else 0 end)"
    hot = " or ".join(f"(sum(([{sums}])[c + 1]) <= {secret_scan.most_sum(a.bits)} and {count([n for n in classes if n not in a.classes]) if len(a.classes) < len(classes) else '0'} = 0" + "".join(f" and {count(g)} >= {least}" for g, least in a.least) + ")" for a in secret_scan.ALPHABETS)
    allowed = secret_scan.ALLOWED
    ctes += [
        pieces("q", texts, secret_scan.CANDIDATE.pattern),
        f"c as (select * from q where hit is not null and not regexp_matches(hit, '{allowed}') and not ends_with(gap, '{secret_scan.ALLOWED_BEFORE}'))",
        f"windows as (select doc_id, i, s, unnest(range(length(hit) - {w - 1})) as k, hit from c)",
        f"chars as (select doc_id, i, s, k, ch, count(*) as c from (select doc_id, i, s, k, unnest(string_split(substr(hit, k::int + 1, {w}), '')) as ch from windows) group by all)",
        f"hot as (select doc_id, i, s, k from chars group by all having {hot})".replace("group by all having", "group by doc_id, i, s, k having"),
        f"marked as (select *, coalesce(k - lag(k) over (partition by doc_id, i order by k) > {w}, true)::int as fresh from hot)",
        "isles as (select *, sum(fresh) over (partition by doc_id, i order by k) as isle from marked)",
        f"added as (select doc_id, s + min(k) as s, {len(patterns)} as kind, s + max(k) + {w} as e from isles group by doc_id, i, s, isle)",
        "base as (" + " union all ".join(f"select * from b{k}" for k in range(len(patterns))) + ")",
        "spans as (select * from base union all select * from added)",
        f"names(kind, name) as (values {', '.join(f'({k}, {chr(39)}{n}{chr(39)})' for k, n in enumerate([*(x.name for x in secret_scan.KINDS), secret_scan.ADDED]))})",
        f"told as (select doc_id, string_agg(name || ':' || s || ':' || e, ',' order by s, kind, e) as spans, coalesce(string_agg(name || ':' || s || ':' || e, ',' order by s, kind, e) filter (kind < {len(patterns)}), '') as base, "
        + ", ".join(f"count(*) filter (kind = {k}) as n{k}" for k in range(len(patterns) + 1))
        + " from spans join names using (kind) group by doc_id)",
    ]
    counts = ", ".join(f"coalesce(n{k}, 0) as n_{n}" for k, n in enumerate([*(x.name for x in secret_scan.KINDS), secret_scan.ADDED]))
    return "with " + ",\n        ".join(ctes) + f"\n        select doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t0 left join told using (doc_id)"
