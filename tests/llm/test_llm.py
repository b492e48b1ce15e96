"""The training-data operators against SQL, brute force, round trips and held-out rows, and on awkward rows."""

import hashlib
import importlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrand.llm import bpe, decontaminate, html_text, pii, preferences, quality, queries, simhash, token_shards, toxicity, urls
from lodestrand.llm.shared import table

SMALL, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
LONG = "word " * 60_000
AWKWARD = [(1, ""), (2, None), (None, "no id here at all"), (3, "   \n\t "), (4, LONG), (5, "same text twice over"), (5, "same text twice over"), (6, "a"), (7, "Ünïcödé İ ß \u00a0 x"), (8, "line\nline\nline\n")]
CLASH = "doc_id long, text string, _row string, _t string, _name string, row string, spans string, items string, fp long, n_words long, kept string, score double, lang string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(d, t, *["z"] * 6, 9, 9, None, None, None) for d, t in AWKWARD], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def texts_of(spark, folder=SMALL, name="documents", key="doc_id"):
    return {r[0]: r[1] for r in table(spark, folder, name).select(key, "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert sorted(str([r[columns.index(c)] for c in order]) for r in cur.fetchall()) == sorted(str([r[c] for c in order]) for r in df.collect())


# quality rules


def test_quality_on_awkward_rows(spark, awkward, empty):
    rows = quality.judge(awkward).collect()
    assert len(rows) == len(AWKWARD) and not any(r.kept for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[4].n_words == 60_000 and by[4].n_repeat_words == 60_000 and by[4].base_failed
    assert by[8].n_dup_lines == 2 and by[2].n_words == 0 and by[7].n_words == 5
    assert quality.judge(empty).count() == 0 and quality.accepted(awkward).columns == awkward.columns


# url filters


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return min(fits, key=lambda r: (-len(r), r)) if fits else None


def test_urls_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["a.net", "net", "www.a.net", "ab.net", "xnet", "a.b.net", "example.com", "b.com", "a-b.net", "NET", "a.net:80", ""]
    paths = ["", "/", "/en/", "/en/x", "/de", "/en?x", "#t", "/fr/a#b?c"]
    rows = [(i, r.choice(["http://", "x://y", "", "https://"]) + r.choice(hosts) + r.choice(paths)) for i in range(600)] + [(900, None), (901, ""), (902, "no scheme"), (None, "http://a.net/")]
    rules = ["net/", "a.net/", "a.net/en/", "b.net/", "com/", "example.com/de", "a.b.net/e", "www.a.net/"]
    pages = spark.createDataFrame([(*x, "e") for x in rows], "page_id long, url string, rule string")
    frame = spark.createDataFrame([(x, "block") for x in rules], "rule string, action string")
    for ranges in (1, 3, 7):
        got = urls.filtered(pages, frame, ranges=ranges).collect()
        assert len(got) == len(rows)
        for g in got:
            assert g.rule == plain_rule(g.host, g.path, rules), g
            assert g.verdict == ("block" if g.rule else "allow")
    assert urls.filtered(pages.limit(0), frame).count() == 0
    # Many paths of one host, a long url, repeated rows.
    many = spark.createDataFrame([(f"a.net/p{k}/", "block") for k in range(3000)] + [("a.net/" + "x" * 50_000, "allow")], "rule string, action string")
    far = spark.createDataFrame([(1, "http://www.a.net/p2999/q"), (1, "http://www.a.net/p2999/q"), (2, "http://a.net/" + "x" * 200_000), (3, "http://a.net/q")], "page_id long, url string")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in urls.filtered(far, many, ranges=3).collect())
    assert got == [(1, "a.net/p2999/", "block"), (1, "a.net/p2999/", "block"), (2, "a.net/" + "x" * 50_000, "allow"), (3, "", "allow")]
    assert {g.verdict for g in urls.filtered(pages, frame.limit(0)).collect()} == {"allow"}


# SimHash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


def test_simhash_against_brute_force(spark):
    texts = texts_of(spark)
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    roots = plain_components(fps)
    least = {}
    for i, r in zip(ids, roots):
        least.setdefault(r, i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_near_dedup(spark, SMALL).collect()}
    assert got == {i: (f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, roots)}


@pytest.mark.parametrize("n", [300, 1500])
def test_links_in_a_cell_span_all_components(n):
    r = random.Random(n)
    base = [r.getrandbits(64) for _ in range(n // 6)]
    fps = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(6)})
    a, b = simhash.links(np.array(fps, np.uint64).view(np.int64))
    assert len(a) and set(a.view(np.uint64).tolist()) | set(b.view(np.uint64).tolist()) <= set(fps)
    at = {f: k for k, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()):
        parent[find(at[x])] = find(at[y])
    want = plain_components(fps)
    assert len({(find(k), want[k]) for k in range(len(fps))}) == len(set(want)) == len({find(k) for k in range(len(fps))})


def test_simhash_keeps_one_of_each(spark, awkward, empty):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    found = {r.doc_id for r in rows}
    assert 1 in found and 2 not in found and 3 not in found and sum(r.doc_id == 5 for r in rows) == 1
    assert simhash.one_of_each(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "one two three four five"), (1, "entirely other words stand in here"), (None, "first without any id at all"), (None, "second text without id, much unlike it")], "doc_id long, text string")
    assert simhash.one_of_each(twice).count() == 4
    # Rows that share id and text: the choice does not hang on their order.
    tied = spark.createDataFrame([(1, "same words here", "b"), (1, "same words here", "a"), (1, "same words here", "a"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    picks = {tuple(simhash.one_of_each(tied.repartition(k).orderBy("lang", ascending=k > 1)).collect()[0]) for k in (1, 3)}
    assert len(picks) == 1 and simhash.one_of_each(tied).count() == 1


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 3000)] + [(5000, k) for k in range(2000, 2100)] + [(9000 + k, 9001 + k) for k in range(40)], "a long, b long")
    got = dict(simhash.components(edges).collect())
    assert all(got[k] == 0 for k in [*range(1, 3000), 5000]) and all(got[9000 + k] == 9000 for k in range(1, 41)) and len(got) == 3040


# preferences


def test_preferences(spark):
    t = lambda *x: [{"role": a, "text": b} for a, b in x]
    rows = [(1, t(("user", "q"), ("assistant", "a")), t(("user", "q"), ("assistant", "b"), ("user", "c"))), (2, t(("user", "q")), t(("user", "q"))), (3, [], t(("user", "z")))]
    pairs = spark.createDataFrame(rows, "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.id: r for r in preferences.formatted(pairs).collect()}
    assert got[1].prompt == "<|user|>\nq\n" and got[1].chosen == "<|assistant|>\na\n" and got[1].rejected.endswith("<|user|>\nc\n")
    assert [m.train for m in got[1].rejected_mask] == [True, False] and sum(m.n_chars for m in got[1].rejected_mask) == len(got[1].rejected)
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "") and got[3].n_prompt_turns == 0
    none = spark.createDataFrame([(None, 1, "user", "x"), (4, None, None, None)], "conv_id long, turn long, role string, text string")
    far = spark.createDataFrame([(2**54 + k, turn, role, f"{k}{'long ' * 20_000 if k == 3 else ''}") for k in range(4) for turn, role in ((0, "user"), (1, "assistant"), (1, "assistant"))], "conv_id long, turn long, role string, text string").withColumn("pair", F.lit(1))
    assert sorted(r.conv_id - 2**54 for r in preferences.formatted(preferences.swapped_responses(far)).collect()) == [0, 1, 2, 3]
    assert preferences.swapped_responses(none).count() == 0 and preferences.swapped_responses(none.limit(0)).count() == 0


# decontamination


def plain_report(docs, items):
    cut = lambda s: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")) if w]
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    for d, text in docs:
        w, hit, found = cut(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= own
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark, awkward, monkeypatch):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    extra = spark.createDataFrame([(100, "the of"), (101, ""), (102, None), (103, "same text twice over"), (103, "word word")], "item_id long, text string")
    bench = bench.select("item_id", "text").unionByName(extra)
    every = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    want = sorted(map(str, plain_report([tuple(r) for r in every.collect()], [tuple(r) for r in bench.collect()])))
    for size in (decontaminate.BLOCK_BYTES, 700):
        got = decontaminate.report(every, bench, block_bytes=size).drop("spans").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    clean = decontaminate.cleaned(awkward, bench)
    assert clean.columns == awkward.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert 4 not in left and 5 not in left and left[7] == AWKWARD[8][1] and left[1] == "" and left[2] is None
    assert not any(r.contaminated for r in decontaminate.report(every, bench.limit(0)).collect())
    # What cutting brings together is cut as well, over blocks and passes too.
    made = spark.createDataFrame([(1, "q a a b b r"), (2, "a b"), (3, "c a d b d"), (4, None)], "doc_id long, text string")
    short = spark.createDataFrame([(1, "a b"), (2, "d")], "item_id long, text string")
    for size, most in ((decontaminate.BLOCK_BYTES, 4), (1, 4), (1, 1)):
        monkeypatch.setattr(decontaminate, "PASS_BLOCKS", most)
        got = {r.doc_id: (r.text or "").split() for r in decontaminate.cleaned(made, short, block_bytes=size).collect()}
        assert got == {1: ["q", "r"], 3: ["c"], 4: []}


def test_index_finds_every_place():
    r = np.random.default_rng(1)
    text = np.concatenate((r.integers(0, 4, 3000), [0]))
    index = decontaminate.FMIndex(text, 3)
    patterns = r.integers(1, 4, (40, 4))
    found, lo, hi = index.search(patterns)
    places = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(found, lo, hi)}
    for k, p in enumerate(patterns):
        assert places.get(k, []) == [i for i in range(len(text) - 4) if np.array_equal(text[i : i + 4], p)]


# html


def test_html_on_held_out_layouts_and_awkward_pages(spark):
    model = html_text.train(html_text.labelled_pages())
    right = total = 0
    for page, labels in html_text.labelled_pages(60, seed=99):
        odds = html_text.log_odds(page, model)
        for element, pieces in page.blocks:
            if "".join(pieces).strip():
                right += (odds[element] >= 0) == bool(labels[element])
                total += 1
    assert right / total > 0.97
    page = "<html><body><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>first\n  <b>bold</b> text</p><p>second text of the article, long enough<p>third</article><footer>foot</footer><script>var x = '</p>'</script></body></html>"
    for odd_part, left in (
        ("<datalist><option value=x>a<option>b</datalist>", ""), ("<option>", ""), ("<svg>", ""), ("<object>", ""), ("<object data=x>old</object>", ""), ("<svg><g><svg><text>in</text></svg><![CDATA[x]]></g> out</svg>", ""),
        ("<p title=it's>Now it's here, and 'there' too.</p>", "\nNow it's here, and 'there' too."), ('<p title="a > b">Signs stay.</p>', "\nSigns stay."), ("<!-- <script> --><script>x()</script>", ""), ("<select><option>a<option>b</select>", ""), ("<p>Take <math><mi>x</mi><mo>+</mo><mn>1</mn></math> apples.</p>", "\nTake x+1 apples."),
    ):
        body = f"<html><body><nav><a href=x>menu</a></nav><article><h1>Title</h1><p>The first paragraph is long enough to be a paragraph of the article.</p>{odd_part}<p>The last paragraph comes after it, and must not be lost either.</p></article></body></html>"
        assert html_text.main_text(body, model) == f"Title\nThe first paragraph is long enough to be a paragraph of the article.{left}\nThe last paragraph comes after it, and must not be lost either.", odd_part
    assert html_text.main_text(page, model) == "A & B\nfirst bold text\nsecond text of the article, long enough\nthird"
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<"), (3, "u", "<p>" * 3000 + "x"), (4, "u", "plain <a href='")], "page_id long, url string, html string")
    got = html_text.extracted(odd, model=model).collect()
    twice = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, "u", "<article>" + "<p>many words stand here</p>" * 40_000 + "</article>", "x")], "page_id long, url string, html string, text string")
    rows = sorted(html_text.extracted(twice, model=model).collect())
    assert rows[0] == rows[1] and rows[2].text.count("\n") == 39_999
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and html_text.extracted(odd.limit(0), model=model).count() == 0


LAYOUTS = [
    ("<body><div id=wrap><div class=top-bar><a href=/>Home</a> <a href=/b>Blog</a></div><div class=post-body><h2>Baking bread</h2><p>Mix the flour with water and salt, then wait for an hour or two.</p><p>Bake it until the crust is brown and firm.</p></div><div class='related-posts'><h4>More</h4><a href=1>Cakes</a><a href=2>Rolls and buns</a></div><div class=footer>Copyright 2024 by the bakers</div></div></body>",
     "Baking bread\nMix the flour with water and salt, then wait for an hour or two.\nBake it until the crust is brown and firm."),
    ("<body><header><h1>The Daily</h1><nav><a href=x>World</a><a href=y>Sport</a></nav></header><main><article><h1>Rain expected</h1><p class=byline>By a reporter</p><p>Heavy rain is expected in the north over the next days, officials said.</p><aside class=promo><p>Subscribe now for more of this.</p></aside><p>Roads may be closed where rivers rise above their banks.</p></article></main><section id=comments><h3>Comments</h3><div class=comment><p>I saw it too, it rained all night at our place.</p></div></section><footer><p>All rights reserved by the paper</p></footer></body>",
     "Rain expected\nBy a reporter\nHeavy rain is expected in the north over the next days, officials said.\nRoads may be closed where rivers rise above their banks."),
    ("<body><div class=sidebar-left><ul><li><a href=1>Install</a><li><a href=2>Usage</a></ul></div><div role=main class=document><h1>Usage</h1><p>Call the function with a table and the name of a column.</p><pre>f(table, 'name')</pre><ul><li>It returns a table.<li>It never changes its input.</ul></div><div class='cookie-banner'><p>We use cookies on this site.</p><button>Accept</button></div></body>",
     "Usage\nCall the function with a table and the name of a column.\nf(table, 'name')\nIt returns a table.\nIt never changes its input."),
    ("<body><form class=search><input name=q><button>Go</button></form><section class=story><h1>A walk</h1><p>We left the village early in the morning and went up along the stream.</p><figure><img src=x><figcaption>The stream in spring</figcaption></figure><p>At noon we reached the pass, and saw the sea.</p></section><div class=share-buttons><a href=1>Share</a></div><footer>Contact us</footer></body>",
     "A walk\nWe left the village early in the morning and went up along the stream.\nThe stream in spring\nAt noon we reached the pass, and saw the sea."),
]


def test_html_on_real_layouts_beats_unconnected_nodes(spark):
    model = html_text.train(html_text.labelled_pages())
    bare = html_text.Model(model.unary, 0.0, 0.0, 0.0)
    right = [sum(html_text.main_text(source, m) == text for source, text in LAYOUTS) for m in (model, bare)]
    lines = lambda m: sum(len(set(html_text.main_text(s, m).split("\n")) ^ set(t.split("\n"))) for s, t in LAYOUTS)
    print("whole pages right", right, "wrong lines", lines(model), lines(bare))
    assert lines(model) <= 3 and lines(model) < lines(bare)
    # Labelled pages teach a layout of their own.
    odd = lambda k: f"<body><div class=zone-a><p>{'offer ' * (k % 7 + 3)}{k}</p></div><div class=zone-b><p>{'prose ' * (k % 5 + 3)}{k}</p></div></body>"
    pages = spark.createDataFrame([(odd(k), f"{'prose ' * (k % 5 + 3)}{k}") for k in range(40)] + [(s, t) for s, t in LAYOUTS] + [(None, "x"), ("<p>x", None)], "html string, text string")
    taught = html_text.trained(pages)
    assert lines(taught) <= lines(model)
    page = html_text.parse(LAYOUTS[1][0])
    own = html_text.labels_of(page, LAYOUTS[1][1])
    assert {page.tag[k] for k in range(len(own)) if own[k]} >= {"article", "main", "h1", "p"} and not own[page.tag.index("footer")] and not own[page.tag.index("aside")]


def test_html_marginals_are_exact():
    model = html_text.Model(tuple(np.random.default_rng(2).normal(size=html_text.N_FEATURES)), 0.7, 0.4, -0.3)
    page = html_text.parse("<div><p>a</p><nav><a href=x>b</a></nav></div>")
    unary = html_text.features(page) @ np.array(model.unary)
    n, weight = len(page.tag), np.zeros(len(page.tag))
    total = 0.0
    for mask in range(1 << n):
        y = [mask >> k & 1 for k in range(n)]
        e = sum(u for u, k in zip(unary, y) if k)
        for k in range(1, n):
            p = y[page.parent[k]]
            e += model.both if p and y[k] else model.neither if not p and not y[k] else model.parent_only if p else 0.0
        total += np.exp(e)
        weight += np.exp(e) * np.array(y)
    assert np.allclose(1 / (1 + np.exp(-np.array(html_text.log_odds(page, model)))), weight / total)


# token shards


def test_slots_are_a_permutation(spark):
    for n in (1, 2, 5, 1000):
        got = sorted(r.slot for r in token_shards.slots(spark.range(n).withColumnRenamed("id", "index"), n).collect())
        assert got == list(range(n))


def test_shards_round_trip(spark, tmp_path, awkward, empty):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(awkward.where("doc_id is not null and doc_id <> 5").select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(-7, "negative id"), (None, "no id")], "doc_id long, text string"))
    at = str(tmp_path / "s")
    rows = token_shards.materialised(docs, at, path, public_tokenizers.PATTERN, length=64, per_shard=50).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len({r.shard for r in rows}) > 10
    with open(path, "rb") as f:
        coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    own = defaultdict(dict)
    for r in rows:
        assert len(r.ids) == 128
        own[r.doc_id][r.part] = np.frombuffer(bytes(r.ids), "<u2")[: r.n_tokens].tolist()
    for d, t in [tuple(r) for r in docs.collect()]:
        assert sum((own[d][k] for k in sorted(own[d])), []) == [*coder.encode_ordinary(t or ""), 50256]
    # Each shard is one file, and a record lies at its offset.
    kind = token_shards.record_type(64)
    files = {int(f.parent.name.split("=")[1]): f for f in (tmp_path / "s").glob("shard=*/part-*")}
    assert len(files) == len(list((tmp_path / "s").glob("shard=*/part-*"))) == len({r.shard for r in rows})
    for r in rows[::17]:
        with open(files[r.shard], "rb") as f:
            f.seek(r.byte_offset)
            one = np.frombuffer(f.read(kind.itemsize), kind)[0]
        assert one["ids"].tobytes() == bytes(r.ids) and (int(one["doc_id"]) if one["has_id"] else None) == r.doc_id and one["end"] == 10
    assert [r.slot for r in token_shards.resumed(spark, at, 700, 64).limit(3).collect()] == [700, 701, 702]
    # Other partitions, same order; another key, another order.
    order = [(r.doc_id, r.part) for r in sorted(rows, key=lambda r: r.slot)]
    again, other = (token_shards.materialised(docs.repartition(7), str(tmp_path / f"again{k}"), path, public_tokenizers.PATTERN, length=64, per_shard=50, key=k) for k in (token_shards.KEY, 1))
    assert order == [(r.doc_id, r.part) for r in again.orderBy("slot").collect()] != [(r.doc_id, r.part) for r in other.orderBy("slot").collect()]
    assert token_shards.materialised(empty, str(tmp_path / "none"), path, public_tokenizers.PATTERN).count() == 0


def test_equal_rows_keep_all_their_sequences(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(3, "twice"), (3, "twice"), (3, "other"), (None, None), (None, "")], "doc_id long, text string")
    rows = token_shards.materialised(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, length=8).collect()
    assert sorted(r.slot for r in rows) == [0, 1, 2, 3, 4] and [r.doc_id for r in rows].count(3) == 3 and [r.doc_id for r in rows].count(None) == 2


# toxicity


def test_toxicity_on_held_out_rows(spark, awkward, empty):
    docs, labels = table(spark, LABELLED, "documents"), table(spark, LABELLED, "labels")
    assert toxicity.training_sample(docs, labels).count() > 100
    model = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.scored(docs, model).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    pos, neg = ([r.score for r in rows if truth[r.doc_id] == y] for y in (1, 0))
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows) / len(rows)
    print("held-out AUC", auc, "accuracy", right, len(pos), len(neg))
    assert auc > 0.85 and all(r.predicted == int(r.score >= 0.5) for r in rows)
    odd = toxicity.scored(awkward, model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd) and toxicity.scored(empty, model).count() == 0
    assert toxicity.train(empty, labels).gram_scores.max() == 0


def test_toxicity_sample_is_one_text_of_each_usable_id(spark):
    ids = [d for d in range(200) if not toxicity.held_out(d)]
    hot, long, gone, rest = ids[0], ids[1:4], ids[11:21], ids[21:61]
    docs = [(hot, f"copy {k % 3}") for k in range(300)] + [(d, "x " * 100_000) for d in long] + [(d, f"text {d}") for d in rest]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in [hot, *long, *gone, *rest]], "doc_id long, toxic int")
    everything = toxicity.bagged(toxicity.training_sample(docs, labels, 100))
    assert list(zip(everything.doc_ids, everything.labels.tolist())) == sorted((d, d % 2) for d in [hot, *long, *rest])
    bag = lambda k: {everything.vocabulary[i]: int(n) for a, b in [everything.starts[k : k + 2]] for i, n in zip(everything.ids[a:b], everything.counts[a:b])}
    assert bag(everything.doc_ids.index(hot)) == {b"copy": 1, b"0": 1} and bag(everything.doc_ids.index(long[0])) == {b"x": 100_000}
    some = toxicity.bagged(toxicity.training_sample(docs, labels, 20))
    assert len(set(some.doc_ids)) == 20 and some.labels.sum() == 10


def test_toxicity_of_one_short_word():
    for w in (b"a", b"ab", "é".encode()):
        (ids, starts), (more, cuts) = toxicity.grams([w]), toxicity.grams([w, b"longer"])
        assert ids.tolist() == more[: cuts[1]].tolist() and starts.tolist() == [0, len(ids)]


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_against_the_library(spark, tokenizer, awkward, empty):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    got = sorted(str(tuple(r)) for r in bpe.digests(docs, queries.tokenizer_path("word_bpe_49k.json")).collect())
    want = []
    for d, t in [tuple(r) for r in docs.collect()]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append(str((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert got == sorted(want) and bpe.digests(empty, queries.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_bpe_on_random_texts(tokenizer):
    r = random.Random(8)
    parts = ["don't", " ", "\n", "  ", "<|endoftext|>", "<|startoftext|>", "é", "e\u0301", "ß", "İ", "\u00a0", "\u2003", "日本", "😀", "a1b2", "...", "'s", "x" * 50, "\r\n", "\t", "Aa", "12345", "\x00", "\x85", "\u200b", "-", "_", "</w>"]
    codec = bpe.Codec(queries.tokenizer_path("word_bpe_49k.json"))
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 3000))) for _ in range(60)] + ["x" * 20_000, "<|endoftext|>" * 300, " " * 9000]
    for text, (ids, decoded) in zip(texts, codec.encode_many([t.encode() for t in texts])):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == tokenizer.decode(want, skip_special_tokens=False)


# PII

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub(r"\D", "", m)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def plain_spans(text):
    found = [(m.start(), list(PLAIN).index(k), m.end(), k) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m.group())]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_pii_base_spans_against_plain_patterns(spark):
    r = random.Random(4)
    parts = ["a", "b.c", "@", "@", ".", "1", "22", "255", "256", "001", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "+1 555-123-4567", "10.0.0.1", "x@y.zz", "%", "é", "\n", "٣"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
    rows = {x.doc_id: x for x in queries.op10_pii(spark, SMALL).collect()}
    for d, t in texts_of(spark).items():
        want = plain_spans(t)
        assert rows[d].base_sha256 == hashlib.sha256(pii.shown(want).encode()).hexdigest()
        assert set(filter(None, pii.shown(want).split(","))) <= set(rows[d].spans.split(","))
        assert rows[d].n_email == sum(k == "email" for _, _, k in want)


def test_pii_on_awkward_rows(spark, awkward, empty):
    assert pii.report(awkward).count() == len(AWKWARD) and pii.report(empty).count() == 0
    out = pii.redacted(awkward)
    assert out.columns == awkward.columns and {r.doc_id: r.text for r in out.collect()}[2] is None
    assert pii.masked("write a@b.cc or 10.0.0.1", [(6, 12, "email"), (16, 24, "ip")]) == "write [email] or [ip]"


def test_pii_weak_supervision_prefers_agreeing_labelers():
    votes = [((1, 1, 1, 1, -1), (1, 4, 5, 1, 3), 50), ((-1, 0, -1, 0, 0), (1, 1, 9, 0, 0), 900), ((-1, 1, -1, 0, -1), (1, 3, 4, 0, 3), 20)]
    model = pii.fit(votes)
    assert model.accepts(pii.Candidate(0, 1, "secret", votes[0][0], votes[0][1])) and not model.accepts(pii.Candidate(0, 1, "id", votes[1][0], votes[1][1]))
    assert set(model.reliability) == set(pii.LABELERS) and not pii.fit([]).accepts(pii.Candidate(0, 1, "id", votes[1][0], votes[1][1]))


def test_pii_added_spans(spark):
    prose = ["the price rose to 12 in 2023, as expected by many", "The quick brown fox is number 7 of 9", "Note: this is fine. Dear Sir, see page 4", "ratio: 3.5, width = 20", "On Monday the Red Cross met"] * 60
    personal = ['token = "7f5790b897549d620aedfc0705a565f96e3741e8"', "password: hunterhunter", "api_key=abcdefghijklmnop", "Contact Mary Smith today", "Contact Mary, please", "ask (Mary Smith)", "Dear Zoltan Kiss, hello", "ssn: 123-45-6789", "name: John Brown."] * 8
    docs = spark.createDataFrame(list(enumerate(prose + personal)), "doc_id long, text string")
    model = pii.train(docs)
    added = lambda t: {(k, t[a:b]) for a, b, k in pii.spans(t, model)[1]}
    assert not any(added(t) for t in ("the price rose to 12 in 2023, as expected by many", "The quick brown fox is number 7 of 9", "ratio: 3.5, width = 20", "On Monday the Red Cross met"))
    assert added(personal[0]) == {("secret", "7f5790b897549d620aedfc0705a565f96e3741e8")}
    for t, want in ((personal[1], "hunterhunter"), (personal[2], "abcdefghijklmnop"), (personal[3], "Mary Smith"), (personal[4], "Mary"), (personal[5], "Mary Smith"), (personal[6], "Zoltan Kiss"), (personal[7], "123-45-6789"), (personal[8], "John Brown")):
        assert want in {v for _, v in added(t)}, (t, added(t))
    assert 0 < model.reliability["name gazetteer"][0] < 1 and 0 < model.reliability["gazetteer"][1] < 1


# pipeline


def test_pipeline_against_its_parts(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    texts = {d: t for d, t in texts_of(spark).items() if d in kept}
    ids = sorted(texts)
    roots = plain_components([plain_fingerprint(texts[i]) for i in ids])
    first = {}
    for i, r in zip(ids, roots):
        first.setdefault(r, i)
    bench = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    stage = docs
    for k, (_, f) in enumerate(pipeline.STAGES):
        stage = f(spark, stage, SMALL)
        if k < 4:
            assert stage.columns == columns
        if k == 0:
            assert {r.doc_id for r in stage.select("doc_id").collect()} == kept
        if k == 1:
            assert sorted(r.doc_id for r in stage.select("doc_id").collect()) == sorted(first.values())
        if k == 2:
            assert not any(x[5] for x in plain_report([(r.doc_id, r.text) for r in stage.collect()], bench))
        if k == 3:
            assert not any(plain_spans(r.text) for r in stage.select("text").collect())
    assert {r.doc_id for r in stage.collect()} <= set(first.values()) and pipeline.run(spark, SMALL).count() == stage.count()


def test_pipeline_on_awkward_rows(spark, awkward, empty, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice(("the", "of", "in")) if k % 4 == 0 else "".join(r.choice("aeilnorst") for _ in range(r.randint(3, 8))) for k in range(n))
    one, two, three = prose(80), prose(90), prose(70_000)
    rows = [(50, one), (51, one), (51, one), (None, two), (52, three), (None, one + " write to me@mail.example.com")]
    docs = awkward.unionByName(spark.createDataFrame([(d, t, *["z"] * 6, 9, 9, None, None, None) for d, t in rows], CLASH))
    bench = spark.createDataFrame([(1, " ".join(one.split()[20:35])), (2, None), (3, "")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage = docs
    for k, (_, f) in enumerate(pipeline.STAGES[:4]):
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    left = {r.doc_id: r.text for r in stage.collect()}
    assert {50, 52, None} == set(left) and left[52] == three and len(left[50].split()) == 65 and "@" not in (left[None] or "")
    assert pipeline.run(spark, str(tmp_path)).count() == len(stage.collect())
    stage = docs.limit(0)
    for _, f in pipeline.STAGES:
        stage = f(spark, stage, str(tmp_path))
    assert stage.count() == 0


def test_new_words_of_many_chunks_reach_the_tokenizer_together():
    codec = bpe.Codec(queries.tokenizer_path("word_bpe_49k.json"))
    calls, ids_of = [], codec.ids_of
    codec.ids_of = lambda texts: calls.append(len(texts)) or ids_of(texts)
    texts = [" ".join(f"w{k}x{j}, don't é{j}" for j in range(400)).encode() for k in range(40)]
    got = codec.encode_many(texts)
    # One call a block of new words and one for the joins, beside single words that lie across a cut; it was one a chunk.
    assert len([n for n in calls if n > 2]) <= 4
    whole = ids_of([t.decode() for t in texts])
    assert [g for g, _ in got] == [np.array(i, "<u4").tobytes() for i in whole]
    assert [d.decode() for _, d in got] == codec.decoded(whole)
