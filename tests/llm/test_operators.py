"""Every operator against a plain version, on odd rows: nulls, empty and very long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import ann, bpe, html_extract, lm, ngram_join, packing, pii, quality, token_output, url_filter
from spanwise.llm.common import fresh_path
from spanwise.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sample_texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [None, "", " \n\t ", "one", "one two", "One TWO", "é 日本 😀 ß", "x" * 30_000, "word " * 5000]
    for edits in (0, 0, 1, 2, 3, 4, 6, 8, 12, 20, 30):
        w = list(base)
        for k in rng.sample(range(150), edits):
            w[k] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for n in (5, 9, 12, 20, 60, 300):
        w = [rng.choice(vocabulary) for _ in range(n)]
        texts += [" ".join(w), " ".join(w), " ".join(w[:-1] + ["end"])]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 4 else "en", "src0" if i % 3 else None, 0) for i, t in enumerate(sample_texts())]
    return spark.createDataFrame(rows + rows[10:12], SCHEMA)  # two rows come twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    part = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = part[a], part[b]
                part = {i: min(x, y) if p in (x, y) else p for i, p in part.items()}
    return {i: (len(sets[i]), part[i]) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_ngram_join(docs, empty, width, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.near_groups(docs, width=width, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, width, percent)
    assert ngram_join.near_groups(empty).count() == 0


def test_bit_sketches_never_drop_links(spark):
    rng, rule = np.random.default_rng(1), ngram_join.Threshold(80)
    rows, linked = [], []
    for n in (1, 5, 50, 500):
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for k in range(0, n, max(1, n // 25)):
            other = np.unique(np.concatenate((base[k:], rng.integers(0, 1 << 63, k // 2).astype(np.uint64))))
            rows.append((len(base), len(other), ngram_join.bit_sketch(base).tolist(), ngram_join.bit_sketch(other).tolist()))
            linked.append(rule.linked(len(np.intersect1d(base, other)), len(base), len(other)))
    table = spark.createDataFrame(rows, "n long, m long, a array<long>, b array<long>").coalesce(1)
    may = [r[0] for r in table.select(ngram_join.may_link(rule, *(F.col(c) for c in "nmab"))).collect()]
    assert all(x or not y for x, y in zip(may, linked, strict=True))
    assert sum(linked) > 5 and may.count(False) > len(may) // 2


def test_crowded_buckets_make_few_pairs(spark):
    """50,000 connected members and five outsiders, two of them connected: no pair of members, each open one once."""
    n = 50_000
    flat = F.array_repeat(F.lit(0).cast("long"), 8)
    rows = spark.range(n + 6).select(F.lit(1).alias("key"), F.lit(n + 5).cast("long").alias("p"), F.col("id").alias("x"), F.lit(10).cast("long").alias("n"), flat.alias("flat"), F.when(F.col("id") < n, 0).when(F.col("id") < n + 2, n).otherwise(F.col("id")).alias("component"))
    rows = rows.withColumns({"few": F.lit(True), "minor": F.col("component") != 0})
    pairs = ngram_join._near(rows, ngram_join.Threshold(80))
    assert pairs.count() == pairs.distinct().count() == 5 * n + 9 and pairs.where("p >= x").isEmpty()


def test_ngram_many_near_copies(spark):
    """A group without a shared original, whose members link by chance: no round may lose a link."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 5, 8])):
            w[k] = f"e{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, 3, 90)


def test_ngram_differences_of_crowded_buckets(spark, monkeypatch):
    """Differences from the pivot are counted in lists, not a row each; no link is lost, and the rows are the rarest shared ones."""
    exploded = []
    explode = F.explode
    monkeypatch.setattr(F, "explode", lambda c: exploded.append(str(c)) or explode(c))
    monkeypatch.setattr(ngram_join, "FEW", 1)
    monkeypatch.setattr(ngram_join, "COUNTED", 500)
    made, counted = [], ngram_join._rarest_differences
    monkeypatch.setattr(ngram_join, "_rarest_differences", lambda rows: made.append(1) or counted(rows))
    rng = random.Random(8)
    rows = []
    for i in range(120):
        w = [f"w{k}" for k in range(60)]
        for k in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            w[k] = f"e{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, 3, 90)
    assert made and not any("keys" in c for c in exploded)
    owners = [(p, 10 * p + x, rng.randint(1, 3), rng.randint(1, 9), [rng.randint(0, 30) for _ in range(rng.randint(0, 20))]) for p in (1, 2) for x in range(9)]
    got = sorted((r.x, r.own, r.component) for r in counted(spark.createDataFrame(owners, "p long, x long, component long, prefix int, keys array<int>").repartition(3)).collect())
    expected = []
    for p, x, component, prefix, keys in owners:
        having = {k: [o[2] for o in owners if o[0] == p for y in o[4] if y == k] for k in keys}
        shared = [k for k in keys if len(set(having[k])) > 1]
        own = len(keys) - len(shared)
        ranks = sorted(len(having[k]) for k in shared)[: max(0, prefix - own)]
        expected.append((x, own, component, prefix, sorted(shared, key=lambda k: len(having[k])), len(ranks)))
    for x, own, component, prefix, shared, most in expected:
        mine = [g for g in got if g[0] == x]
        assert all(g == (x, own, component) for g in mine) and len(mine) <= most and bool(mine) == bool(most)
        if len(set(shared)) == len(shared):
            assert len(mine) == most


def test_keep_one(docs, empty):
    kept = ngram_join.keep_one(docs.withColumn("id", F.lit(1)).withColumn("key", F.lit("k")))
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, p) in groups.items() if i == p)
    assert ngram_join.keep_one(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 5)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100 and None not in got


def test_components_of_long_chains(spark):
    """Ids that rise along a chain, and one in any order."""
    order = random.Random(5).sample(range(10_000, 13_000), 3000)
    edges = [(i, i + 1) for i in range(3000)] + list(zip(order, order[1:]))
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(3001)) and {got[i] for i in order} == {10_000} and len(got) == 6001


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="ad">Buy</div><article><h1>A &amp; B</h1><p>First&nbsp; line<br>goes
    on.</p><form><p>Mail?</p></form><p>Second <b>line</b>.<div class=comments><p>Nice</p></div><script>var a="</p>";</script></article><footer>&copy;</footer></body></html>"""
    assert html_extract.main_text(page) == "A & B\n\nFirst line goes on.\n\nSecond line."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    long = "<body>" + "<div><a href=a>Link</a></div>" + "".join(f"<p>{'text ' * 40}{k}</p>" for k in range(4)) + "<div class='cookie-notice'>We use</div></body>"
    assert html_extract.main_text(long).count("\n\n") == 3 and "Link" not in html_extract.main_text(long)
    assert html_extract.kept_lines([0, 5, 0, 0, 0, 80, 90, 3, 0, 0, 0, 4], 100) == [False] * 5 + [True] * 3 + [False] * 4
    assert len(html_extract.main_text("<article>" + "<p>x" * 20_000)) > 20_000


def test_html_odd_pages():
    text = html_extract.main_text
    assert text("<article><p>a <![CDATA[hello world") == "a hello world"
    kept = "<article><div class='entry-header'><h1>Title</h1></div><div class='post-tags-body'><p>Body</p></div><div class=menu><p>No</p></div></article>"
    assert text(kept) == "Title\n\nBody"
    assert text("<div class='page has-sidebar'><main><p>Body</p></main></div>") == "Body"
    links = "".join(f"<p><a href={k}>Other article {k}</a></p>" for k in range(4))
    assert text(f"<article><p>First.</p>{links}<p>Last.</p></article>") == "First.\n\nLast."
    assert text("<article><p>First.</p><p><a href=x>One link</a></p><p>Last.</p></article>") == "First.\n\nOne link\n\nLast."
    assert html_extract.runs([True, True, False, True, True, True]) == [False] * 3 + [True] * 3


def test_html_empty_table(spark):
    rows = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(rows).count() == 0
    again = spark.createDataFrame([(1, "u", "<p>hi</p>")] * 2, "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(again).collect()] == ["hi", "hi"]


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", "<p>hi</p>", 5), (2, None, None, 5)], "page_id long, url string, html string, text int")
    assert [tuple(r) for r in html_extract.extract(rows).orderBy("page_id").collect()] == [(1, "u", "hi", 2), (2, None, "", 0)]


def test_neighbours(spark):
    rng = np.random.RandomState(2)
    x = rng.randn(1200, 16) * (1 + rng.rand(1200, 1))
    x[50:90] = x[40]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0]), (40, [float(v) for v in x[40]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 20 = 0"), k=10, target=0.6).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-9) and r.query_id != r.vec_id
    hits = 0
    for q in range(0, 1200, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1200), -s))[:10]) & set(by[q]))
    assert hits / 600 >= 0.9
    ties = [v for v in by[40] if 50 <= v < 90]
    assert ties == list(range(50, 50 + len(ties))) and len(by[40]) == 10
    assert ann.search(table.where("vec_id < 0"), table.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("scale", [1e-7, 1.0, 1e6])
def test_neighbours_at_any_scale(spark, scale):
    """The shipped settings on tight clusters and scattered vectors: recall of each kind; few vectors give them all."""
    rng = np.random.RandomState(5)
    centres = rng.randn(12, 16)
    x = np.concatenate((centres[rng.randint(0, 12, 1500)] + 0.1 * rng.randn(1500, 16), rng.randn(500, 16))) * scale
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0")).collect():
        by.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = {True: [], False: []}
    for q in range(0, 2000, 20):
        s = (x * x[q]).sum(1)
        assert len(by[q]) == 20 and all(by[q][i] == pytest.approx(s[i], rel=1e-12) for i in by[q])
        s[q] = -np.inf
        hits[q < 1500].append(len(set(np.lexsort((np.arange(2000), -s))[:20]) & set(by[q])) / 20)
    assert np.mean(hits[True]) >= 0.9 and np.mean(hits[False]) >= 0.9
    few = table.where("vec_id < 15")
    assert ann.search(few, few.where("vec_id % 20 = 0")).count() == 14


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    from spanwise.llm.tokens import default_path

    exact = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    rows = packing.pack(docs.withColumn("length", F.lit("x"))).collect()
    sequences = {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(ids[r.doc_id]) for r in docs.select("doc_id").collect())
    assert sum(r.length for r in rows) == total
    assert packing.pack(empty).count() == 0


def test_packing_plan():
    rng = random.Random(1)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        room, seen = {}, Counter()
        for p in packing.plan(counts, 50):
            seen[p.length] += p.count
            for j in range(p.count):
                room.setdefault(p.sequence + j // p.each, []).append((p.offset + j % p.each * p.length, p.length))
        assert seen == Counter(counts)
        for places in room.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 50
        # Best fit decreasing, one by one, opens as many.
        gaps, opened = [], 0
        for length in sorted(Counter(counts).elements(), reverse=True):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                opened += 1
                gaps.append(50 - length)
        assert len(room) == opened


def plain_quality(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(max(0, len(w) - 7)))
    covered = set()
    for i in range(max(0, len(w) - 7)):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, empty):
    more = docs.union(docs.sparkSession.createDataFrame([(900, "a b\n" * 9 + "c", "en", None, 1), (901, ("## $$ " * 30 + "z ") + " ".join(map(str, range(90))), "en", None, 1)], SCHEMA))
    rows = quality.judge_measures(more.withColumn("n_words", F.lit("clash")), ("doc_id",)).collect()
    texts = {r.doc_id: r.text for r in more.collect()}
    assert len(rows) == more.count()
    for r in rows:
        expected = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in rows}
    assert not verdict[901] and all(verdict[i] for i in range(9, 20))
    kept = quality.keep(more.withColumn("_w", F.lit(1)).withColumn("kept", F.lit("old")))
    assert kept.columns[-2:] == ["_w", "kept"] and {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}
    assert quality.judge_measures(empty, ("doc_id",)).count() == 0


def test_urls(spark):
    canon = '<link href="http://bad.net/x" rel="canonical">'
    moved = '<meta http-equiv="refresh" content="0; url=https://ok.example.net/en/b">'
    rows = [
        (1, "http://A.Example.NET/en/1?q", None),
        (2, "http://example.com/de/1", ""),
        (3, "https://x.org/fr/", ""),
        (4, "http://alias.com/1", canon),
        (5, "https://alias.com/1/#top", ""),
        (6, "http://both.com/1", canon + moved),
        (7, None, canon),
        (8, "nothing", ""),
        (9, "http://example.net/de/", ""),
        (10, "http://clean.com/", "<p>canonical refresh</p>"),
        (11, "http://notexample.com/de/", ""),
        (1, "http://A.Example.NET/en/1?q", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[3] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[4][2:] == got[5][2:] == (None, "allow")  # 6 joins them with an allowed page
    assert got[6][3] == "allow" and got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("net/", "block") and got[10][3] == got[11][3] == "allow"
    alone = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame([r for r in rows if r[0] != 6], "page_id long, url string, html string")).collect()}
    assert alone[4] == alone[5] == "block"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_references(spark):
    page = "http://h.com/a/b/page.html?q"
    forms = {
        "https://x.com/p": "https://x.com/p",
        "HTTP://x.com/p": "HTTP://x.com/p",
        "other.html": "http://h.com/a/b/other.html",
        "../x": "http://h.com/a/x",
        "../../../x?y": "http://h.com/x?y",
        "./c/./d/..": "http://h.com/a/b/c/",
        "?id=1": "http://h.com/a/b/page.html?id=1",
        "//bad.net/x": "http://bad.net/x",
        "/go?u=https://bad.net/": "http://h.com/go?u=https://bad.net/",
        "s?u=https://bad.net/": "http://h.com/a/b/s?u=https://bad.net/",
        "mailto:a@b.c": None,
        "#top": None,
        "": None,
    }
    table = spark.createDataFrame([(page, t) for t in forms] + [("http://h.com", "x")], "u string, t string")
    got = [tuple(r) for r in table.select("t", url_filter.resolved(F.col("u"), F.col("t"))).collect()]
    assert got == [*forms.items(), ("x", "http://h.com/x")]
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.com/d/1", link("//bad.net/x")),
        (2, "http://b.com/d/2", link("/go?u=https://bad.net/")),
        (3, "http://c.com/d/e/3", link("../bad")),
        (4, "http://c.com/d/bad", link("https://bad.net/y")),
        (5, "http://d.com/5", '<base href="http://bad.net/z/">' + link("w")),
        (6, "http://e.com/6", link("mailto:x@bad.net")),
        (7, "http://f.com/7?a", link("?b")),
        (8, "http://f.com/7?b", '<meta http-equiv=refresh content="0; url=//bad.net/">'),
    ]
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i for i, v in verdicts.items() if v == "block"} == {1, 3, 4, 5, 7, 8}


def test_url_chains_and_long_rule_lists(spark):
    """A chain of 250 canonical links ends on a blocked page; links in comments don't count; rules by table give the same."""
    link = '<link rel="canonical" href="{}">'.format
    rows = [(k, f"http://chain.com/{k}", link(f"/{k + 1}")) for k in range(250)] + [(250, "http://chain.com/250", link("http://bad.net/"))]
    rows += [(300, "http://c.com/1", "<!-- " + link("http://bad.net/") + " -->"), (301, "http://A.x.example.net/en/", None), (302, "http://net/", None), (303, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(table).collect()}
    assert all(few[k] == (None, "block") for k in range(251)) and few[300] == (None, "allow")
    assert few[301] == ("example.net/en/", "allow") and few[302] == ("net/", "block") and few[303] == (None, "allow")
    many = (*url_filter.RULES, *(("block", f"h{k}.test", "/") for k in range(url_filter.FEW_RULES)))
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(table, rules=many).collect()} == few


def plain_pii(t):
    def luhn(x):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0

    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, empty):
    texts = [None, "", "a@b.c_d@e.f g@h", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9-", "4929348385146306 4929-3483-8514-6306 9807915762804490", "é😀 a@b.cc 1.2.3.4", "1" * 20_000, "a" * 20_000 + "@b", "1.1.1.1 " * 300, "x@" + "a." * 9000 + "b"]
    texts += ['the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "in 1999 we met 12 people at 10:30"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_base", F.lit(0))
    got = {r.doc_id: r for r in pii.find(rows.drop("_base")).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i]._base] == plain_pii(t)
    assert [x.k for x in got[11].spans] == ["secret"] and got[12].spans == []
    masked = {r.doc_id: r.text for r in pii.mask(rows).collect()}
    assert masked[6] == "é😀 [EMAIL] [IP]" and masked[0] is None and masked[12] == texts[12] and "04dbe" not in masked[11]
    assert pii.mask(rows).columns == ["doc_id", "text", "_base"]
    assert pii.find(empty).count() == 0


def test_weak_supervision():
    patterns = [((1, 1, -1), 50), ((0, 0, 0), 200), ((1, 0, -1), 5), ((-1, -1, 1), 10)]
    share, right, belief = pii.reliabilities(patterns)
    assert belief[0] > 0.9 and belief[1] < 0.1 and 0 < share < 0.6 and all(0.5 < p < 1 for r in right for p in r)


def test_token_output(spark, docs, empty):
    folder = fresh_path(spark, "shards-test")
    rows = sorted(token_output.materialise(docs, folder, stride=64).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    counts = [n for _, n in sorted(Counter(r.shard for r in rows).items())]
    records = token_output.read_slots(folder, counts, 0, len(rows), 64)
    for k, r in enumerate(rows):
        assert zlib.crc32(records[k][: r.n_tokens].astype("<u4")) == r.ids_crc32 and (records[k][r.n_tokens :] == 2).all()
    assert (token_output.read_slots(folder, counts, 3, 4, 64) == records[3:7]).all()
    again = sorted(token_output.materialise(docs, fresh_path(spark, "shards-test"), stride=64).collect(), key=lambda r: r.slot)
    assert [(r.doc_id, r.piece) for r in again] == [(r.doc_id, r.piece) for r in rows] != sorted((r.doc_id, r.piece) for r in rows)
    assert token_output.materialise(empty, fresh_path(spark, "shards-test")).count() == 0


def test_feistel():
    for n in (1, 2, 3, 17, 1000, 4096):
        assert sorted(token_output.feistel(np.arange(n), n, 99).tolist()) == list(range(n))


def test_scores(spark, docs, empty):
    tokens = {r.doc_id: [*WORD.findall(lower(r.text)), None] for r in docs.collect()}
    each = [r.doc_id for r in docs.select("doc_id").collect()]
    learns = [i for i in each if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in learns for w in tokens[i])
    total = sum(c.values())
    one = {r.doc_id: r for r in lm.score(docs, vocabulary=64).collect()}
    two = {r.doc_id: r for r in lm.score(docs, vocabulary=64, broadcast_words=3).collect()}
    for i in each:
        r = one[i]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in tokens[i])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and two[i].score == pytest.approx(r.score, rel=1e-9) and two[i].n_known == r.n_known
    assert lm.score(empty).count() == 0


def test_model_is_normalised_and_learns():
    rng = np.random.RandomState(1)
    ids = rng.randint(1, 30, 4000)
    ids[1::2] = ids[::2] % 29 + 1  # each second token follows from the one before
    hashes, counts = np.unique(ids, return_counts=True)
    order = np.argsort(-counts)
    model = lm.Model(hashes[order].astype(np.uint64), counts[order], len(ids), len(hashes))
    known = model.ids_of(ids.astype(np.uint64)).astype(np.int64)
    grams = np.stack([known[3:], known[2:-1], known[1:-2], known[:-3]], 1)

    def loss():
        return -model.log_probabilities(grams[:, 0].astype(np.int32), [grams[:, k] for k in (1, 2, 3)]).mean()

    before = loss()
    model.train(known, np.array([0, len(known)]), 0, epochs=4, batch=512)
    assert loss() < before - 0.3
    n = len(hashes) + 1
    p = np.exp(model.log_probabilities(np.arange(n, dtype=np.int32), [np.full(n, 3)] * 3))
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_all_contexts_train_a_growing_vocabulary(spark):
    """3,000 words of 100 occurrences each, every second one following from the one before."""
    rng = np.random.RandomState(4)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rng.permutation(1500))) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4, "id")
    learns = sum(bool(zlib.crc32(str(i).encode()) % 10) for i in range(120))
    model, _ = lm.fit(docs)
    assert learns >= lm.MIN_COUNT and len(model.hashes) == 3001
    assert model.total == 3001 * learns and model.trained == lm.ROUNDS * model.total
    got = lm.score(docs.withColumnRenamed("id", "doc_id")).where("held_out").select(F.avg(F.col("score") - F.col("base_score"))).first()[0]
    assert got > 300  # log10: a gain beyond the frequencies on words of every rank


def test_bpe(spark, docs, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    exact = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = ["don't I'll 123 456 ½ Ⅷ", chr(0x1C) + " x" + chr(0x85) + "y" + chr(0xA0) + "z", "日本語 😀😀", "ab" * 400, " " * 300 + "a", "<|endoftext|>", chr(0x200B) + chr(0xFEFF)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(700 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for bound in (bpe.BROADCAST_WORDS, 5):
        got = bpe.encode(rows, broadcast_words=bound).collect()
        assert len(got) == rows.count()
        for r in got:
            ids = np.array(exact.encode_ordinary(texts[r.doc_id]), "<u4")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert bpe.encode(empty).count() == 0


def plain_pipeline(rows, masked):
    """doc_id -> its token ids after all stages; ``masked``: what the personal data stage makes of a text."""
    from tokenizers import Tokenizer

    from spanwise.llm.tokens import default_path

    exact = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    kept = [(i, t) for i, t in rows if not (plain_quality(t)[0] < 20 or 100 * plain_quality(t)[4] > 30 * plain_quality(t)[0])]
    groups = brute_groups(kept, 5, 80)
    return {i: np.array([*exact.encode(masked(t), add_special_tokens=False).ids, 2], "<u4") for i, t in kept if groups[i][1] == i}


def test_pipeline(spark, tmp_path, docs, empty):
    """Rejected documents, groups of copies, masked texts and packed rows, against a plain version of all stages."""
    import corpus_pipeline

    def masked(text):
        out, at = "", 0
        for kind, s, e in sorted(plain_pii(text), key=lambda x: x[1:]):
            if s >= at:
                out, at = out + text[at:s] + f"[{kind.upper()}]", e
        return out + text[at:]

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("ijklmnopq") for _ in range(rng.randint(2, 8))) for _ in range(n))
    more = [(500 + i, f"{words(30)} write to ann{i}@mail.example.org or {i}.20.30.40 {words(30)}", "en", "src1", 0) for i in range(5)]
    more += [(600, words(3000), "en", "src1", 0), (601, "too short", "en", "src1", 0), (602, "the same words " * 60, "en", "src1", 0)]
    table = docs.union(spark.createDataFrame(more, SCHEMA))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline([(r.doc_id, r.text) for r in table.collect()], masked)
    assert {r.doc_id for r in rows} == set(want) and {500, 504, 600} <= set(want) and not {601, 602} & set(want)
    sequences, pieces = {}, {}
    for r in rows:
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and (r.length == 1024 or r.piece == 0)
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in pieces.items():
        assert [p for p, *_ in sorted(own)] == list(range(len(own))) and sum(n for *_, n in own) == len(want[i])
    for places in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
    assert len(sequences) <= -(-sum(map(len, want.values())) // 1024) + 1
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_scores_do_not_depend_on_the_layout(spark):
    """The same rows, dealt and ordered otherwise, give the same scores, better than those of counts on held-out texts."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"a{k} b{k}" for k in (rng.randint(0, 40) for _ in range(60)))) for i in range(300)]
    one = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    two = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5, "text")
    first = {r.doc_id: r for r in lm.score(one).collect()}
    for r in lm.score(two).collect():
        assert r.score == pytest.approx(first[r.doc_id].score, rel=1e-6) and r.base_score == pytest.approx(first[r.doc_id].base_score, rel=1e-12)
    held = [r for r in first.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.5 * sum(r.n_tokens for r in held)
