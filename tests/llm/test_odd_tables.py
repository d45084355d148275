"""Extra columns whose names the operators use themselves, and texts of a megabyte: same results, no crash."""

import random

import pytest
from pyspark.sql import functions as F

from spanwise.llm import ann, bpe, html_extract, lm, ngram_join, packing, quality, repeats, token_output, url_filter
from spanwise.llm.common import fresh_path

NAMES = ("id", "key", "block", "q", "v", "word", "ids", "n_tokens", "piece", "slot", "shard", "component", "x", "p", "w", "t", "c", "n", "_row")


def crowded(rows):
    """``rows`` with a column of every name that operators use."""
    return rows.withColumns({c: F.lit("clash") for c in NAMES if c not in rows.columns})


def plain(rows, drop=()):
    return sorted(str([v for k, v in r.asDict().items() if k not in drop]) for r in rows.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 80)))) for i in range(40)]
    return spark.createDataFrame([*rows, (40, rows[3][1]), (41, None), (42, "")], "doc_id long, text string")


def test_clashing_columns_of_texts(spark, texts):
    assert plain(ngram_join.near_groups(crowded(texts))) == plain(ngram_join.near_groups(texts))
    assert plain(bpe.encode(crowded(texts))) == plain(bpe.encode(texts))
    assert plain(lm.score(crowded(texts), vocabulary=32)) == plain(lm.score(texts, vocabulary=32))
    assert plain(packing.pack(crowded(texts)), ("sequence_id",)) == plain(packing.pack(texts), ("sequence_id",))
    assert plain(repeats.remove_repeats(crowded(texts))) == plain(repeats.remove_repeats(texts))
    made = [token_output.materialise(rows, fresh_path(spark, "odd"), stride=64) for rows in (crowded(texts), texts)]
    assert plain(made[0]) == plain(made[1])


def test_clashing_columns_of_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://a/b", "<p>one</p><p>two</p>"), (2, None, None)], "page_id long, url string, html string")
    assert plain(html_extract.extract(pages.withColumns({"text": F.lit("x"), "n_chars": F.lit(1)}))) == plain(html_extract.extract(pages))
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<double>")
    one, two = (ann.search(v, v.where("vec_id % 20 = 0"), k=5) for v in (crowded(vectors), vectors))
    assert plain(one) == plain(two)


def test_texts_of_a_megabyte(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(200_000))
    rows = spark.createDataFrame([(1, long), (2, long[:-5] + "other"), (3, "x" * 1_000_000), (4, "a short one")], "doc_id long, text string").repartition(2)
    groups = {r.doc_id: r.component_id for r in ngram_join.near_groups(rows).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    coded = {r.doc_id: r for r in bpe.encode(rows.where("doc_id <> 3")).collect()}
    assert coded[1].n_tokens > 200_000 and coded[1].n_tokens > coded[4].n_tokens > 0
    assert sum(r.length for r in packing.pack(rows.where("doc_id <> 2")).collect()) > 200_000
    judged = {r.doc_id: r for r in quality.judge_measures(rows.withColumns({"lang": F.lit("en"), "source": F.lit("s")}), ("doc_id",)).collect()}
    assert judged[1].n_words == 200_000 and judged[3].base_failed
    kept = {r.doc_id: r for r in repeats.remove_repeats(rows).collect()}
    assert kept[1].spans == [] and len(bytes(kept[2].kept)) < 60 and len(bytes(kept[3].kept)) == 1_000_000


def test_links_of_pages(spark):
    """Links in scripts and other raw text don't count; rel is a list of words; broken markup takes linear time."""
    link = '<link rel="canonical" href="http://a.net/x">'
    pages = [
        (link, ["http://a.net/x"]),
        ("<LINK href=/y REL=canonical>", ["/y"]),
        ("<link rel='alternate canonical' href='/z'>", ["/z"]),
        ('<link rel="not-canonical" href="/n"><link rel="canonicals" href="/m"><link title="canonical" href="/t">', []),
        (f"<script>var s = '{link}'</script>", []),
        (f"<SCRIPT>{link}", []),
        (f"<style>{link}</style >{link}", ["http://a.net/x"]),
        (f"<!-- {link} --><textarea>{link}</textarea><title>{link}</title>", []),
        (f"<script>'<!--'</script>{link}", ["http://a.net/x"]),
        ('<meta http-equiv="refresh" content="0; url=/r?a=1&amp;b=2">', ["/r?a=1&b=2"]),
        ("<link canonical " * 60_000, []),
        ("<script>canonical" * 60_000, []),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, html string")
    got = {r.i: r.t or [] for r in rows.select("i", url_filter.link_targets(F.col("html")).alias("t")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(pages)}
