import random
import time

from pyspark.sql import functions as F

from spanwise.functions.text import estimate_tokens, token_count
from spanwise.plans.chunks import plan, plan_chunks


def prose(n: int, words=("stone", "river", "under", "slowly", "bright", "old", "hill", "by")) -> str:
    """Numbered sentences, a blank line after every eighth."""
    return "".join(f"The {words[i % 8]} {words[(i * 3) % 8]} goes {words[(i * 5 + 1) % 8]} and {words[i % 5]} ({i})." + ("\n\n" if i % 8 == 7 else " ") for i in range(n))


def check(text: str, budget: int) -> list:
    spans = plan(text, budget)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(token_count(text[a:b]) <= budget for a, b, _ in spans)
    assert all(w > 0 for *_, w in spans) and abs(sum(w for *_, w in spans) - 1) < 1e-9
    assert all(x[0] < y[0] <= x[1] < y[1] for x, y in zip(spans, spans[1:], strict=False))
    return spans


def test_estimates(spark):
    texts = {"": 0, "abc": 1, "abcd": 2, "é": 1, "日本語": 3, "😀😀😀": 4}
    rows = spark.createDataFrame(list(texts.items()), "t string, n long").select("n", estimate_tokens(F.col("t")).alias("e")).collect()
    assert all(r.n == r.e for r in rows) and all(token_count(t) == n for t, n in texts.items())


def test_vectors():
    assert plan("A short note.", 1000) == [(0, 13, 1.0)]
    assert [x[:2] for x in plan("One. Two! Three? Four.", 4)] == [(0, 10), (10, 22)]
    assert [x[:2] for x in plan("日本語。テスト！終", 3)] == [(0, 3), (3, 6), (6, 9)]
    assert [x[:2] for x in plan("aaaa bbbb cccc dddd eeee ffff gggg", 5)] == [(0, 14), (14, 25), (25, 34)]
    assert plan("", 10) == [(0, 0, 1.0)]


def test_random_texts():
    rng = random.Random(4)
    parts = [" ", "\n", "\r\n", ". ", "! ", "?\" ", "。", "！", "日本", "😀", " ", "　", "it's"]
    for _ in range(400):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 300)))
        check(text, rng.randint(2, 80))


def test_overlap_evenness_and_cuts():
    text = prose(2000)
    spans = check(text, 5000)
    for x, y in zip(spans, spans[1:], strict=False):
        assert 0.05 <= len(text[y[0] : x[1]].encode()) / 15_000 < 0.1
        assert text[x[1] - 1].isspace() and text[y[0] - 1].isspace()
    sizes = [b - a for a, b, _ in check(prose(3000), 8000)]
    assert min(sizes) / max(sizes) > 0.85
    assert len(check("x" * 750_000, 28_784)) == 10
    check("x" * 50_000, 2000)


def test_speed():
    text = prose(24_000)
    assert len(text) > 1_000_000
    began = time.time()
    plan(text, 28_000)
    assert time.time() - began < 1


def test_column(spark):
    from spanwise.shipping import ship

    ship(spark)
    rows = spark.createDataFrame([(prose(60),), ("",), (None,)], "t string").select("t", plan_chunks(F.col("t"), 100).alias("s")).collect()
    for r in rows:
        assert r.s is None if r.t is None else [tuple(x) for x in r.s] == plan(r.t, 100)
