"""Chunk rows without gathering, levels, other reducers, evaluation, and the planner on hostile texts."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanwise import DecideError, decide
from spanwise.functions.text import BREAK, sentences
from spanwise.operators.combine import agreement, combine, combine_rows
from spanwise.operators.evaluate import best_threshold, calibration, chunk_band, label_f1, reliability, score_errors, thresholds
from spanwise.operators.levels import decide_levels
from spanwise.operators.observe import observed
from spanwise.operators.reducers import REDUCERS, adjusted_confidence, agreement_rows, agreement_with, answer_of, base_confidence, effective_chunks, majority, reduce_probs
from spanwise.plans import chunks as planner
from spanwise.queries import FOUND, LEVEL, TOPIC, _failing, keyword

from .test_chunks import prose

CHUNK = "id long, idx int, weight double, value double, label string, probs array<double>, confidence double"


def random_chunks(kind, seed=1):
    rng, rows = random.Random(seed), []
    n = {"choice": 3, "score": 4, "noul": 2}[kind]
    for i in [*range(30), None]:
        count = rng.choice([1, 1, 2, 3, 7, 40])
        weights = [rng.random() for _ in range(count)]
        for k in range(count):
            p = [round(rng.random(), rng.choice([1, 6])) + 0.001 for _ in range(n)]
            p = [x / sum(p) for x in p]
            value = None if kind == "choice" else sum(j * x for j, x in enumerate(p)) if kind == "score" else p[1]
            sure = None if kind == "noul" or (i is not None and i % 5 == 0 and k == 1) else rng.random()
            rows.append((i, k, weights[k] / sum(weights), value, ["en", "fr", "other"][rng.randint(0, 2)] if kind == "choice" else None, p, sure))
    return rows


@pytest.mark.parametrize(("kind", "how"), [("choice", "average"), ("score", "average"), ("score", "max"), ("noul", "average"), ("noul", "max")])
def test_rows_combine_as_arrays_do(spark, kind, how):
    question = {"choice": TOPIC, "score": LEVEL, "noul": FOUND}[kind]
    rows = spark.createDataFrame(random_chunks(kind), CHUNK).repartition(5)
    chunks = F.array_sort(F.collect_list(F.struct("idx", "weight", "value", "label", "probs", "confidence")))
    arrays = rows.groupBy("id").agg(chunks.alias("c"))
    want = {r.id: r for r in arrays.select("id", combine(question, F.col("c"), how).alias("a"), agreement(question, F.col("c")).alias("g")).collect()}
    got = combine_rows(rows, question, how).collect()
    assert len(got) == len(want) == 31
    for r in got:
        a = want[r.id].a
        assert (r.label, r.value, r.confidence, r.agreement) == (a.label, pytest.approx(a.value, abs=1e-12), pytest.approx(a.confidence, abs=1e-12), pytest.approx(want[r.id].g, abs=1e-12))
        assert r.probs == pytest.approx(a.probs, abs=1e-12)
    again = combine_rows(rows.repartition(3, "value", "idx"), question, how).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_an_input_of_many_chunks(spark):
    """200,000 chunks of one input: by sorted sums, not by pairs, and no array of them."""
    n = 200_000
    p = (F.hash("idx") % 10_000).cast("double").alias("p")
    rows = spark.range(n).select(F.lit(1).alias("id"), F.col("id").alias("idx")).select("id", "idx", F.abs(p) / 10_000).toDF("id", "idx", "p")
    rows = rows.select("id", "idx", F.lit(1 / n).alias("weight"), F.col("p").alias("value"), F.lit(None).cast("string").alias("label"), F.array(1 - F.col("p"), F.col("p")).alias("probs"), F.lit(None).cast("double").alias("confidence"))
    got = combine_rows(rows, FOUND)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    r = got.first()
    values = sorted(x.value for x in rows.select("value").collect())
    mean = sum(v * (2 * i - n + 1) for i, v in enumerate(values)) * 2 / (n * (n - 1))
    assert r.agreement == pytest.approx(1 - mean, abs=1e-6) and r.value == pytest.approx(sum(values) / n)


def test_levels(spark):
    texts = [(1, "a", "x", prose(80)), (2, "a", "y", "the the end"), (3, "b", "x", "que que que"), (4, "b", "x", "the que"), (5, None, "z", "the")]
    rows = spark.createDataFrame(texts, "at_ long, lang string, source string, text string")
    got = decide_levels(rows, FOUND, [["lang", "source"], ["lang"], []], "at_", section_tokens=400, transport=keyword(FOUND), max_chunk_tokens=200).collect()
    leaf = {r.at_: r for r in got if r.level == 0}
    assert sorted(leaf) == [1, 2, 3, 4, 5] and leaf[1].parts > 2 and leaf[1].bytes == len(texts[0][3])
    flat = {r.at_: r.result.value for r in decide(rows, FOUND, transport=keyword(FOUND), max_chunk_tokens=200).collect()}
    assert leaf[3].value == pytest.approx(flat[3]) and leaf[3].agreement == 1
    size = {i: len(t) for i, _, _, t in texts}
    for r in got:
        below = [i for i, lang, source, _ in texts if r.level == 3 or (r.level == 2 and lang == r.lang) or (r.level == 1 and (lang, source) == (r.lang, r.source))]
        if r.level:
            assert r.bytes == sum(size[i] for i in below) and r.value == pytest.approx(sum(leaf[i].value * size[i] for i in below) / r.bytes) and r.at_ is None
    top = next(r for r in got if r.level == 3)
    assert top.parts == 3 and 0 <= top.agreement < 1
    strong = {r.at_: r.result.value for r in decide(rows, FOUND, transport=keyword(FOUND), combine_how="max", max_chunk_tokens=200).collect()}
    best = decide_levels(rows, FOUND, [["lang"]], "at_", combine_how="max", transport=keyword(FOUND), max_chunk_tokens=200).where("level = 1").collect()
    assert {r.lang: r.value for r in best} == {k: max(strong[i] for i, lang, *_ in texts if lang == k) for k in ("a", "b", None)}
    with pytest.raises(DecideError):
        decide_levels(rows, FOUND, [["lang"], ["source"]], "at_", transport=keyword(FOUND))
    with pytest.raises(DecideError):
        decide_levels(rows.withColumnRenamed("lang", "value"), FOUND, [["value"]], "at_", transport=keyword(FOUND))


def test_long_texts_get_answers_by_sections(spark):
    text = prose(400)
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    limit = len(text) // 3 // 4
    refused = decide(rows, FOUND, transport=keyword(FOUND), max_input_tokens=limit, on_error="column").first().result
    assert refused.error.code == "input_too_large"
    r = decide_levels(rows, FOUND, [], "id", section_tokens=limit, max_input_tokens=limit, transport=keyword(FOUND), max_chunk_tokens=300).first()
    assert r.parts >= 4 and 0 < r.value < 1


def columns(*rows):
    return F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.array(*[F.lit(float(x)) for x in p]).alias("probs"), F.lit(c).cast("double").alias("confidence")) for w, p, c in rows])


def test_reducers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    three = columns((0.5, (0.8, 0.2, 0), 0.9), (0.3, (0.1, 0.9, 0), 0.5), (0.2, (0.3, 0.3, 0.4), 0.7))
    want = {"weighted_mean": (0.49, 0.43, 0.08), "mean": (0.4, 1.4 / 3, 0.4 / 3), "median": (0.3, 0.3, 0.0), "min": (0.1, 0.2, 0.0), "max": (0.8, 0.9, 0.4), "percentile": (0.3, 0.2, 0.0)}
    for how in REDUCERS:
        total = sum(want[how])
        assert value(reduce_probs(TOPIC, three, how)) == pytest.approx([x / total for x in want[how]]), how
    assert value(reduce_probs(TOPIC, three, "percentile", 1.0)) == pytest.approx([0.8 / 2.1, 0.9 / 2.1, 0.4 / 2.1])
    assert value(reduce_probs(FOUND, columns((0.5, (1, 0), None), (0.5, (0, 1), None)), "min")) == [0, 0]
    even = columns((0.5, (1, 0), None), (0.25, (0.5, 0.5), None), (0.25, (0, 1), None), (0, (0.2, 0.8), None))
    assert value(reduce_probs(FOUND, even, "median")) == pytest.approx([0.35 / (0.35 + 0.65), 0.65])
    assert value(majority(TOPIC, three)) == pytest.approx([0.5, 0.3, 0.2]) and value(majority(TOPIC, three, by_weight=False)) == pytest.approx([1 / 3, 1 / 3, 1 / 3])
    tie = columns((0.5, (0, 1, 0), None), (0.5, (1, 0, 0), None))
    assert value(answer_of(TOPIC, majority(TOPIC, tie))) == "en"
    assert value(answer_of(LEVEL, F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4))))) == pytest.approx(2.0) and value(answer_of(FOUND, F.array(F.lit(0.3), F.lit(0.7)))) == 0.7
    for bad in (("sum", 0.5), ("percentile", 2)):
        with pytest.raises(DecideError):
            reduce_probs(TOPIC, three, *bad)


def test_signals(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    alone, apart = columns((1, (0.3, 0.7), 0.6)), columns((0.5, (1, 0), 0.9), (0.5, (0, 1), 0.5))
    probs = lambda c: reduce_probs(FOUND, c, "weighted_mean")
    assert value(agreement_with(alone, probs(alone))) == 1 and value(agreement_with(apart, probs(apart))) == 0.5
    assert value(effective_chunks(alone)) == 1 and value(effective_chunks(apart)) == 2
    assert value(base_confidence(FOUND, alone, probs(alone))) == pytest.approx(0.4) and value(base_confidence(LEVEL, apart, probs(apart))) == pytest.approx(0.7)
    assert value(base_confidence(TOPIC, columns((0.5, (1, 0, 0), None), (0.5, (1, 0, 0), 0.3)), F.lit(None))) is None
    adjusted = lambda base, n, agreed: value(adjusted_confidence(F.lit(base), F.lit(n), F.lit(agreed)))
    assert adjusted(0.6, 1.0, 1.0) == 0.6 and adjusted(0.6, 9.0, 0.5) == 0.6 and adjusted(0.6, 1e9, 1.0) == pytest.approx(0.98)
    assert adjusted(0.6, 5.0, 0.9) == pytest.approx(0.6 + 0.38 * (1 - math.exp(-1)) * 0.8**2)
    rows = spark.createDataFrame(random_chunks("choice"), CHUNK)
    arrays = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "weight", "probs"))).alias("c"))
    want = {r.id: r.x for r in arrays.select("id", agreement_with(F.col("c"), reduce_probs(TOPIC, F.col("c"), "weighted_mean")).alias("x")).collect()}
    assert {r.id: pytest.approx(r.agreement, abs=1e-9) for r in agreement_rows(rows, TOPIC).collect()} == want


def judged():
    rng = random.Random(3)
    rows = [(rng.choice("ab"), round(rng.random(), 3), rng.randint(0, 1), rng.choice("xyz"), rng.choice("xyw")) for _ in range(500)]
    return [*rows, ("a", None, 1, None, "x"), ("a", 0.5, None, "x", None), ("b", float("nan"), 1, "x", "x"), ("a", 1.0, 1, "x", "x"), ("a", 0.0, 0, "x", "x")]


def test_evaluation(spark):
    rows = judged()
    frame = spark.createDataFrame(rows, "g string, p double, y int, label string, truth string")
    p, y = F.col("p"), F.col("y")
    good = [(g, a, b) for g, a, b, *_ in rows if a is not None and not math.isnan(a) and b is not None]
    for r in calibration(frame, p, y, ["g"]).collect():
        own = [(a, b) for g, a, b in good if g == r.g]
        bins = {}
        for a, b in own:
            bins.setdefault(min(9, int(a * 10)), []).append((a, b))
        n = len(own)
        assert (r.n, r.accuracy) == (n, pytest.approx(sum((a >= 0.5) == (b == 1) for a, b in own) / n))
        assert r.brier == pytest.approx(sum((a - b) ** 2 for a, b in own) / n) and r.mae == pytest.approx(sum(abs(a - b) for a, b in own) / n)
        assert r.ece == pytest.approx(sum(abs(sum(a - b for a, b in v)) for v in bins.values()) / n)
    assert sum(r.n for r in reliability(frame, p, y).collect()) == len(good)
    for r in thresholds(frame, p, y, ["g"], 20).collect():
        own = [(a, b) for g, a, b in good if g == r.g]
        called = [b for a, b in own if math.floor(a * 20) >= r.step]
        hit, there = sum(called), sum(b for _, b in own)
        assert r.f1 == pytest.approx(2 * hit / (len(called) + there)) and r.recall == pytest.approx(hit / there) and r.precision == pytest.approx(hit / len(called))
    best = {r.g: r for r in best_threshold(frame, p, y, ["g"], 20).collect()}
    every = thresholds(frame, p, y, ["g"], 20).collect()
    assert all(best[g].f1 == max(r.f1 for r in every if r.g == g) for g in "ab")
    pairs = [(a, b) for *_, a, b in rows if a and b]
    got = {r.label: r for r in label_f1(frame, F.col("label"), F.col("truth")).collect()}
    assert set(got) == set("xyzw")
    for k, r in got.items():
        assert (r.called, r.there) == (sum(a == k for a, _ in pairs), sum(b == k for _, b in pairs)) and r.f1 == pytest.approx(2 * sum(a == b == k for a, b in pairs) / (r.called + r.there))
    assert got["x"].macro_f1 == pytest.approx(sum(r.f1 for r in got.values()) / 4)
    e = score_errors(frame, 3 * p, 3 * y).first()
    assert e.mae == pytest.approx(3 * sum(abs(a - b) for _, a, b in good) / len(good)) and e.bias == pytest.approx(3 * sum(a - b for _, a, b in good) / len(good))
    assert calibration(frame.limit(0), p, y).first().n in (0, None) and label_f1(frame.limit(0), F.col("label"), F.col("truth")).count() == 0
    bands = [r[0] for r in spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 10, 11)], "n int").select(chunk_band(F.col("n"))).collect()]
    assert bands == ["1", "2", "3-5", "3-5", "6-10", "6-10", "over 10"]


def test_counters_of_a_run(spark):
    rows = spark.createDataFrame([("x" * n,) for n in range(7, 21)] + [(" ",)], "text string")
    seen, counters = observed(decide(rows, TOPIC, transport=_failing, on_error="column"))
    usage = seen.select("result.usage.requests", "result.error.code").collect()
    told = counters.get
    assert told["inputs"] == 15 and told["requests"] == sum(r.requests for r in usage) and told["answered"] == 2 == told["chunks"]
    assert (told["invalid_request"], told["request_failed"], told["aborted"]) == (1, 12, 0)


def test_chunks_in_sql(spark):
    from spanwise.sql import register

    register(spark)
    text = prose(30)
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string").createOrReplaceTempView("texts_to_chunk")
    got = spark.sql("SELECT id, c.* FROM texts_to_chunk, LATERAL chunks(t, 100) c ORDER BY id, idx").collect()
    want = planner.plan(text, 100)
    assert [(r.start, r.end, r.weight, r.state) for r in got if r.id == 1] == [(a, z, w, text[a:z]) for a, z, w in want]
    assert [tuple(r) for r in got if r.id != 1] == [(3, 0, 0, 0, 1.0, "")]


def test_sentences_are_the_same_in_linear_time(spark):
    plain, rng = re.compile(rf"[\s\S]*?(?:{BREAK})|[\s\S]+\Z"), random.Random(1)
    parts = [".", "!", "?", '"', "'", ")", "]", "\n", " ", "a", "é", "。", "！", "　", "’", " ", ". ", '."', "...", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        assert list(planner._sentences(t)) == plain.findall(t)
    got = spark.createDataFrame([(t,) for t in texts[:300]], "t string").coalesce(1).select(sentences(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [plain.findall(t) for t in texts[:300]]
    for text in ("a" + "." * 750_000 + "b", '."' * 375_000, "x" * 750_000, "a.b" * 250_000, ". " * 375_000):
        begun = time.time()
        spans = planner.plan(text, 28_000)
        assert spans[-1][1] == len(text) and time.time() - begun < 8
    begun = time.time()
    assert spark.createDataFrame([("." * 200_000 + "a",)], "t string").select(F.size(sentences(F.col("t")))).first()[0] == 1 and time.time() - begun < 20


def test_words_fill_pieces_as_before():
    """The fast way through plain sentences against gathering word by word."""

    def slow(text, most):
        out = []
        for sentence in planner._sentences(text):
            run = []
            for atom in planner._ATOM.findall(sentence) if planner._bytes(sentence) > most else [sentence]:
                if planner._bytes(atom) <= most:
                    run.append(atom)
                else:
                    planner._gathered(run, most, out)
                    run = []
                    planner._gathered(list(atom), most, out)
            planner._gathered(run, most, out)
        return out

    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\t", "\n", ". ", "x" * rng.randint(1, 12), "é", "\x1c"]) for _ in range(rng.randint(0, 60)))
        most = rng.choice([4, 7, 12, 37])
        assert planner.pieces(text, most) == slow(text, most)
