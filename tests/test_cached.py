"""Answers by content, remote calls whose filters reach the scan, many questions, against a model on a local server."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from spanwise import ColumnTransport, DecideError, decide
from spanwise.functions.text import token_count
from spanwise.operators.ask import Run
from spanwise.operators.cached import AnswerCache, decide_cached
from spanwise.operators.many import decide_many, unnested
from spanwise.queries import FOUND, LEVEL, QUESTIONS, TOPIC, _fake_many, keyword
from spanwise.shared import fresh_folder
from spanwise.sources.http import HttpError

from .test_chunks import prose


class _Model(BaseHTTPRequestHandler):
    def do_POST(self):
        request = json.loads(self.rfile.read(int(self.headers["content-length"])))
        text, server = request["state"], self.server
        with server.lock:
            server.seen.append(request)
            server.now += 1
            server.peak = max(server.peak, server.now)
        if server.slow:
            time.sleep(server.slow)
        status = 413 if token_count(text) > server.most else next((s for word, s in server.fails.items() if word in text), 200)
        body = json.dumps(_fake_many(request, 1) if status == 200 else {"message": "no"}).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)
        with server.lock:
            server.now -= 1

    def log_message(self, *_):
        pass


@pytest.fixture
def model():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Model)
    server.seen, server.fails, server.most, server.lock = [], {}, 10**9, threading.Lock()
    server.now, server.peak, server.slow = 0, 0, 0
    server.options = {"url": f"http://127.0.0.1:{server.server_port}/decide", "api_key": "k"}
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()
    server.server_close()


def table(spark, rows, more="note string"):
    return spark.createDataFrame(rows, f"id long, text string, {more}")


def cached(rows, cache, server, **options):
    return {r.id: r.result for r in decide_cached(rows, TOPIC, cache, "id", on_error="column", **server.options, **options).collect()}


def test_filters_reach_the_scan(spark, model, tmp_path):
    table(spark, [(i, f"the text {i}", "n") for i in range(20)]).write.parquet(str(tmp_path / "t"))
    decided = decide(spark.read.parquet(str(tmp_path / "t")), TOPIC, on_error="column", **model.options)
    one = decided.where("id = 5")
    assert "EqualTo(id,5)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.first().result.label == "en" and len(model.seen) == 1
    # Filters on the result ask once for each row, however often they mention it.
    model.seen.clear()
    good = decided.where("result.error is null and result.agreement > 0 and result.label <> 'x' and note = 'n'").select("id", "result.label")
    assert len(good.where("label = 'en'").collect()) == 20 == len(model.seen)


def test_only_new_chunks_are_asked(spark, model):
    cache = AnswerCache(spark, fresh_folder(spark, "cache"))
    long = prose(60)
    rows = table(spark, [(1, long, "a"), (2, long, "b"), (3, "the end", "c"), (4, "the end", "d"), (5, " ", "e"), (6, None, "f")])
    one = cached(rows, cache, model, max_chunk_tokens=300)
    plain = {r.id: r.result for r in decide(rows, TOPIC, on_error="column", max_chunk_tokens=300, **model.options).collect()}
    n = len(one[1].chunks)
    assert n > 2 and len(model.seen) == n + 1 + 2 * n + 2
    for i, want in plain.items():
        assert (one[i].label, one[i].probs, one[i].confidence, one[i].agreement, one[i].chunks, one[i].error, one[i].answer) == (want.label, want.probs, want.confidence, want.agreement, want.chunks, want.error, want.answer)
    # Paid for once, by the first that needs it.
    assert [one[i].usage.requests for i in range(1, 7)] == [n, 0, 1, 0, 0, 0] and one[1].usage.cost_usd == pytest.approx(0.001 * n) and one[2].usage.cost_usd is None
    model.seen.clear()
    again = cached(rows.union(table(spark, [(7, "the new", "g"), (0, long, "h")])), cache, model, max_chunk_tokens=300)
    assert len(model.seen) == 1 == again[7].usage.requests and again[0].probs == one[1].probs and again[0].usage.requests == 0
    # Another question or model has answers of its own.
    model.seen.clear()
    assert cached(rows, cache, model, max_chunk_tokens=300, model="other")[3].usage.requests == 1 and len(model.seen) == n + 1
    assert one[1].model == "keyword-1"
    cache.forget_plans()
    assert cache.answers(TOPIC, "default").count() == n + 2


def test_failures_are_asked_again(spark, model):
    cache = AnswerCache(spark, fresh_folder(spark, "cache"))
    rows = table(spark, [(1, "the bad one", ""), (2, "the good one", ""), (3, "the bad one", "")])
    model.fails = {"bad": 400}
    got = cached(rows, cache, model)
    assert got[1].error.code == got[3].error.code == "request_failed" and got[1].error.status == 400 and got[1].error.message.startswith("Chunk 1 of 1 failed: 127.0.0.1") and got[1].chunks is None
    assert got[2].label == "en" and len(model.seen) == 2
    with pytest.raises(Exception, match="request_failed"):
        decide_cached(rows, TOPIC, cache, "id", **model.options).collect()
    model.fails, before = {}, len(model.seen)
    got = cached(rows, cache, model)
    assert [got[i].label for i in (1, 2, 3)] == ["en"] * 3 and len(model.seen) == before + 1


def test_too_long_chunks_are_planned_anew(spark, model):
    cache = AnswerCache(spark, fresh_folder(spark, "cache"))
    text = prose(150)
    model.most = 1500
    rows = table(spark, [(1, text, ""), (2, "the end", "")])
    got = cached(rows, cache, model, max_chunk_tokens=2000)
    tokens = token_count(text)
    assert tokens > 2000 and got[1].error is None and len(got[1].chunks) > 1 and got[2].label == "en"
    assert all(token_count(text[c.start : c.end]) <= 1500 for c in got[1].chunks) and got[1].chunks[-1].end == len(text)
    model.most = 1
    got = cached(rows, AnswerCache(spark, fresh_folder(spark, "cache")), model, max_chunk_tokens=2000)
    assert got[1].error.status == got[2].error.status == 413 and "even after shrinking" in got[1].error.message


def test_cache_gates(spark, model):
    cache = AnswerCache(spark, fresh_folder(spark, "cache"))
    got = decide_cached(table(spark, [(None, "the", ""), (1, "the", ""), (1, "que", ""), (2, "x" * 40, "")]), TOPIC, cache, "id", max_input_tokens=10, on_error="column", **model.options).collect()
    said = sorted((str(r.id), r.result.error.code) for r in got if r.result.error)
    assert said == [("1", "invalid_request"), ("1", "invalid_request"), ("2", "input_too_large"), ("None", "invalid_request")]
    assert decide_cached(table(spark, []), TOPIC, cache, "id", **model.options).count() == 0
    for wrong in ({"transport": keyword(TOPIC)}, {"on_error": "x"}, {"output_col": "note"}, {"max_requests": 3}, {"max_requests": True}):
        with pytest.raises(DecideError):
            decide_cached(table(spark, []), TOPIC, cache, "id", **(model.options | wrong))


def test_requests_at_a_time_are_bounded(spark, model):
    model.slow = 0.05
    rows = table(spark, [(i, f"the {i}", "") for i in range(60)]).repartition(6)
    assert all(r.error is None for r in cached(rows, AnswerCache(spark, fresh_folder(spark, "cache")), model, max_requests=5).values())
    assert len(model.seen) == 60 and 2 <= model.peak <= 5


def test_many_questions(spark, model):
    rows = table(spark, [(1, prose(60), "a"), (2, "the the que", "b"), (3, " ", "c")])
    many = decide_many(rows.withColumn("_many", F.lit(1)), QUESTIONS, combine_how={"level": "max"}, on_error="column", max_chunk_tokens=300, **model.options)
    got = {r.id: r for r in many.collect()}
    n = len(got[1].result.answers.topic.chunks)
    assert n > 2 and len(model.seen) == n + 1 == got[1].result.usage.requests + 1 and got[1]._many == 1
    assert all(set(r["questions"]) == set(QUESTIONS) for r in model.seen)
    for name, question in QUESTIONS.items():
        how = "max" if name == "level" else "average"
        want = decide(rows.where("id < 3"), question, transport=keyword(question), combine_how=how, max_chunk_tokens=300).collect()
        for r in want:
            a = got[r.id].result.answers[name]
            assert (a.label, a.value, a.agreement) == (r.result.label, pytest.approx(r.result.value), pytest.approx(r.result.agreement)) and a.answer.asDict().keys() == r.result.answer.asDict().keys()
    assert got[3].result.error.code == "invalid_request" and got[3].result.answers.topic is None
    long = unnested(many.where("id < 3"), QUESTIONS, "id").collect()
    assert sorted((r.id, r.question) for r in long) == sorted((i, q) for i in (1, 2) for q in QUESTIONS)


def test_many_questions_fail_as_one(spark):
    rows = table(spark, [(1, "the end", "")])
    models = {"topic": keyword(TOPIC), "level": keyword(LEVEL), "found": ColumnTransport(lambda t: keyword(TOPIC).function(t))}
    r = decide_many(rows, QUESTIONS, transport=models, on_error="column").first().result
    assert r.error.code == "request_failed" and r.error.message.startswith("Chunk 1 of 1 failed") and "expected a noul answer" in r.error.message and r.answers.topic is None

    def forgets(request, timeout):
        out = _fake_many(request, timeout)
        del out["answers"]["level"]
        return out

    r = decide_many(rows, QUESTIONS, transport=forgets, on_error="column").first().result
    assert r.error.code == "request_failed" and "expected a score answer" in r.error.message and r.usage.requests == 1
    for questions, more in (({}, {}), ("x", {}), (QUESTIONS, {"combine_how": {"no": "max"}}), (QUESTIONS, {"combine_how": "max"}), (QUESTIONS, {"transport": {"topic": keyword(TOPIC)}}), (QUESTIONS, {"transport": keyword(TOPIC)}), (QUESTIONS, {"output_col": "note"})):
        with pytest.raises(DecideError):
            decide_many(rows, questions, **({"transport": _fake_many} | more))
    with pytest.raises(DecideError, match="too long"):
        decide_many(rows, {str(i): FOUND | {"instructions": "x" * 30_000} for i in range(4)}, transport=_fake_many)


def test_waits_as_told_and_wakes_when_stopped():
    seen = []

    def busy(request, timeout):
        seen.append(time.time())
        if len(seen) < 3:
            raise HttpError("busy", 429, 300.0)
        return _fake_many(request, timeout)

    Run("the end", TOPIC, busy, "m").decide(1000)
    assert len(seen) == 3 and all(0.25 < b - a < 2 for a, b in zip(seen, seen[1:], strict=False))
    seen.clear()

    def first_waits(request, timeout):
        if "rock" in request["state"][:200]:
            raise HttpError("busy", 429, 20_000.0)
        time.sleep(0.3)
        raise HttpError("no", 401)

    begun = time.time()
    with pytest.raises(DecideError) as e:
        Run("rock " * 300 + "tree " * 3000, TOPIC, first_waits, "m").decide(1000)
    assert e.value.status == 401 and time.time() - begun < 5


def test_failed_chunks_go_to_the_next_model(spark):
    def first(request, timeout):
        if "que" in request["state"]:
            raise HttpError("no", 401)
        if "bad" in request["state"]:
            return {"answers": {}, "usage": {"input_tokens": 7}}
        return _fake_many(request, timeout) | {"model": "one"}

    def second(request, timeout):
        assert request["model"] == "two"
        if "zzz" in request["state"]:
            raise HttpError("no", 400)
        return {k: v for k, v in _fake_many(request, timeout).items() if k != "model"}

    rows = table(spark, [(1, "the end", ""), (2, "que que", ""), (3, "bad", ""), (4, "que zzz", ""), (5, "the. " * 300 + "que. " * 300, "")])
    got = {r.id: r.result for r in decide(rows, TOPIC, transport=first, fallbacks=[("two", second)], on_error="column", max_chunk_tokens=200).collect()}
    used = {i: [(m.model, m.chunks, m.requests) for m in r.by_model] for i, r in got.items()}
    assert used[1] == [("default", 1, 1), ("two", 0, 0)] and got[1].model == "one" and used[2] == [("default", 0, 1), ("two", 1, 1)] and got[2].model == "two"
    assert got[3].label is not None and got[3].by_model[0].input_tokens == 7 and got[3].usage.requests == 2
    assert got[4].error.code == "request_failed" and got[4].error.status == 400
    n = len(got[5].chunks)
    assert used[5][0][1] + used[5][1][1] == n and 0 < used[5][1][2] < n == used[5][0][2] and got[5].error is None
    for wrong in ([("x",)], [("", second)], [("two", 1)]):
        with pytest.raises(DecideError):
            decide(rows, TOPIC, transport=first, fallbacks=wrong)
    with pytest.raises(DecideError):
        decide(rows, TOPIC, transport=keyword(TOPIC), fallbacks=[("two", second)])
