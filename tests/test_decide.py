import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from spanwise import ColumnTransport, DecideError, decide, decide_one, result_schema
from spanwise.functions.answers import read_scalar
from spanwise.operators.ask import Run, backoff_ms, next_budget, verdict
from spanwise.question import chunk_tokens, labels_of, question_json, validate_question
from spanwise.queries import FOUND, LEVEL, TOPIC, _fake, keyword
from spanwise.sources.http import HttpError, HttpTransport, provider_message, retry_after

from .test_chunks import prose

BAD_QUESTIONS = [
    "no",
    TOPIC | {"more": 1},
    TOPIC | {"type": "rank"},
    TOPIC | {"instructions": " \n"},
    TOPIC | {"criteria": {"a": "x"}},
    TOPIC | {"criteria": {"a": "x", "b": " "}},
    LEVEL | {"criteria": ["x"]},
    LEVEL | {"criteria": ["x"] * 11},
    FOUND | {"criteria": {"true": "x"}},
    FOUND | {"instructions": {"x": float("nan")}},
]


@pytest.mark.parametrize("question", BAD_QUESTIONS)
def test_bad_questions(question):
    with pytest.raises(DecideError) as e:
        validate_question(question)
    assert e.value.code == "invalid_request"


def test_questions():
    for q in (TOPIC, LEVEL, FOUND, FOUND | {"criteria": {"true": "a", "false": {}}}):
        validate_question(q)
    assert labels_of({"type": "choice", "criteria": {"b": 1, "10": 1, "2": 1, "01": 1}}) == ["2", "10", "b", "01"]
    assert chunk_tokens({"type": "noul", "instructions": "Mentions forests?"}) == 28_784
    assert question_json({"a": "é"}) == '{"a":"é"}'
    with pytest.raises(DecideError):
        chunk_tokens(FOUND | {"instructions": "x" * 100_000})


def response(**answer):
    return {"answers": {"decision": answer}}


def test_read_scalar():
    a, p = read_scalar(TOPIC, response(type="choice", choice="en", probabilities={"en": 0.6, "fr": 0.33, "other": 0.06}, confidence=0.7))
    assert p is None and a["probs"][0] == pytest.approx(0.6 / 0.99) and sum(a["probs"]) == pytest.approx(1)
    assert read_scalar(FOUND, response(type="noul", noul=0.8))[0]["probs"] == pytest.approx([0.2, 0.8])
    for bad in (None, {}, response(type="score"), response(type="choice", choice="en"), response(type="choice", choice="en", probabilities={"en": "1"}), response(type="choice", choice="xx", probabilities={"en": 1})):
        assert read_scalar(TOPIC, bad)[1]


def test_policies():
    assert [verdict(413), verdict(429), verdict(500), verdict(404), verdict(None, True), verdict(None)] == ["too_long", "retry", "retry", "fail", "retry", "fail"]
    assert backoff_ms(2, None, 0.0) == 500 and backoff_ms(1, 99_000.0) == 30_000 and backoff_ms(1, 0) == 0
    assert next_budget(28_753, 1000) == 750
    assert retry_after("2") == 2000 and retry_after(" ") is None and retry_after("x") is None
    assert provider_message('{"error": {"message": " no "}}', "text") == "no"
    assert provider_message('{"message": "abcdefghijklmnopqrstuvwxyz"}', "__bcdefghijklmnopqrstuvwxyz") is None
    assert provider_message("<html>", "t") is None


def run(transport, text, budget, **more):
    return Run(text, TOPIC, transport, "m", wait=lambda ms: None, **more)


def test_retries_and_usage():
    seen = []

    def flaky(request, timeout):
        seen.append(request)
        if len(seen) == 1:
            raise HttpError("slow down", 429, 5.0)
        if len(seen) == 2:
            raise ConnectionError
        return _fake(request, timeout)

    r = run(flaky, "the end", 1000)
    spans, answers = r.decide(1000)
    assert len(spans) == 1 and answers[0]["label"] == "en" and (r.requests, r.input_tokens, r.cost) == (3, 100, 0.001) and r.answered_by() == "keyword-1"


def test_gives_up_after_four():
    def down(request, timeout):
        raise HttpError("down", 503)

    r = run(down, "text", 1000)
    with pytest.raises(DecideError) as e:
        r.decide(1000)
    assert r.requests == 4 and e.value.status == 503 and e.value.chunk == 0


def test_replans_and_concurrency():
    text, now, most, lock = prose(3000), 0, 0, threading.Lock()

    def short(request, timeout):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        try:
            if len(request["state"]) > 20_000:
                raise HttpError("too long", 413)
            return _fake(request, timeout)
        finally:
            with lock:
                now -= 1

    spans, answers = run(short, text, 8000).decide(8000)
    assert spans[-1][1] == len(text) and len(spans) == len(answers) and most <= 4
    with pytest.raises(DecideError) as e:
        run(lambda r, t: (_ for _ in ()).throw(HttpError("x", 413)), text, 8000).decide(8000)
    assert "too long" in e.value.message and e.value.status == 413


def test_cancel():
    stop = threading.Event()
    stop.set()
    with pytest.raises(DecideError) as e:
        run(_fake, "text", 1000, cancelled=stop).decide(1000)
    assert e.value.code == "aborted"


def test_decide_both_ways(spark):
    rows = spark.createDataFrame([(1, prose(200)), (2, "the the que"), (3, " \n"), (4, None)], "id long, text string")
    one = {r.id: r.result for r in decide(rows, TOPIC, transport=keyword(TOPIC), max_chunk_tokens=500, on_error="column").collect()}
    two = {r.id: r.result for r in decide(rows, TOPIC, transport=_fake, max_chunk_tokens=500, on_error="column").collect()}
    for i in (1, 2):
        assert one[i].label == two[i].label and one[i].agreement == pytest.approx(two[i].agreement) and len(one[i].chunks) == len(two[i].chunks)
    assert one[2].agreement == 1 and len(one[1].chunks) > 1
    assert one[3].error.code == two[4].error.code == "invalid_request" and one[3].answer is None
    with pytest.raises(Exception, match="invalid_request"):
        decide(rows, TOPIC, transport=keyword(TOPIC)).collect()


def test_malformed_column(spark):
    wrong = ColumnTransport(lambda t: keyword(LEVEL).function(t))
    r = decide(spark.createDataFrame([("x",)], "text string"), TOPIC, transport=wrong, on_error="column").first().result
    assert r.error.code == "request_failed" and "expected a choice answer" in r.error.message and r.error.chunk == 0


def test_gates(spark, monkeypatch):
    monkeypatch.delenv("SPANWISE_API_KEY", raising=False)
    for options, code in (
        ({"input": "x", "question": TOPIC, "oops": 1}, "invalid_request"),
        ({"input": " ", "question": "bad"}, "invalid_request"),
        ({"input": "x", "question": TOPIC, "combine": "max", "transport": _fake}, "invalid_request"),
        ({"input": "x", "question": TOPIC, "max_input_tokens": 0, "transport": _fake}, "invalid_request"),
        ({"input": "x", "question": TOPIC}, "invalid_request"),
        ({"input": "x" * 750_003, "question": TOPIC, "transport": _fake}, "input_too_large"),
    ):
        with pytest.raises(DecideError) as e:
            decide_one(spark, **options)
        assert e.value.code == code
    assert decide_one(spark, input="the end", question=TOPIC, transport=_fake)["label"] == "en"


def test_sql_names(spark):
    from spanwise.sql import register

    register(spark)
    assert spark.sql("SELECT estimate_tokens('abcd') AS n, size(plan_chunks('One. Two! Three? Four.', 4)) AS k").first() == (2, 2)


def test_agreement_vectors(spark):
    from spanwise.operators.combine import agreement, combine

    def chunks(*rows):
        return F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(v).cast("double").alias("value"), F.lit(None).cast("string").alias("label"), F.array(F.lit(1 - p), F.lit(p)).alias("probs"), F.lit(None).cast("double").alias("confidence")) for w, v, p in rows])

    one = spark.range(1)
    noul = one.select(agreement(FOUND, chunks((0.5, 0.2, 0.2), (0.5, 0.8, 0.8))).alias("x")).first().x
    assert noul == pytest.approx(0.4)
    dissent = one.select(agreement(FOUND, chunks((0.49, 1.0, 1.0), (0.49, 1.0, 1.0), (0.02, 0.0, 0.0))).alias("x")).first().x
    assert dissent == pytest.approx(1 - 0.0196 / 0.2597)
    same = one.select(agreement(FOUND, chunks((0.5, 0.7, 0.7), (0.5, 0.7, 0.7))).alias("x")).first().x
    assert same == 1
    best = one.select(combine(FOUND, chunks((0.9, 0.2, 0.2), (0.1, 0.95, 0.95)), "max").alias("x")).first().x
    assert best.value == 0.95


class _Model(BaseHTTPRequestHandler):
    """Answers by the text: a status to fail with, or an answer."""

    def do_POST(self):
        request = json.loads(self.rfile.read(int(self.headers["content-length"])))
        status, body, headers = self.server.answers[request["state"]]
        self.server.seen.append((self.headers["authorization"], request))
        if status is None:
            self.server.hold.wait(5)
            status = 200
        self.send_response(status)
        for name, value in headers.items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def test_http_connector():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Model)
    server.hold, server.seen = threading.Event(), []
    quoting = "the first twenty characters of this text are quoted"
    server.answers = {
        "good": (200, '{"answers": {}}', {}),
        "busy": (429, '{"error": {"message": "slow down"}}', {"retry-after": "1.5"}),
        "long": (400, '{"message": "maximum context length"}', {}),
        quoting: (400, json.dumps({"message": "cannot read: " + quoting}), {}),
        "html": (200, "<html>", {}),
        "slow": (None, "{}", {}),
    }
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"127.0.0.1:{server.server_port}"
    call = HttpTransport(f"http://{host}/decide", "key-1")
    ask = lambda text, timeout=5.0: call({"state": text, "questions": {"decision": FOUND}}, timeout)
    assert ask("good") == {"answers": {}}
    assert server.seen[0][0] == "Bearer key-1" and server.seen[0][1]["questions"]["decision"]["type"] == "noul"
    for text, status, wait, said in (("busy", 429, 1500.0, f"{host} returned HTTP 429: slow down"), ("long", 413, None, "maximum context"), (quoting, 400, None, "HTTP 400"), ("html", None, None, "JSON")):
        with pytest.raises(HttpError) as e:
            ask(text)
        assert (e.value.status, e.value.retry_after_ms) == (status, wait) and said in str(e.value) and quoting not in str(e.value)
    with pytest.raises(TimeoutError):
        ask("slow", 0.3)
    server.hold.set()
    server.shutdown()
    server.server_close()
    with pytest.raises(ConnectionError):
        ask("good")
    assert "key-1" not in repr(call)


def test_cancel_running_call(spark):
    stop = threading.Event()

    def slow(request, timeout):
        time.sleep(30)

    threading.Timer(3, stop.set).start()
    begun = time.time()
    with pytest.raises(DecideError) as e:
        decide_one(spark, input="a text", question=FOUND, transport=slow, cancelled=stop)
    assert e.value.code == "aborted" and time.time() - begun < 20
    with pytest.raises(DecideError) as e:
        decide_one(spark, input="a text", question=FOUND, transport=_fake, cancelled=stop)
    assert e.value.code == "aborted"
    assert decide_one(spark, input="the end", question=TOPIC, transport=_fake, cancelled=threading.Event())["label"] == "en"


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([("the the que", 1, 2, 3, "x")], "_chunks string, _error int, _DONE int, _answer int, text string")
    for model in (keyword(TOPIC), _fake):
        r = decide(rows, TOPIC, input_col="_chunks", transport=model).first()
        assert list(r[:5]) == ["the the que", 1, 2, 3, "x"] and r.result.label == "en"
    with pytest.raises(DecideError, match="output_col"):
        decide(rows.withColumn("result", F.lit(1)), TOPIC, transport=_fake)
    assert "said" in decide(rows.withColumn("result", F.lit(1)), TOPIC, transport=_fake, output_col="said").columns


def test_result_schema(spark):
    rows = spark.createDataFrame([("the",)], "text string")
    for question in (TOPIC, LEVEL, FOUND):
        for model in (keyword(question), _fake):
            assert decide(rows, question, transport=model).schema["result"].dataType.simpleString() == result_schema(question).simpleString()


def test_first_failing_gate_is_named(spark, monkeypatch):
    monkeypatch.delenv("SPANWISE_API_KEY", raising=False)
    wrong = [("oops", 1, "oops"), ("input", " ", "input must"), ("question", {}, None), ("combine", "most", "combine must"), ("max_input_tokens", 0, "max_input_tokens"), ("model", " ", "model must"), ("url", "x", "API key")]
    good = {"input": "x", "question": TOPIC}
    for k, (_, _, said) in enumerate(wrong):
        options = good | {name: value for name, value, _ in wrong[k:]}
        with pytest.raises(DecideError) as e:
            decide_one(spark, **options)
        assert said is None or said in e.value.message
