"""Queries over tables that differ from the generated ones: other layouts, odd texts."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from spanwise import decide, queries
from spanwise.operators.levels import decide_levels
from spanwise.streaming import decide_stream, run_available

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    """A function that writes rows of documents, in two files, and gives the folder of the tables."""

    def write(texts):
        d = tmp_path_factory.mktemp("tables")
        rows = [(i, t, ("en", "fr")[i % 2], "web", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, DOCUMENTS).repartition(2).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, 0, "user", "the end"), (1, 1, "user", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
        return str(d)

    return write


def both(spark, name, d):
    """The query's rows and its SQL's, numbers to six digits."""
    plain = lambda rows: sorted((tuple(round(v, 6) + 0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    found = queries.QUERIES[name](spark, d)
    with duckdb.connect() as con:
        for table in glob.glob(f"{d}/*.parquet"):
            con.execute(f"CREATE VIEW {table.split('/')[-1].removesuffix('.parquet')} AS SELECT * FROM '{table}/*.parquet'")
        told = con.execute(queries.SQL[name])
        at = [[c[0] for c in told.description].index(c) for c in found.columns]
        return plain(found.collect()), plain([r[i] for i in at] for r in told.fetchall())


def test_a_stream_reads_tables_of_many_files(spark, some):
    found, told = both(spark, "stream_decide", some(["the cat", "que la vie", "x"] * 3))
    assert found == told and len(found) == 9


def test_a_stream_without_rows_gives_none(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    rows = run_available(spark, decide_stream(stream, queries.FOUND, transport=queries.keyword(queries.FOUND)), f"{tmp_path}/rows", f"{tmp_path}/state")
    assert rows.count() == 0 and rows.select(F.col("result.value")).columns == ["value"]


#: Nothing, white space of several kinds and lengths, and texts around them.
ODD = ["the cat", "", "   ", None, "que la vie", "\n\n \t", "the que " * 400, " " * 4000, chr(0x3000) * 3, "the end. " * 900 + " " * 9000]


@pytest.mark.parametrize(
    "name",
    ["best_threshold", "agreement_vs_quality", "calibration", "cached_decide", "confidence_signals", "decide_anywhere", "decide_documents", "decide_levels", "f1_thresholds", "decide_score", "label_f1", "public_answer", "reduced_answers", "reliability", "single_chunk", "score_errors"]
    + ["stream_decide", "decide_many", "rpc_decide_many", "rpc_decide", "usage_rollup", "plan_chunks", "chunk_overlap", "chunk_state", "chunks_function", "ask_noul"],
)
def test_every_text_with_a_character_is_decided(spark, some, name):
    found, told = both(spark, name, some(ODD))
    assert found == told and found


def test_texts_over_the_size_gate_are_decided(spark, some):
    rows = queries.QUERIES["decide_anywhere"](spark, some(["the cat. " * 90_000])).collect()
    assert len(rows) == 1 and rows[0]["chunks"] > 500


def test_blank_texts_are_asked_about_only_on_demand(spark):
    df = spark.createDataFrame([(1, " "), (2, ""), (3, None)], "id long, text string")
    code = lambda **more: [r["code"] for r in decide(df, queries.FOUND, transport=queries.keyword(queries.FOUND), on_error="column", **more).orderBy("id").select("result.error.code").collect()]
    assert code() == ["invalid_request"] * 3 and code(ask_blank=True) == [None, None, "invalid_request"]


def test_blank_sections_of_a_text_do_not_fail_levels(spark):
    ask = lambda text: decide_levels(spark.createDataFrame([(1, text)], "id long, text string"), queries.FOUND, [[]], "id", section_tokens=100, transport=queries.keyword(queries.FOUND)).collect()
    assert len(ask("the end. " * 20 + " " * 2000)) == 2
    with pytest.raises(Exception, match="invalid_request"):
        ask(" " * 2000)


#: Texts of one chunk and of several, by the model's window.
LONG = ["the cat ", "que la vie. " * 9_000, "the end. " * 2_100, "the que " * 2_000, "que the end. " * 20_001]


@pytest.mark.parametrize("name", ["retry_policy", "replan_budget", "fallback_model", "run_counters", "too_long_phrases"])
def test_failing_models_are_asked_about_whole_texts(spark, some, name):
    # A null text has no label to compare.
    texts = [t for t in ODD + LONG if t is not None or name != "fallback_model"]
    found, told = both(spark, name, some(texts))
    assert found == told and found


def test_ties_of_rounding_fall_as_in_sql(spark):
    # A document of check_s: its exact level is 1.8359375, and SQL's sum is the number below.
    w, p = [0.3494318181818182, 0.328125, 0.3224431818181818], [2 / 3, 0.5, 2 / 3]
    with duckdb.connect() as con:
        (told,) = con.execute("SELECT round(sum(weight * 3 * p), 6)::VARCHAR FROM (SELECT unnest(?) AS weight, unnest(?) AS p)", [w, p]).fetchone()
    value = sum(a * (3 * b) for a, b in zip(w, p, strict=True))
    df = spark.createDataFrame([(value, "score", [(a, [1 - b, 0.0, 0.0, b]) for a, b in zip(w, p, strict=True)])], "value double, type string, chunks array<struct<weight:double,probs:array<double>>>")
    row = df.select(F.round("value", 6).cast("string").alias("before"), queries._six(queries._as_sql(F.col("value"), F.col("type"), F.col("chunks"))).cast("string").alias("now")).first()
    assert row["now"] == told != row["before"]
