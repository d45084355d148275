"""What grows with the tables: rows that arise, files that stay."""

import numpy as np
from pyspark.sql import functions as F

from spanwise.llm import bpe, ngram_join
from spanwise.llm.common import written


def some_keys(spark, n=400, width=50):
    """(id, own, next, own_most, next_most) with few keys that two rows have, and all keys by row."""
    rng = np.random.RandomState(3)
    keys = rng.randint(-(1 << 62), 1 << 62, (n, width), dtype=np.int64)
    keys[1::4, 7] = keys[::4, 5]
    schema = "id long, own array<long>, next array<long>, own_most long, next_most long"
    return spark.createDataFrame([(i, k[:30].tolist(), k[30:].tolist(), 3, 4) for i, k in enumerate(keys)], schema).repartition(3), keys


def test_only_keys_that_others_may_have_become_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 1000)  # many buckets
    monkeypatch.setattr(ngram_join, "PACKED", 3000)
    table, keys = some_keys(spark)
    rows = ngram_join._key_rows(table).collect()
    owners = {}
    for i, k in enumerate(keys):
        for key in k.tolist():
            owners.setdefault(key, set()).add(i)
    shared = {(i, key) for key, of in owners.items() if len(of) > 1 for i in of}
    assert shared and shared <= {(r.x, r.key) for r in rows} and len(rows) < len(shared) + keys.size / 10
    assert all(r.total == (30, 20)[r.g] and r.prefix == (4, 5)[r.g] for r in rows)
    assert ngram_join._key_rows(table.limit(0)).count() == 0


def test_five_bytes_a_key_come_back():
    v = np.array([0, 1, (1 << 40) - 1, 1 << 39], np.uint64)
    assert ngram_join._unpacked(ngram_join._as_bytes(v)).tolist() == v.tolist() and len(ngram_join._as_bytes(v)) == 20


def test_written_tables_leave_no_shuffle_files(spark):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = held()
    table = written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "cleanup")
    assert held() <= before and table.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_words_of_few_texts_are_encoded_in_their_rows(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "qxzvkw qxzvkw wvvqjx"), (2, "wvvqjx zzkqwy"), (3, None), (4, "wvvqjx")], "doc_id long, text string")
    texts = docs.withColumnRenamed("doc_id", "id")
    assert [tuple(r) for r in bpe.counted_words(texts, path, pattern).collect()] == [("wvvqjx", 2)]
    assert bpe.encoded_words(texts, path, pattern, 0).count() == 0
    whole, none = bpe.encode(docs), bpe.encode(docs, broadcast_words=0)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, none.collect()))
    # No word's place is shuffled, however few words are broadcast.
    assert "Exchange" not in none._jdf.queryExecution().executedPlan().toString()
