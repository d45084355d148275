"""Clustering, hard negatives and repeated strings against plain versions, on odd rows."""

import hashlib
import math
import os
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanwise.llm import clustering, html_extract, negatives, pii, repeats
from spanwise.llm.common import shared_dir

VECTORS = "vec_id long, embedding array<double>, label int, id string, x int, label_ long"


def vectors(spark, n=400, size=64, scale=1.0, seed=1):
    rng = np.random.RandomState(seed)
    centers = rng.randn(6, size)
    rows = [(i, [float(v) for v in scale * (centers[i % 6] + 0.4 * rng.randn(size))], i % 5, "c", 1, 2) for i in range(n)]
    rows += [(n, None, 1, "c", 1, 2), (n + 1, [1.0] * (size - 1), 1, "c", 1, 2), (n + 2, [None] + [1.0] * (size - 1), 1, "c", 1, 2)]
    rows += [(n + 3, [float("nan")] + [1.0] * (size - 1), 1, "c", 1, 2), (n + 4, [float("inf")] + [1.0] * (size - 1), None, "c", 1, 2)]
    rows += [(n + 5, [0.0] * size, 3, "c", 1, 2), (n + 6, rows[7][1], 2, "c", 1, 2), (n + 7, rows[7][1], 2, "c", 1, 2), rows[3]]
    return rows


def plain_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * v) if abs(v) < 1 << 53 else int(v) * 64 for v in x]) for i, x, *_ in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    names = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    c = [x for _, x in names[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        c = [[sum(col) // len(own[j]) for col in zip(*own[j], strict=True)] if j in own else y for j, y in enumerate(c)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = {j: sum(d for _, k_, d in found if k_ == j) for j in range(len(c))}
    long = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return [(i, j, long(d), long(inertia[j]), long(sum(inertia.values())), digest[j]) for i, j, d in found]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e9, 1e30])  # by float64 products, 64-bit differences, and Python's integers twice
def test_clusters(spark, scale):
    rows = [*vectors(spark, 150, scale=scale), (None, [scale] * 64, 1, "c", 1, 2)]
    got = clustering.cluster(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_clusters(rows)))


def test_few_or_no_vectors_to_cluster(spark):
    rows = vectors(spark, 5)[:4]
    got = clustering.cluster(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_clusters(rows))
    assert clustering.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert clustering.cluster(spark.createDataFrame([(1, None, 1, "", 1, 1)], VECTORS)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_guards_of_products():
    """At the bound, float64 products and integers must agree."""
    rng = np.random.RandomState(0)
    for most in (1 << 10, (1 << 22) - 1, 1 << 23, 1 << 27, 1 << 30):
        x, c = rng.randint(-most, most, (50, 64)), rng.randint(-most, most, (7, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
        assert clustering.distances(x, c).tolist() == want


def plain_negatives(rows, every, n_positives=5, k=5, low=80):
    good = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * v) for v in x])
        good[i] = min(good.get(i, own), own)
    sizes = [len(x) for _, x in good.values()]
    size = min(set(sizes), key=lambda d: (-sizes.count(d), d)) if sizes else 0
    good = {i: v for i, v in good.items() if len(v[1]) == size}
    out = []
    for a in (i for i in good if i % every == 0):
        score = {i: sum(p * q for p, q in zip(good[a][1], x, strict=True)) for i, (_, x) in good.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if good[i][0] == good[a][0]][:n_positives]:
            bad = [i for i in order if good[i][0] != good[a][0] and low * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(bad[:k])]
    return sorted(out)


def mined(rows, every, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mine(rows, F.col("id") % every == 0, label, **more).collect()))


@pytest.mark.parametrize("sizes", [(16384, 4096, 1024), (37, 11, 8)])  # one block, and many blocks and crowds
def test_negatives(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "CROWD", "PART"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(spark, 300, size=12)
    rows += [(None, [1.0] * 12, 1, "c", 1, 2), (900, rows[0][1], None, "c", 1, 2), (42, rows[9][1], 0, "c", 1, 2)]  # a second row of 42
    rows += [(1000 + i, [0.5] * 12, i % 2, "c", 1, 2) for i in range(30)]  # ties
    got = mined(spark.createDataFrame(rows, VECTORS), 10)
    assert got == plain_negatives(rows, 10) and len(got) > 100


def test_negatives_of_little(spark):
    assert mined(spark.createDataFrame([], VECTORS), 10) == []
    one = [(0, [1.0, 2.0], 1, "", 1, 1)]
    assert mined(spark.createDataFrame(one, VECTORS), 10) == []
    negative = [(i, [(-1.0) ** i, 0.0], i % 3, "", 1, 1) for i in range(12)]
    assert mined(spark.createDataFrame(negative, VECTORS), 2) == plain_negatives(negative, 2)
    large = [(20, [1e300, 1.0], 1, "", 1, 1), (10, [1.0, 1.0], 1, "", 1, 1), (11, [1.0, 1.0], 1, "", 1, 1), (3, [0.875, 0.875], 2, "", 1, 1)]
    assert mined(spark.createDataFrame(large, VECTORS), 10) == plain_negatives(large[1:], 10) == [(10, 11, 1, 3, 131072, 114688)]


def test_rotation_discards_and_never_errs():
    rng = np.random.RandomState(5)
    basis = rng.randn(64, 64) * (2.0 ** -np.arange(64))[:, None]
    x = np.floor(rng.randn(6000, 64) @ basis * 4096).astype(np.int64)
    turn = negatives.Rotation(x.astype(float).T @ x)
    assert turn.lead < 8
    a, ids = x[:40], np.arange(len(x))
    best = negatives.best_positives(turn, ids[:40], a, ids, x, 5)
    exact = a @ x.T
    exact[np.arange(40), np.arange(40)] = -(1 << 62)
    assert (best.id == np.lexsort((np.broadcast_to(ids, exact.shape), -exact), axis=1)[:, :5]).all()
    assert best.verified < 0.4 * exact.size  # the first part of a block is compared whole
    middle, room = turn.bounds(turn.turned(a), turn.turned(x))
    assert (np.abs(a @ x.T - middle) <= room).all()


def plain_repeats(rows, span):
    first, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - span + 1 if i is not None else 0):
            s = b[p : p + span]
            first[s] = min(first.get(s, i), i)
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1 if i is not None else 0):
            if first[b[p : p + span]] < i:
                gone[p : p + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).reshape(-1, 2)
        out.append((i, len(b), [(int(a), int(z)) for a, z in edges], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def repeating_texts(rng):
    pool = ["".join(rng.choice("abcdefgh é😀 ") for _ in range(rng.randint(20, 300))) for _ in range(12)]
    cut = lambda p: p[rng.randint(0, len(p) // 2) : rng.randint(len(p) // 2, len(p))]
    fresh = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 60)))
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.4 else cut(rng.choice(pool)) if rng.random() < 0.5 else fresh() for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 51), (None, pool[0]), (None, None), (-7, pool[1] + pool[2]), (1 << 62, pool[0] * 2)]
    rows += [(7, rows[8][1]), (7, rows[8][1]), (300, "word " * 5000), (299, "word " * 6000), (301, "y" * 20_000), (302, "y" * 30_000)]
    return rows


@pytest.mark.parametrize("small", [False, True])  # small: many buckets
def test_repeats(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(repeats, "RECORDS", 300)
        monkeypatch.setattr(repeats, "FRAGMENTS", 20)
    rows = repeating_texts(random.Random(2))
    frame = spark.createDataFrame([(*r, "b", 1, "k") for r in rows], "doc_id long, text string, block string, kind int, spans string").repartition(3)
    got = repeats.remove_repeats(frame, span=50)
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got.collect()]
    assert sorted(got, key=str) == plain_repeats(rows, 50)
    assert sum(len(s) for _, _, s, _ in got) > 50


def test_memory_of_a_block_with_repeats():
    n = 1 << 20
    raw = np.random.RandomState(1).randint(97, 123, n).astype(np.uint8).tobytes()
    block = repeats.Block(pa.array([[1, 2]], pa.list_(pa.int64()))[0], pa.array([[0, n // 2, n]])[0], pa.compress(raw, codec="zstd", asbytes=True), 50, 1)
    at = np.arange(n // 2, n - 100, 400)
    tracemalloc.start()
    spans = [spans for _, _, spans, _ in block.documents(at, at + 20)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == [[], [{"start": i - n // 2, "end": i - n // 2 + 69} for i in at.tolist()]]
    assert peak < 8 * n


def test_no_texts_to_repeat(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = repeats.remove_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.spans, bytes(r.kept)) for r in got) == [(1, 0, [], b""), (2, 0, [], b"")]


def by_blocks(rows, span, blocks, buckets):
    """The steps of remove_repeats without Spark, so that bounds can be set."""
    made = []
    for k in range(blocks):
        own = rows[k::blocks]
        raw = [(t or "").encode() for _, t in own]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).tolist()
        made.append(repeats.Block(pa.array([[i for i, _ in own]], pa.list_(pa.int64()))[0], pa.array([starts])[0], pa.compress(b"".join(raw), codec="zstd", asbytes=True), span, buckets))

    def grouped(sent, run):
        by, back = {}, {}
        for row in sent:
            by.setdefault(row["bucket"], []).append(row)
        for group in by.values():
            for row in run(pa.Table.from_pylist(group, repeats._schema(repeats._SENT))).to_pylist():
                back.setdefault(row["block"], []).append((row["bucket"], row["data"]))
        return back

    back = grouped([x for k, b in enumerate(made) for x in b.records.rows(k, repeats.OF_FRAGMENTS)], repeats._meet)
    states = [b.records.states(dict(back.get(k, []))) for k, b in enumerate(made)]
    suffixes = grouped([x for k, b in enumerate(made) for x in b.open_rows(k, states[k], 2)], repeats._suffixes(span))
    by_window = grouped([x for k, b in enumerate(made) if (states[k] == repeats.BY_WINDOW).any() for x in b.by_window(states[k], 2)[1].rows(k, repeats.OF_WINDOWS)], repeats._meet)
    out, seen = [], {int(s) for x in states for s in np.unique(x)}
    for k, b in enumerate(made):
        results = {repeats.OF_WINDOWS: dict(by_window.get(k, [])), repeats.OF_SUFFIXES: [x for _, x in suffixes.get(k, [])]}
        out += [(i, n, [(s["start"], s["end"]) for s in spans], kept) for i, n, spans, kept in b.documents(*b.starts_removed(states[k], results, 2))]
    return sorted(out, key=str), seen


@pytest.mark.parametrize(("slice_", "longest", "crowded", "hot", "span"), [(200, 40, 1, 2, 50), (1000, 5, 2, 1 << 16, 20), (1 << 20, 4096, 4, 2, 50), (300, 4096, 4, 1 << 16, 9), (1 << 20, 4096, 1, 1 << 16, 8)])
def test_bounds_of_groups_change_nothing(monkeypatch, slice_, longest, crowded, hot, span):
    for name, value in (("SLICE", slice_), ("LONGEST", longest), ("CROWDED", crowded), ("HOT", hot), ("_POWERS", {})):
        monkeypatch.setattr(repeats, name, value)
    seen = set()
    for seed in range(4):
        rows = repeating_texts(random.Random(seed))
        got, states = by_blocks(rows, span, 1 + 2 * (seed % 2), 3)
        assert got == plain_repeats(rows, span)
        seen |= states
    assert {repeats.CLEAN, repeats.REMOVED, repeats.BY_WINDOW} <= seen or hot > 2


@pytest.mark.parametrize("page", ["<div " * 200_000, "<a '" * 250_000, "<a '" * 250_000 + ">", "<a \"'" * 200_000 + ">", "<div>" * 4_000 + "</p>" * 200_000, "<!" * 500_000, "<" * 1_000_000, "</" * 400_000, "<div class='" + "ad-" * 300_000 + "'>"])
def test_hostile_pages_take_linear_time(page):
    begun = time.time()
    html_extract.main_text(page)
    assert time.time() - begun < 5


def test_broken_markup_is_text():
    assert html_extract.main_text("one <div two") == "one <div two"
    assert html_extract.main_text("<p>a < b <3</p><p>c <!-- no end <p>d") == "a < b <3\n\nc"
    assert html_extract.main_text("<p>x</p><![CDATA[a <b> c") == "x\n\na <b> c"
    assert html_extract.main_text("<a title='>'>in</a> <b>out</b>") == "in out"


def test_no_secret_is_left_behind(spark):
    secret = "ghp_" + "a1B2c3D4" * 4
    rows = spark.createDataFrame([(i, f"the token = {secret} was here") for i in range(20)], "doc_id long, text string")
    assert pii.find(rows).where("size(spans) > 0").count() == 20
    folder = shared_dir(spark).removeprefix("file://")
    assert not any(name.startswith("pii-") for name in os.listdir(folder) if os.path.isdir(f"{folder}/{name}"))
