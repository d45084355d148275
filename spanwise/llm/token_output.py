"""Training-order materialisation: token records in a keyed random order, in shards of fixed stride.

A document's ids and an end id are cut into records of ``stride`` ids. Documents reserve consecutive
places, as many as their bytes could need (a token has at least one byte), so places are known before
anything is encoded and texts are encoded once. A keyed Feistel network permutes the reserved places;
results outside the range are permuted again (cycle walking) until inside, so that it is a bijection.
Range partitions of the permuted places are the shards: each is sorted, closed up (places that no
record took vanish) and written as one file of equal strides, 2 bytes an id, padded with the end id.
A record's global slot is its position plus the sizes of the shards before. The order of any subset of
a permutation is itself one, so slots are a keyed permutation of the records.

A shard is written under a temporary name and moved into place: a repeated task replaces it by the
same bytes. ``read_slots`` reads any range of slots with one seek for each shard, so training resumes
anywhere. Only sizes by partition and by shard come to the driver.

Defined results: null text counts as empty: one record with the end id; repeated rows give records
each; an empty table gives no rows. The input must give the same rows in the same partitions when read
twice (files do); otherwise the run fails rather than giving two records one place.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_in_arrow
from .common import fresh_path, written
from .tokens import default_path, json_tokenizer

STRIDE = 256
END = 2
KEY = 0x51A7E5EED
#: Records of a shard, about; from the reserved places, which are about four times the records.
SHARD_PLACES = 1 << 18
_U = np.uint64


def feistel(x: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed bijection of 0 .. size - 1."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = [_U((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % (1 << 64)) for r in range(1, rounds + 1)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> _U(half), v & mask
        for k in keys:
            f = (b ^ k) * _U(0x94D049BB133111EB)
            f = (f ^ (f >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> _U(32)) & mask)
        return (a << _U(half)) | b

    out = once(x.astype(_U))
    while len(outside := np.flatnonzero(out >= _U(size))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def materialise(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, end: int = END, key: int = KEY, path: str | None = None) -> DataFrame:
    """Writes the shards; returns every record: id, piece, n_tokens, ids_crc32, shard, position, slot."""
    spark = docs.sparkSession
    path = path or default_path("byte_bpe_50k.json")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    needs = lambda n_bytes: n_bytes // stride + 1  # noqa: E731  of n_bytes ids at most and the end id

    def sizes(batches):
        total = sum(int(needs(batch.column(0).to_numpy()).sum()) for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.int64())], names=["part", "n"])

    reserved = map_in_arrow(docs.select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), sizes, "part long, n long").collect()
    reserved = sorted((r["part"], r["n"]) for r in reserved)
    first = dict(zip([p for p, _ in reserved], accumulate([n for _, n in reserved], initial=0), strict=False))
    size, limit = sum(n for _, n in reserved), dict(reserved)
    shards = max(1, -(-size // SHARD_PLACES))

    def encode(batches):
        tokenizer, part = json_tokenizer(path), TaskContext.get().partitionId()
        used = 0
        for batch in batches:
            ids, out, places = batch.column(0).to_pylist(), [], []
            for i, text in zip(ids, batch.column(1), strict=True):
                text = text.as_py() or ""
                t = np.append(tokenizer.encode(text), np.uint32(end))
                if t.max() > 0xFFFF:
                    raise ValueError("ids over 65535 need a wider record")
                t = t.astype("<u2")
                for k in range(0, len(t), stride):
                    out.append((i, k // stride, min(stride, len(t) - k), t[k : k + stride].tobytes()))
                    places.append(used + k // stride)
                used += needs(len(text.encode()))
            if used > limit.get(part, 0):
                raise RuntimeError("the input changed between two readings")
            place = feistel(np.array(places, np.int64) + first.get(part, 0), size, key)
            shard = (place.astype(object) * shards // size).astype(np.int32) if size > 1 << 40 else (place * shards // max(size, 1)).astype(np.int32)
            i, k, n, b = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.binary()), pa.array(place), pa.array(shard)], names=["id", "piece", "n_tokens", "ids", "place", "shard"])

    def write(batches):
        system, root = _open(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, sink, position, name = None, None, 0, ""

        def close() -> None:
            if sink is not None:
                sink.close()
                system.move(f"{root}/{name}.{attempt}", f"{root}/{name}")

        for batch in batches:
            rows = []
            for ids, s in zip(batch.column(3), batch.column(5).to_pylist(), strict=True):
                if s != shard:
                    close()
                    shard, position, name = s, 0, f"shard-{s:08d}.bin"
                    sink = system.open_output_stream(f"{root}/{name}.{attempt}")
                ids = ids.as_py()
                sink.write(ids + np.full(stride - len(ids) // 2, end, "<u2").tobytes())
                # As unsigned 32-bit ids, like the other operators'.
                rows.append((s, position, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4"))))
                position += 1
            s, p, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s, pa.int64()), pa.array(p, pa.int64()), pa.array(c, pa.int64())], names=["id", "piece", "n_tokens", "shard", "position", "ids_crc32"])
        close()

    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    records = map_in_arrow(docs, encode, "id long, piece long, n_tokens long, ids binary, place long, shard int")
    dealt = records.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place")
    index = written(map_in_arrow(dealt, write, "id long, piece long, n_tokens long, shard long, position long, ids_crc32 long"), "token-index")
    counts = dict(index.groupBy("shard").agg(F.count(F.lit(1))).collect())
    starts = list(accumulate([counts.get(s, 0) for s in range(shards)], initial=0))
    table = spark.createDataFrame([(s, starts[s]) for s in range(shards)], "shard long, _first long")
    out = index.join(F.broadcast(table) if shards < 100_000 else table, "shard")
    return out.select(F.col("id").alias(id_col), "piece", "n_tokens", "ids_crc32", "shard", "position", (F.col("_first") + F.col("position")).alias("slot"))


def read_slots(folder: str, counts: list[int], start: int, number: int, stride: int = STRIDE) -> np.ndarray:
    """Records [start, start + number) as an array of ids; counts: records of each shard, in order."""
    system, root = _open(folder)
    parts, at = [], 0
    for shard, n in enumerate(counts):
        a, b = max(start, at), min(start + number, at + n)
        if a < b:
            with system.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
                f.seek((a - at) * stride * 2)
                parts.append(np.frombuffer(f.read((b - a) * stride * 2), "<u2").reshape(-1, stride))
        at += n
    return np.concatenate(parts) if parts else np.zeros((0, stride), "<u2")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return materialise(docs, fresh_path(spark, "token-shards"))
