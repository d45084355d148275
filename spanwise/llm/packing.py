"""Best-fit packing of documents into token sequences, bulk-synchronously.

A document is its token ids and an end id; only documents longer than a sequence are cut, into full
sequences after a shorter first piece. Pieces are range-sorted by (length, id, piece) over the
cluster, which gives each a rank among the pieces of its length: its length class. There are at most
as many classes as a sequence has tokens, however large the corpus. Gaps are kept the same way, as
ranges of sequences that have equally much room left.

Rounds go down the lengths. In a round, the class is matched with the successor gap, the smallest that
holds it; conflicts are resolved by rank: the lowest ranks take the first sequences of the range, as
many to each as fit. The range's gap is updated, and the sweep repeats until the class is placed; new
sequences are opened only when no gap holds it. Since whole classes and ranges move at once, a sweep
costs one step, not one for each piece, and its outcome is that of best-fit decreasing. The sweeps
run on the histogram of lengths; every piece then finds its place from its own rank, in parallel.

Only counts by (partition, length) come to the driver: at most partitions + classes rows. Defined
results: null text counts as empty: one piece, the end id; repeated rows are packed each; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_in_arrow
from .common import written
from .tokens import default_path, json_tokenizer

CAPACITY = 1024
END = 2


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """Of every row of (id, text) its pieces: id, piece, start, length, crc."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches):
        tokenizer = json_tokenizer(path)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1), strict=True):
                t = np.append(tokenizer.encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(t) % capacity or capacity
                cuts = [0, *range(first, len(t) + 1, capacity)]
                rows += [(i, k, a, b - a, zlib.crc32(t[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["id", "piece", "start", "length", "crc"])

    return map_in_arrow(docs, run, "id long, piece long, start long, length long, crc long")


@dataclass(frozen=True)
class Placement:
    """Ranks [rank, rank + count) of a length go to the sequences from ``sequence`` on, ``each`` to one, from ``offset`` on."""

    length: int
    rank: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Best fit over length classes: how many pieces there are of each length decides all."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, how many)
    opened, out = 0, []
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, length
        while left:
            while room < capacity and not gaps[room]:
                room += 1
            if gaps[room]:
                first, n = gaps[room].pop()
            else:  # no gap holds it
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full, rest = divmod(min(left, n * each), each)
            for sequences, per in ((full, each), (1, rest)) if rest else ((full, each),):
                if sequences:
                    out.append(Placement(length, rank, sequences * per, per, first, capacity - room))
                    gaps[room - per * length].append((first, sequences))
                    rank, left, first, n = rank + sequences * per, left - sequences * per, first + sequences, n - sequences
            if n:
                gaps[room].append((first, n))
            room = length  # what is left of the gap may be the smallest that holds the next
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """Every piece with its sequence and place: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = written(pieces(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), capacity, end, path), "pack-pieces")

    def number(batches):
        """Partition, and the piece's number among those of its length there."""
        part, last, n = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            starts = np.flatnonzero(np.diff(lengths, prepend=-1))
            run = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.append(starts, len(lengths))))
            if len(lengths) and lengths[0] == last:
                run[: starts[1] if len(starts) > 1 else len(lengths)] += n
            if len(lengths):
                last, n = lengths[-1], int(run[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int64)), pa.array(run, pa.int64())], names=["id", "piece", "start", "length", "crc", "part", "nth"])

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(spread, "length", "id", "piece").sortWithinPartitions("length", "id", "piece")
    ranked = written(map_in_arrow(ranged, number, "id long, piece long, start long, length long, crc long, part long, nth long"), "pack-ranked")
    found = sorted((r["length"], r["part"], r["n"]) for r in ranked.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for length, part, n in found:
        base[length, part] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    steps = sorted(plan(counts, capacity), key=lambda p: (p.length, p.rank))
    # At most a few steps for each pair of a length and a range of gaps: bounded by the capacity, not by the corpus.
    table = np.array([(p.length, p.rank, p.each, p.sequence, p.offset) for p in steps], np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table, base))

    def place(batches):
        steps, base = shared.value
        keys = steps[:, 0] * (1 << 50) + steps[:, 1]
        for batch in batches:
            length, part, nth = (batch.column(k).to_numpy() for k in (3, 5, 6))
            rank = nth + np.array([base[k] for k in zip(length.tolist(), part.tolist(), strict=True)], np.int64)
            at = steps[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1]
            local = rank - at[:, 1]
            sequence, offset = at[:, 3] + local // at[:, 2], at[:, 4] + local % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = map_in_arrow(ranked, place, "id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
