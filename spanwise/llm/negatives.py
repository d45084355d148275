"""Hard-negative mining: for anchors and their positives, the best rows of another label within a window of scores.

Scores are inner products of whole-number vectors. An orthogonal rotation, the eigenvectors of all rows'
second moments, moves most of every vector's length into its leading components. A block of rows meets a
crowd of anchors; the partial products of the leading components come first, and what is left of a pair's
score is at most the product of both residual norms, plus a slack for rounding and for what the rotation
lacks in orthogonality. Pairs whose bounds lie outside every window, or below the k-th find so far, are
discarded; only survivors get their exact product, in 64-bit integers. So the rotation never decides a result.

Rows are dealt to blocks of about BLOCK by hash, anchors to crowds of about CROWD: positives within a label
(a label of any size has as many blocks as it needs), negatives over all rows. Nothing is broadcast but
the rotation. Each block passes on at most k finds for an anchor and window; they are merged in two levels.
All rows are compared with the stated anchors, in blocks: time grows with rows times anchors.

Defined results: rows with a null id or label, or a null vector or one that holds null or non-finite
components or has another length than most, take no part, nor do vectors with a component so large
that a score might leave a long (``reach``); of several rows with one id the least by (label, vector)
stands for all; ties go to the smaller id; an anchor without positives, or a pair without negatives, has
no row; an empty table gives no rows. Extra columns, of any name, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_in_arrow, ship
from .common import discard, written

BLOCK = 16384
CROWD = 4096
#: Rows of a block that are compared at once.
PART = 1024
#: Share of the rows' summed squares that the leading components hold.
LEAD = 0.75
FOUND = pa.list_(pa.struct([("loss", pa.int64()), ("id", pa.int64())]))
_NONE = np.iinfo(np.int64).min


def reach(size: int) -> int:
    """Components up to this keep a hundred times any score within a long."""
    return math.isqrt((1 << 56) // max(1, size))


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: Column, factor: int) -> tuple[DataFrame, int]:
    """((id, label, x) of the rows that take part, x in whole numbers; their length)."""
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(good & F.col(id_col).isNotNull() & label_col.isNotNull()).select(F.col(id_col).cast("long").alias("id"), label_col.cast("long").alias("label"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    size = sizes[0]["d"] if sizes else 0
    small = F.forall(F.col("v"), lambda x: F.abs(factor * x.cast("double")) <= reach(size))
    whole = F.transform("v", lambda x: F.floor(factor * x.cast("double")).cast("long"))
    rows = rows.where((F.size("v") == size) & small).select("id", "label", whole.alias("x"))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("s")).select("id", "s.label", "s.x")
    return rows, size


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    lists = pa.concat_arrays(table[column].chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.int64, copy=False)


class Rotation:
    """An orthogonal rotation, its number of leading components, and bounds of scores by them."""

    def __init__(self, moments: np.ndarray):
        values, vectors = np.linalg.eigh(moments)
        self.r = np.ascontiguousarray(vectors[:, ::-1])
        held = np.cumsum(np.maximum(values[::-1], 0))
        self.lead = min(len(held), int(np.searchsorted(held, LEAD * held[-1])) + 1)
        d = len(held)
        # Off orthogonality, rounding of both rotations and of the partial product: for each unit of both lengths.
        self.slack = 2 * np.linalg.norm(self.r.T @ self.r - np.eye(d)) + 16 * (d + 2) * 2.0**-52

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leading components, residual norms, lengths)."""
        y = x.astype(np.float64) @ self.r
        rest = np.sqrt((y[:, self.lead :] ** 2).sum(1))
        return y[:, : self.lead], rest, np.sqrt((y * y).sum(1))

    def bounds(self, a, x) -> tuple[np.ndarray, np.ndarray]:
        """(middle, room): every score is within room of middle, for anchors and rows as ``turned`` gives them."""
        return a[0] @ x[0].T, a[1][:, None] * x[1] + (self.slack * a[2])[:, None] * x[2] + 1e-6


def rotation(rows: DataFrame, size: int) -> Rotation:
    """From the second moments of all rows, summed in a tree."""

    def moments(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = map_in_arrow(rows.select("x"), moments, "m binary").rdd
    total = parts.treeAggregate(np.zeros((size, size)), lambda a, row: a + np.frombuffer(row.m).reshape(size, size), lambda a, b: a + b)
    return Rotation(total)


class Best:
    """The k best (score, id) of each of n slots, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _NONE), np.zeros((n, k), np.int64)
        self.k = k

    def kth(self) -> np.ndarray:
        """What a score must reach, as a float that is never above it."""
        least = self.score[:, -1].astype(np.float64)
        return np.where(self.score[:, -1] == _NONE, -np.inf, least - np.abs(least) * 2.0**-52)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        slots = np.concatenate((np.repeat(touched, self.k), slot))
        scores = np.concatenate((self.score[touched].ravel(), score))
        ids = np.concatenate((self.id[touched].ravel(), ids))
        order = np.lexsort((ids, np.where(scores == _NONE, np.iinfo(np.int64).max, -scores), slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        keep = place < self.k
        self.score[slots[keep], place[keep]] = scores[keep]
        self.id[slots[keep], place[keep]] = ids[keep]

    def lists(self) -> tuple[np.ndarray, pa.ListArray]:
        """(slots with finds, their finds)."""
        has = self.score != _NONE
        slots = np.flatnonzero(has.any(1))
        offsets = np.concatenate(([0], np.cumsum(has[slots].sum(1)))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(-self.score[slots][has[slots]]), pa.array(self.id[slots][has[slots]])], names=["loss", "id"])
        return slots, pa.ListArray.from_arrays(pa.array(offsets), pairs)


def best_positives(turn: Rotation, anchor_ids, a, ids, x, k: int) -> Best:
    """Each anchor's k best other rows; all are of its label."""
    best, ta, verified = Best(len(a), k), turn.turned(a), 0
    for at in range(0, len(x), PART):
        part = slice(at, at + PART)
        middle, room = turn.bounds(ta, turn.turned(x[part]))
        r, c = np.nonzero((middle + room >= best.kth()[:, None]) & (anchor_ids[:, None] != ids[part]))
        best.add(r, (a[r] * x[part][c]).sum(1), ids[part][c])
        verified += len(r)
    best.verified = verified
    return best


def best_negatives(turn: Rotation, labels, a, positives: np.ndarray, ids, of_rows, x, k: int, low: int) -> Best:
    """For each anchor and each of its positives' scores p (_NONE: none): the k best rows of other labels with low * p <= 100 * score <= 100 * p."""
    n = positives.shape[1]
    best, ta, verified = Best(len(a) * n, k), turn.turned(a), 0
    for at in range(0, len(x), PART):
        part = slice(at, at + PART)
        middle, room = turn.bounds(ta, turn.turned(x[part]))
        may, other = np.zeros(middle.shape, bool), labels[:, None] != of_rows[part]
        kth = best.kth().reshape(len(a), n)
        for j in range(n):
            p = np.where(positives[:, j] == _NONE, -1, positives[:, j]).astype(np.float64)
            wide = np.abs(p) * 2.0**-50
            floor = np.maximum(p * low / 100 - wide, kth[:, j])
            may |= (positives[:, j] >= 0)[:, None] & (middle + room >= floor[:, None]) & (middle - room <= (p + wide)[:, None])
        r, c = np.nonzero(may & other)
        score = (a[r] * x[part][c]).sum(1)
        verified += len(r)
        for j in range(n):
            p = positives[r, j]
            ok = (p != _NONE) & (score <= p) & (low * np.where(p == _NONE, 0, p) <= 100 * score)
            best.add(r[ok] * n + j, score[ok], ids[part][c[ok]])
    best.verified = verified
    return best


def mine(vectors: DataFrame, anchors: Column, label: Column, n_positives: int = 5, k: int = 5, low: int = 80, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors``: a condition on ``id``.

    ``low``: the least negative score as hundredths of the positive's.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, size = rows_of(vectors, id_col, vector_col, label, factor)
    rows = written(rows, "negatives-rows")
    asked = rows.where(anchors)
    anchor_rows = asked.select(F.col("id").alias("q"), F.col("label").alias("ql"), F.col("x").alias("qx"))
    n, n_anchors = rows.count(), asked.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], schema)
    turn = rotation(rows, size)
    parted = lambda count, most: F.ceil(count / most).cast("int")
    dealt = lambda col, parts: F.pmod(F.xxhash64(col), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    found_type = "array<struct<loss:long,id:long>>"

    def merged(found: DataFrame, keys: list[str], blocks: int, most: int) -> DataFrame:
        one = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, most).alias("found")
        shard = F.pmod(F.col("block"), F.lit(max(1, math.isqrt(blocks)))).alias("shard")
        return found.groupBy(*keys, shard).agg(one).groupBy(*keys).agg(one)

    # Positives: blocks within each label.
    per_label = rows.groupBy("label").agg(parted(F.count(F.lit(1)), BLOCK).alias("blocks"), F.greatest(F.lit(1), parted(F.count_if(anchors), CROWD)).alias("crowds"), F.count_if(anchors).alias("asked"))
    per_label = written(per_label.where("asked > 0").drop("asked"), "negatives-labels")
    left = rows.join(per_label, "label").select("label", dealt("id", F.col("blocks")).alias("block"), every(F.col("crowds")).alias("crowd"), "id", "x")
    right = anchor_rows.join(per_label.withColumnRenamed("label", "ql"), "ql").select("ql", every(F.col("blocks")).alias("block"), dealt("q", F.col("crowds")).alias("crowd"), "q", "qx")

    def positives(rows: pa.Table, asked: pa.Table) -> pa.Table:
        slots, lists, q, block = np.zeros(0, np.int64), pa.array([], FOUND), np.zeros(0, np.int64), 0
        if rows.num_rows and asked.num_rows:
            q, block = asked["q"].to_numpy(), asked["block"][0].as_py()
            slots, lists = best_positives(turn, q, _matrix(asked, "qx"), rows["id"].to_numpy(), _matrix(rows, "x"), n_positives).lists()
        return pa.Table.from_arrays([pa.array(q[slots]), pa.array(np.full(len(slots), block, np.int32)), lists], names=["q", "block", "found"])

    found = left.groupBy("label", "block", "crowd").cogroup(right.groupBy("ql", "block", "crowd")).applyInArrow(positives, f"q long, block int, found {found_type}")
    close = written(merged(found, ["q"], -(-n // BLOCK), n_positives), "negatives-positives")

    # Negatives: blocks over all rows.
    blocks, crowds = max(1, -(-n // BLOCK)), max(1, -(-n_anchors // CROWD))
    left = rows.select(dealt("id", F.lit(blocks)).alias("block"), every(F.lit(crowds)).alias("crowd"), "id", "label", "x")
    scores = close.select("q", F.transform("found", lambda f: -f["loss"]).alias("p"))
    right = anchor_rows.join(scores, "q").select(every(F.lit(blocks)).alias("block"), dealt("q", F.lit(crowds)).alias("crowd"), "q", "ql", "qx", "p")

    def negatives(rows: pa.Table, asked: pa.Table) -> pa.Table:
        slots, lists, q, block = np.zeros(0, np.int64), pa.array([], FOUND), np.zeros(0, np.int64), 0
        if rows.num_rows and asked.num_rows:
            q, block = asked["q"].to_numpy(), asked["block"][0].as_py()
            p = np.full((len(q), n_positives), _NONE)
            for i, own in enumerate(asked["p"].to_pylist()):
                p[i, : len(own)] = own
            one = best_negatives(turn, asked["ql"].to_numpy(), _matrix(asked, "qx"), p, rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows, "x"), k, low)
            slots, lists = one.lists()
        places = [pa.array(q[slots // n_positives]), pa.array((slots % n_positives).astype(np.int32)), pa.array(np.full(len(slots), block, np.int32))]
        return pa.Table.from_arrays([*places, lists], names=["q", "j", "block", "found"])

    found = left.groupBy("block", "crowd").cogroup(right.groupBy("block", "crowd")).applyInArrow(negatives, f"q long, j int, block int, found {found_type}")
    best = merged(found, ["q", "j"], blocks, k)
    pairs = close.select("q", F.posexplode("found").alias("j", "p"))
    out = best.join(pairs, ["q", "j"]).select("q", "p", F.posexplode("found").alias("place", "f"))
    out = out.select(F.col("q").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"), (-F.col("p.loss")).alias("positive_score"), (-F.col("f.loss")).alias("negative_score"))
    out = written(out, "negatives")
    discard(rows, per_label, close)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label)


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS (SELECT a.vec_id AS q, a.label AS ql, b.vec_id AS id, b.label, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT q, ql, id, s FROM s WHERE label = ql QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 5)
SELECT p.q AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.q, p.id ORDER BY n.s DESC, n.id)::INT AS rank, n.id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.q = p.q AND n.label <> p.ql AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY row_number() OVER (PARTITION BY p.q, p.id ORDER BY n.s DESC, n.id) <= 5"""
