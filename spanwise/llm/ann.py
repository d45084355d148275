"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Inner products become distances: vectors are divided by the largest norm and get one more component
that makes them unit vectors; queries are unit vectors without it. A table hashes a vector to SLOTS
numbers, floor((a x + b) / WIDTH), a having normal components (2-stable). A query's neighbour at
similarity s projects to about s times the query's projection with variance 1 - s², which gives the
probability of each slot, and of a bucket the product. Buckets are visited in order of this estimated
success until its sum reaches TARGET; s is taken from a bounded sample of pairs, as the similarity
that a k-th neighbour has. A query whose own k-th find lies lower is asked again with that similarity;
one that still has fewer than k finds is compared with all vectors, in blocks.

Buckets are dealt to blocks by hash; a bucket of more than BLOCK vectors is split over several, all of
which its queries visit, and a block that more than QUERIES queries visit is repeated for parts of
them: no group grows with the table. A block scores each bucket's vectors against the bucket's
queries, exactly, in double precision, and passes on the best k for each query. Tables are merged by
query and vector, and the best k stay; ties go to the smaller id. All probed candidates are scored.
Matrix products only choose, with room for their rounding; scores are sums in one fixed order, compared
as they are.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another
length than most, take no part; a row with null id neither; repeated rows (one id) count once for a
query; with k or fewer candidates, a query gets them all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_in_arrow, ship
from .common import written

TABLES = 6
SLOTS = 4
WIDTH = 1.3
TARGET = 0.45
SEED = 5
#: Vectors of a block, about, and queries that visit it together.
BLOCK = 16384
QUERIES = 16384
#: The sample that sets s: so many queries and vectors.
SAMPLE = (128, 4096)
BROADCAST_ROWS = 200_000
FOUND = pa.list_(pa.struct([("loss", pa.float64()), ("vec_id", pa.int64())]))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector_col)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


class Hashes:
    def __init__(self, size: int, norm: float, tables: int = TABLES, target: float = TARGET, seed: int = SEED):
        rng = np.random.RandomState(seed)
        self.a = rng.randn(size + 1, tables * SLOTS)
        self.b = rng.rand(tables * SLOTS) * WIDTH
        self.norm, self.tables, self.target = norm, tables, target

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The bucket of every vector in every table."""
        x = x / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        slots = np.floor((x @ self.a[:-1] + rest[:, None] * self.a[-1] + self.b) / WIDTH).astype(np.int64)
        return self._key(slots.reshape(len(x), self.tables, SLOTS), np.arange(self.tables))

    @staticmethod
    def _key(slots: np.ndarray, table) -> np.ndarray:
        key = np.asarray(table, np.int64)
        for i in range(SLOTS):
            key = key * 4096 + (np.clip(slots[..., i], -2047, 2047) + 2048)
        return key

    def probes(self, q: np.ndarray, similarity: float) -> list[np.ndarray]:
        """Of a query whose k-th neighbour has this similarity: the buckets to visit in each table, best first."""
        from math import erf

        q = q / np.sqrt((q * q).sum())
        at = (q @ self.a[:-1]) * similarity
        spread = max(1e-3, np.sqrt(1 - similarity**2))
        out = []
        for t in range(self.tables):
            slots, chances = np.zeros((1, 0), np.int64), np.ones(1)
            for i in range(t * SLOTS, (t + 1) * SLOTS):
                own = np.arange(int(np.floor((at[i] - 3.5 * spread + self.b[i]) / WIDTH)), int(np.floor((at[i] + 3.5 * spread + self.b[i]) / WIDTH)) + 1)
                edges = [erf(((e * WIDTH - self.b[i]) - at[i]) / spread / 2**0.5) / 2 for e in [*own, own[-1] + 1]]
                slots = np.concatenate((np.repeat(slots, len(own), 0), np.tile(own, len(slots))[:, None]), 1)
                chances = np.repeat(chances, len(own)) * np.tile(np.diff(edges), len(chances))
            order = np.argsort(-chances, kind="stable")
            n = int(np.searchsorted(np.cumsum(chances[order]), self.target)) + 1
            out.append(self._key(slots[order[:n]], t))
        return out


def _similarity(rows: DataFrame, queries: DataFrame, n: int, k: int, norm: float) -> float:
    """The similarity that three in four queries' k-th neighbours among n exceed, from a bounded sample of pairs."""
    pick = lambda df, m: df.orderBy(F.xxhash64("id")).limit(m).toArrow()
    q, x = pick(queries, SAMPLE[0]), pick(rows, SAMPLE[1])
    if q.num_rows == 0 or x.num_rows < 2:
        return 0.5
    one = lambda t: _matrix(pa.concat_arrays(t["v"].chunks))
    a, b = one(q), one(x)
    s = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / norm).T
    s[q["id"].to_numpy()[:, None] == x["id"].to_numpy()] = -1
    place = min(x.num_rows - 2, int(x.num_rows * k / max(1, n)))
    return float(np.clip(np.percentile(-np.sort(-s, axis=1)[:, place], 25), 0.05, 0.99))


def likely(scores: np.ndarray, room: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all that may be among each row's k largest if scores are off by at most ``room``, of each row."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return np.nonzero(scores >= (least - 2 * room)[:, None])
    return np.nonzero(scores > -np.inf)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found; a query is not its own neighbour."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    asked = valid(queries, id_col, vector_col).dropDuplicates(["id"])
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, norm, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.sqrt(square)), F.lit(1.0)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    similarity = _similarity(rows, asked, n, k, norm)
    hashes = Hashes(size, norm, tables, target)
    element = rows.schema["v"].dataType.simpleString()

    def index(batches):
        for batch in batches:
            key = hashes.keys(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, hashes.tables), np.int64)
            for t in range(hashes.tables):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key[:, t])], names=["id", "v", "key"])

    def visit(batches):
        for batch in batches:
            ids, out = batch.column(0).to_numpy(), [np.zeros(0, np.int64)]
            lengths = []
            for q, s in zip(_matrix(batch.column(1)), batch.column(2).to_pylist(), strict=True) if batch.num_rows else ():
                found = np.concatenate(hashes.probes(q, s))
                out.append(found)
                lengths.append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, lengths)), pa.array(np.concatenate(out))], names=["q", "key"])

    indexed = map_in_arrow(rows, index, f"id long, v {element}, key long")
    counts = indexed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    counts = written(counts, "ann-buckets")
    blocks = max(1, -(-n * tables // BLOCK))
    block = lambda part: F.pmod(F.xxhash64("key", part), F.lit(blocks)).cast("int")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def in_crowds(data: DataFrame, wanted: DataFrame) -> DataFrame:
        """What rerank finds for ``data`` (block, id, v, key) and ``wanted`` (block, q, keys), a block's queries in crowds."""
        crowds = small(written(wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("crowds")), "ann-blocks"))
        left = data.join(crowds, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), "id", "v", "key")
        right = wanted.join(crowds, "block").join(asked.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
        right = right.select("block", F.pmod(F.xxhash64("q"), F.col("crowds")).cast("int").alias("crowd"), "q", "qv", "keys")
        return left.groupBy("block", "crowd").cogroup(right.groupBy("block", "crowd")).applyInArrow(rerank, "query_id long, found array<struct<loss:double,vec_id:long>>")

    def probed(queries: DataFrame) -> DataFrame:
        """The finds of queries (id, v, s) in the buckets that they visit."""
        probes = map_in_arrow(queries.select("id", "v", "s"), visit, "q long, key long").join(counts, "key")
        probes = probes.select("q", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        probes = written(probes.select(block(F.col("part")).alias("block"), "q", "key").groupBy("block", "q").agg(F.collect_set("key").alias("keys")), "ann-probes")
        split = small(counts.where("parts > 1"))
        data = indexed.join(split, "key", "left").withColumn("block", block(F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")))
        return in_crowds(data, probes)

    def merged(found: DataFrame, name: str) -> DataFrame:
        # A query has at most k from each block that it visits.
        return written(found.groupBy("query_id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("found")), name)

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        asked_, found_ = pa.array([], pa.int64()), pa.array([], FOUND)
        if left.num_rows and right.num_rows:
            one = lambda t, c: pa.concat_arrays(t[c].chunks)
            ids, key, x = left["id"].to_numpy(), left["key"].to_numpy(), _matrix(one(left, "v"))
            order = np.lexsort((ids, key))
            ids, key, x = ids[order], key[order], x[order]
            q, qx, lists = right["q"].to_numpy(), _matrix(one(right, "qv")), one(right, "keys")
            probed, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            order = np.argsort(probed, kind="stable")
            probed, who = probed[order], who[order]
            rows, columns = [], []
            q_norm, top_norm = np.linalg.norm(qx, axis=1), np.linalg.norm(x, axis=1).max()
            for b in np.unique(key):
                a, z = np.searchsorted(key, [b, b + 1])
                ask = who[slice(*np.searchsorted(probed, [b, b + 1]))]
                for i in range(0, len(ask), 2048):
                    part = ask[i : i + 2048]
                    s = qx[part] @ x[a:z].T
                    s[q[part][:, None] == ids[a:z]] = -np.inf
                    r, c = likely(s, 1e-14 * x.shape[1] * q_norm[part] * top_norm, k)
                    rows.append(part[r])
                    columns.append(c + a)
            if rows:
                r, c = map(np.concatenate, (rows, columns))
                order = np.lexsort((ids[c], r))  # a block may hold buckets of several tables: each vector once
                order = order[np.concatenate(([True], (np.diff(r[order]) != 0) | (np.diff(ids[c][order]) != 0)))]
                r, c = r[order], c[order]
                keep = q[r] != ids[c]
                r, c = r[keep], c[keep]
            if rows and len(r):
                # The same sum for the same two vectors, whatever the block's shape.
                s = np.concatenate([(qx[r[i : i + 65536]] * x[c[i : i + 65536]]).sum(1) for i in range(0, len(r), 65536)])
                order = np.lexsort((ids[c], -s, r))
                r, c, s = r[order], c[order], s[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c, s = r[keep], c[keep], s[keep]
                rows, starts = np.unique(r, return_index=True)
                pairs = pa.StructArray.from_arrays([pa.array(-s), pa.array(ids[c])], names=["loss", "vec_id"])
                asked_, found_ = pa.array(q[rows]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(r)).astype(np.int32)), pairs)
        return pa.Table.from_arrays([asked_, found_], names=["query_id", "found"])

    ship(spark)
    found = merged(probed(asked.withColumn("s", F.lit(similarity))), "ann-found")
    # Queries whose k-th find lies lower than the sample said visit what is likely at their own similarity.
    v_norm = F.sqrt(square)
    reach = found.where(F.size("found") >= k).select(F.col("query_id").alias("id"), (-F.get("found", F.lit(k - 1))["loss"]).alias("kth"))
    low = asked.join(reach, "id").withColumn("s", F.greatest(F.lit(0.05), F.col("kth") / v_norm / norm)).where(F.col("s") < similarity)
    low = written(low.select("id", "v", "s"), "ann-low")
    if not low.isEmpty():
        found = merged(found.union(probed(low)), "ann-found")
    short = asked.join(found.where(F.size("found") >= min(k, n - 1)).select(F.col("query_id").alias("id")), "id", "left_anti").select("id")
    short = written(short, "ann-short")
    if not short.isEmpty():
        parts = max(1, -(-n // BLOCK))
        data = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("block"), "id", "v", F.lit(0).cast("long").alias("key"))
        every = short.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"), F.col("id").alias("q"), F.array(F.lit(0).cast("long")).alias("keys"))
        found = merged(found.union(in_crowds(data, every)), "ann-found")
    out = found.select("query_id", F.posexplode("found").alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.loss")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 20 = 0"))
