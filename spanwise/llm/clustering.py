"""Centroid clustering (Lloyd's rounds) in exact whole numbers, by matrix products guarded against rounding.

Vectors are packed once into blocks of BLOCK rows, a written table that every round reads. A round sends
the centroids to the tasks; a task computes each block's squared distances as |x|² - 2 x·c + |c|² in float64
matrix products. All terms are whole numbers, so that nothing is rounded while size * (max|x| + max|c|)²
stays below 2**53: that bound is computed for each block, and a block beyond it takes differences of 64-bit
integers, or of Python integers where those could overflow. ``RDD.treeAggregate`` adds up counts, sums and
distances of the clusters; only those, of a size that no table changes, reach the driver. The last round's
aggregate gives the inertias, and one more pass over the blocks gives each vector's row.

Defined results: only vectors of exactly ``size`` components, none null or non-finite, take part; a row
with null id takes part but starts no centroid; repeated rows count as often as they occur and may start
several centroids; equal hashes (one id on different vectors) start in the order of the vectors; with
fewer vectors than ``k`` there are fewer centroids; ties go to the smaller number; a distance or inertia
that doesn't fit a long is null; an empty table gives no rows. Extra columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_in_arrow, ship
from .common import discard, written

#: Vectors of a block.
BLOCK = 4096
_EXACT, _LONG = 1 << 53, 1 << 63


def whole(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x): 64-bit integers, or Python's where they don't fit."""
    with np.errstate(over="ignore"):
        y = np.floor(x * factor)
    if not y.size or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    # A float of 2**53 or more is a whole number already.
    return np.array([[int(v) * factor if abs(v) >= _EXACT else math.floor(v * factor) for v in row] for row in x.tolist()], object)


def top(x: np.ndarray) -> int:
    """The largest magnitude."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every centroid, exactly, whatever the magnitudes."""
    bound = x.shape[1] * (top(x) + top(c)) ** 2
    if bound < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    if bound >= _LONG:
        x, c = x.astype(object), c.astype(object)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance) of every vector; ties to the smaller number."""
    d = distances(x, c)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def gathered(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sums, summed distances) of each cluster in a block, as Python integers."""
    counts = np.bincount(cluster, minlength=k).astype(object)
    inertia = np.array([sum(distance[cluster == j].tolist()) for j in range(k)], object)
    if len(x) * top(x) < _EXACT:
        member = (cluster == np.arange(k)[:, None]).astype(np.float64)
        return counts, (member @ x.astype(np.float64)).astype(np.int64).astype(object), inertia
    big = x.astype(object)
    return counts, np.stack([big[cluster == j].sum(0) + np.zeros(x.shape[1], object) for j in range(k)]), inertia


def valid(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector_col)
    ok = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (ids, x: the vectors' float64 bytes) of rows (id, v)."""

    def run(batches):
        ids, parts, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if n + part.num_rows > BLOCK:
                    yield block(ids, parts)
                    ids, parts, n = [], [], 0
                ids.append(part.column(0))
                parts.append(np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64))
                n += part.num_rows
        if n:
            yield block(ids, parts)

    def block(ids, parts):
        all_ids = pa.concat_arrays(ids)
        one = pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids)
        return pa.RecordBatch.from_arrays([one, pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["ids", "x"])

    return map_in_arrow(rows, run, "ids array<long>, x binary")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, factor: int = 64, size: int = 64, salt: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    ship(spark)
    rows = valid(vectors, id_col, vector_col, size)
    name = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    seeds = rows.where("id is not null").select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    blocks = written(packed(rows, size), "cluster-blocks")
    centroids = whole(np.array([r.v for r in seeds], np.float64).reshape(len(seeds), size), factor)
    n = len(centroids)
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not n:
        return spark.createDataFrame([], schema)
    matrix = lambda data: whole(np.frombuffer(data, np.float64).reshape(-1, size), factor)
    zero = (np.zeros(n, object), np.zeros((n, size), object), np.zeros(n, object))
    plus = lambda a, b: tuple(p + q for p, q in zip(a, b, strict=True))

    def aggregate(c: np.ndarray):
        def add(total, row):
            x = matrix(row.x)
            return plus(total, gathered(x, *nearest(x, c), n))

        return blocks.rdd.treeAggregate(zero, add, plus)

    for _ in range(rounds):
        counts, sums, _ = aggregate(centroids)
        moved = [[int(s) // int(m) for s in own] if m else old for own, m, old in zip(sums.tolist(), counts.tolist(), centroids.tolist(), strict=True)]
        fits = all(abs(x) < 1 << 62 for c in moved for x in c)
        centroids = np.array(moved, np.int64 if fits else object)
    _, _, inertia = aggregate(centroids)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    long = lambda x: int(x) if x < _LONG else None
    of_cluster, of_all = [long(x) for x in inertia], long(sum(inertia))

    def assign(batches):
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                number, distance = nearest(matrix(data.as_py()), centroids)
                columns = [
                    ids.values,
                    pa.array(number, pa.int32()),
                    pa.array([long(x) for x in distance] if distance.dtype == object else distance, pa.int64()),
                    pa.array([of_cluster[j] for j in number], pa.int64()),
                    pa.array([of_all] * len(number), pa.int64()),
                    pa.array([digest[j] for j in number], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    out = written(map_in_arrow(blocks, assign, schema), "clusters")
    discard(blocks)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 16, rounds: int = 3, factor: int = 64, size: int = 64) -> str:
    apart = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    assigned = lambda r: f"a{r} AS (SELECT n, vec_id, x, {{'d': d, 'k': k}} AS best FROM (SELECT n, vec_id, x, k, {apart} AS d FROM kept, c{r}) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1)"
    steps = []
    for r in range(rounds):
        steps.append(assigned(r))
        steps.append(f"""m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT best.k AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) t(i) GROUP BY ALL) GROUP BY k),
c{r + 1} AS (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return f"""WITH kept AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda v: floor({factor} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {size}),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT sha256('1:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})),
{", ".join(steps)}, {assigned(rounds)}
SELECT vec_id, best.k::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = best.k"""


SQL = _sql()
