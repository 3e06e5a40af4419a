"""Centroid clustering on bit planes: exact k-means over integer vectors by popcounts.

1. Components become integers in the JVM; each vector of 64 is packed into one 64-bit word per bit of its numbers in two's
   complement (bit k of word i is bit i of component k), and its squared length is kept. The planes are written once.
2. With plane weights 1, 2, 4, ... and a negative one for the sign, a dot product is the sum over pairs of planes of
   ``weight * weight * popcount(a & b)``, and a distance follows from it and the two squared lengths. All is integer
   arithmetic, so it is exact.
3. A round is one pass over the planes: tasks assign their vectors and add up counts and components per cluster (a
   component's sum is the weighted number of set bits in its planes), Spark adds up ``k * 64`` of these sums per task, and
   the driver gets ``k * 64`` numbers whatever the number of vectors. A round starts from the written planes and the last
   centroids, so a lost executor costs its tasks only. Rounds end early once no centroid moves, as later ones would change
   nothing.

Rows without a vector of 64 finite components take no part. Scaled components count as at most ``LIMIT`` either way, so
that distances stay within a long; sums of distances beyond a long are null. Repeated rows count as often as they occur.
Vectors at equal distances go to the smaller centroid. The first centroids are the vectors with the smallest hashes of
their ids, rows that share an id ordered by their components; null ids come last. Fewer vectors than ``k`` make fewer
centroids, and an empty table gives no rows. Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.lineage import saved

WIDTH = 64
#: Largest scaled component either way: squared distances of 64 such components stay below 2**62.
LIMIT = 2**27 - 1


def usable(vector: str, dim: int = WIDTH):
    """Whether a column holds ``dim`` components, none null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) == dim) & fine, F.lit(False))


def scaled(vector: str, scale: int, limit: int):
    """Components as integers ``floor(scale * x)``, at most ``limit`` either way."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(-float(limit))), F.lit(float(limit)))).cast("int"))


def weights(planes: int) -> np.ndarray:
    """Values of the planes of a number in two's complement."""
    out = np.int64(1) << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """Bit planes (rows, planes) of integers (rows, 64); as many planes as the largest of them needs."""
    if not len(values):
        return np.empty((0, 1), np.uint64)
    planes = max(int(values.max()).bit_length(), int(~values.min()).bit_length()) + 1
    out = np.empty((len(values), planes), np.uint64)
    for i in range(planes):
        bits = ((values >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def widened(planes: np.ndarray, to: int) -> np.ndarray:
    """The same numbers in more planes: the sign's plane repeats."""
    return planes if planes.shape[1] >= to else np.concatenate([planes, np.repeat(planes[:, -1:], to - planes.shape[1], axis=1)], axis=1)


def dots(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Dot products (rows, centroids) of packed vectors, by weighted popcounts of plane pairs."""
    own, other = weights(vectors.shape[1]), weights(centroids.shape[1])
    out = np.zeros((len(vectors), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        for i in range(vectors.shape[1]):
            ones = np.bitwise_count(vectors[:, i, None] & centroid)
            out[:, k] += own[i] * (ones @ other)
    return out


def unpacked(planes: np.ndarray) -> np.ndarray:
    """Set bits (rows, planes, 64) of packed vectors."""
    return np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")


def column_sums(planes: np.ndarray) -> np.ndarray:
    """Sums of each component over packed vectors: the weighted number of set bits in its planes."""
    sums = np.zeros((planes.shape[1], WIDTH), np.int64)
    for at in range(0, len(planes), 4096):
        sums += unpacked(planes[at : at + 4096]).sum(axis=0, dtype=np.int64)
    return weights(planes.shape[1]) @ sums


@dataclass
class Centroids:
    values: list[list[int]]

    def assign(self, planes: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of packed vectors; the smaller cluster of equal distances."""
        own = np.array(self.values, np.int64)
        far = squares[:, None] - 2 * dots(planes, pack(own)) + (own * own).sum(axis=1)
        best = far.argmin(axis=1)
        return best, far[np.arange(len(far)), best]

    def moved(self, counts: dict[int, int], sums: dict[tuple[int, int], int]) -> Centroids:
        """Exact floors of the means; centroids without vectors stay."""
        return Centroids([[sums[k, d] // counts[k] for d in range(WIDTH)] if counts.get(k) else row for k, row in enumerate(self.values)])

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.values[k])).encode()).hexdigest()


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as a binary column."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1] * 8
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)]).cast(pa.binary())


def _planes(column: pa.Array) -> np.ndarray:
    """Packed vectors of a binary column, all in as many planes as the widest."""
    rows = column.cast(pa.large_binary())
    ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    sizes = np.diff(ends) // 8
    if not len(sizes):
        return np.empty((0, 1), np.uint64)
    words = np.frombuffer(rows.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]).copy().view(np.uint64)
    starts, widest = (ends[:-1] - ends[0]) // 8, int(sizes.max())
    return words[starts[:, None] + np.minimum(np.arange(widest), sizes[:, None] - 1)]


def packed(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, planes, squares) of the usable vectors."""
    rows = vectors.where(usable(vector)).select(F.col(key).alias("key"), scaled(vector, scale, LIMIT).alias("values"))

    def of(batches):
        for batch in batches:
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(pack(values)), pa.array((values * values).sum(axis=1))], ["key", "planes", "squares"])

    return rows.mapInArrow(of, f"key {rows.schema['key'].dataType.simpleString()}, planes binary, squares long")


def first_centroids(vectors: DataFrame, key: str, vector: str, scale: int, k: int, seed: str) -> Centroids:
    """The ``k`` vectors with the smallest hashes of ``seed`` and id, in their order."""
    rows = vectors.where(usable(vector)).select(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"), 256).alias("hash"), scaled(vector, scale, LIMIT).alias("values"))
    return Centroids([list(r["values"]) for r in rows.orderBy(F.col("hash").asc_nulls_last(), "values").limit(k).collect()])


def totals(rows: DataFrame, centroids: Centroids) -> tuple[dict, dict]:
    """Counts per cluster, and sums per cluster and component, of one assignment."""

    def of(batches):
        counts, sums = np.zeros(len(centroids.values), np.int64), np.zeros((len(centroids.values), WIDTH), np.int64)
        for batch in batches:
            planes = _planes(batch.column("planes"))
            cluster, _ = centroids.assign(planes, batch.column("squares").to_numpy())
            counts += np.bincount(cluster, minlength=len(counts))
            for k in np.unique(cluster):
                sums[k] += column_sums(planes[cluster == k])
        found = np.flatnonzero(counts)
        place = np.tile(np.arange(WIDTH, dtype=np.int32), len(found))
        arrays = [np.repeat(found, WIDTH).astype(np.int32), place, np.repeat(counts[found], WIDTH), sums[found].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["cluster", "place", "n", "total"])

    parts = rows.select("planes", "squares").mapInArrow(of, "cluster int, place int, n long, total long")
    found = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    return {r.cluster: r.n for r in found}, {(r.cluster, r.place): r.total for r in found}


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector after ``rounds`` rounds."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, key, vector, scale, k, seed)
    name = vectors.schema[key].dataType.simpleString()
    if not centroids.values:
        return spark.createDataFrame([], f"`{key}` {name}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = saved(packed(vectors, key, vector, scale))
    for _ in range(rounds):
        before, centroids = centroids, centroids.moved(*totals(rows, centroids))
        if before == centroids:
            break

    def of(batches):
        for batch in batches:
            cluster, far = centroids.assign(_planes(batch.column("planes")), batch.column("squares").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cluster.astype(np.int32)), pa.array(far)], ["key", "cluster", "distance"])

    found = saved(rows.mapInArrow(of, f"key {name}, cluster int, distance long"))
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    within = lambda x: x if x < 2**63 else None
    facts = [(c, within(total), within(sum(sums.values())), centroids.digest(c)) for c, total in sums.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings: 8 centroids, 10 rounds, components scaled by 1024."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(rounds: int) -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda i: (r.v[i] - c.v[i]) * (r.v[i] - c.v[i])))::BIGINT"
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM kept QUALIFY k < 8)""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT place, r.v AS v, k, {distance} AS distance FROM kept r, c{n} c
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY distance, k) = 1)""")
        if n < rounds:
            parts.append(f"""m{n} AS MATERIALIZED (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY k, i) GROUP BY k)""")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (k))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (place) JOIN c{rounds} c ON a.k = c.k"""


OP11_SQL = _sql(10)
