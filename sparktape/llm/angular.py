"""Hard-negative mining by angular triangle filtering.

1. Components become integers. Every row stores its angles to a few reference directions, which are rows themselves, and
   rows lie by their nearest direction and their angle to it, so that neighbours see the directions at like angles. A range
   partitioning on that order, with the id as its last part, splits a direction or a vector that holds many rows.
2. Angles obey the triangle inequality: seen from one direction, two vectors at angles ``s`` and ``t`` enclose an angle
   between ``|s - t|`` and the lesser of ``s + t`` and ``2 pi - s - t``. Runs of ``GROUP`` rows keep the range of each of
   their angles and of their norms, so each direction gives an interval of cosines for an anchor and a run, and, multiplied
   by norms and widened by more than any rounding, an interval of scores; the directions' intervals are intersected.
3. Anchors are a stated query set and meet all rows in blocks of ``ANCHORS``, which are broadcast. A first pass finds
   each anchor's best rows of its own label: a run is scored only if its interval reaches the score of the last partner
   found. A second pass finds each positive's negatives: only runs whose interval overlaps a window of scores that is still
   open are scored. Scoring is an exact integer product.
4. Tasks return at most ``n`` rows per anchor, and window; Spark ranks them in two steps, first within parts of the tasks.

Rows without a label, without a vector of ``dim`` components, or with a null or non-finite one take no part. Scaled
components count as at most ``LIMIT`` either way, so that scores stay within a long. Repeated rows are partners as often
as they occur, and one anchor; rows that share an id and differ are anchors of their own, but no row is a partner of its
own id. Rows with a null id are no anchors, come last among equal scores, and may be
positives and negatives. Positives with negative scores have no negatives, as no score lies in their window; a positive
without negatives gives no row. Empty tables give none, and other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.llm.bitplanes import scaled, usable

#: Largest scaled component either way: products of 64 such components stay below 2**62.
LIMIT = 2**28 - 1
#: Reference directions: distinct vectors among four times as many rows with the smallest hashes; they only steer the filter.
DIRECTIONS = 12
#: Rows whose angles share one interval, rows cut into runs at once, anchors broadcast at once, partners held before they are ranked.
GROUP, ROWS, ANCHORS, HELD = 64, 4096, 8192, 1 << 18
#: A score's interval is widened by this share of the product of the norms, far above the rounding of angles and cosines.
SLACK = 1e-6
#: Below this size of component, products of 64 are exact in double precision.
_EXACT = 2**23
#: Parts in which the rows of an anchor are ranked first.
PARTS = 16
_LAST = np.iinfo(np.int64).max  # stands for a null id, which sorts last


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def angles(values: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angles to the directions, norms) of integer rows; a zero row is at angle zero to all."""
    values = values.astype(np.float64)
    norms = np.sqrt((values * values).sum(axis=1))
    cosines = (values @ directions.T) / np.where(norms > 0, norms, 1.0)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1.0, 1.0)), 0.0), norms


def bounds(seen: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores (anchors, runs): anchors at angles ``seen``, runs at angles ``low`` to ``high`` with norms ``least`` to ``most``."""
    up, down = np.ones((len(seen), len(low))), -np.ones((len(seen), len(low)))
    for r in range(seen.shape[1]):
        own, a, b = seen[:, r, None], low[None, :, r], high[None, :, r]
        near = np.maximum(np.maximum(a - own, own - b), 0.0)
        sharp, blunt = np.minimum(own + b, 2 * math.pi - own - a), (own + a <= math.pi) & (own + b >= math.pi)
        far = np.where(blunt, math.pi, np.where(own + b < math.pi, own + b, sharp))
        np.minimum(up, np.cos(near), out=up)
        np.maximum(down, np.cos(np.minimum(far, math.pi)), out=down)
    rim = SLACK * norms[:, None] * most[None, :] + 1
    greatest = norms[:, None] * np.where(up >= 0, most, least) * up + rim
    smallest = norms[:, None] * np.where(down >= 0, least, most) * down - rim
    return smallest, greatest


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    seen: np.ndarray
    norms: np.ndarray
    #: Closed windows (anchors, windows) of allowed scores, empty where low > high, and whether partners share the anchor's label.
    low: np.ndarray
    high: np.ndarray
    same: bool


class Best:
    """The ``n`` best partners found so far of each (anchor, window): higher scores first, then smaller ids."""

    def __init__(self, size: int, n: int):
        self.n, self.slot, self.score, self.key, self.held = n, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
        self.more = []
        self.last_score, self.last_key = np.full(size, np.iinfo(np.int64).min), np.full(size, _LAST)

    def add(self, slot, score, key):
        if len(slot):
            self.more.append((slot, score, key))
            self.held += len(slot)
            if self.held > HELD:
                self.rank()

    def rank(self):
        self.slot, self.score, self.key = (np.concatenate([own, *[m[i] for m in self.more]]) for i, own in enumerate((self.slot, self.score, self.key)))
        self.more, self.held = [], 0
        order = np.lexsort((self.key, -self.score, self.slot))
        slot = self.slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order, place = order[place < self.n], place[place < self.n]
        self.slot, self.score, self.key = self.slot[order], self.score[order], self.key[order]
        full = place == self.n - 1
        self.last_score[self.slot[full]], self.last_key[self.slot[full]] = self.score[full], self.key[full]


def scan(anchors: Anchors, pieces, n: int) -> Best:
    """Partners of all anchors among rows (keys, labels, values, angles, norms), given in order as ``pieces``."""
    windows = anchors.low.shape[1]
    best = Best(len(anchors.ids) * windows, n)
    for keys, labels, values, seen, norms in pieces:
        starts = np.arange(0, len(keys), GROUP)
        low, high = np.minimum.reduceat(seen, starts), np.maximum.reduceat(seen, starts)
        smallest, greatest = bounds(anchors.seen, anchors.norms, low, high, np.minimum.reduceat(norms, starts), np.maximum.reduceat(norms, starts))
        for g, start in enumerate(starts):
            part = slice(start, start + GROUP)
            last = best.last_score.reshape(-1, windows)
            floor = np.maximum(anchors.low, last)  # a full window takes nothing below its last partner
            open_ = (floor <= anchors.high) & (greatest[:, g, None] >= floor) & (smallest[:, g, None] <= anchors.high)
            own = np.flatnonzero(open_.any(axis=1))
            if not len(own):
                continue
            scores = products(anchors.values[own], values[part])
            fit = ((anchors.labels[own, None] == labels[None, part]) == anchors.same) & (anchors.ids[own, None] != keys[None, part])
            fit &= (scores >= np.where(open_[own], floor[own], _LAST).min(axis=1)[:, None]) & (scores <= anchors.high[own].max(axis=1)[:, None])
            a, b = np.nonzero(fit)
            score, key = scores[a, b], keys[part][b]
            for w in range(windows):
                slot = own[a] * windows + w
                better = (score > best.last_score[slot]) | ((score == best.last_score[slot]) & (key < best.last_key[slot]))
                hit = (score >= anchors.low[own[a], w]) & (score <= anchors.high[own[a], w]) & better
                best.add(slot[hit], score[hit], key[hit])
        if best.held > len(best.last_score):
            best.rank()
    best.rank()
    return best


def _column(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy()


def _pieces(batches, dim: int, directions: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            keys, labels, norms = _keys(part.column("key")), part.column("label").to_numpy(), part.column("norm").to_numpy()
            yield keys, labels, _column(part, "values", dim).astype(np.int64), _column(part, "angles", directions), norms


def rows_in_order(rows: DataFrame, directions: np.ndarray, dim: int) -> DataFrame:
    """``rows`` (key, label, values) with their angles and norms, by nearest direction and angle to it, saved."""

    def of(batches):
        for batch in batches:
            seen, norms = angles(_column(batch, "values", dim), directions)
            near = seen.argmin(axis=1)
            stored = pa.array(list(seen), pa.list_(pa.float64())), pa.array(norms)
            places = pa.array(near.astype(np.int32)), pa.array(seen[np.arange(len(seen)), near])
            yield pa.RecordBatch.from_arrays([*batch.columns, *stored, *places], [*batch.schema.names, "angles", "norm", "near", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = saved(rows.mapInArrow(of, f"{kinds}, angles array<double>, norm double, near int, angle double"))
    order = ["near", "angle", "key"]
    return saved(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("near", "angle"))


def searched(rows: DataFrame, anchors: Anchors, dim: int, n: int) -> DataFrame:
    """(anchor, slot, score, key, rank): the best partners of each anchor and window among all rows, saved."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)
    windows, directions = anchors.low.shape[1], anchors.seen.shape[1]

    def of(batches):
        best = scan(sent.value, _pieces(batches, dim, directions), n)
        keys = pa.array(best.key, mask=best.key == _LAST)
        slots = [pa.array((best.slot // windows).astype(np.int32)), pa.array((best.slot % windows).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*slots, pa.array(best.score), keys], ["anchor", "slot", "score", "key"])

    found = rows.mapInArrow(of, "anchor int, slot int, score long, key long")
    order = [F.desc("score"), F.asc_nulls_last("key")]
    for by in (["anchor", "slot", "part"], ["anchor", "slot"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        if "part" in by:
            found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        found = found.withColumn("rank", rank).where(F.col("rank") <= n)
    found = saved(found.select("anchor", "slot", "score", "key", "rank"))
    sent.unpersist()
    return found


def reference_directions(rows: DataFrame, dim: int) -> np.ndarray:
    """Distinct unit vectors of rows with the smallest hashes; the first axis if no row has a length."""
    picked = rows.orderBy(F.xxhash64("key", "values"), "key", "values").limit(4 * DIRECTIONS).collect()
    found = list(dict.fromkeys(tuple(r["values"]) for r in picked if any(r["values"])))[:DIRECTIONS]
    found = np.array(found, np.float64).reshape(-1, dim) if found else np.eye(1, dim)
    return found / np.sqrt((found**2).sum(axis=1, keepdims=True))


def hard_negatives(
    vectors: DataFrame, is_anchor, key: str = "vec_id", label: str = "label", vector: str = "embedding", dim: int = 64, scale: int = 256, n: int = 5, percent: int = 80
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``key`` (a long). A negative of a positive has another label and a score from ``percent``
    percent of the positive's up to it.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.where(F.col(label).isNotNull() & usable(vector, dim)).select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), scaled(vector, scale, LIMIT).alias("values"))
    directions = reference_directions(rows, dim)
    rows = rows_in_order(rows, directions, dim)
    queries = saved(rows.where(is_anchor).select("key", "label", "values", F.pmod(F.xxhash64("key"), F.lit(1 << 20)).cast("int").alias("block")).distinct())
    result = None
    for lower, upper in _ranges(queries, 1 << 20):
        block = queries.where((F.col("block") >= lower) & (F.col("block") < upper)).orderBy("key", "label", "values").toArrow()
        values = block.column("values").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, dim)
        ids, labels = block.column("key").to_numpy(), block.column("label").to_numpy()
        least, greatest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        anchors = Anchors(ids, labels, values, *angles(values, directions), np.full((len(ids), 1), least + 1), np.full((len(ids), 1), greatest), True)
        positives = searched(rows, anchors, dim, n)
        anchors = windowed(anchors, positives.select("anchor", "rank", "score").toArrow(), n, percent)
        negatives = searched(rows, anchors, dim, n)
        names = spark.createDataFrame([(i, int(k)) for i, k in enumerate(ids)], "anchor int, anchor_id long")
        positives = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
        made = negatives.join(positives, ["anchor", "slot"]).join(F.broadcast(names), "anchor")
        made = saved(made.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        result = made if result is None else result.unionByName(made)
    return result if result is not None else spark.createDataFrame([], out)


def _ranges(queries: DataFrame, blocks: int):
    """Ranges of ``block`` that hold about ``ANCHORS`` rows each."""
    parts = max(1, -(-queries.count() // ANCHORS)) if not queries.isEmpty() else 0
    return [(blocks * i // parts, blocks * (i + 1) // parts) for i in range(parts)]


def windowed(anchors: Anchors, positives: pa.Table, n: int, percent: int) -> Anchors:
    """The anchors with one window of scores per positive."""
    low, high = np.ones((len(anchors.ids), n), np.int64), np.zeros((len(anchors.ids), n), np.int64)
    at = positives.column("anchor").to_numpy(), positives.column("rank").to_numpy() - 1
    score = positives.column("score").to_numpy()
    low[at], high[at] = [-(-percent * s // 100) for s in score.tolist()], score
    return Anchors(anchors.ids, anchors.labels, anchors.values, anchors.seen, anchors.norms, low, high, False)


def op12(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh embedding's label is the next one's."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(vectors, F.col("key") % 100 == 0)


OP12_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM kept a JOIN kept r ON a.vec_id % 100 = 0 AND r.vec_id IS DISTINCT FROM a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
