"""SimHash near-duplicate classes with a hierarchical index in Gray order.

1. Every text gets a 64-bit SimHash over its shingles' XXH64 (Arrow batches, no shuffle); equal fingerprints collapse.
2. Two fingerprints that differ in at most ``distance`` bits agree on ``j`` of ``distance + j`` blocks of bits, so each
   fingerprint goes to one partition key per choice of ``j`` blocks. ``j`` follows the number of fingerprints, so a key
   holds few of them at any size; keys that hold many nevertheless are cut into chunks, and pairs of chunks are dealt
   out, so no task gets a whole hot key. Both lose no link.
3. Within a key, fingerprints lie in the order of their Gray rank, where neighbours share most bits. Nodes over runs of
   them store the bits that all below share (mask and pattern); pairs of nodes are cut as soon as the shared bits differ
   more than allowed, whole groups at once. What remains is compared bit by bit. Each key gives one edge per
   fingerprint that is linked, to the smallest it reaches there, never all pairs.
4. Edges of all keys join into components by alternating large-star and small-star rounds on saved tables.

Null and empty texts have no words: their fingerprint is zero, and they link like any other. Repeated rows and ties get
the same class. Other columns are kept; a row with a null id takes the class of its fingerprint, and counts for no
smallest id unless it is alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktape.lineage import saved

SEED = 42
#: Fingerprints of one key that a task compares at once, at most twice as many.
CHUNK = 2048
LEAF = 16

# spread[b] holds the eight bits of byte b in eight lanes of eight bits.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of a text in UTF-8: bit i is set if more than half the shingles' hashes have it."""
    words = (text or b"").lower().split()  # of bytes: only A-Z change, and only ASCII space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[shingle - 1 :].tolist() or [len(joined)]
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 255):  # a lane counts to 255
        lanes = _SPREAD[octets[at : at + 255]].sum(axis=0, dtype=np.uint64)
        ones += lanes.view(np.uint8).reshape(8, 8)
    bits = (2 * ones > len(hashes)).reshape(64)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "fp") -> DataFrame:
    """All columns but the text, and the fingerprint as a signed 64-bit number."""
    at = docs.columns.index(text)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(name, T.LongType(), False)])

    def of(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found.view(np.int64))], schema.names)

    return docs.mapInArrow(of, schema)


def gray_rank(fp):
    """Place of a bit pattern in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def blocks(count: int, distance: int) -> list[list[tuple[int, int]]]:
    """Choices of blocks, each as (shift, width): every pair within ``distance`` agrees on all blocks of some choice."""
    j = 1
    while count >> (64 * j // (distance + j)) > CHUNK // 4 and j < 4:
        j += 1
    edges = [64 * k // (distance + j) for k in range(distance + j + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(choice) for choice in combinations(parts, j)]


def keyed(points: DataFrame, count: int, distance: int) -> DataFrame:
    """One row (key_no, key_bits, part_a, part_b, side, fp) for each choice of blocks, and chunk pair of a hot key."""
    choices = blocks(count, distance)
    masks = [sum(((1 << w) - 1) << s for s, w in choice) for choice in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("key_no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key_bits")) for i, m in enumerate(signed)])
    rows = points.select("fp", F.inline(keys))
    hot = saved(
        rows.groupBy("key_no", "key_bits").count().where(F.col("count") > CHUNK)
        .select("key_no", "key_bits", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
    )
    rows = rows.join(hot, ["key_no", "key_bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(
        "key_no", "key_bits", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "fp"
    )


def _nodes(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that all of each run of ``size`` share, and their pattern."""
    at = np.arange(0, len(fps), size)
    every, some = np.bitwise_and.reduceat(fps, at), np.bitwise_or.reduceat(fps, at)
    return ~(every ^ some), every


def linked(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each of the fingerprints, in Gray order, the position of the smallest position its component reaches."""
    n = len(fps)
    root = np.arange(n)
    sizes = [LEAF]
    while sizes[-1] * 8 < n:
        sizes.append(sizes[-1] * 8)
    levels = [_nodes(fps, s) for s in sizes]
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    for level in range(len(sizes) - 1, -1, -1):
        mask, pattern = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
        a, b = a[near], b[near]
        if level:
            below = len(levels[level - 1][0])
            a = (a[:, None] * 8 + np.repeat(np.arange(8), 8)).ravel()
            b = (b[:, None] * 8 + np.tile(np.arange(8), 8)).ravel()
            real = (a <= b) & (b < below)
            a, b = a[real], b[real]
    for at in range(0, len(a), 4096):
        x = (a[at : at + 4096, None] * LEAF + np.repeat(np.arange(LEAF), LEAF)).ravel()
        y = (b[at : at + 4096, None] * LEAF + np.tile(np.arange(LEAF), LEAF)).ravel()
        real = (x < y) & (y < n)
        x, y = x[real], y[real]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        hit = np.bitwise_count(fps[x] ^ fps[y]) <= distance
        x, y = x[hit], y[hit]
        while len(x):  # join the components of all hits
            p, q = root[x], root[y]
            low, high = np.minimum(p, q), np.maximum(p, q)
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
    return root


def _edges(distance: int):
    names = ["key_no", "key_bits", "part_a", "part_b", "fp"]

    def of(batches):
        rest = [np.empty(0, np.int64)] * len(names)
        for batch in batches:
            own = [np.concatenate((r, batch.column(n).to_numpy(zero_copy_only=False))) for r, n in zip(rest, names)]
            if not len(own[0]):
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in own[:-1]], axis=0)) + 1
            last = change[-1] if len(change) else 0
            yield from found(own[-1][:last], change[:-1])
            rest = [c[last:] for c in own]  # a key may go on in the next batch
        yield from found(rest[-1], np.empty(0, np.int64))

    def found(fps, change):
        above, below = [], []
        for part in np.split(fps, change):
            if len(part) > 1:
                root = linked(part.view(np.uint64), distance)
                moved = root != np.arange(len(part))
                above.append(part[moved])
                below.append(part[root[moved]])
        if above:
            x, y = np.concatenate(above), np.concatenate(below)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return of


def edges(points: DataFrame, count: int, distance: int) -> DataFrame:
    """Links (a < b) between distinct fingerprints, enough to reach what all pairs would reach."""
    rows = keyed(points, count, distance).withColumn("gray", gray_rank(F.col("fp")))
    keys = ["key_no", "key_bits", "part_a", "part_b"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "gray").drop("gray")
    return rows.mapInArrow(_edges(distance), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the links except the roots, by large-star and small-star rounds."""
    links = saved(links)
    if links.isEmpty():
        return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = saved(large)
        least = saved(large.groupBy("b").agg(F.min("a").alias("m")))
        near = large.join(least, "b")
        small = near.select(F.col("m").alias("a"), F.explode(F.array("b", "a")).alias("b")).where("a < b")
        links = saved(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def classes(docs: DataFrame, key: str, text: str, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of every row, and (fp, component_id) of every fingerprint, both saved."""
    prints = with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", shingle)
    prints = saved(prints)
    points = saved(prints.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(edges(points.select("fp"), points.count(), distance))
    roots = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = saved(roots)
    smallest = saved(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints, saved(roots.join(smallest, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row (key, fp, component_id) per row of ``docs``: its fingerprint and the smallest key of its class."""
    prints, found = classes(docs, key, text, shingle, distance)
    return prints.join(found, "fp", "left").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their class: one row with its smallest key.

    Of rows that repeat this key one stays. A class whose keys are all null keeps one row for each fingerprint.
    """
    prints, found = classes(docs, key, text, shingle, distance)
    smallest = found.select(F.col("component_id").alias("key")).where("key is not null").distinct()
    rows = docs.join(smallest.withColumnRenamed("key", key), key, "left_semi")
    again = prints.groupBy("key").count().where("count > 1 and key is not null").select(F.col("key").alias(key))
    again = saved(again)
    if not again.isEmpty():
        rows = rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates([key]))
    if not prints.where("key is null").isEmpty():
        bare = docs.where(F.col(key).isNull())
        bare = with_fingerprint(bare.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc"), F.col(text).alias("text")), "text", shingle)
        alone = found.where("component_id is null").select("fp")
        rows = rows.unionByName(bare.join(alone, "fp", "left_semi").dropDuplicates(["fp"]).select("doc.*"))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 4-word shingles, links at four or fewer differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
