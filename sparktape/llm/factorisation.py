"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairs of features interact through vectors of low rank, and a text is scored in time linear in its features, as the sum
over pairs equals half the difference between the square of the sum and the sum of the squares. Features are the counts
of words in hash buckets, scaled to unit length; statistics of structure such as shares of capitals, digits, marks and
lines; and numeric columns given as metadata.

The machine is fitted by logistic loss on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id; their
features are made in tasks, and only these come to the driver. Scoring reads every text whole, one Arrow batch at a time,
without a shuffle.

Null texts are empty; empty texts have no words and get a score like any other. Null metadata counts as zero. Labels
that are null are left out; of repeated ids one row is learnt from. Without labels of both kinds every score is their
mean, or 0.5. ``docs`` may have other columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.llm.words import Piece, carried, pieces, returning, sampled, texts_of

BUCKETS = 1 << 13
RANK = 8
SAMPLE = 6000
EPOCHS = 12
#: Rows in one dense block of word counts.
BLOCK = 256
CUT = 0.7

_CLASSES = {
    "upper": range(ord("A"), ord("Z") + 1),
    "lower": range(ord("a"), ord("z") + 1),
    "digits": range(ord("0"), ord("9") + 1),
    "stops": b".,;:",
    "shouts": b"!?",
    "symbols": b"#*$%&<>@",
    "bars": b"|",
    "lines": b"\n",
    "beyond": range(0x80, 0x100),
}
_TABLES = {name: np.isin(np.arange(256), list(members)) for name, members in _CLASSES.items()}
STATISTICS = len(_CLASSES) + 4


def structure(piece: Piece) -> np.ndarray:
    """A row of statistics for each text."""
    size = np.maximum(np.diff(piece.offsets), 1)
    words, lengths = piece.counts, piece.ends - piece.starts
    longest = np.zeros(len(words))
    full = words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(lengths, piece.bounds[:-1][full])
    shares = [np.sqrt(piece.sums(table[piece.data]) / size) for table in _TABLES.values()]
    heads = _TABLES["upper"][piece.data[piece.starts]] if len(lengths) else np.empty(0)
    capital = np.concatenate(([0], np.cumsum(heads)))
    capital = capital[piece.bounds[1:]] - capital[piece.bounds[:-1]]
    mean = np.diff(piece.offsets) / np.maximum(words, 1)
    return np.stack([*shares, np.log1p(words), np.log1p(mean), np.log1p(longest), capital / np.maximum(words, 1)], axis=1)


def features(texts: pa.Array, metadata: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word counts scaled to unit length, statistics and metadata) for blocks of consecutive texts."""
    for piece in pieces(texts):
        buckets = (piece.hashes() & np.uint64(BUCKETS - 1)).astype(np.int64)
        dense = np.concatenate((structure(piece), metadata[piece.first : piece.last]), axis=1)
        for at in range(0, len(dense), BLOCK):
            rows = min(BLOCK, len(dense) - at)
            a, b = piece.bounds[at], piece.bounds[at + rows]
            row = np.repeat(np.arange(rows), piece.counts[at : at + rows])
            counts = np.bincount(row * BUCKETS + buckets[a:b], minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(np.float32)
            counts /= np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1)
            yield counts, dense[at : at + rows]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # of buckets, then statistics and metadata
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4).astype(np.float32) / np.sqrt(max(dense.shape[1], 1))

    def score(self, words: np.ndarray, dense: np.ndarray) -> np.ndarray:
        w, v, dense = self.weights, self.factors, self.standard(dense)
        sums = words @ v[:BUCKETS] + dense @ v[BUCKETS:]
        squares = (words * words) @ (v[:BUCKETS] ** 2) + (dense * dense) @ (v[BUCKETS:] ** 2)
        raw = self.bias + words @ w[:BUCKETS] + dense @ w[BUCKETS:] + 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -40, 40)))


def fit(places: list[np.ndarray], values: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, seed: int = 1) -> Machine:
    """Adagrad on logistic loss; ``places`` and ``values`` hold each row's buckets and their scaled counts."""
    total = BUCKETS + dense.shape[1]
    rng = np.random.default_rng(seed)
    scale = dense.std(axis=0) if len(dense) else np.ones(dense.shape[1])
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(total, np.float32), rng.normal(0, 0.05, (total, RANK)).astype(np.float32), dense.mean(axis=0) if len(dense) else np.zeros(dense.shape[1]), np.where(scale > 1e-9, scale, 1.0))
    if labels.min(initial=1) == labels.max(initial=0):
        machine.factors[:] = 0
        return machine
    standard = machine.standard(dense)
    own = np.arange(BUCKETS, total)
    seen_w, seen_v, seen_b, decay, rate = np.full(total, 1e-3), np.full((total, RANK), 1e-3), 1e-3, 1e-5, 0.1
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            index = np.concatenate([x for i in part for x in (places[i], own)])
            x = np.concatenate([x for i in part for x in (values[i], standard[i])]).astype(np.float32)
            sizes = np.array([len(places[i]) + len(own) for i in part])
            starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)
            v = machine.factors[index]
            vx = v * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            raw = machine.bias + np.add.reduceat(machine.weights[index] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[part]) / len(part)
            each = slope[row] * x
            grad_w = np.bincount(index, each, total) + decay * machine.weights
            grad_v = decay * machine.factors
            pull = each[:, None] * (sums[row] - vx)
            for f in range(RANK):
                grad_v[:, f] += np.bincount(index, pull[:, f], total)
            seen_w += grad_w**2
            seen_v += grad_v**2
            seen_b += slope.sum() ** 2
            machine.weights -= (rate * grad_w / np.sqrt(seen_w)).astype(np.float32)
            machine.factors -= (0.3 * rate * grad_v / np.sqrt(seen_v)).astype(np.float32)
            machine.bias -= rate * slope.sum() / np.sqrt(seen_b)
    return machine


def _numbers(metadata: list[str]) -> Column:
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in metadata]
    return F.array(*[F.log1p(F.greatest(n, F.lit(0.0))) for n in numbers]).cast("array<double>").alias("metadata")


def _metadata(batch: pa.RecordBatch, count: int) -> np.ndarray:
    return batch.column("metadata").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, count) if count else np.empty((batch.num_rows, 0))


def learn(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", metadata: list[str] | None = None) -> Machine:
    """Fit on the labelled rows with the smallest hashes."""
    metadata = metadata or []
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    chosen = sampled(saved(chosen), "key", SAMPLE)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _numbers(metadata)).join(F.broadcast(chosen), "key")
    dense_type = "array<double>"

    def of(batches):
        for batch in batches:
            found = list(features(batch.column("text"), _metadata(batch, len(metadata))))
            places, values, dense = [], [], []
            for words, block in found:
                for row in words:
                    places.append(np.flatnonzero(row).astype(np.int32))
                    values.append(row[places[-1]])
                dense += list(block)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(dense, pa.list_(pa.float64()))],
                ["key", "label", "places", "values", "dense"],
            )

    kind = chosen.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(of, f"key {kind}, label int, places array<int>, values array<float>, dense {dense_type}")
    table = saved(made.dropDuplicates(["key"])).orderBy("key").toArrow()
    width = STATISTICS + len(metadata)
    dense = np.array(table.column("dense").to_pylist(), float).reshape(len(table), width)
    lists = [[np.asarray(x.values) for x in table.column(c)] for c in ("places", "values")]
    return fit(*lists, dense, table.column("label").to_numpy().astype(float))


def scored(docs: DataFrame, machine: Machine, text: str = "text", metadata: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc, score): the carried columns of every row, all by default, and its score."""
    metadata = metadata or []
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(*carried(docs, text, carry or docs.columns), _numbers(metadata))

    def of(batches):
        for batch in batches:
            found = [sent.value.score(*f) for f in features(texts_of(batch, text), _metadata(batch, len(metadata)))]
            scores = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(scores)], ["doc", "score"])

    return rows.mapInArrow(of, returning(rows, "score double"))


def held_out(key, parts: int, part: int):
    return F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part


def quality_machine(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine that op6 and the pipeline use: labels of held-out rows are not learnt from."""
    return learn(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)), "quality", metadata=["n_chars"])


def op6(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_machine(docs, labels)
    rows = scored(docs, machine, metadata=["n_chars"], carry=["doc_id"])
    out = F.coalesce(held_out(F.col("doc.doc_id"), 4, 2), F.lit(False))
    return rows.select("doc.doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
