"""Words of Arrow text columns as numpy arrays.

A batch is cut into pieces of about one megabyte of whole texts. Within a piece, words are found and hashed with array
operations over the UTF-8 bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktape.lineage import saved

PIECE_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII that is neither a digit nor a letter.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(b).isalnum() for b in range(128)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _geometric(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        _powers = _geometric(_BASE, max(n, PIECE_BYTES + 1))
        _inverses = _geometric(pow(_BASE, -1, 1 << 64), max(n, PIECE_BYTES + 1))
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Piece:
    """Whole texts of consecutive rows ``first`` to ``last`` of a batch, as bytes with the places of their words."""

    first: int
    last: int
    data: np.ndarray  # UTF-8 bytes
    offsets: np.ndarray  # of the texts in data, one more than there are texts
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    bounds: np.ndarray  # the words of text i are bounds[i] to bounds[i + 1]
    _sums: np.ndarray | None = None  # running sums, once they are needed again

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The text of each word, counted from the piece's first."""
        return np.repeat(np.arange(self.last - self.first), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        powers, inverses = _tables(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverses[self.starts])

    def heads(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of at least ``length`` bytes, and hashes of their first ``length`` bytes, as ``hashes`` makes them."""
        long = np.flatnonzero(self.ends - self.starts >= length)
        if not len(long):
            return long, np.empty(0, np.uint64)
        powers, inverses = _tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)])))
        starts = self.starts[long]
        return long, mix((self._sums[starts + length] - self._sums[starts]) * inverses[starts])

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate(([0], np.cumsum(per_byte, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def runs(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive words, and their bounds by text; shorter texts have none."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    if not out_bounds[-1]:
        return np.empty(0, np.uint64), out_bounds
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], counts)
    return mix(total[at]), out_bounds


def pieces(texts: pa.Array, separators: np.ndarray = SPACES, fold: bool = False, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Pieces of a text column; nulls count as empty. ``fold`` lower-cases A to Z, ``separators`` marks bytes between words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, places, values = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts), first + size)
        own = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        yield _piece(first, last, LOWER[part] if fold else part, own, separators)
        first = last


def _piece(first: int, last: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Piece:
    inside = ~separators[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads] = inside[heads]
    stops[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return Piece(first, last, data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def carried(docs: DataFrame, text: str, carry: list[str]) -> list[Column]:
    """The carried columns as a struct ``doc``, so that no name clashes, and the text unless it is one of them."""
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("doc")
    return [own] if text in carry else [own, F.col(f"`{text}`").alias("text")]


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    return batch.column("text") if "text" in batch.schema.names else batch.column("doc").field(text)


def returning(rows: DataFrame, more: str) -> T.StructType:
    """Schema of the struct ``doc`` as it came in, and more columns."""
    return T.StructType([rows.schema["doc"], *T.StructType.fromDDL(more).fields])


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The at most ``most`` rows with the smallest hash of their key, saved.

    Rows whose hash is far above are left out before the sort, so that what tasks hand on stays near ``most`` rows in all.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = 4 * most / max(1, rows.count())
    few = rows.where(place < int(share * (1 << 30))) if share < 1 else rows
    return saved(few.orderBy(place, key).limit(most))
