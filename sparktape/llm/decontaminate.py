"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash containment search.

Items are split by their number of distinct five-word shingles into classes of a factor of two. For class c a document
is seen as overlapping windows of three blocks of 2**c shingles: an item of the class that lies in the text in one piece
lies in one window, and a window is at most three times the item's size, however long the document. So containment of 0.8
means a resemblance of 0.25 at least, and one of 48 minima agrees but for one case in a million. Minima of blocks are
computed once and merged upwards from class to class. What agrees is verified by exact shingle containment in the whole
document: hashes first, then the words themselves.

Items are the stated query set: they are read in blocks of bounded size, each broadcast and searched in all documents, so
neither the driver nor a worker holds more than one block. Documents are never shuffled.

Words are runs of letters, digits and characters beyond ASCII, lower-cased. Null and empty texts match nothing; items
under five words have no shingle and match nothing. Repeated documents and items match one by one. Documents may have
other columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.llm.words import NOT_ALNUM, Piece, carried, pieces, runs, texts_of

SHINGLE = 5
THRESHOLD = 0.8
MINIMA = 48
#: Words of the items in one block, about; one item is never split.
BLOCK_WORDS = 2_000_000

_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, MINIMA, np.uint32)


def _narrow(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def _low(values: np.ndarray) -> np.ndarray:
    return (values ^ (values >> np.uint32(16))) & np.uint32(0xFFFF)


@dataclass
class Index:
    """A block of items: shingle hashes and words of each, and for each class and minimum the sorted values."""

    ids: list
    shingles: list[np.ndarray]
    words: list[list[bytes]]
    tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _words(piece: Piece, row: int) -> list[bytes]:
    a, b = piece.bounds[row], piece.bounds[row + 1]
    raw = piece.data.tobytes() if len(piece.offsets) == 2 else piece.data[piece.offsets[row] : piece.offsets[row + 1]].tobytes()
    base = 0 if len(piece.offsets) == 2 else piece.offsets[row]
    return [raw[x:y] for x, y in zip((piece.starts[a:b] - base).tolist(), (piece.ends[a:b] - base).tolist())]


def _strings(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def build(ids: list, texts: list) -> Index:
    index = Index([], [], [], {})
    column = pc.utf8_lower(pa.array(texts, pa.large_string()))
    minima: dict[int, list] = {}
    for piece in pieces(column, NOT_ALNUM):
        hashes, bounds = runs(piece.hashes(), piece.bounds, SHINGLE)
        for row in range(piece.last - piece.first):
            own = np.unique(hashes[bounds[row] : bounds[row + 1]])
            if len(own):
                size = int(len(own)).bit_length() - 1
                minima.setdefault(size, []).append((len(index.ids), (_narrow(own)[:, None] * _FACTORS + _SHIFTS).min(axis=0)))
                index.ids.append(ids[piece.first + row])
                index.shingles.append(own)
                index.words.append(_words(piece, row))
    for size, found in minima.items():
        at, values = np.array([i for i, _ in found]), np.array([v for _, v in found])
        tables = index.tables[size] = []
        for column in values.T:
            order = np.argsort(column, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[_low(column)] = True
            tables.append((column[order], at[order], seen))
    return index


def _steps(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``size`` within groups of ``counts`` consecutive values, and how many runs a group has."""
    many = -(-counts // size)
    first = np.repeat(np.cumsum(counts) - counts, many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return first + place * size, many


def candidates(shingles: np.ndarray, bounds: np.ndarray, index: Index) -> np.ndarray:
    """Distinct (text, item) pairs that agree on a minimum, as rows of two numbers."""
    found = []
    if index.tables and len(shingles):
        narrow = _narrow(shingles)
        lowest, highest = min(index.tables), max(index.tables)
        begin, first = _steps(np.diff(bounds), 1 << lowest)
        for i in range(MINIMA):
            values, counts = np.minimum.reduceat(narrow * _FACTORS[i] + _SHIFTS[i], begin), first
            for size in range(lowest, highest + 1):
                if size > lowest:
                    at, more = _steps(counts, 2)
                    values, counts = np.minimum.reduceat(values, at), more
                if size not in index.tables:
                    continue
                row = np.repeat(np.arange(len(counts)), counts)
                window = values.copy()
                for ahead in (1, 2):
                    same = row[ahead:] == row[:-ahead]
                    np.minimum(window[:-ahead], values[ahead:], out=window[:-ahead], where=same)
                keys, items, seen = index.tables[size][i]
                near = np.flatnonzero(seen[_low(window)])
                left, right = np.searchsorted(keys, window[near]), np.searchsorted(keys, window[near], "right")
                many = right - left
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)
                found.append(np.stack((np.repeat(row[near], many), items[place]), axis=1))
    pairs = [f for f in found if len(f)]
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)


def matches(texts: pa.Array, index: Index, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shingles found, shingles of the item) for each text that contains an item."""
    for piece in pieces(pc.utf8_lower(texts.cast(pa.large_string())), NOT_ALNUM):
        hashes, bounds = runs(piece.hashes(), piece.bounds, SHINGLE)
        pairs = candidates(hashes, bounds, index)
        for row in np.unique(pairs[:, 0]):
            own = np.unique(hashes[bounds[row] : bounds[row + 1]])
            strings = None
            for item in pairs[pairs[:, 0] == row, 1]:
                sought = index.shingles[item]
                at = np.minimum(np.searchsorted(own, sought), len(own) - 1)
                if (own[at] == sought).sum() < threshold * len(sought):
                    continue
                strings = strings or _strings(_words(piece, row))
                wanted = _strings(index.words[item])
                both = len(wanted & strings)
                if both >= threshold * len(wanted):
                    yield piece.first + int(row), int(item), both, len(wanted)


def blocks(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """The items in blocks of bounded size."""
    items = items.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    number = total // (5 * BLOCK_WORDS) + 1
    for block in range(number):
        part = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(number)) == block).orderBy("key", "text").collect()
        yield build([r.key for r in part], [r.text for r in part])


def search(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item_key="item_id", item_text="text", threshold=THRESHOLD) -> DataFrame:
    """(key, item key, matched, shingles, containment) for every document and item that it contains."""
    spark = docs.sparkSession
    own, theirs = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {own}, `{item_key}` {theirs}, matched long, shingles long, containment double"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    for index in blocks(items, item_key, item_text):
        sent = spark.sparkContext.broadcast(index)

        def find(batches, sent=sent):
            for batch in batches:
                hits = list(matches(batch.column(1), sent.value, threshold))
                rows, found, matched, sizes = (np.array(c, np.int64) for c in zip(*hits)) if hits else [np.empty(0, np.int64)] * 4
                keys = pa.array([sent.value.ids[i] for i in found], pa.from_numpy_dtype(np.int64) if theirs == "bigint" else None)
                columns = [batch.column(0).take(pa.array(rows)), keys, pa.array(matched), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(matched / np.maximum(sizes, 1))], [key, item_key, "matched", "shingles", "containment"]
                )

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text="text", item_key="item_id", item_text="text", threshold=THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain none of the items."""
    rows = docs.select(*carried(docs, text, docs.columns))
    schema = rows.schema
    for index in blocks(items, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, sent=sent):
            for batch in batches:
                free = np.ones(batch.num_rows, bool)
                free[[m[0] for m in matches(texts_of(batch, text), sent.value, threshold)]] = False
                yield batch.filter(pa.array(free))

        rows = rows.mapInArrow(keep, schema)
    return rows.select("doc.*")


def op1(spark, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they contain, over all documents and items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items)


OP1_SQL = r"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') from benchmark
), shingles as (
  select kind, id, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) as s from words where len(w) >= 5
), sizes as (
  select id as item_id, count(*) as shingles from shingles where kind = 'b' group by id
), hits as (
  select d.id as doc_id, b.id as item_id, count(*) as matched
  from shingles d join shingles b on d.s = b.s and d.kind = 'd' and b.kind = 'b' group by 1, 2
)
select doc_id, item_id, matched, shingles, matched / shingles::double as containment
from hits join sizes using (item_id) where matched >= 0.8 * shingles
"""
