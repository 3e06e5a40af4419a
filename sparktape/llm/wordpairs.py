"""Word level of the language model: modified Kneser-Ney over hashed word n-grams, counted and looked up by one shuffle.

Three consecutive words ``u v w`` of a text are one number of 64 bits: 24 for ``v`` and its language, 24 for ``w``, 16 for
``u``. Words that a sample has often go by their place in a lexicon (``w`` and ``u`` by their rank in ``v``'s language), all others by hash. The numbers of a block of texts are
sorted and dealt into buckets by ``v``, so that a bucket has all pairs of its contexts and knows their totals; bucket and number
together tell words apart. A pair's count is the number of different words before it. Contexts and pairs that are frequent in
the sample are dealt over all buckets, by the rest of their n-gram, and their counts are added up between the two passes over
the shuffled blocks. The sample makes the blocks small and changes no result but by the hashes' chance collisions: spellings of
words in the lexicon are broadcast with it and not shuffled, and places, hashes, rows and runs are compressed apart.

The first pass gives counts of counts for the discounts, the second what every word gains over its spelling:
``log((count - discount) / total / spelled + weight)``, with count and total without the word's own three words. A bucket is
unpacked into arrays of fixed width and sorted a range of contexts at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktape.llm.words import mix

#: Words and documents of a block, symbols of a bucket, and words of a bucket that are counted at a time.
BLOCK, BLOCK_ROWS, BUCKET, PART = 1 << 19, 1 << 16, 1 << 24, 1 << 17
#: One document of so many is read for frequent words, contexts and pairs; the latter two have one of ``RARE`` words.
SAMPLE, RARE = 64, 4096
#: Words in the lexicon, and those of a language that go by their rank as the first of three, too.
WORDS, EARLIER = 1 << 17, 1 << 15
#: Fractions of a nat in which spellings go to the buckets, and in which gains come back.
SPELLED, GAINED = 4, 4096
START = np.uint64(0x5851F42D4C957F2D)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_HASHED = 1 << 23


def salted(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Hashes of words with the numbers of their languages."""
    return mix(hashes + (numbers.astype(np.uint64) + np.uint64(1)) * _BASE)


def spelled(logs: np.ndarray) -> np.ndarray:
    """-log of the spelling's probability, in fractions."""
    return np.rint(-SPELLED * logs).astype(np.uint32)


def _places(sought: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(sought), bool), np.zeros(len(sought), np.int64)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return keys[at] == sought, at


def _before(values: np.ndarray, heads: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value before each, and ``first`` at the heads of texts."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[heads] = first
    return out


@dataclass
class Lexicon:
    """Frequent words by language, in each by falling frequency: places over all languages, ranks within one."""

    keys: np.ndarray  # salted hashes, sorted
    places: np.ndarray  # of each key, its word's place
    numbers: np.ndarray  # by place: the language
    spelled: np.ndarray
    often: np.ndarray  # by place: a number among the frequent contexts, or -1
    firsts: np.ndarray  # of each language, the place of its first word
    pairs: np.ndarray  # frequent pairs: the context's place and the word's rank in 24 bits each, sorted

    @staticmethod
    def of(counts: DataFrame) -> Lexicon:
        """``counts`` is what ``frequent`` gives, saved."""
        words, pairs = (counts.where(F.col("level") == k).orderBy(F.desc("n"), "key", "other").limit(most).toArrow() for k, most in ((0, WORDS), (1, 2 * RARE)))
        return Lexicon.made(words, pairs, counts.where("level = 2").agg(F.sum("n")).first()[0] or 0)

    @staticmethod
    def made(words: pa.Table, pairs: pa.Table, total: int) -> Lexicon:
        keys, n, numbers, spellings = (words.column(c).to_numpy() for c in ("key", "n", "number", "spelled"))
        order = np.lexsort((keys, -n, numbers))
        keys, n, numbers, spellings = keys[order].view(np.uint64), n[order], numbers[order], spellings[order]
        often = np.where(n * RARE >= total, np.cumsum(n * RARE >= total) - 1, -1)
        places, firsts = np.argsort(keys), np.searchsorted(numbers, np.arange(numbers.max(initial=0) + 1))
        made = Lexicon(keys[places], places.astype(np.uint32), numbers.astype(np.uint16), spellings.astype(np.uint32), often, firsts, np.empty(0, np.uint64))
        both = pairs.column("n").to_numpy() * RARE >= total
        v, w = (made.codes(pairs.column(c).to_numpy()[both].view(np.uint64)) for c in ("key", "other"))
        known = made.frequent(v) & (w < _HASHED)
        v, w = v[known], w[known]
        made.pairs = np.unique(v.astype(np.uint64) << np.uint64(24) | made.ranks(w, made.numbers[v]))
        return made

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """24 bits for each salted hash: its place, or a flag and 23 bits of the hash."""
        found, at = _places(keys, self.keys)
        out = (np.uint64(_HASHED) | keys >> np.uint64(41)).astype(np.uint32)
        out[found] = self.places[at[found]]
        return out

    def ranks(self, codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The same with ranks for places; ``numbers`` are the languages."""
        known = codes < _HASHED
        out = codes.copy()
        out[known] -= self.firsts[numbers[known]].astype(np.uint32)
        return out

    def frequent(self, codes: np.ndarray) -> np.ndarray:
        """Whether they are places of frequent contexts."""
        out = codes < len(self.often)
        out[out] = self.often[codes[out]] >= 0
        return out


@dataclass
class Tokens:
    """The words of consecutive texts."""

    numbers: np.ndarray  # of the texts' languages
    row: np.ndarray  # of each word, its text
    gram: np.ndarray
    low: np.ndarray  # what the bucket goes by
    spelled: np.ndarray
    counted: np.ndarray

    @staticmethod
    def of(keys, languages, inverse, bounds, numbers, logs, with_sign, incidental, lexicon: Lexicon) -> Tokens:
        """``keys``, ``languages`` and ``logs`` are of the distinct words. N-grams with a word of markup count where markup is incidental."""
        if not len(inverse):
            return Tokens(numbers, *[np.empty(0, t) for t in (np.uint32, np.uint64, np.uint32, np.uint32, bool)])
        near = with_sign.copy()
        near[1:] |= with_sign[:-1]
        near[2:] |= with_sign[:-2]
        row = np.repeat(np.arange(len(numbers), dtype=np.uint32), np.diff(bounds))
        full = np.diff(bounds) > 0
        heads, start = bounds[:-1][full], salted(START, numbers)[full]
        codes, first = lexicon.codes(keys), lexicon.codes(start)
        ranks = lexicon.ranks(codes, languages)
        short = lambda c, k: np.where(c < EARLIER, c, np.uint64(EARLIER) | k >> np.uint64(49)).astype(np.uint16)
        w, key = ranks[inverse], keys[inverse]
        v, context = _before(codes[inverse], heads, first), _before(key, heads, start)
        own = short(lexicon.ranks(first, numbers[full]), start)
        u = _before(_before(short(ranks, keys)[inverse], heads, own), heads, own)
        low = context.astype(np.uint32)
        many = np.flatnonzero(lexicon.frequent(v))
        pair = mix(context[many] + key[many] * _OTHER)
        both, _ = _places(v[many].astype(np.uint64) << np.uint64(24) | w[many], lexicon.pairs)
        if both.any():
            pair[both] = mix(pair[both] + _before(context, heads, start)[many[both]])
        low[many] = pair.astype(np.uint32)
        gram = v.astype(np.uint64) << np.uint64(40) | w.astype(np.uint64) << np.uint64(16) | u
        return Tokens(numbers, row, gram, low, spelled(logs)[inverse], ~near | incidental)


def _grouped(keys: np.ndarray, counts: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    head = _heads(keys)
    return [keys[head], np.add.reduceat(counts[order], head), *[o[order[head]] for o in others]]


def frequent(sample: DataFrame, spelt: Callable) -> DataFrame:
    """Counts of the words, pairs and all words of a sample (text, lang), of which ``spelt`` gives pieces, distinct words, languages and spellings."""
    names = ["level", "key", "other", "number", "spelled", "n"]

    def count(batches):
        total, words, pairs = 0, [], []
        for batch in batches:
            for piece, d, numbers, logs, _ in spelt(batch):
                if not len(d.inverse):
                    continue
                total += len(d.inverse)
                full = np.diff(piece.bounds) > 0
                start = salted(START, numbers)[full]
                words.append((d.keys, d.counts, d.languages, spelled(logs)))
                words.append((start, np.ones(len(start), np.int64), numbers[full], np.zeros(len(start), np.uint32)))
                key = d.keys[d.inverse]
                context = _before(key, piece.bounds[:-1][full], start)
                both, n, at = _grouped(mix(context + key * _OTHER), np.ones(len(key), np.int64), np.arange(len(key)))
                at, n = at[n * 2 * RARE >= len(key)], n[n * 2 * RARE >= len(key)]
                pairs.append((context[at], key[at], n))
                if sum(len(w[0]) for w in words) > BLOCK:
                    words = [_grouped(*map(np.concatenate, zip(*words)))]
        if not total:
            return
        keys, n, numbers, spellings = _grouped(*map(np.concatenate, zip(*words)))
        seen = (n > 1) | (spellings == 0)
        context, key, often = map(np.concatenate, zip(*pairs))
        none = np.zeros(len(key), np.int64)
        yield _counted(names, 0, keys[seen], np.zeros(seen.sum(), np.uint64), numbers[seen], spellings[seen], n[seen])
        yield _counted(names, 1, context, key, none, none, often)
        yield _counted(names, 2, *[np.zeros(1, np.uint64)] * 4, np.array([total]))

    rows = sample.mapInArrow(count, ", ".join(f"{n} long" for n in names))
    return rows.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _counted(names: list[str], level: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64).view(np.int64)) for c in (np.full(len(columns[0]), level), *columns)], names)


def _packed(values: np.ndarray) -> tuple[int, str, list[bytes]]:
    """Planes of bytes, each compressed by itself; the highest that are zero are left out."""
    size, kind = len(values), values.dtype.str
    width = -(-int(values.max()).bit_length() // 8) if size else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(size, -1)[:, :width].T) if size else []
    return size, kind, [min(p.tobytes(), pa.compress(p, "zstd", asbytes=True), key=len) for p in planes]


def _unpacked(data: tuple[int, str, list[bytes]]) -> np.ndarray:
    size, kind, planes = data
    out = np.zeros((size, np.dtype(kind).itemsize), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = np.frombuffer(plane if len(plane) == size else pa.decompress(plane, size, "zstd", asbytes=True), np.uint8)
    return out.view(kind).ravel()


def _flags(values: np.ndarray) -> tuple[int, str, list[bytes]]:
    return _packed(np.packbits(values))


def _unflagged(data: tuple[int, str, list[bytes]], size: int) -> np.ndarray:
    return np.unpackbits(_unpacked(data), count=size).view(bool)


def _sizes(head: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(head, size)).astype(np.uint32)


def packed(grams: np.ndarray, rows: np.ndarray, spellings: np.ndarray, counted: np.ndarray, numbers: np.ndarray) -> tuple:
    """Sorted n-grams as contexts, their words, and the words before; of words by hash with the spelling.

    The rows of a language follow each other. Of contexts by place, the language is known, so that its first row need not be told again.
    """
    head = _heads(grams >> np.uint64(16))
    w, u = (grams[head] >> np.uint64(16)).astype(np.uint32) & np.uint32(0xFFFFFF), grams.astype(np.uint16)
    v = (grams[head] >> np.uint64(40)).astype(np.uint32)
    first = _heads(v)
    hashed, early = w >= _HASHED, u >= EARLIER
    runs = _heads(v.astype(np.uint64) << np.uint64(1) | hashed)  # from each, words of a context by rank, or by hash
    step = np.diff(w, prepend=np.uint32(0))
    step[runs] = w[runs] & np.uint32(_HASHED - 1)
    known = np.searchsorted(grams, np.uint64(1 << 63))  # from here on, contexts by hash
    used, of = np.unique(numbers, return_inverse=True)
    least = np.full(len(used), 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, of, rows)
    return (
        (_packed(np.diff(v[first], prepend=np.uint32(0))), _packed(_sizes(first, len(head))), _packed(_sizes(head, len(grams)))),
        (_flags(hashed), _packed(step[~hashed]), _packed(step[hashed])),
        (_flags(early), _packed(u[~early]), _packed(u[early] & np.uint16(EARLIER - 1))),
        (_packed(used.astype(np.uint16)), _packed(least), _packed(rows[known:]), _flags(~counted)),
        (_packed(rows[:known] - least[of[:known]]), _packed(spellings[head][hashed])),
    )


def unpacked(parts: tuple, lexicon: Lexicon, whole: bool) -> tuple[np.ndarray, ...]:
    """N-grams, whether they are counted, languages, and with ``whole`` rows and spellings."""
    steps, pairs, times = map(_unpacked, parts[0])
    v, n = np.repeat(np.cumsum(steps, dtype=np.uint32), pairs), int(times.sum())
    hashed = _unflagged(parts[1][0], len(v))
    w = np.empty(len(v), np.uint32)
    w[~hashed], w[hashed] = _unpacked(parts[1][1]), _unpacked(parts[1][2])
    runs = _heads(v.astype(np.uint64) << np.uint64(1) | hashed)
    line = np.cumsum(w, dtype=np.uint64)
    w = (line - np.repeat(line[runs] - w[runs], _sizes(runs, len(v)))).astype(np.uint32)
    w[hashed] |= np.uint32(_HASHED)
    early = _unflagged(parts[2][0], n)
    u = np.empty(n, np.uint16)
    u[~early], u[early] = _unpacked(parts[2][1]), _unpacked(parts[2][2]) | np.uint16(EARLIER)
    grams = np.repeat(v.astype(np.uint64) << np.uint64(40) | w.astype(np.uint64) << np.uint64(16), times) | u
    used, least, rows = map(_unpacked, parts[3][:3])
    known = np.searchsorted(v, np.uint32(_HASHED))
    number = lexicon.numbers[v[:known]]
    numbers = np.concatenate((np.repeat(number, times[:known]), used[np.searchsorted(least, rows, "right") - 1]))
    counted = ~_unflagged(parts[3][3], n)
    if not whole:
        return grams, counted, numbers
    rows = np.concatenate((_unpacked(parts[4][0]) + least[np.searchsorted(used, numbers[: n - len(rows)])], rows))
    spellings = np.empty(len(v), np.uint32)
    of = numbers[np.cumsum(times) - 1][~hashed]
    spellings[~hashed], spellings[hashed] = lexicon.spelled[lexicon.firsts[of] + w[~hashed]], _unpacked(parts[4][1])
    return grams, counted, numbers, rows, np.repeat(spellings, times)


def dealt(block: list[Tokens], buckets: int) -> Iterator[tuple[int, bytes]]:
    """The n-grams of a block by bucket, sorted; texts are counted in the order of ``by_language``."""
    numbers = np.concatenate([t.numbers for t in block])
    order = by_language(block)
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    firsts = np.cumsum([0, *[len(t.numbers) for t in block]])
    row = place[np.concatenate([t.row + np.uint32(f) for t, f in zip(block, firsts)])]
    numbers = numbers[order]
    gram, low, spellings, counted = (np.concatenate([getattr(t, n) for t in block]) for n in ("gram", "low", "spelled", "counted"))
    bucket = (low % np.uint32(buckets)).astype(np.uint16)
    order = np.argsort(gram)
    order = order[np.argsort(bucket[order], kind="stable")]
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        own = order[bounds[k] : bounds[k + 1]]
        if len(own):
            yield k, pickle.dumps((len(own), packed(gram[own], row[own], spellings[own], counted[own], numbers[row[own]])))


def by_language(block: list[Tokens]) -> np.ndarray:
    """The places of the block's texts, those of a language together."""
    return np.argsort(np.concatenate([t.numbers for t in block]), kind="stable")


def _heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


@dataclass
class Bucket:
    """The n-grams of a bucket, sorted within each block."""

    lexicon: Lexicon
    blocks: list[int]
    bounds: np.ndarray  # of the blocks
    grams: np.ndarray
    counted: np.ndarray
    numbers: np.ndarray
    row: np.ndarray
    spelled: np.ndarray

    @staticmethod
    def of(blobs: list[tuple[int, bytes]], lexicon: Lexicon, whole: bool) -> Bucket:
        """Rows and spellings only with ``whole``. ``blobs`` is emptied, so that nothing is held both packed and unpacked."""
        blocks, found = [b for b, _ in blobs], []
        while blobs:
            found.append(pickle.loads(blobs.pop()[1]))
        bounds = np.cumsum([0, *[n for n, _ in found[::-1]]])
        columns = [np.empty(bounds[-1] if k < 3 or whole else 0, t) for k, t in enumerate((np.uint64, bool, np.uint16, np.uint32, np.uint32))]
        for start, end in zip(bounds, bounds[1:]):
            for column, values in zip(columns, unpacked(found.pop()[1], lexicon, whole)):
                column[start:end] = values
        return Bucket(lexicon, blocks, bounds, *columns)

    def parts(self) -> Iterator[tuple[np.ndarray, Part]]:
        """Whole contexts, about ``PART`` words at a time, with the words' places in the bucket."""
        blocks = [self.grams[a:b] for a, b in zip(self.bounds, self.bounds[1:])]
        some = np.sort(np.concatenate([g[k * 89 % 256 :: 256] for k, g in enumerate(blocks)]) >> np.uint64(40))
        cuts = np.unique(some[PART // 256 :: PART // 256]) << np.uint64(40)
        edges = np.stack([np.concatenate(([0], np.searchsorted(g, cuts), [len(g)])) for g in blocks]) + self.bounds[:-1, None]
        for start, end in zip(edges.T, edges.T[1:]):
            sizes = end - start
            if sizes.any():
                at = np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
                at = at[np.argsort(self.grams[at])]
                yield at, Part.of(self.grams[at], self.spelled[at] if len(self.spelled) else None, self.counted[at], self.numbers[at], self.lexicon)


@dataclass
class Part:
    """Some contexts of a bucket, with counts of n-grams, pairs and contexts."""

    spelled: np.ndarray | None  # of n-grams
    gram: np.ndarray  # of each entry, the place of its n-gram; of n-grams, of their pair, and so on
    pair: np.ndarray
    context: np.ndarray
    counted: np.ndarray  # of n-grams: 1 if counted
    numbers: np.ndarray  # of pairs: their language
    often: tuple[np.ndarray, np.ndarray]  # of pairs: whether they are frequent, and their place
    frequent: np.ndarray  # of contexts: their number among the frequent ones, or -1
    n: np.ndarray  # of pairs: different words before them

    @staticmethod
    def of(grams: np.ndarray, spellings: np.ndarray | None, counted: np.ndarray, numbers: np.ndarray, lexicon: Lexicon) -> Part:
        head = _heads(grams)
        gram = np.repeat(np.arange(len(head)), _sizes(head, len(grams)))
        once = np.logical_or.reduceat(counted, head).astype(np.int64)
        pairs = grams[head] >> np.uint64(16)
        first = _heads(pairs)
        pair = np.repeat(np.arange(len(first)), _sizes(first, len(pairs)))
        words = pairs[first]
        start = _heads(words >> np.uint64(24))
        context = np.repeat(np.arange(len(start)), _sizes(start, len(words)))
        ids = (words[start] >> np.uint64(24)).astype(np.int64)
        frequent = np.full(len(ids), -1)
        frequent[ids < len(lexicon.often)] = lexicon.often[ids[ids < len(lexicon.often)]]
        least = None if spellings is None else np.minimum.reduceat(spellings, head)
        return Part(least, gram, pair, context, once, numbers[head][first], _places(words, lexicon.pairs), frequent, np.add.reduceat(once, first))

    def totals(self) -> np.ndarray:
        """Of each context, its counts and its pairs counted once, twice and more; frequent pairs are left out."""
        n = np.where(self.often[0], 0, self.n)
        return np.stack([np.bincount(self.context, x) for x in (n, n == 1, n == 2, n >= 3)], 1).astype(np.int64)


def tallied(bucket: Bucket) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """Counts of counts by language, counts of frequent contexts and pairs."""
    for _, part in bucket.parts():
        both, place = part.often
        few = np.flatnonzero(~both & (part.n >= 1) & (part.n <= 4))
        counts = np.bincount(part.numbers[few].astype(np.int64) * 4 + part.n[few] - 1, minlength=4)
        for number in np.unique(part.numbers).tolist():
            yield ("language", number), np.append(counts[4 * number : 4 * number + 4], np.zeros(4, np.int64))[:4]
        totals = part.totals()
        for at in np.flatnonzero(part.frequent >= 0):
            yield ("context", int(part.frequent[at])), totals[at]
        for at in np.flatnonzero(both):
            yield ("pair", int(place[at])), part.n[at : at + 1]


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more, from how many pairs have counts of 1 to 4."""
    out = np.zeros(4)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else None
    for k in (1, 2, 3):
        out[k] = 0.5 * k if y is None or not n[k - 1] else min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k)
    return out


@dataclass
class Known:
    """What is added up over all buckets."""

    discounts: np.ndarray  # by language
    contexts: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def of(tallies: dict, lexicon: Lexicon, languages: int) -> Known:
        counts, contexts, pairs = np.zeros((languages, 4), np.int64), np.zeros((lexicon.often.max(initial=-1) + 1, 4), np.int64), np.zeros(len(lexicon.pairs), np.int64)
        for (what, at), n in tallies.items():
            if what == "pair":
                pairs[at] = n[0]
            else:
                (counts if what == "language" else contexts)[at] = n
        for n, of in zip(pairs, (lexicon.pairs >> np.uint64(24)).astype(np.int64)):
            if n:
                contexts[lexicon.often[of]] += [n, n == 1, n == 2, n >= 3]
            if 1 <= n <= 4:
                counts[lexicon.numbers[of], n - 1] += 1
        return Known(np.array([discounts(n) for n in counts]), contexts, pairs)


def gains(part: Part, known: Known) -> np.ndarray:
    """What each word's log probability gains over its spelling, without the word's own n-gram."""
    totals, n = part.totals(), part.n.copy()
    totals[part.frequent >= 0] = known.contexts[part.frequent[part.frequent >= 0]]
    both, place = part.often
    n[both] = known.pairs[place[both]]
    # By n-gram; what its words have in common is worked out once.
    own, whole = part.counted, n[part.pair]
    count = whole - own
    of = totals[part.context[part.pair]].astype(float)
    of[:, 0] -= own
    for k in (1, 2, 3):
        of[:, k] -= (whole == k) & (own == 1)
        if k < 3:
            of[:, k] += (whole == k + 1) & (own == 1)
    cuts = known.discounts[part.numbers[part.pair]]
    rest = np.maximum(count - np.take_along_axis(cuts, np.minimum(count, 3)[:, None], 1)[:, 0], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.log((of[:, 1:] * cuts[:, 1:]).sum(1) / of[:, 0])
        seen = np.log(rest / of[:, 0])
        gain = np.where(of[:, 0] > 0, np.logaddexp(seen + part.spelled / SPELLED, weight), 0)
    return gain[part.gram]


def summed(bucket: Bucket, known: Known) -> Iterator[tuple[int, bytes]]:
    """Gains by block and text, as whole numbers, so that sums do not depend on their order."""
    gain = np.empty(len(bucket.grams), np.int64)
    for own, part in bucket.parts():
        gain[own] = np.rint(GAINED * gains(part, known))
    for block, start, end in zip(bucket.blocks, bucket.bounds, bucket.bounds[1:]):
        row = bucket.row[start:end]
        at = np.flatnonzero(np.bincount(row))
        sums = np.bincount(row, gain[start:end])[at].astype(np.int64)
        yield block, pickle.dumps((_packed(np.diff(at, prepend=0).astype(np.uint32)), _packed((sums << 1 ^ sums >> 63).astype(np.uint64))))


def scored(rows: DataFrame, measure: Callable[[Iterator[pa.RecordBatch], Lexicon], Iterator[tuple[pa.RecordBatch, Tokens]]], schema: T.StructType, lexicon: Lexicon, symbols: int) -> DataFrame:
    """The batches that ``measure`` makes of ``rows``, of ``schema``, and ``gain``: what the words of each row gain over their spelling."""
    spark = rows.sparkSession
    buckets = min(max(1, symbols // BUCKET, min(int(spark.conf.get("spark.sql.shuffle.partitions")), symbols >> 20)), 1 << 16)
    sent = spark.sparkContext.broadcast(lexicon)

    def blocks(batches):
        task = TaskContext.get().partitionId()
        held, number = [], 0
        for pair in measure(batches, sent.value):
            held.append(pair)
            if sum(len(t.row) for _, t in held) >= BLOCK or sum(len(t.numbers) for _, t in held) >= BLOCK_ROWS:
                yield _block(task << 32 | number, held, buckets)
                held, number = [], number + 1
        if held:
            yield _block(task << 32 | number, held, buckets)

    made = rows.mapInArrow(blocks, "place int, block long, texts boolean, body binary")
    shuffled = made.repartitionById(buckets, "place").rdd  # both passes read the one shuffle

    def bucket(records, texts: list | None) -> Iterator[Bucket]:
        """The buckets of a task; texts go to the list, if there is one."""
        held = {}
        for r in records:
            if not r.texts:
                held.setdefault(r.place, []).append((r.block, r.body))
            elif texts is not None:
                texts.append((r.block, True, r.body))
        while held:
            yield Bucket.of(sorted(held.popitem()[1], key=lambda b: b[0]), sent.value, texts is not None)

    tallies = shuffled.mapPartitions(lambda r: (x for b in bucket(r, None) for x in tallied(b))).reduceByKey(lambda a, b: a + b).collectAsMap()
    languages = 1 + max([at for what, at in tallies if what == "language"] + lexicon.numbers.tolist(), default=0)
    known = spark.sparkContext.broadcast(Known.of(tallies, lexicon, languages))

    def gained(records):
        texts = []
        for b in bucket(records, texts):
            yield from ((block, False, body) for block, body in summed(b, known.value))
        yield from texts

    def joined(table: pa.Table) -> pa.Table:
        """The texts of a block with the sums of what the buckets gave them."""
        texts = table.column("texts").to_numpy()
        body = table.column("body")
        opened = pa.ipc.open_stream(body[int(np.flatnonzero(texts)[0])].as_buffer()).read_all()
        total = np.zeros(len(opened), np.int64)
        for k in np.flatnonzero(~texts):
            at, gain = map(_unpacked, pickle.loads(body[int(k)].as_buffer()))
            gain = gain.view(np.int64)
            total[np.cumsum(at, dtype=np.int64)] += gain >> 1 ^ -(gain & 1)
        return opened.append_column("gain", pa.array(total / GAINED))

    found = spark.createDataFrame(shuffled.mapPartitions(gained), "block long, texts boolean, body binary", verifySchema=False)
    return found.groupBy("block").applyInArrow(joined, T.StructType([*schema.fields, T.StructField("gain", T.DoubleType())]))


def _block(number: int, held: list[tuple[pa.RecordBatch, Tokens]], buckets: int) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(pa.Table.from_batches([b for b, _ in held]).take(by_language([t for _, t in held])))
    blobs = list(dealt([t for _, t in held], buckets))
    place = [(number >> 32) % buckets, *[k for k, _ in blobs]]
    columns = [pa.array(place, pa.int32()), pa.array([number] * len(place)), pa.array([True] + [False] * len(blobs))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([sink.getvalue().to_pybytes(), *[b for _, b in blobs]], pa.binary())], ["place", "block", "texts", "body"])
