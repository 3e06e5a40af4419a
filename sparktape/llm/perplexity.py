"""Quality rules with n-gram perplexity.

Fixed rules count words, symbols, repeated lines and repeated eight-word windows. The language model is a modified
Kneser-Ney model of hashed word n-grams, one for each language, over a modified Kneser-Ney model of the words' spelling:

1. Spelling: every task counts four-grams of the characters of its texts' words, Spark sums them over all documents.
   Characters are 64 symbols (letters, digits, classes of punctuation, hashed classes of all else), so a language has at
   most 2**24 four-grams. Continuation counts, discounts and interpolated probabilities are DataFrame joins and aggregates;
   the model is broadcast. Languages with under a thousand counted four-grams in all their text share one model.
2. Words: every three words of all texts are hashed and shuffled by the middle one, the context of the third, in sorted
   blocks. A pair counts once for each different word before it (Kneser-Ney's continuation count), so that a text's copies
   and near copies do not vouch for each other. Discounts come from counts of counts over all pairs of a language. A
   word's probability after its context is interpolated with its spelling. Every word is judged without its own three
   words (leaving one out), so that a text does not vouch for itself. See ``sparktape.llm.wordpairs``.
3. Score: a text's perplexity is per symbol, word ends included. A text whose spelling is far above its language's usual
   perplexity may hold passages of another one, so each word's spelling counts by its distance to the usual of the language
   that knows it best. N-grams with markup (#*$%&|<>) are counted like others where markup is incidental, in at most
   ``INCIDENTAL`` of a text's words; texts made of markup would else vouch for each other.
4. Bands: within a language, texts whose log perplexity lies too far above or below the median are rejected: several
   interquartile ranges, and never less than ``LEAST_ABOVE`` or ``LEAST_BELOW`` nats a symbol. Junk lies above, boilerplate
   of few words below. Both statistics are over all different log perplexities of a language, so that texts with many
   copies count once and do not narrow the bands.

Null texts have no words: they fail the base rules. Null languages are a language of their own. Repeated rows count and
are judged one by one. ``docs`` may have other columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.llm import wordpairs
from sparktape.llm.words import Piece, carried, mix, pieces, returning, runs, texts_of

WINDOW = 8
#: Distance of the bands from the median, in interquartile ranges of the log perplexity; short texts vary more and get more.
ABOVE, BELOW = 5.0, 4.5
SHORT = 50.0
#: Least distance of the bands from the median, in nats a symbol: markup, names and numbers in clean texts stay within it.
LEAST_ABOVE, LEAST_BELOW = 0.17, 0.5
#: Share of a text's words up to which markup in them is counted.
INCIDENTAL = 0.1
#: Times its language's usual log perplexity from which a text may hold passages of other languages.
FAR = 1.06
#: Four-grams of text from which a language has a model of its own, however much text others have.
LEAST_GRAMS = 1000
PIECE = 1 << 20
#: The symbol of #*$%&|<>.
MARKUP = 57

# Symbols: 0 word boundary, letters, digits, punctuation by class, and from 59 hashed classes beyond ASCII.
_SYMBOL = np.full(256, 58, np.int32)
_SYMBOL[ord("a") : ord("z") + 1] = range(1, 27)
_SYMBOL[ord("A") : ord("Z") + 1] = range(27, 53)
_SYMBOL[ord("0") : ord("9") + 1] = 53
for _number, _characters in enumerate((".,;:", "!?", "'\"()[]{}-_/", "#*$%&|<>"), 54):
    _SYMBOL[list(_characters.encode())] = _number

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Distinct:
    """The distinct (language, word) pairs of a piece and the four-grams in them."""

    keys: np.ndarray  # hashes of the pairs
    inverse: np.ndarray  # of each word of the piece, its pair
    counts: np.ndarray
    grams: np.ndarray
    of: np.ndarray  # the pair of each gram
    languages: np.ndarray  # of each pair


def distinct(piece: Piece, hashes: np.ndarray, languages: np.ndarray) -> Distinct:
    """``languages``: a number for each text."""
    of_word = np.repeat(languages, piece.counts)
    salted = wordpairs.salted(hashes, of_word)
    order = np.argsort(salted)
    new = np.ones(len(salted), bool)
    new[1:] = salted[order[1:]] != salted[order[:-1]]
    inverse = np.empty(len(salted), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first, counts = order[new], np.diff(np.append(np.flatnonzero(new), len(salted)))
    starts, lengths = piece.starts[first], piece.ends[first] - piece.starts[first]
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    octets, pair = piece.data[at], np.repeat(np.arange(len(first)), lengths)
    symbols = _SYMBOL[octets]
    wide = np.flatnonzero(octets >= 0xC0)  # first bytes of other characters; what follows has no symbol of its own
    after = piece.data[np.minimum(at[wide] + 1, len(piece.data) - 1)]
    symbols[wide] = 59 + (octets[wide].astype(np.int32) * 64 + after) % 5
    real = (octets & 0xC0) != 0x80
    symbols, pair = symbols[real], pair[real]
    own = np.bincount(pair, minlength=len(first))
    # Each word lies after three boundaries; the gram at the boundary behind it ends the word.
    place = np.arange(len(symbols)) + 3 * (pair + 1)
    line = np.zeros(len(symbols) + 3 * len(first) + 3, np.int32)
    line[place] = symbols
    grams = line[3:] | line[2:-1] << 6 | line[1:-2] << 12 | line[:-3] << 18
    ends = np.cumsum(own) + 3 * np.arange(1, len(first) + 1)
    where = np.concatenate((place, ends)) - 3
    return Distinct(salted[first], inverse, counts, grams[where], np.concatenate((pair, np.arange(len(first)))), of_word[first])


def marked(grams: np.ndarray) -> np.ndarray:
    """Four-grams that hold a symbol of markup."""
    return np.logical_or.reduce([(grams >> 6 * k & 63) == MARKUP for k in range(4)])


def incidental(piece: Piece, d: Distinct) -> np.ndarray:
    """How often each pair occurs in texts of the piece that have markup in at most ``INCIDENTAL`` of their words."""
    return np.bincount(d.inverse[signs(piece)[1]], minlength=len(d.counts))


def signs(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, whether it holds markup, and whether markup is incidental in its text."""
    sign = np.concatenate(([0], np.cumsum(_IS_SYMBOL[piece.data])))
    with_sign = sign[piece.ends] > sign[piece.starts]
    row = piece.rows()
    few = np.bincount(row, with_sign, len(piece.counts)) <= INCIDENTAL * piece.counts
    return with_sign, few[row]


def _numbers(column: pa.Array) -> tuple[np.ndarray, list]:
    coded = column.cast(pa.string()).fill_null("").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def counted(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all words of all documents; grams with markup over those of texts where markup is incidental."""

    def count(batches):
        numbers: dict[str, int] = {}
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            languages, names = _numbers(batch.column(1))
            languages = np.array([numbers.setdefault(n, len(numbers)) for n in names] or [0], np.int64)[languages]
            for piece in pieces(batch.column(0), size=PIECE):
                if not len(piece.starts):
                    continue
                d = distinct(piece, piece.hashes(), languages[piece.first : piece.last])
                times = np.where(marked(d.grams), incidental(piece, d)[d.of], d.counts[d.of])
                seen = times > 0
                own, inverse = np.unique(d.languages[d.of[seen]] << 24 | d.grams[seen], return_inverse=True)
                found = np.concatenate((keys, own))
                total = np.concatenate((sums, np.bincount(inverse, times[seen], len(own)).astype(np.int64)))
                keys, inverse = np.unique(found, return_inverse=True)
                sums = np.bincount(inverse, total).astype(np.int64)
        names = pa.array(list(numbers), pa.string()).take(pa.array(keys >> 24))
        yield pa.RecordBatch.from_arrays([names, pa.array((keys & 0xFFFFFF).astype(np.int32)), pa.array(sums)], ["lang", "gram", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(count, "lang string, gram int, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted keys (language and n-gram) with log probabilities, and contexts with log back-off weights, by order."""

    languages: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    values: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    usual: dict[int, float] = field(default_factory=dict)  # log perplexity of each language's text as a whole
    symbols: int = 0  # in all counted text

    def log_prob(self, languages: np.ndarray, grams: np.ndarray, order: int = 4) -> np.ndarray:
        if not order:
            return np.full(len(grams), -np.log(64.0))
        out = np.empty(len(grams))
        found, at = _find(self.keys[order], languages << 24 | grams)
        out[found] = self.values[order][at[found]]
        rest = ~found
        if rest.any():
            lower = self.log_prob(languages[rest], grams[rest] & ((1 << 6 * (order - 1)) - 1), order - 1)
            seen, at = _find(self.contexts[order], languages[rest] << 24 | grams[rest] >> 6)
            lower[seen] += self.weights[order][at[seen]]
            out[rest] = lower
        return out


def _find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(sought), bool), np.zeros(len(sought), np.int64)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return keys[at] == sought, at


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Modified Kneser-Ney models of the languages of ``docs``; number 0 holds all that have too little text."""
    spark = docs.sparkSession
    raw = saved(counted(docs, text, lang))
    shares = raw.groupBy("lang").agg(F.sum("n").alias("n"))
    shares = saved(shares)
    own = [r.lang for r in shares.where(F.col("n") >= LEAST_GRAMS).orderBy("lang").collect()]
    model = Model(["", *own], symbols=shares.agg(F.sum("n")).first()[0] or 0)
    numbers = F.create_map(*[F.lit(x) for i, name in enumerate(own, 1) for x in (name, i)]) if own else F.lit(None)
    number = F.coalesce(numbers[F.col("lang")], F.lit(0)) if own else F.lit(0)
    order = {4: saved(raw.groupBy(number.alias("lang"), "gram").agg(F.sum("n").alias("c")))}
    for n in (3, 2, 1):  # below the highest order, a gram counts once for each symbol seen before it
        low = F.col("gram").bitwiseAND(F.lit((1 << 6 * n) - 1)).alias("gram")
        order[n] = saved(order[n + 1].groupBy("lang", low).agg(F.count("*").alias("c")))
    below = spark.createDataFrame([(i, 0, 1 / 64) for i in range(len(model.languages))], "lang int, gram int, p double")
    for n in (1, 2, 3, 4):
        sizes = order[n].groupBy("lang").agg(*[F.count(F.when(F.col("c") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        cut = []
        for k in (1, 2, 3):
            raw = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            cut.append(F.when(raw.isNull(), 0.5 * k).otherwise(F.least(F.greatest(raw, F.lit(0.05)), F.lit(float(k)))))
        cuts = F.broadcast(sizes.select("lang", *[c.alias(f"d{k}") for k, c in enumerate(cut, 1)]))  # one row for each language
        grams = order[n].join(cuts, "lang")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        d = F.least(d, F.col("c").cast("double"))
        grams = grams.select("lang", "gram", "c", d.alias("d"), F.shiftright("gram", 6).alias("context"))
        contexts = saved(grams.groupBy("lang", "context").agg(F.sum("c").alias("all"), (F.sum("d") / F.sum("c")).alias("weight")))
        low = F.col("gram").bitwiseAND(F.lit((1 << 6 * (n - 1)) - 1))
        grams = grams.withColumn("low", low).join(contexts, ["lang", "context"])
        p = (F.col("c") - F.col("d")) / F.col("all") + F.col("weight") * F.col("p")
        grams = grams.join(below.withColumnRenamed("gram", "low"), ["lang", "low"]).select("lang", "gram", "c", p.alias("p"))
        below = saved(grams)
        key = (F.shiftleft(F.col("lang").cast("long"), 24) + F.col("gram")).alias("key")
        model.keys[n], model.values[n] = _sorted(below.select(key, F.log("p").alias("value")))
        key = (F.shiftleft(F.col("lang").cast("long"), 24) + F.col("context")).alias("key")
        model.contexts[n], model.weights[n] = _sorted(contexts.select(key, F.log("weight").alias("value")))
        if n == 4:
            whole = below.groupBy("lang").agg((-F.sum(F.col("c") * F.log("p")) / F.sum("c")).alias("h"))
            model.usual = {r.lang: r.h for r in whole.collect()}
        below = below.select("lang", "gram", "p")
    return model


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = rows.toArrow()
    keys, values = table.column("key").to_numpy(), table.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.int64), values[order].astype(np.float32)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    full = [line for line in lines if line and not line.isspace() or line.strip(" \t\n\v\f\r")]
    return len(full) - len(set(full))


def repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, the words in eight-word windows that the text has twice or more."""
    windows, own = runs(hashes, bounds, WINDOW)
    out = np.zeros(len(bounds) - 1, np.int64)
    if not len(windows):
        return out
    row = np.repeat(np.arange(len(own) - 1), np.diff(own))
    salted = mix(windows + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(salted)
    equal = salted[order[1:]] == salted[order[:-1]]
    again = np.zeros(len(windows), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    where = np.flatnonzero(again)
    first = bounds[row[where]] + where - own[row[where]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return inside[bounds[1:]] - inside[bounds[:-1]]


MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "log_perplexity": "double"}


def _known(langs: pa.Array, model: Model) -> np.ndarray:
    """The model's number of each language."""
    numbers, names = _numbers(langs)
    own = {n: i for i, n in enumerate(model.languages[1:], 1)}  # null languages are "", as the one that number 0 goes by
    return np.array([own.get(n, 0) for n in names] or [0], np.int64)[numbers]


def spelt(texts: pa.Array, langs: pa.Array, model: Model) -> Iterator[tuple[Piece, Distinct, np.ndarray, np.ndarray, np.ndarray]]:
    """For consecutive pieces of a batch, their distinct words, the languages of their texts, and of each word its log probability and symbols."""
    numbers = _known(langs, model)
    for piece in pieces(texts, size=PIECE):
        own = numbers[piece.first : piece.last]
        d = distinct(piece, piece.hashes(), own)
        keys = d.languages[d.of] << 24 | d.grams
        order = np.argsort(keys)
        log = np.empty(len(keys))
        log[order] = model.log_prob(keys[order] >> 24, keys[order] & 0xFFFFFF)
        yield piece, d, own, np.bincount(d.of, log, len(d.counts)), np.bincount(d.of, minlength=len(d.counts))


def measures(texts: pa.Array, langs: pa.Array, model: Model, lexicon: wordpairs.Lexicon) -> Iterator[tuple[list[np.ndarray], wordpairs.Tokens]]:
    """For consecutive pieces of a batch, the columns of MEASURES, the perplexity of the spelling alone, and the symbols; and the words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    for piece, d, numbers, logs, symbols in spelt(texts, langs, model):
        total = piece.last - piece.first
        word_chars = piece.sums((piece.data & 0xC0) != 0x80) - piece.sums((piece.data == 0x20) | ((piece.data >= 9) & (piece.data <= 13)))
        lines = np.array([repeated_lines(t) for t in texts[piece.first : piece.last].to_pylist()], np.int64)
        perplexity, size = np.full(total, np.nan), np.zeros(total)
        if len(d.inverse):
            row = piece.rows()
            with np.errstate(invalid="ignore", divide="ignore"):
                size = np.bincount(row, symbols[d.inverse], total)
                perplexity = -np.bincount(row, logs[d.inverse], total) / size
                # Passages of another language are no junk: where a text is far from its own, each word counts by what it
                # has above or below the usual of the language that knows it best.
                usual = np.array([model.usual.get(n, np.inf) for n in range(len(model.languages))])
                home = usual[numbers]
                far = np.isfinite(home) & (perplexity > FAR * home)
                if far.any():
                    used = np.zeros(len(d.counts), bool)
                    used[d.inverse[far[row]]] = True
                    part = used[d.of]
                    of, grams, best = d.of[part], d.grams[part].astype(np.int64), np.full(len(d.counts), -np.inf)
                    for n, h in model.usual.items():
                        own = np.bincount(of, model.log_prob(np.full(len(of), n), grams), len(d.counts)) + h * symbols
                        best[used] = np.maximum(best, own)[used]
                    excess = -np.bincount(row, np.where(used, best, 0)[d.inverse], total) / size
                    perplexity[far] = (home + excess)[far]
        columns = [piece.counts, word_chars, piece.sums(_IS_SYMBOL[piece.data]), lines, repeated_words(d.keys[d.inverse], piece.bounds), perplexity, size]
        yield columns, wordpairs.Tokens.of(d.keys, d.languages, d.inverse, piece.bounds, numbers, logs, *signs(piece), lexicon)


def measured(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """(doc, lang, and MEASURES): the carried columns of every row, all by default, and its measures."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    language = F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang")
    rows = docs.select(*carried(docs, text, docs.columns if carry is None else carry), language)
    schema = returning(rows, "lang string, " + ", ".join(f"{n} {t}" for n, t in MEASURES.items()) + ", symbols double")

    def of(batches, lexicon):
        for batch in batches:
            first = 0
            for columns, tokens in measures(texts_of(batch, text), batch.column("lang"), sent.value, lexicon):
                part = batch.slice(first, len(columns[0]))
                first += len(columns[0])
                names = ["doc", "lang", *MEASURES, "symbols"]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("lang"), *map(pa.array, columns)], names), tokens

    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(wordpairs.SAMPLE)) == 0)
    counts = wordpairs.frequent(sample.select(F.col(text).alias("text"), language), lambda batch: spelt(batch.column(0), batch.column(1), sent.value))
    found = wordpairs.scored(rows, of, schema, wordpairs.Lexicon.of(saved(counts)), model.symbols)
    whole = F.col("log_perplexity") - F.col("gain") / F.col("symbols")
    return found.select("doc", "lang", *list(MEASURES)[:5], F.when(F.col("symbols") > 0, whole).otherwise(F.col("log_perplexity")).alias("log_perplexity"))


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, middle, spread) of the different log perplexities of measured rows that pass the base rules."""
    different = rows.where(~base_failed()).select("lang", F.round("log_perplexity", 9).alias("h")).distinct()
    quarters = different.groupBy("lang").agg(F.percentile_approx("h", [0.25, 0.5, 0.75], 10000).alias("q"))
    return quarters.select("lang", F.col("q")[1].alias("middle"), (F.col("q")[2] - F.col("q")[0]).alias("spread"))


def in_band(above: float = ABOVE, below: float = BELOW, short: float = SHORT):
    """True for measured rows joined with their language's bands, where the perplexity is neither too high nor too low."""
    away = (F.col("log_perplexity") - F.col("middle")) / F.sqrt(1 + short / F.greatest("n_words", F.lit(1)))
    low, high = -F.greatest(below * F.col("spread"), F.lit(LEAST_BELOW)), F.greatest(above * F.col("spread"), F.lit(LEAST_ABOVE))
    return F.coalesce(away.between(low, high), F.lit(True))


def passing(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that neither fail the base rules nor lie outside their language's bands.

    Rows of equal text and language are judged alike, so verdicts go back to the rows by a hash of the text.
    """
    key = F.xxhash64(F.col(f"`{text}`")), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key[0].alias("hash"), key[1].alias("lang"))
    plain = docs.select(F.col(f"`{text}`").alias("text"), key[0].alias("hash"), key[1].alias("lang"))
    rows = saved(measured(plain, train(plain), carry=["hash"]))
    rows = rows.join(saved(bands(rows)), "lang", "left")
    rejected = saved(rows.where(base_failed() | ~in_band()).select("doc.hash", "lang").distinct())
    return keyed.join(rejected, ["hash", "lang"], "left_anti").select("doc.*")


def op7(spark, sf_dir: str) -> DataFrame:
    """Base rules and perplexity verdict of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = saved(measured(docs, train(docs), carry=["doc_id"]))
    judged = rows.join(saved(bands(rows)), "lang", "left")
    return judged.select(
        "doc.doc_id", *list(MEASURES)[:5], base_failed().alias("base_failed"), (~base_failed() & in_band()).alias("kept"), "log_perplexity"
    )
