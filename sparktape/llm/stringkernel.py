"""Language identification by string kernels: blended-spectrum presence kernels, Nyström features, kernel ridge regression.

The kernel of two texts counts the n-grams of two, three and four bytes that both have, however often, and is scaled so
that a text has kernel one with itself. N-grams run over the lower-cased letters, with one blank for all between them, in
``BUCKETS`` hash buckets. Landmarks, a few training texts of each language, span the Nyström features; a ridge regression of
one language against the rest on these gives each language's weights. A block of texts is scored by two matrix products: with
the landmarks' presence, then with the weights.

At most ``SAMPLE`` labelled texts of each language are learnt from, those with the smallest hash of their id, whatever the
corpus's size. Landmarks are ``LANDMARKS`` of each language, fewer where there would be more than ``ALL_LANDMARKS`` of them,
one at least. Only their presence bits come to the driver; the regression is solved from sums of products of features, which
tasks add up over their texts. So what the driver holds, and sends out, does not grow with texts and hardly with languages.
Scoring reads every text whole, without a shuffle.

Texts that are null or hold no letter are ``und`` with score zero, as is everything if nothing can be learnt. Null languages
and ids are not learnt from; of rows with one id and language, that with the least presence bits is, so that reruns agree.
Languages at equal scores are taken in the order of their names. Repeated rows get the same result. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.llm.words import NOT_ALNUM, carried, pieces, returning, texts_of

BUCKETS = 1 << 14
LENGTHS = (2, 3, 4)
SAMPLE = 300
LANDMARKS, ALL_LANDMARKS = 24, 480
#: Partitions in which the products of features are added up.
PARTS = 8
RIDGE = 1e-2
BLOCK = 128
UNKNOWN = "und"

_BLANK = NOT_ALNUM.copy()
_BLANK[ord("0") : ord("9") + 1] = True
_has_letter = regex.compile(r"\p{L}").search


def presence(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, presence of n-gram buckets) for blocks of consecutive texts."""
    for piece in pieces(pc.utf8_lower(texts.cast(pa.large_string()))):
        blank = _BLANK[piece.data]
        inner = np.zeros(len(blank), bool)
        inner[1:] = blank[1:] & blank[:-1]
        inner[piece.offsets[:-1][piece.offsets[:-1] < len(blank)]] = False
        data = np.where(blank, np.uint32(32), piece.data)[~inner].astype(np.uint32)
        kept = np.concatenate(([0], np.cumsum(~inner)))[piece.offsets]
        total = piece.last - piece.first
        for at in range(0, total, BLOCK):
            rows = min(BLOCK, total - at)
            a, b = kept[at], kept[at + rows]
            found = np.zeros(rows * BUCKETS, bool)
            base = np.repeat(np.arange(rows) * BUCKETS, np.diff(kept[at : at + rows + 1]))
            left = np.repeat(kept[at + 1 : at + rows + 1], np.diff(kept[at : at + rows + 1])) - np.arange(a, b)
            code = data[a:b].copy()
            for n in range(2, max(LENGTHS) + 1):
                code = (code[:-1] << np.uint32(8)) | data[a + n - 1 : b]
                if n in LENGTHS and len(code):
                    spread = code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                    spread ^= spread >> np.uint32(15)
                    bucket = (spread * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 14)
                    inside = left[: len(code)] >= n
                    found[(base[: len(code)] + bucket)[inside]] = True
            yield piece.first + at, found.reshape(rows, BUCKETS)


@dataclass
class Classifier:
    languages: list[str]
    landmarks: np.ndarray  # buckets x landmarks, columns of unit length
    weights: np.ndarray  # landmarks x languages

    def scores(self, found: np.ndarray) -> np.ndarray:
        """A share for each language, from the block's kernel with the landmarks."""
        block = found.astype(np.float32)
        block /= np.maximum(np.sqrt(found.sum(axis=1, keepdims=True)), 1)
        raw = (block @ self.landmarks) @ self.weights
        odds = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
        return odds / odds.sum(axis=1, keepdims=True)


def unit_rows(bits: list[bytes] | np.ndarray) -> np.ndarray:
    """Presence bits, one packed row for each text, as rows of unit length."""
    packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), BUCKETS // 8)
    found = np.unpackbits(packed, axis=1).astype(np.float32)
    return found / np.maximum(np.sqrt(found.sum(axis=1, keepdims=True)), 1)


def whitening(landmarks: np.ndarray) -> np.ndarray:
    """What turns kernels with the landmarks into Nyström features: the inverse root of the landmarks' own kernel."""
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    real = values > 1e-6 * values.max()
    return vectors[:, real] / np.sqrt(values[real])


def products(bits: list[bytes], number: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray, whiten: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over texts of features times features, and of features times aims; every language weighs the same."""
    squares, aimed = np.zeros((whiten.shape[1],) * 2), np.zeros((whiten.shape[1], len(sizes)))
    for at in range(0, len(bits), BLOCK):
        own = number[at : at + BLOCK]
        features = (unit_rows(bits[at : at + BLOCK]) @ landmarks).astype(np.float64) @ whiten
        shared = features / sizes[own][:, None]
        squares += features.T @ shared
        aimed += shared.T @ np.where(own[:, None] == np.arange(len(sizes)), 1.0, -1.0)
    return squares, aimed


def fit(texts: DataFrame) -> Classifier:
    """Kernel ridge regression on Nyström features of saved ``texts``: key, lang, rank (from 1 within a language) and bits."""
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    languages = list(sizes)
    if not languages:
        return Classifier([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    chosen = texts.where(F.col("rank") <= each).orderBy("lang", "rank", "key").toArrow()
    landmarks = np.ascontiguousarray(unit_rows(chosen.column("bits").to_pylist()).T)
    whiten = whitening(landmarks)
    sent = texts.sparkSession.sparkContext.broadcast((languages, np.array(list(sizes.values()), float), landmarks, whiten))

    def add_up(batches):
        names, counts, marks, white = sent.value
        places, total = {n: i for i, n in enumerate(names)}, None
        for batch in batches:
            number = np.array([places[n] for n in batch.column("lang").to_pylist()], np.int64)
            found = products(batch.column("bits").to_pylist(), number, counts, marks, white)
            total = found if total is None else (total[0] + found[0], total[1] + found[1])
        if total is not None:
            yield pa.RecordBatch.from_pydict({"squares": [total[0].tobytes()], "aimed": [total[1].tobytes()]})

    # A fixed dealing, in order: floating-point sums then come out the same in every run.
    dealt = texts.repartition(PARTS, "key").sortWithinPartitions("lang", "rank", "key").select("lang", "bits")
    parts = dealt.mapInArrow(add_up, "squares binary, aimed binary").collect()
    width = whiten.shape[1]
    squares = sum(np.frombuffer(bytes(r["squares"])).reshape(width, width) for r in parts)
    aimed = sum(np.frombuffer(bytes(r["aimed"])).reshape(width, len(languages)) for r in parts)
    sent.unpersist()
    weights = whiten @ np.linalg.solve(squares + RIDGE * np.eye(width), aimed)
    return Classifier(languages, landmarks, weights.astype(np.float32))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier:
    """Fit on the texts of ``docs`` with a language, up to SAMPLE of each."""
    named = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    ids = named.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(key).alias("hash"))
    sizes = saved(ids.groupBy("lang").agg(F.count("*").alias("n")))
    # About four times SAMPLE ids of each language pass by their hash; of these the smallest are ranked.
    share = F.least(F.lit(1.0), F.lit(4.0 * SAMPLE) / F.col("n"))
    some = ids.join(sizes, "lang").where(F.pmod("hash", F.lit(1 << 30)) < share * (1 << 30)).select("key", "lang", "hash").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "key"))
    chosen = saved(some.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).drop("hash"))
    rows = named.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(chosen, ["key", "lang"])

    def bits(batches):
        for batch in batches:
            parts = [np.packbits(found, axis=1) for _, found in presence(batch.column("text"))]
            packed = [row.tobytes() for part in parts for row in part]
            columns = [batch.column("key").cast(pa.string()), batch.column("lang"), batch.column("rank"), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang", "rank", "bits"])

    made = rows.mapInArrow(bits, "key string, lang string, rank int, bits binary")
    return fit(saved(made.groupBy("key", "lang", "rank").agg(F.min("bits").alias("bits"))))


def identified(docs: DataFrame, classifier: Classifier, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc, lang_pred, score): the carried columns of every row, all by default, and its language."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    rows = docs.select(*carried(docs, text, docs.columns if carry is None else carry))

    def of(batches):
        own = sent.value
        for batch in batches:
            texts = texts_of(batch, text)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if own.languages:
                for first, found in presence(texts):
                    shares = own.scores(found)
                    names[first : first + len(found)] = np.array(own.languages, object)[shares.argmax(axis=1)]
                    scores[first : first + len(found)] = shares.max(axis=1)
            bare = np.array([t is None or not _has_letter(t) for t in texts.to_pylist()], bool)
            names[bare], scores[bare] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(names, pa.string()), pa.array(scores)], ["doc", "lang_pred", "score"])

    return rows.mapInArrow(of, returning(rows, "lang_pred string, score double"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; rows with crc32 mod 4 = 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    classifier = learn(docs.where(~out))
    rows = identified(docs, classifier, carry=["doc_id"])
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", out)
