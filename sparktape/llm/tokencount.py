"""Token counts of whole texts by a map-side lookup in two tiers, without any shuffle of pre-tokens.

A byte-level vocabulary splits a text into pre-tokens and encodes each by itself, so a text's count is the sum of its
pre-tokens' counts. Tier one is a broadcast table of the corpus's most frequent pre-tokens with their counts, of fixed
size. To fill it, every task counts the words of all its texts with array operations and hands in only its most frequent
ones, so what Spark adds up is a summary of fixed size for each task. Tier two is a cache in each worker process, which lasts from task to task: what the table
lacks is encoded by the tokenizer itself and remembered, up to a bound, after which the cache starts anew. Neither tier
changes a count.

The strings of special tokens are cut out first and count as one, as the library does. Characters outside well-known
blocks, whose classes could differ between Unicode versions, are left to the library with what stands around them: a text is
cut before single spaces between ASCII characters, where a pre-token begins in any version, and only the stretches with such
characters are encoded by it, through the cache. Vocabularies of other kinds are encoded whole by the library. Null texts are empty and have no tokens; repeated rows are counted one by one. Other columns are kept.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.llm.words import carried, pieces, returning, texts_of

TABLE = 1 << 16
#: What each task hands in for the table, and how many words it counts at once: rarer ones are dropped beyond that.
LOCAL, COUNTED = 1 << 14, 1 << 18
CACHE = 400_000
LONGEST = 64
LIMIT = 1024

# How a byte-level vocabulary of this family cuts text; part of the format, a fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose classes every Unicode version in use agrees on.
UNCOMMON = r"[^\t\n\r\x20-\x7e\u00a0-ɏΑ-ΡΣ-ωЀ-ѿא-תء-غف-يก-ะ‐-‧€ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001faff]"

#: Where a pre-token begins whatever the classes of other characters: at a space between a visible ASCII character and a letter.
BORDER = r"(?V1)(?<=[!-~])(?= [A-Za-z])"

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _tokenizer(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


def splits_by_pattern(model: str) -> bool:
    """True if pre-tokens of this vocabulary are those of PRE_TOKEN and nothing else changes the text."""
    parts = json.loads(model)
    cut = parts.get("pre_tokenizer") or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in parts["added_tokens"])
    whole = parts.get("normalizer") is None and not parts["model"].get("dropout")
    return plain and whole and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and bool(cut.get("use_regex", True))


class _Lengths(dict):
    """Counts by pre-token: the table's entries, and those found since."""

    def __init__(self, table: dict[str, int], tokenizer):
        super().__init__(table)
        self.table, self.tokenizer = table, tokenizer

    def __missing__(self, token: str) -> int:
        n = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
        if len(token) <= LONGEST:
            if len(self) > CACHE + len(self.table):
                self.clear()
                self.update(self.table)
            self[token] = n
        return n


def counter(model: str, table: dict[str, int]) -> Callable[[list[str]], list[int]]:
    """Token counts of a list of texts, by the vocabulary in the JSON text ``model``."""
    tokenizer = _tokenizer(model)

    def whole(texts: list[str]) -> list[int]:
        return [len(e.ids) for at in range(0, len(texts), 64) for e in tokenizer.encode_batch(texts[at : at + 64], add_special_tokens=False)]

    if not splits_by_pattern(model):
        return whole
    special = [t["content"] for t in json.loads(model)["added_tokens"]]
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    find, odd, length = regex.compile(PRE_TOKEN).findall, regex.compile(UNCOMMON).search, _Lengths(table, tokenizer).__getitem__
    stretches = regex.compile(BORDER).split

    def plain(part: str) -> int:
        return sum(map(length, find(part)))

    def mixed(part: str) -> int:
        total, usual = 0, []
        for stretch in stretches(part):
            if odd(stretch):
                total += plain("".join(usual)) + length(stretch)
                usual = []
            else:
                usual.append(stretch)
        return total + plain("".join(usual))

    def count(text: str) -> int:
        parts = cut.split(text) if cut and "<" in text else [text]
        return len(parts) - 1 + sum(map(mixed if odd(text) else plain, parts))

    if cut and not all("<" in s for s in special):
        return whole
    return lambda texts: [count(t) for t in texts]


_kept: dict[str, Callable[[list[str]], list[int]]] = {}  # of this process: the counter of the last run, with its cache


def kept_counter(run: str, model: str, table: dict[str, int]) -> Callable[[list[str]], list[int]]:
    """The run's counter: tasks of one worker process share it."""
    if run not in _kept:
        _kept.clear()
        _kept[run] = counter(model, table)
    return _kept[run]


def frequent(docs: DataFrame, text: str) -> list[str]:
    """The most frequent words after a space, with the space, over all texts."""

    def words(batches):
        keys, sums, samples = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, object)
        for batch in batches:
            for piece in pieces(batch.column(0), _NOT_LETTER):
                spaced = (piece.starts > 0) & (piece.data[np.maximum(piece.starts - 1, 0)] == 0x20) & (piece.ends - piece.starts < LONGEST)
                own, first, count = np.unique(piece.hashes()[spaced], return_index=True, return_counts=True)
                many = count > 1
                own, count, at = own[many], count[many], np.flatnonzero(spaced)[first[many]]
                new = np.array([piece.data[a:b].tobytes() for a, b in zip(piece.starts[at], piece.ends[at])], object)
                keys, place, inverse = np.unique(np.concatenate((keys, own)), return_index=True, return_inverse=True)
                sums = np.bincount(inverse, np.concatenate((sums, count)), len(keys)).astype(np.int64)
                samples = np.concatenate((samples, new))[place]
                if len(keys) > COUNTED:
                    keep = np.sort(np.argsort(-sums)[: COUNTED // 2])
                    keys, sums, samples = keys[keep], sums[keep], samples[keep]
        keep = np.argsort(-sums)[:LOCAL]
        yield pa.RecordBatch.from_arrays([pa.array([" " + s.decode() for s in samples[keep]], pa.string()), pa.array(sums[keep])], ["token", "n"])

    found = saved(docs.select(text).mapInArrow(words, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = found.count()
    if total > TABLE:  # else every partition would hand TABLE rows to the driver
        least = found.agg(F.percentile_approx("n", 1 - TABLE / total, 10_000)).first()[0]
        found = found.where(F.col("n") >= least)
    return [r.token for r in found.orderBy(F.desc("n"), "token").limit(TABLE).collect()]


def token_counts(docs: DataFrame, model_path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc, n_bytes, n_tokens): the carried columns of every row, all by default, and its counts.

    ``model_path`` is a vocabulary for tokenizers (.json) or sentencepiece (.model); the driver reads it and sends it on.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = file.read()
    if model_path.endswith(".json"):
        table: dict[str, int] = {}
        if splits_by_pattern(model.decode()):
            tokens = [t for t in frequent(docs, text) if regex.fullmatch(PRE_TOKEN, t)]
            lengths = _tokenizer(model.decode()).encode_batch(tokens, add_special_tokens=False)
            table = {t: len(e.ids) for t, e in zip(tokens, lengths)}
    else:
        table = {}
    sent, kind, run = spark.sparkContext.broadcast((model, table)), model_path.rsplit(".", 1)[1], uuid.uuid4().hex
    rows = docs.select(*carried(docs, text, docs.columns if carry is None else carry))

    def of(batches):
        model, table = sent.value
        if kind == "json":
            count = kept_counter(run, model.decode(), table)
        else:
            from sentencepiece import SentencePieceProcessor

            pieces_of = SentencePieceProcessor(model_proto=model)
            count = lambda texts: [len(p) for p in pieces_of.encode(texts, num_threads=1)]
        for batch in batches:
            texts = texts_of(batch, text).fill_null("")
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), sizes, pa.array(count(texts.to_pylist()), pa.int64())], ["doc", "n_bytes", "n_tokens"])

    return rows.mapInArrow(of, returning(rows, "n_bytes long, n_tokens long"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Tokens of all documents in the 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
    return rows.select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
