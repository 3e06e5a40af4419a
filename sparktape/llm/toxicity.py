"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers read a clause's words by class and pass a weight on. The insult transducer gives an insult its weight where
it is the head of what is said to a person or of one ("you idiot", "she is an idiot"), or ends a clause that is nothing else;
before another content word it only modifies that ("a trash collector") and has a part of it (``BARE``), as everywhere else.
Insults that are ordinary words too (``PLAIN_WORDS``) need a person and a copula, and have a lesser part elsewhere. The threat
transducer gives a verb of harm its weight only with a word of intent before it and a person as its object, after it or before
it; the target transducer raises that next to an addressed person, the negation transducer lowers what follows a negation
closely, the reported-speech transducer lowers what somebody else is said to have said. They are composed once into one machine
over their joint states, which is run over each clause. A clause whose heaviest path alone is enough evidence counts once, with
that path. What is weaker, bare words above all, is summed over different words - the same one again adds nothing - and counts
in full only where it makes up ``DENSE`` of the text's words: few weak words in a long text are no evidence. A text's score is a
logistic function of the sum.

The insult lexicon has a fixed part and one learnt in any language: of at most ``SAMPLE`` labelled texts, those with the
smallest hash of their id, words and stems (first ``STEM`` characters or more) whose texts are toxic far more often than
chance allows; its size is bounded by ``LEXICON``. Words are looked up by hashes of their heads with array operations, whole texts,
one Arrow batch at a time, without a shuffle of texts.

Null and empty texts have no clause and the score of no evidence. Null labels are not learnt from; of repeated ids one row is.
Without labels the fixed lexicon remains. Repeated rows get the same score. Other columns are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.llm.words import NOT_ALNUM, carried, pieces, returning, sampled, texts_of

SAMPLE = 20_000
LEXICON = 20_000
#: Least hashes of words that texts of one family share.
FAMILY = 3
STEM, LONGEST_STEM = 4, 8
#: Least log-likelihood ratio of a learnt entry against the share of toxic texts, above the logarithm of the candidates.
EVIDENCE = 0.0
MOST_WEIGHT = 7.0
LEAST_WEIGHT = 3.5
BIAS = 4.5
CUT = 0.5

INSULTS = "idiot idiots stupid moron morons loser losers pathetic scum worthless trash disgusting imbecile dumb".split()
HARM = "kill hurt destroy murder strangle stab beat shoot burn töten umbringen tuer frapper matar golpear".split()
INTENT = "will gonna shall should must werde werden vais va voy vamos".split()
NEGATIONS = "not never isn wasn aren don doesn nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says wrote claimed called quoted reportedly sagte sagt schrieb dit écrit dijo dice escribió".split()
COPULAS = "is are was were am be re s m ist bist seid sind war waren bin est es êtes sont était étais étaient suis son eres era eran soy fue".split()
#: Articles and what may stand with them before an insult.
ARTICLES = (
    "a an what such so very really totally just total complete utter real absolute your ein eine einen so was echt"
    " un une des quel quelle vraiment si una unos unas qué tan muy"
).split()
FIXED_WEIGHT = 6.0
#: Of an insult's weight, what a word that is aimed at nobody gets; under BIAS for any weight.
BARE, PLAIN_BARE = 0.6, 0.25
#: Share of a text's words from which weak evidence counts in full.
DENSE = 0.01

# Words by what the transducers make of them.
PLAIN_WORDS = "trash dumb disgusting".split()
DEFINITE = "the der die das dem den le la les el los las".split()
YOU = "you du ihr tu toi vous tú usted vos ustedes".split()
THIRD = "he she they we er sie wir il elle ils elles nous él ella ellos ellas".split()
OBJECTS = "yourself yourselves him dich dir euch ihn te lui os".split()
#: "We will beat them" may be said of eggs: such an object has a part of the weight.
LOOSE_OBJECTS = "them ihnen leur".split()
#: A possessive as well; an object only where it ends the clause.
HER = "her".split()
ATTACHED = [verb + object_ for verb in ("matar", "golpear") for object_ in ("te", "os", "lo", "la", "los", "las", "le", "les")]
#: Words that no insult modifies: an insult before them is a head.
FUNCTION = (
    "and or but nor so because if when while who that than then too also now here there again today really for to in on at of from with without by like as always ever"
    " und oder aber denn weil wenn dass als auch nun hier wieder heute für zu in auf an von mit ohne wie immer"
    " et ou mais car quand qui que aussi ici encore pour à dans sur de avec sans comme toujours"
    " y o pero porque cuando que también aquí ahora para en sobre con sin como siempre"
).split()

# Classes of words, as the transducers read them. An insult modifies (INSULT), is a head (HEAD), or ends its clause (CLOSING).
(OTHER, INSULT, HEAD, CLOSING, PLAIN, PLAIN_HEAD, THREAT_VERB, ATTACHED_VERB, INTENT_WORD, ADDRESSED, PERSON, OBJECT, LOOSE_OBJECT, NEGATION, REPORT, ARTICLE,
 THE, COPULA, LINK) = range(19)
KINDS = 19
_CLASS = {}
for _kind, _list in (
    (LINK, FUNCTION), (ARTICLE, ARTICLES), (THE, DEFINITE), (COPULA, COPULAS), (INTENT_WORD, INTENT), (PERSON, THIRD), (ADDRESSED, YOU), (OBJECT, OBJECTS),
    (LOOSE_OBJECT, LOOSE_OBJECTS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT_VERB, HARM), (ATTACHED_VERB, ATTACHED),
):
    _CLASS.update(dict.fromkeys(_list, _kind))

_CLAUSE = regex.compile(r"[.!?;:\n]+")
_WORD = regex.compile(r"[a-z0-9\u0080-\U0010ffff]+")


@dataclass
class Transducer:
    """Deterministic: from (state, class) to (next state, factor, added). What is not listed goes to state 0, unchanged."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float, float]]

    def arc(self, state: int, kind: int) -> tuple[int, float, float]:
        return self.arcs.get((state, kind), (0, 1.0, 0.0))


def near(opening: int, effects: dict[int, tuple[float, float]], reach: int, sticky: bool = False) -> Transducer:
    """After a word of class ``opening``, for ``reach`` words (or, sticky, to the clause's end), words of other classes are changed."""
    arcs = {}
    for state in range(reach + 1):
        after = state if sticky else max(0, state - 1)
        for kind in range(KINDS):
            factor, added = effects.get(kind, (1.0, 0.0)) if state else (1.0, 0.0)
            arcs[state, kind] = (reach if kind == opening else after, factor, added)
    return Transducer(reach + 1, arcs)


#: What the weight of an insult or a threat is passed on with.
WEIGHED = (INSULT, HEAD, CLOSING, PLAIN, PLAIN_HEAD, THREAT_VERB, ATTACHED_VERB, ADDRESSED, OBJECT, LOOSE_OBJECT)
THREAT = 5.5


def threatening() -> Transducer:
    """Intent, verb of harm and a person as its object: "will kill you", "werde dich töten", "te voy a matar", "voy a matarte".

    States: nothing, an object waiting for its intent (3 words), intent waiting for a verb (4), intent and object waiting for a
    verb (4), intent and verb waiting for an object (2). The weight is passed on with the word that completes the threat.
    """
    early, intent, held, struck = range(1, 4), range(4, 8), range(8, 12), range(12, 14)
    arcs = {}
    for state in range(14):
        span = next((r for r in (early, intent, held, struck) if state in r), None)
        later = 0 if span is None or state == span[0] else state - 1
        for kind in range(KINDS):
            to, added = later, 0.0
            if kind == INTENT_WORD:
                to = held[-1] if span is early else intent[-1]
            elif span is struck and kind in (OBJECT, ADDRESSED, LOOSE_OBJECT):
                to, added = 0, THREAT if kind != LOOSE_OBJECT else 0.7 * THREAT
            elif kind == OBJECT and span in (None, intent):
                to = held[-1] if span is intent else early[-1]
            elif kind == THREAT_VERB and span is intent:
                to = struck[-1]
            elif kind == THREAT_VERB and span is held or kind == ATTACHED_VERB and span in (intent, held):
                to, added = 0, THREAT
            arcs[state, kind] = (to, 1.0, added)
    return Transducer(14, arcs)


THREATS = threatening()
AIMED = near(ADDRESSED, {THREAT_VERB: (1.15, 0.0), OBJECT: (1.15, 0.0), LOOSE_OBJECT: (1.15, 0.0)}, 4)
DENIED = near(NEGATION, dict.fromkeys(WEIGHED, (0.2, 0.0)), 3)
REPORTED = near(REPORT, dict.fromkeys(WEIGHED, (0.3, 0.0)), 1, sticky=True)


def insulting() -> Transducer:
    """Accepts insults to a person ("you idiot", "she is so dumb"), of a named one ("anna is an idiot"), and whole clauses ("what an idiot")."""
    nothing, opening, addressed, person, said_of, copula, named, described = range(8)
    arcs = {}
    for state in range(8):
        arcs[state, INSULT] = (state, BARE, 0.0)
        arcs[state, PLAIN] = (state, PLAIN_BARE, 0.0)
        head = 1.15 if state in (addressed, said_of) else 1.0 if state == named else BARE
        arcs[state, HEAD] = (state, head, 0.0)
        arcs[state, CLOSING] = (state, 1.0 if state in (opening, described) else head, 0.0)
        arcs[state, PLAIN_HEAD] = (state, 1.15 if state == said_of else PLAIN_BARE, 0.0)
        arcs[state, ADDRESSED] = (addressed, 1.0, 0.0)
        arcs[state, PERSON] = arcs[state, OBJECT] = arcs[state, LOOSE_OBJECT] = (person, 1.0, 0.0)
        arcs[state, COPULA] = (said_of if state in (addressed, person, said_of) else copula, 1.0, 0.0)
        arcs[state, ARTICLE] = ({copula: named, described: nothing}.get(state, state), 1.0, 0.0)
        arcs[state, THE] = (state if state in (opening, addressed, said_of) else nothing, 1.0, 0.0)
        arcs[state, NEGATION] = (said_of if state in (addressed, person) else state, 1.0, 0.0)
    arcs[named, OTHER] = (described, 1.0, 0.0)
    return Transducer(8, arcs)


INSULTING = insulting()


def compose(parts: list[Transducer], start: tuple[int, ...]) -> dict[tuple[int, ...], list[tuple[tuple[int, ...], float, float]]]:
    """One machine over the joint states reached from ``start``: a word's weight gets what all parts add, times all their factors."""
    table, open_ = {}, [start]
    while open_:
        joint = open_.pop()
        if joint in table:
            continue
        row = []
        for kind in range(KINDS):
            steps = [p.arc(state, kind) for p, state in zip(parts, joint)]
            row.append((tuple(s[0] for s in steps), math.prod(s[1] for s in steps), sum(s[2] for s in steps)))
        table[joint] = row
        open_ += [step[0] for step in row]
    return table


PARTS = [INSULTING, THREATS, AIMED, DENIED, REPORTED]
START = (1, 0, 0, 0, 0)  # a clause opens
GRAMMAR = compose(PARTS, START)


@dataclass
class Lexicon:
    """Weights of whole words, and of stems; hashes of both by their length in bytes, for looking up."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        own = self.words.get(word, 0.0)
        for n in range(STEM, min(LONGEST_STEM, len(word)) + 1):
            own = max(own, self.stems.get(word[:n], 0.0))
        return own

    def heads(self) -> dict[int, np.ndarray]:
        """By length in bytes, sorted hashes of all stems, words and verbs of harm: each is the head of itself."""
        by_size: dict[int, list[str]] = {}
        for entry in {*self.words, *self.stems, *HARM, *ATTACHED}:
            by_size.setdefault(len(entry.encode()), []).append(entry)
        found = {}
        for size, entries in by_size.items():
            found[size] = np.unique(np.concatenate([p.hashes() for p in pieces(pa.array(entries, pa.string()), NOT_ALNUM)]))
        return found


def kinds(words: list[str], lexicon: Lexicon) -> list[tuple[int, float]]:
    """Class and insult weight of each word of a clause."""
    own = [0.0 if word in _CLASS else lexicon.weight(word) for word in words]
    found = []
    for place, word in enumerate(words):
        kind, ends = _CLASS.get(word, OTHER), place + 1 == len(words)
        if own[place]:
            head = ends or words[place + 1] in _CLASS
            kind = (PLAIN_HEAD if head else PLAIN) if word in PLAIN_WORDS else CLOSING if ends else HEAD if head else INSULT
        elif word in HER:
            kind = OBJECT if ends else PERSON
        found.append((kind, own[place]))
    return found


def clause_weights(words: list[str], lexicon: Lexicon) -> list[tuple[float, str]]:
    """The weights above zero that the composed grammar gives to words of the clause, with these words."""
    state, weights = START, []
    for word, (kind, own) in zip(words, kinds(words, lexicon)):
        state, factor, added = GRAMMAR[state][kind]
        if own + added:
            weights.append((factor * (own + added), word))
    return weights


def evidence(text: str, lexicon: Lexicon) -> float:
    """Of a lower-cased text: the sum of its sure clauses' heaviest weights, and of its different weak words as far as they are dense."""
    sure, weak, hits, total = 0.0, {}, 0, 0
    for clause in _CLAUSE.split(text):
        words = _WORD.findall(clause)
        total += len(words)
        weights = clause_weights(words, lexicon)
        heaviest = max((w for w, _ in weights), default=0.0)
        if heaviest >= BIAS:
            sure += heaviest
        else:
            for weight, word in weights:
                weak[word] = max(weak.get(word, 0.0), weight)
            hits += len(weights)
    return sure + (sum(weak.values()) * min(1.0, hits / (DENSE * total)) if hits else 0.0)


def score(total: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(total, float) - BIAS, -40, 40)))


def _heads(words, n: int):
    """First ``n`` characters of the words that have as many; a second argument of the lambdas would be the index."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Lexicon:
    """The fixed lexicon and what labelled texts add to it."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    chosen = sampled(saved(chosen), "key", SAMPLE)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9\u0080-\x{10ffff}]+)"), F.lit(1)))
    bags = rows.select("key", "label", words.alias("words")).dropDuplicates(["key"])
    # Copies of a text count once: their words would look toxic, or clean, together. Near copies share their least hashes.
    family = F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, FAMILY)
    bags = saved(bags.withColumn("family", family).dropDuplicates(["label", "family"]))
    sizes = {r.label: r.n for r in bags.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, total = sizes.get(1, 0), sum(sizes.values())
    words, stems = dict.fromkeys(INSULTS, FIXED_WEIGHT), {}
    if toxic and toxic < total:
        long = F.filter("words", lambda w: F.length(w) >= STEM)
        heads = [_heads(long, n) for n in range(STEM, LONGEST_STEM + 1)]
        parts = F.array_union(F.transform(F.array_distinct(F.concat(*heads)), lambda w: F.concat(F.lit("<"), w)), F.transform(long, lambda w: F.concat(F.lit("="), w)))
        counts = bags.select("label", F.explode(parts).alias("part")).groupBy("part").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
        share = toxic / total
        bad, n = F.col("bad").cast("double"), F.col("n").cast("double")
        rest = F.when(n > bad, (n - bad) * F.log((n - bad) / (n * (1 - share)))).otherwise(0.0)
        weight = F.log((bad + 1) / (toxic + 2.0)) - F.log((n - bad + 1) / (total - toxic + 2.0))
        counts = saved(counts.where(bad > 0))
        least = EVIDENCE + math.log(max(1, counts.count()))  # the more candidates, the more of them look toxic by chance
        found = counts.where(bad > n * share).withColumns({"sure": bad * F.log(bad / (n * share)) + rest, "weight": weight})
        found = found.where((F.col("sure") >= least) & (F.col("weight") >= LEAST_WEIGHT))
        for row in found.orderBy(F.desc("sure"), "part").limit(LEXICON).collect():
            entry, own = row.part[1:], min(MOST_WEIGHT, row.weight)
            if entry not in _CLASS:
                into = words if row.part[0] == "=" else stems
                into[entry] = max(into.get(entry, 0.0), own)
    return Lexicon(words, stems)


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc, evidence, score): the carried columns of every row, all by default."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, lexicon.heads()))
    rows = docs.select(*carried(docs, text, docs.columns if carry is None else carry))

    def of(batches):
        own, heads = sent.value
        seen = {size: np.zeros(1 << 16, bool) for size in heads}
        for size, hashes in heads.items():
            seen[size][(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            lower = pc.utf8_lower(texts_of(batch, text).cast(pa.large_string()))
            totals = np.zeros(batch.num_rows)
            for piece in pieces(lower, NOT_ALNUM):
                hit = np.zeros(len(piece.starts), bool)
                for size, hashes in heads.items():
                    at, found = piece.heads(size)
                    some = np.flatnonzero(seen[size][(found & np.uint64(0xFFFF)).astype(np.int64)])
                    hit[at[some[np.isin(found[some], hashes)]]] = True
                for row in np.unique(np.searchsorted(piece.bounds, np.flatnonzero(hit), "right") - 1).tolist():
                    totals[piece.first + row] = evidence(lower[piece.first + row].as_py(), own)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(totals), pa.array(score(totals))], ["doc", "evidence", "score"])

    return rows.mapInArrow(of, returning(rows, "evidence double, score double"))


def op8(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels of rows with crc32 mod 5 = 0 are held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    rows = scored(docs, learn(docs, labels.where(~out)), carry=["doc_id"])
    rows = rows.select(F.col("doc.doc_id").alias("doc_id"), "score")
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
