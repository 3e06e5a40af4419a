"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

1. A page is cut into leaf blocks (``dom.blocks``). A block's features are the tags and the class, id and role tokens of all
   its ancestors, those of its own element, its nearest section, and measures of its text: words, share of links, sentence
   marks, digits, signs, words of short blocks, place before or after the first heading.
2. The field labels the blocks of a page as main text or not. Besides the features, it weighs each label after each
   label, apart for blocks within one element and blocks across elements. It is trained by maximum likelihood (forward
   and backward sums over whole pages, all pages at once) and decoded by Viterbi.
3. Labelled pages: any pages whose elements carry ``data-main="1"`` or ``"0"``, nearest ancestor first. By default they are
   made from at most ``SAMPLE`` pages of the table, with the smallest hashes of their ids and at most ``LONGEST``
   characters, and one of plain words: each as it is, if it has an ``article`` or ``main`` element, and ``DRESSED`` times in
   all with its main blocks in other layouts, among menus, headers, notices, adverts, sidebars, forms, comments and
   footers. Only learning uses samples; every page is extracted, whole.
4. Pages are read and decoded in tasks, one after the other, without a shuffle; features and labels of the sample come to
   the driver, the learnt weights go out.

Null and empty pages, and pages without main text, give an empty text. White space is Unicode's. Rows are not merged:
repeated rows and null ids each give their own row. An empty table gives no rows; other columns are not looked at. Labels at
equal scores go to main text.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.llm.dom import Block, Path, blocks
from sparktape.llm.words import sampled

#: Bounds of the sample that is learnt from.
SAMPLE, LONGEST, DRESSED = 240, 40_000, 1200
#: Features in fewer pages than this are not learnt. Steps of training; strength of the weights' penalty, and of that of single words.
LEAST_PAGES, STEPS, PENALTY, WORD_PENALTY = 6, 120, 0.5, 8.0
#: Paths that a task keeps before it starts afresh.
PATHS = 50_000

_END = re.compile(r"[.!?…。！？](?:[\"'»”’)\]]*)(?=\s|$)")
_DIGIT = re.compile(r"\d")
_SIGNS = {"©": "copyright", "@": "at", "#": "hash"}
#: Signs that part the entries of a menu; among unlinked words they tell nothing.
_PARTING = {"|": "bar", "·": "dot", "•": "dot", "»": "guillemet", "›": "guillemet"}
#: Elements that hold no main text even within an article, for pages that label themselves.
ASIDE = frozenset("a:nav a:aside a:footer a:form a:header a:dialog a:menu a:button".split())


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def text_features(block: Block) -> list[str]:
    """Features of a block's own text."""
    text = block.text
    words = text.split(" ")
    share, marks = block.linked / max(block.size, 1), len(_END.findall(text))
    digits = len(_DIGIT.findall(text)) / len(text)
    out = [f"t:words{_bin(len(words), 3, 6, 11, 21, 41, 81)}", f"t:links{_bin(share, 0.01, 0.2, 0.5, 0.8)}", f"t:marks{_bin(marks, 1, 2, 4)}", f"t:digits{_bin(digits, 0.01, 0.1, 0.3)}"]
    if marks and text[-1] in ".!?…。！？\"'»”’)":
        out.append("t:ends")
    out.append("t:upper" if text[0].isupper() else "t:lower" if text[0].islower() else "t:sign")
    signs = _SIGNS | _PARTING if block.linked else _SIGNS
    out += {f"t:{signs[c]}" for c in signs if c in text}
    if "," in text:
        out.append("t:comma")
    if len(words) <= 8:
        out += {f"w:{w.strip('.,:;!?').lower()}" for w in words}
    return out


def page_features(found: list[Block]) -> list[list[str]]:
    """Features of every block of a page besides its path's keys."""
    first = next((i for i, b in enumerate(found) if b.path.own and b.path.own[0] == "l:h1"), -1)
    out = []
    for i, block in enumerate(found):
        place = "p:none" if first < 0 else "p:heading" if i == first else "p:before" if i < first else "p:after"
        out.append([*text_features(block), *block.path.own, f"s:{block.path.section}", place, *(["p:first"] if i == 0 else []), *(["p:last"] if i == len(found) - 1 else [])])
    return out


def together(found: list[Block]) -> list[int]:
    """1 where a block's nearest ancestors outside its own element are those of the block before, else 0."""
    keys = [b.path.keys for b in found]
    return [0, *(int(a is b or a == b) for a, b in zip(keys, keys[1:]))] if found else []


# --- labelled pages -------------------------------------------------------------------------------------------------

# Names that pages give to their parts. The layouts are made from them by rule.
MAIN = [
    "article", "main", 'div class="post-content"', 'div id="content"', 'section class="entry"', 'div class="story-body"', 'div class="article-text"', "div",
    'div role="main"', 'div itemprop="articleBody"', 'div class="page"', 'td class="text"', 'div class="post"', 'article class="post hentry"', "section",
]
OUTSIDE = {
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header top"', 'div id="banner"'],
    "menu": ["nav", 'div class="menu"', 'ul class="nav navbar"', 'div id="navigation"', 'div class="breadcrumbs"', 'div role="navigation"', "menu"],
    "notice": ['div class="cookie-notice"', 'div id="cookies"', 'div class="alert notice"', 'div role="dialog"', 'aside class="consent"', 'div class="message popup"', 'div role="alert"'],
    "advert": ['div class="ad"', 'div class="advert"', 'aside class="promo"', 'div class="sponsored"', 'div id="ads"', 'div class="advertisement"'],
    "sidebar": ["aside", 'div class="sidebar"', 'div class="widget"', 'div id="side"', 'div class="related"', 'section class="recommended"', 'div role="complementary"'],
    "form": ["form", 'form class="search"', 'form id="newsletter"', 'div class="newsletter subscribe"', 'form class="login"'],
    "comments": ['section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="comment reply"', 'div id="disqus"', 'section id="discussion"', 'div class="responses"'],
    "share": ['div class="share"', 'ul class="social"', 'div class="tags"', 'div class="author-meta byline"', 'div class="pagination"'],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer copyright"', 'div role="contentinfo"', 'div class="legal"'],
}
SAID = {
    "notice": ["We use cookies.", "Accept all", "Sign up now", "This site uses cookies to improve your experience.", "Please enable notifications."],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Special offer"],
    "sidebar": ["Related articles", "Most read", "Popular", "See also", "Latest news"],
    "form": ["Email", "Subscribe", "Search", "Name", "Password", "Send", "Log in"],
    "comments": ["Comments", "Reply", "Leave a comment", "3 comments", "Posted by", "Report"],
    "share": ["Share", "Tweet", "Tags:", "Print", "Next page"],
    "header": ["Welcome", "Daily news"],
    "menu": ["Home", "About", "Contact", "Archive"],
    "footer": ["© 2020 All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Contact"],
}
FILLER = "of the and to in is that it was for on are with as his they at be this from".split()


def _element(name: str, inside: str, mark: str = "", close: bool = True) -> str:
    tag = name.split(" ")[0]
    return f"<{name}{mark and f' data-main={mark}'}>{inside}" + (f"</{tag}>" if close else "")


def dressed(texts: list[tuple[str, str]], rng: random.Random) -> str:
    """A page in a layout drawn from the lists above, around main blocks (tag, text); every block is labelled."""
    words = [w for _, t in texts for w in t.split()[:400]] or FILLER
    sentence = lambda low, high: html_text(" ".join(rng.choices(words, k=rng.randint(low, high))).capitalize().rstrip(".,;") + ".")
    link = lambda n: f'<a href="/{rng.randint(1, 99)}">{html_text(" ".join(rng.choices(words, k=n)))}</a>'

    def part(kind: str) -> str:
        name, inner = rng.choice(OUTSIDE[kind]), []
        if rng.random() < 0.6:
            inner.append(_element(rng.choice(["p", "h3", "div", "span", "h2"]), html_text(rng.choice(SAID[kind]))))
        if kind == "header" and rng.random() < 0.4:
            inner.append(_element(rng.choice(["h1", "h2", "p"]), rng.choice(["{}", '<a href="/">{}</a>']).format(html_text(" ".join(rng.choices(words, k=rng.randint(1, 4))).title()))))
        if kind in ("menu", "sidebar", "share", "footer", "header"):
            items = [link(rng.randint(1, 6)) for _ in range(rng.randint(1, 7))]
            inner.append(rng.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: "<p>" + " | ".join(items) + "</p>", lambda: "".join(f"<div>{i}</div>" for i in items)])())
        if kind == "footer":
            inner.append(rng.choice(["&copy; ", "© 2021 ", ""]) + f"example.com &middot; {sentence(2, 14)}")
        if kind == "form":
            inner.append(f'<label>{html_text(rng.choice(SAID[kind]))}</label> <input name="q"><button>{html_text(rng.choice(SAID[kind]))}</button>{sentence(3, 10)}')
        if kind == "comments":
            inner += [_element(rng.choice(["p", "li", "div"]), f"{rng.choice(words).capitalize()}: {sentence(3, 50)}") for _ in range(rng.randint(1, 5))]
        if kind in ("notice", "advert", "sidebar", "header") and rng.random() < 0.8:
            inner += [rng.choice(["{}", "<p>{}</p>", "<p>{}</p>"]).format(sentence(3, 40)) for _ in range(rng.randint(1, 2))]
        return _element(name, "".join(inner), "0")

    if len(texts) > 12:
        at = rng.randint(0, len(texts) - 12)
        texts = [*texts[:1], *texts[at + 1 : at + 12]]
    shown = [(tag, text) for tag, text in texts if rng.random() < 0.95]
    if rng.random() < 0.7:
        shown.insert(0, (rng.choice(["h1", "h1", "h2"]), " ".join(rng.choices(words, k=rng.randint(2, 12)))))
    body, headed = [], {"h1", "h2", "h3"}
    for tag, text in shown:
        if tag not in headed:
            if rng.random() < 0.3:
                text = " ".join(text.split()[: rng.randint(3, 14)]).rstrip(".,;") + rng.choice([".", ".", ""])
            if rng.random() < 0.35:
                tag = rng.choice(["li", "li", "blockquote", "div", "pre", "h2", "h3", "dd", "figcaption"])
        inner = html_text(text)
        if rng.random() < 0.3:
            own = inner.split(" ")
            at = rng.randrange(len(own))
            own[at] = rng.choice(['<a href="/x">{}</a>', '<a href="/x">{}</a>', "<b>{}</b>"]).format(own[at])
            inner = " ".join(own)
        if tag == "li":
            more = [html_text(" ".join(rng.choices(words, k=rng.randint(2, 15)))) for _ in range(rng.randint(1, 4))]
            body.append("<ul>" + "".join(f"<li>{i}</li>" for i in [inner, *more]) + "</ul>")
        else:
            body.append(_element(tag, inner, close=tag != "p" or rng.random() < 0.9))
        if rng.random() < 0.08:
            body.append(part(rng.choice(["advert", "advert", "form", "share", "sidebar", "notice"])))
    inside = "".join(body)
    if rng.random() < 0.4:
        inside = _element(rng.choice(["div", 'div class="inner"', 'div class="body"', "section"]), inside)
    if rng.random() < 0.3:
        inside += part(rng.choice(["share", "comments", "form"]))
    most = rng.choice([0, 0.3, 0.6, 0.6, 0.6])
    before = [part(k) for k in ("notice", "header", "menu", "menu", "advert", "sidebar") if rng.random() < most]
    after = [part(k) for k in ("share", "sidebar", "advert", "form", "comments", "footer") if rng.random() < most]
    rng.shuffle(before)
    name = rng.choice(MAIN) if rng.random() < 0.95 else ""
    main = _element(name, inside, "1") if name else inside
    if name.startswith("td"):
        main = f"<table><tr>{main}</tr></table>"
    if most and rng.random() < 0.05:
        main = ""
    whole = "".join([*before, main, *after])
    if rng.random() < 0.4:
        whole = _element(rng.choice(["div", 'div id="wrapper"', 'div class="container"']), whole)
    return f"<html><head><title>x</title></head>{_element('body', whole, '0' if name else '1')}</html>"


def html_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def labelled(page: str, seed: int, dressings: int = 5) -> list[tuple[list[Block], list[int]]]:
    """A page and its dressings as blocks with labels; a page with marks gives itself only."""
    found, out = blocks(page, Path()), []
    own = [i for i, b in enumerate(found) if b.path.keys & {"a:article", "a:main"} and not b.path.keys & ASIDE]
    if any(b.path.mark for b in found):
        return [(found, [int(b.path.mark == "1") for b in found])]
    if own:
        out.append((found, [int(i in set(own)) for i in range(len(found))]))
    kept = [found[i] for i in own] or [b for b in found if len(b.text) > 60 and not b.linked]
    texts = [(b.path.own[0][2:] if b.path.own and b.path.own[0] in ("l:h1", "l:h2", "l:h3", "l:p", "l:li", "l:blockquote", "l:pre") else "p", b.text) for b in kept]
    for n in range(dressings):
        again = blocks(dressed(texts or [("p", " ".join(FILLER))] * 4, random.Random(f"{seed} {n}")), Path())
        out.append((again, [int(b.path.mark == "1") for b in again]))
    return [pair for pair in out if pair[0]]


# --- the field ------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of features for main text, and of label pairs: ``edges[together][before][now]``; ``start`` of the first label."""

    weights: dict[str, float]
    edges: np.ndarray
    start: np.ndarray

    def score(self, features: list[str], path: Path) -> float:
        get, memo = self.weights.get, path.memo
        if "" not in memo:  # the path's own sum, kept with the path
            memo[""] = sum(get(k, 0.0) for k in path.keys)
        return memo[""] + sum([get(f, 0.0) for f in features])

    def decode(self, scores: list[float], same: list[int]) -> list[int]:
        """Viterbi: the labels of greatest total score."""
        edges, back = self.edges.tolist(), []
        no, yes = self.start[0], self.start[1] + scores[0]
        for score, t in zip(scores[1:], same[1:]):
            (a, b), (c, d) = edges[t]
            back.append((int(yes + c > no + a), int(yes + d >= no + b)))
            no, yes = max(no + a, yes + c), max(no + b, yes + d) + score
        labels = [int(yes >= no)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def main_text(self, page: str | None, root: Path) -> str:
        found = blocks(page, root)
        if not found:
            return ""
        scores = [self.score(f, b.path) for f, b in zip(page_features(found), found)]
        return " ".join(b.text for b, label in zip(found, self.decode(scores, together(found))) if label)


def likelihood(scores: np.ndarray, edges: np.ndarray, start: np.ndarray, same: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log partition sums, P(main), expected label pairs by ``together``, P of first labels) of padded pages, longest first.

    ``scores`` and ``same`` are (pages, blocks).
    """
    pages, most = scores.shape
    both = np.stack([np.zeros_like(scores), scores], axis=2)
    forward, backward = np.empty((pages, most, 2)), np.zeros((pages, most, 2))
    live = [int((lengths > t).sum()) for t in range(most)]
    forward[:, 0] = start + both[:, 0]
    for t in range(1, most):
        n = live[t]
        forward[:n, t] = np.logaddexp.reduce(forward[:n, t - 1, :, None] + edges[same[:n, t]], axis=1) + both[:n, t]
    for t in range(most - 2, -1, -1):
        n = live[t + 1]
        backward[:n, t] = np.logaddexp.reduce(edges[same[:n, t + 1]] + (both[:n, t + 1] + backward[:n, t + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(forward[:, 0] + backward[:, 0], axis=1)
    inside = np.arange(most)[None, :] < lengths[:, None]
    main = np.where(inside, np.exp(np.where(inside, forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0.0)), 0.0)
    pairs = np.zeros((2, 2, 2))
    for t in range(1, most):
        n = live[t]
        chance = np.exp(forward[:n, t - 1, :, None] + edges[same[:n, t]] + (both[:n, t] + backward[:n, t])[:, None, :] - total[:n, None, None])
        for s in (0, 1):
            pairs[s] += chance[same[:n, t] == s].sum(axis=0)
    first = np.stack([1 - main[:, 0], main[:, 0]], axis=1).sum(axis=0)
    return total, main, pairs, first


def fit(pages: list[tuple[list[list[str]], list[int], list[int]]]) -> Field:
    """Maximum likelihood with a squared penalty over pages (features by block, together, labels)."""
    seen: dict[str, int] = {}
    for rows, _, _ in pages:
        for key in {k for row in rows for k in row}:
            seen[key] = seen.get(key, 0) + 1
    names = sorted(k for k, n in seen.items() if n >= min(LEAST_PAGES, len(pages)))
    number = {k: i for i, k in enumerate(names)}
    pages = sorted(pages, key=lambda p: -len(p[2]))
    lengths = np.array([len(p[2]) for p in pages])
    shape = len(pages), int(lengths[0])
    same, truth, inside = np.zeros(shape, np.int64), np.zeros(shape), np.arange(shape[1])[None, :] < lengths[:, None]
    block, feature = [], []
    for i, (rows, together_, labels) in enumerate(pages):
        same[i, : len(labels)], truth[i, : len(labels)] = together_, labels
        for t, row in enumerate(rows):
            own = [number[k] for k in row if k in number]
            feature += own
            block += [i * shape[1] + t] * len(own)
    block, feature = np.array(block, np.int64), np.array(feature, np.int64)
    wanted = np.bincount(feature, truth.reshape(-1)[block], len(names))
    labels = truth.astype(int)
    pairs = np.zeros((2, 2, 2))
    inner = inside[:, 1:]
    np.add.at(pairs, (same[:, 1:][inner], labels[:, :-1][inner], labels[:, 1:][inner]), 1)
    first = np.array([(labels[:, 0] == 0).sum(), (labels[:, 0] == 1).sum()], float)
    values, sizes = np.zeros(len(names) + 10), np.full(len(names) + 10, 0.1)
    before, penalty = np.zeros_like(values), np.full(len(values), PENALTY)
    penalty[: len(names)][[k.startswith("w:") for k in names]] = WORD_PENALTY
    for _ in range(STEPS):  # steps by the sign of the slope, longer while it holds (Rprop): no rate to choose
        weights, edges, start = values[: len(names)], values[len(names) : -2].reshape(2, 2, 2), values[-2:]
        scores = np.bincount(block, weights[feature], shape[0] * shape[1]).reshape(shape)
        _, main, expected, begun = likelihood(scores, edges, start, same, lengths)
        slope = np.concatenate([wanted - np.bincount(feature, main.reshape(-1)[block], len(names)), (pairs - expected).reshape(-1), first - begun]) - penalty * values
        turn = slope * before
        sizes = np.clip(np.where(turn > 0, sizes * 1.2, np.where(turn < 0, sizes * 0.5, sizes)), 1e-6, 1.0)
        slope = np.where(turn < 0, 0.0, slope)
        values = values + np.sign(slope) * sizes
        before = slope
    weights = {k: float(w) for k, w in zip(names, values) if w}
    return Field(weights, values[len(names) : -2].reshape(2, 2, 2), values[-2:])


def learn(pages: DataFrame, key: str = "page_id", html: str = "html") -> Field:
    """The field of labelled pages made from a sample of ``pages``."""
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("page")).where((F.length("page") <= LONGEST) & (F.length("page") > 0))
    place = F.struct("key", F.xxhash64("page").alias("hash"))
    rows = sampled(rows.select(place.alias("place"), "page"), "place", SAMPLE)
    plain = rows.sparkSession.range(1).select(F.struct(F.lit("").alias("key"), F.lit(0).cast("long").alias("hash")).alias("place"), F.lit("").alias("page"))
    dressings = -(-DRESSED // (rows.count() + 1))
    rows = rows.unionByName(plain)

    def of(batches):
        for batch in batches:
            out = []
            for page, seed in zip(batch.column("page").to_pylist(), batch.column("place").field("hash").to_pylist()):
                for found, labels in labelled(page, seed, dressings):
                    features = [[*own, *sorted(b.path.keys)] for own, b in zip(page_features(found), found)]
                    out.append({"features": features, "same": together(found), "labels": labels, "seed": seed})
            schema = pa.schema([("features", pa.list_(pa.list_(pa.string()))), ("same", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("seed", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema)

    made = saved(rows.mapInArrow(of, "features array<array<string>>, same array<int>, labels array<int>, seed long"))
    found = [(r["features"], r["same"], r["labels"]) for r in made.orderBy("seed", "labels", "features").toArrow().to_pylist()]
    return fit(found)


def main_texts(pages: DataFrame, field: Field, key: str = "page_id", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The key, the carried columns, and (text, n_chars) of every page."""
    names = [key, *(carry or [])]
    sent = pages.sparkSession.sparkContext.broadcast(field)
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in names]).alias("row")
    rows = pages.select(own, F.col(html).alias("page"))

    def of(batches):
        root, done = Path(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = []
                for page in part.column("page"):
                    page = page.as_py()
                    texts.append(sent.value.main_text(page, root))
                    done += 1 + len(page or "") // 2000
                    if done > PATHS:
                        root, done = Path(), 0
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(of, f"row {kind}, text string, n_chars long").select("row.*", "text", "n_chars")


def op13(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_texts(pages, learn(pages), carry=["url"])
