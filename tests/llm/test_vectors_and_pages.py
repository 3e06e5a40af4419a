"""Centroid clustering, hard negatives and main-text extraction: odd rows, brute force and held-out pages."""

import html
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sparktape.llm import angular, bitplanes, pagecrf, registry
from sparktape.llm.dom import Path, blocks

SF = "/root/testdata/sf0.01"


def vectors(spark, rows, extra="clash"):
    full = [(*r, extra, 1) for r in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, cluster string, `doc.id` int")


def odd_vectors(seed=3, n=400):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in middles[i % 6]], (i // 6) % 10) for i in range(n)]
    common = [float(x) for x in rows[0][1]]
    rows += [(n + i, common, i % 3) for i in range(200)]  # a vector that a third of the rows share
    rows += [rows[5], rows[5], (7, rows[9][1], 4), (None, rows[11][1], 2), (None, rows[11][1], None)]
    rows += [(1001, None, 1), (1002, [], 1), (1003, [0.5] * 63, 1), (1004, [0.5] * 65, 1), (1005, [None] + [0.5] * 63, 1)]
    rows += [(1006, [float("nan")] + [0.5] * 63, 1), (1007, [float("inf")] + [0.5] * 63, 1), (1008, [0.0] * 64, 1), (1100, [0.0] * 64, 2), (1200, [-3.0] * 64, 1)]
    return rows


def usable(row, scale, limit):
    if row[1] is None or len(row[1]) != 64 or any(x is None or not math.isfinite(x) for x in row[1]):
        return None
    return [math.floor(min(max(float(np.float32(x)) * scale, -limit), limit)) for x in row[1]]


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for size in (1, 3, 700, 2**27 - 1):
        a, b = rng.integers(-size, size + 1, (50, 64)), rng.integers(-size, size + 1, (4, 64))
        packed = bitplanes.pack(a)
        assert (bitplanes.dots(packed, bitplanes.pack(b)) == a @ b.T).all()
        assert (bitplanes.column_sums(packed) == a.sum(axis=0)).all()
        assert (bitplanes.dots(bitplanes.widened(packed, packed.shape[1] + 3), bitplanes.pack(b)) == a @ b.T).all()
        mixed = pa.concat_arrays([bitplanes._lists(packed), bitplanes._lists(bitplanes.pack(b))]).slice(3)
        assert (bitplanes.dots(bitplanes._planes(mixed), bitplanes.pack(b)) == np.concatenate([a, b])[3:] @ b.T).all()


def brute_clusters(rows, k=8, rounds=10):
    import hashlib

    kept = [(r[0], v) for r in rows if (v := usable(r, 1024, bitplanes.LIMIT)) is not None]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middles = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), i) for i, m in enumerate(middles))
    for _ in range(rounds):
        groups = [[] for _ in middles]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        middles = [[sum(c) // len(g) for c in zip(*g)] if g else m for g, m in zip(groups, middles)]
    return sorted(((key, nearest(v)[1], nearest(v)[0]) for key, v in kept), key=str)


@pytest.mark.parametrize("n", [0, 2, 400])
def test_clusters_are_brute_force(spark, n):
    rows = odd_vectors(n=400) if n == 400 else odd_vectors(n=400)[:n]
    found = bitplanes.clusters(vectors(spark, rows).repartition(5)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=str) == brute_clusters(rows)
    for r in found:
        assert r.inertia == sum(x.distance for x in found) and r.cluster_inertia == sum(x.distance for x in found if x.cluster == r.cluster)


def test_huge_components_are_bounded(spark):
    rows = [(i, [3e38 * (-1) ** i] * 64, 1) for i in range(40)]
    found = bitplanes.clusters(vectors(spark, rows)).collect()
    assert sorted(r.vec_id for r in found) == list(range(40)) and {r.distance for r in found} == {0}
    assert angular.hard_negatives(vectors(spark, rows), "key % 100 = 0").collect() == []


def brute_negatives(rows, n=5, percent=80):
    kept = [(r[0], r[2], v) for r in rows if r[2] is not None and (v := usable(r, 256, angular.LIMIT)) is not None]
    out, known = [], set()
    for a in kept:
        if a[0] is None or a[0] % 100 or str(a) in known:
            continue
        known.add(str(a))
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2])), r[0] is None, r[0] or 0, r[1]) for r in kept if r[0] != a[0]))
        for p in [s for s in scored if s[3] == a[1]][:n]:
            fit = [s for s in scored if s[3] != a[1] and percent * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:n]
            out += [(a[0], None if p[1] else p[2], i + 1, None if s[1] else s[2], -p[0], -s[0]) for i, s in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [0, 1, 3, 10_000])
def test_negatives_are_brute_force(spark, monkeypatch, size):
    rows = odd_vectors() if size > 3 else odd_vectors()[:size]
    monkeypatch.setattr(angular, "ANCHORS", 3)
    found = angular.hard_negatives(vectors(spark, rows).repartition(4), "key % 100 = 0").collect()
    assert sorted(map(tuple, found), key=str) == brute_negatives(rows)
    assert bool(found) == (size > 3)


def test_small_pieces_and_full_buffers_lose_nothing(spark, monkeypatch):
    for name, value in {"GROUP": 4, "ROWS": 37, "HELD": 50}.items():
        monkeypatch.setattr(angular, name, value)
    rows = odd_vectors(seed=8)
    table = vectors(spark, rows).coalesce(1)
    values = [(r[0], r[2], usable(r, 256, angular.LIMIT)) for r in rows]
    values = [r for r in values if r[0] is not None and r[1] is not None and r[2] is not None]
    directions = angular.reference_directions(table.select(bitplanes.F.col("vec_id").alias("key"), angular.scaled("embedding", 256, angular.LIMIT).alias("values")).where("values is not null and size(values) = 64 and key < 400"), 64)
    keys, labels, own = (np.array([r[i] for r in values]) for i in range(3))
    seen, norms = angular.angles(own, directions)
    at = np.flatnonzero(keys % 100 == 0)
    anchors = angular.Anchors(keys[at], labels[at], own[at], seen[at], norms[at], np.full((len(at), 1), -(2**62)), np.full((len(at), 1), 2**62), True)
    order = np.argsort(seen.argmin(axis=1), kind="stable")
    cut = [order[i : i + 37] for i in range(0, len(order), 37)]
    best = angular.scan(anchors, ((keys[c], labels[c], own[c], seen[c], norms[c]) for c in cut), 5)
    for slot, a in enumerate(at):
        mates = sorted((-int(own[a] @ own[r]), int(keys[r])) for r in range(len(keys)) if labels[r] == labels[a] and keys[r] != keys[a])[:5]
        assert sorted((-int(s), int(k)) for s, k in zip(best.score[best.slot == slot], best.key[best.slot == slot])) == mates


def test_score_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 40, (5, 64))
    rows = np.floor(np.concatenate([m + rng.normal(0, 6, (128, 64)) for m in middles])).astype(np.int64)
    seen, norms = angular.angles(rows, middles / np.sqrt((middles**2).sum(axis=1, keepdims=True)))
    starts = np.arange(0, len(rows), 64)
    ends = [np.minimum.reduceat(seen, starts), np.maximum.reduceat(seen, starts), np.minimum.reduceat(norms, starts), np.maximum.reduceat(norms, starts)]
    low, high = angular.bounds(seen, norms, *ends)
    scores = angular.products(rows, rows)
    each = np.repeat(np.arange(len(starts)), 64)
    assert (scores >= low[:, each]).all() and (scores <= high[:, each]).all()
    fifth = np.sort(scores, axis=1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.5  # most runs need no scores
    big = np.array([[2**28 - 1] * 64])
    assert angular.products(big, -big)[0, 0] == -64 * (2**28 - 1) ** 2


# --- pages ----------------------------------------------------------------------------------------------------------


def article_of(page):
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def test_every_page_gives_its_article(spark):
    want = {r["page_id"]: (r["url"], article_of(r["html"])) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    found = registry.queries()["op13_html_extraction"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in found} == want and all(r.n_chars == len(r.text) for r in found)


@pytest.fixture(scope="module")
def field(spark):
    return pagecrf.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def test_layouts_held_out(field):
    right = total = hit = wrong = missed = 0
    for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").slice(2000, 150).to_pylist():
        for found, labels in pagecrf.labelled(r["html"], r["page_id"] + 10**7)[1:]:
            got = field.decode([field.score(f, b.path) for f, b in zip(pagecrf.page_features(found), found)], pagecrf.together(found))
            right, total = right + (got == labels), total + 1
            hit, wrong, missed = hit + sum(g & y for g, y in zip(got, labels)), wrong + sum(g > y for g, y in zip(got, labels)), missed + sum(g < y for g, y in zip(got, labels))
    assert right / total > 0.95 and wrong < 0.01 * hit and missed < 0.01 * hit, (right, total, hit, wrong, missed)


PAGES = [
    (
        '<html><head><title>t</title></head><body><header><h1>The Daily</h1><nav><a href="/">Home</a> | <a href="/w">World</a></nav></header><div class="cookie-banner"><p>We use cookies to make this'
        ' site better for you and to measure our audience.</p><button>OK</button></div><div id="content"><h2>Storm hits the coast</h2><p>A strong storm hit the coast on Monday, and many people lost'
        ' power for hours.</p><p>Officials said that repairs would take days. <a href="/x">Read the report</a>.</p></div><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten ways to cook'
        ' rice</a></li></ul></aside><section id="comments"><h3>2 comments</h3><div class="comment">Anna: I was there and it was a terrible night for all of us, truly.</div></section><footer>&copy; 2024'
        " The Daily. All rights reserved.</footer></body></html>",
        "Storm hits the coast A strong storm hit the coast on Monday, and many people lost power for hours. Officials said that repairs would take days. Read the report.",
    ),
    (
        '<body><div class="menu"><a href=a>One</a><a href=b>Two</a></div><article><h1>Title here</h1><p>First paragraph of the text, it is short.</p><div class="ad"><p>Buy these new shoes today, they are'
        " the best shoes ever made.</p></div><p>Second&nbsp;paragraph\n  with &lt;signs&gt; &#8364; <b>in</b>side.</p><ul><li>First item of a list<li>Second item</ul><form><label>Email</label><input><button>"
        "Subscribe</button></form></article><footer>Imprint</footer>",
        "Title here First paragraph of the text, it is short. Second paragraph with <signs> € inside. First item of a list Second item",
    ),
    ("<p>Only one long paragraph of text stands on this page, and nothing else is there to see.</p>", "Only one long paragraph of text stands on this page, and nothing else is there to see."),
    ('<nav><a href=x>a</a></nav><script>document.write("<p>no</p>")</script><style>p{}</style>', ""),
]


def test_pages_of_other_makes(field):
    for page, text in PAGES:
        assert field.main_text(page, Path()) == text


def test_leaf_blocks():
    texts = lambda page: [b.text for b in blocks(page, Path())]
    assert texts("<p>a<b>b</b> c<br>d<p>e</div>f") == ["ab c d", "e f"] or texts("<p>a<b>b</b> c<br>d<p>e</div>f") == ["ab c d", "e", "f"]
    assert texts('<script>var t="</p><p>x";</script>y<!-- <p>z -->w<style>p{}</style>') == ["yw"]
    assert texts("1 < 2 & 3 &gt; 2 <3") == ["1 < 2 & 3 > 2 <3"]
    assert texts('<p title="a>b">x</p><p title=\'>\'>y</p><p <div>z') == ["x", "y", "z"]
    assert texts(None) == texts("") == texts("<") == [] or texts("<") == ["<"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    inner = blocks("<ul><li>a<ul><li>b</ul><li>c</ul>", Path())
    assert [b.text for b in inner] == ["a", "b", "c"] and inner[0].path.keys == inner[2].path.keys
    deep = "<div class='x%d'>" * 20_000 % tuple(range(20_000)) + "core" + "</div>" * 20_000
    assert texts(deep) == ["core"] and len(blocks(deep, Path())[0].path.keys) < 100
    assert texts("<p>" + "word " * 400_000)[0].count("word") == 400_000
    assert texts("x<a " + 'b="c" ' * 200_000) == texts("x" + '<a ="' * 200_000) == texts("<p>x</p><!-- " + "<p" * 200_000) == ["x"]
    assert texts('<p>a</p><p>b <a href="/un') == ["a", "b"]  # a page that breaks off within a tag


def test_likelihood_and_decoding_are_brute_force():
    rng = np.random.default_rng(4)
    field = pagecrf.Field({}, rng.normal(0, 1, (2, 2, 2)), rng.normal(0, 1, 2))
    lengths, most = np.array([5, 4, 1]), 5
    scores, same = rng.normal(0, 1, (3, most)), rng.integers(0, 2, (3, most))
    total, main, pairs, first = pagecrf.likelihood(scores, field.edges, field.start, same, lengths)
    want_pairs, want_first = np.zeros((2, 2, 2)), np.zeros(2)
    for i, n in enumerate(lengths):
        paths = {}
        for labels in itertools.product((0, 1), repeat=int(n)):
            edges = [(same[i, t], labels[t - 1], labels[t]) for t in range(1, n)]
            paths[labels] = field.start[labels[0]] + sum(scores[i, t] for t in range(n) if labels[t]) + sum(field.edges[e] for e in edges), edges
        z = math.log(sum(math.exp(s) for s, _ in paths.values()))
        assert math.isclose(total[i], z)
        for t in range(n):
            assert math.isclose(main[i, t], sum(math.exp(s - z) for labels, (s, _) in paths.items() if labels[t]))
        for labels, (s, edges) in paths.items():
            want_first[labels[0]] += math.exp(s - z)
            for e in edges:
                want_pairs[e] += math.exp(s - z)
        assert tuple(field.decode(scores[i, :n].tolist(), same[i, :n].tolist())) == max(paths, key=lambda p: paths[p][0])
    assert np.allclose(pairs, want_pairs) and np.allclose(first, want_first)


def test_odd_pages(spark):
    prose = "<article><p>" + "Some words of prose, and then a few more of them. " * 5 + "</p></article>"
    rows = [(1, "u", prose), (1, "u", prose), (None, None, prose), (2, None, None), (3, "", ""), (4, "x", "   \n "), (5, "long", "<article>" + "<p>Prose of many words is here, and it goes on. " * 20_000)]
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "page_id long, url string, html string, text string, page int, `row` int")
    found = pagecrf.main_texts(table, pagecrf.learn(table), carry=["url"]).collect()
    text = article_of(prose)
    want = [(1, "u", text), (1, "u", text), (None, None, text), (2, None, ""), (3, "", ""), (4, "x", ""), (5, "long", " ".join(["Prose of many words is here, and it goes on."] * 20_000))]
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in found), key=str) == sorted(((*w, len(w[2])) for w in want), key=str)
    nothing = table.where("page_id = 2")
    assert [r.text for r in pagecrf.main_texts(nothing, pagecrf.learn(nothing), carry=["url"]).collect()] == [""]


def test_marked_pages_train(spark):
    page = '<div class="lead" data-main="0">{0} words of a lead, that is no text.</div><div class="core" data-main="1">{0} words of the text, that is all.</div>'
    table = spark.createDataFrame([(i, page.format(f"Number {i}")) for i in range(30)], "page_id long, html string")
    own = pagecrf.learn(table)
    assert own.main_text(page.replace(" data-main=", " x=").format("Other"), Path()) == "Other words of the text, that is all."


def test_reruns_agree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    first, again = pagecrf.learn(pages), pagecrf.learn(pages.repartition(7))
    assert first.weights == again.weights and (first.edges == again.edges).all()
