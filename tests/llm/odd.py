"""Small tables with every kind of odd row, written as the driver's tables are."""

import random

from pyspark.sql import types as T

CLASHES = ["key", "doc", "score", "fp", "size", "bucket", "component_id", "hash", "label", "lang_no", "copies", "_place", "doc.id"]
SYLLABLES = {"en": "the and ing tion er re on at en st".split(), "fr": "le eau ou que ré ai é è tre ment".split(), "de": "der ung sch ein keit ü ä lich ver te".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def documents(rng=None):
    rng = rng or random.Random(5)
    rows = []
    for i in range(90):
        lang = ("en", "fr", "de")[i % 3]
        text = "\n".join(sentence(rng, lang, rng.randint(8, 14)) for _ in range(6))
        if i % 10 == 3:
            text = text.upper().replace(" ", "!! ")
        if i % 10 == 4:
            text += " You are a stupid idiot. What a pathetic moron."
        if i % 10 == 5:
            text += " Released under the MIT License."
        rows.append((i, text, lang, f"s{i % 4}" if i % 2 else "hot", len(text)))
    rows += [(90, rows[0][1], "en", "hot", 5), (91, rows[0][1] + " more", "en", "hot", 5), (92, rows[0][1], "en", "s1", 5)]
    rows += [(93, None, "en", "hot", None), (94, "", None, None, 0), (95, " \t\n ", "fr", None, 4), (96, "word", "de", "s1", 4)]
    rows += [(97, "日本語 éÉ <|endoftext|> \x00 x", "en", "s2", 9), (98, "x" * 70_000, "en", "s2", 70_000)]
    rows += [(99, " ".join(sentence(rng, "en", 12) for _ in range(4000)), "en", "hot", 1)]
    rows += [(None, rows[1][1], "fr", "hot", 3), (None, None, None, None, None)]
    rows += [rows[2]] * 5 + [(94, "", None, None, 0)] * 2
    return rows


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
)


def write(spark, folder, rows=None, extra=True):
    """The tables documents, labels, benchmark and pages below ``folder``; their path."""
    rows = documents() if rows is None else rows
    full = [(*r, *(["clash"] * len(CLASHES) if i % 2 else [None] * len(CLASHES))) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(full, SCHEMA)
    docs = docs if extra else docs.select(*[f"`{c}`" for c in SCHEMA.names[:5]])
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(r[0], None if r[0] == 7 else int(r[0] % 10 != 3), int(r[0] % 10 == 4)) for r in rows if r[0] is not None and r[0] < 80]
    spark.createDataFrame([*marks, *marks[:1], *([(None, 1, 1)] if marks else [])], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    texts = [r[1] for r in rows if r[1]]
    items = [(1, " ".join(texts[5].split()[4:24])), (2, " ".join(texts[6].split()[:9])), (3, None), (4, "too short"), (1, " ".join(texts[5].split()[4:24]))] if texts else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    long = "<p>" + "payload " * 40
    pages = [(i, f"http://x/{i}", long + str(i % 3)) for i in range(12)] + [(20, None, None), (21, "u\r\nv", ""), (22, "u", "short"), (23, "u", "short"), (None, "u", long + "0"), (0, "again", long + "0"), (30, "u", "é" * 300_000)]
    spark.createDataFrame(pages if rows else [], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    near = lambda i: [((i * 37 + j * j) % 101 - 50) / 400 + (i % 3) * 0.2 * ((j % 3) - 1) for j in range(64)]
    vectors = [(i, near(i), i % 4) for i in range(120)] + [(0, near(0), 0), (None, near(1), 1), (200, near(100), None), (201, None, 1), (202, [], 1), (203, [None] * 64, 1), (204, [float("nan")] * 64, 1)]
    spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)
