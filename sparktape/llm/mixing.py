"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source gets the same expected number of copies e = target / source size. Its place in the source's
order, times e, is the prefix sum of expected copies; one random offset per source is added, and the document is emitted
once for each whole number between its own prefix sum and the one before. Documents lie in order of size, so the words
taken differ from the target by little more than one long document.

The prefix sum needs no window over a whole source: documents are counted by (source, size class, bucket), where size
classes are exact below 1024 words and keep ten leading bits above, so there are a few thousand at most, and the bucket
is a hash of the id. Running totals go over size classes within a source, then over buckets within a size class, then over
documents within a bucket. A source, or a group of copies, that holds a third of all rows is spread over all buckets.

Null texts have size zero; a null source is a source of its own, last in order. Sources without words have target zero
and are left out of the mix. Null ids go by their text; rows that repeat an id share a bucket and are taken one by one. Other
columns are kept, under any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktape.lineage import saved

WORD = r"[^\x20\x09-\x0D]+"
#: A source is taken at most this many times.
MOST = 3
WEIGHTS = (1.0, 2.0, 3.0)
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS = 64


def words(text):
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size):
    """The size with its ten leading bits."""
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(size)) - 10, F.lit(0)))
    return (size - F.pmod(size, unit)).cast("long")


def hashed(column, digits: int = 8):
    """A number below 16 ** digits from an MD5 sum."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("null"))), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (named, source, source_size) with the target of each: shares by weight, none above ``most`` times its size.

    Weights repeat over the sources in code point order, null last. Once the sources are ordered by size for weight, those
    that are cut come first: the share of words for a unit of weight is the least level at which the rest takes it all.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight)
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = weighed.withColumns({
        "rest": F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # The first source in this order that its share does not fill sets the level for all that follow.
    share = F.when(F.col("weight") * F.col("rest") / F.col("open") <= most * F.col("source_size"), F.col("rest") / F.col("open"))
    levels = levels.withColumn("level", F.first(share, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("weight") * F.coalesce("level", F.lit(math.inf)), most * F.col("source_size").cast("double"))
    return levels.select("named", "source", "source_size", target.alias("target"))


def copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most=MOST, carry: list[str] | None = None
) -> DataFrame:
    """(doc, size, source_size, target, copies): the carried columns of every row, all by default, and its copies.

    Words are counted once, on the way to a saved table that all further steps read.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(c) for c in carry or docs.columns]).alias("doc"),
        F.col(source).cast("string").alias("source"),
        words(F.col(text)).alias("size"),
        # Rows without an id are told apart by their text, so that they spread over the buckets too.
        F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null"), F.coalesce(F.md5(text), F.lit("")))).alias("key"),
        F.xxhash64(text).alias("tie"),
    )
    rows = saved(rows)
    rows = rows.withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))  # joins need no null
    rows = rows.withColumns({"class": size_class(F.col("size")), "hash": hashed(F.col("key"))})
    sizes = saved(rows.groupBy("named", "source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets))).drop("hash")

    exact = targets(sizes.groupBy("named", "source").agg(F.sum("words").alias("source_size")), weights, most)
    lower = Window.partitionBy("named").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    by_class = sizes.select("named", "class", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below"))
    groups = rows.groupBy("named", "class", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("named", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    groups = groups.join(by_class, ["named", "class"]).join(exact.drop("source"), "named")
    groups = saved(groups.withColumn("before", F.col("before") + F.col("below")).drop("below"))

    inside = Window.partitionBy("named", "class", "bucket").orderBy("key", "size", "tie")
    rows = rows.join(groups, ["named", "class", "bucket"]).withColumn("place", F.col("before") + F.row_number().over(inside))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = hashed(F.col("named")) / F.lit(float(16**8))
    crossed = F.floor(F.col("place") * rate + offset) - F.floor((F.col("place") - 1) * rate + offset)
    return rows.select("doc", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("int").alias("copies"))


def mix(docs: DataFrame, **names) -> DataFrame:
    """The mixed documents: the columns of ``docs``, each row once per copy."""
    taken = copies(docs, **names).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op2(spark, sf_dir: str) -> DataFrame:
    """Copies of all documents in a mix that weighs the sources 1, 2, 3, repeating."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    taken = copies(docs, carry=["doc_id"])
    return taken.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = """
with docs as (
  select doc_id, source, coalesce(cast(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as bigint), 0) as size,
    coalesce('=' || source, 'null') as named, coalesce(cast(doc_id as varchar), 'null' || coalesce(md5(text), '')) as k
  from documents
), placed as (
  select *, size - size % (1::bigint << greatest(length(bin(size)) - 10, 0)) as class,
    ('0x' || md5(k)[1:8])::bigint % greatest(64, (select count(*) from docs) // 100000) as bucket
  from docs
), sizes as (
  select named, source, sum(size)::bigint as source_size, 1.0::double + (row_number() over (order by source is null, source) - 1) % 3 as weight
  from docs group by named, source
), levels as (
  select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over earlier, 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over earlier, 0) as unfilled,
    row_number() over (order by source_size / weight, source is null, source) as place
  from sizes
  window earlier as (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding)
), level as (
  select arg_min(rest::double / unfilled, place) as share from levels where weight * (rest::double / unfilled) <= 3 * source_size
), targets as (
  select named, source_size, least(weight * share, 3.0::double * source_size) as target from levels, level
), ranked as (
  select placed.*, source_size, target, row_number() over (partition by placed.named order by class, bucket, k, size) as place,
    case when source_size > 0 then target / source_size else 0.0::double end as rate,
    ('0x' || md5(placed.named)[1:8])::bigint / 4294967296.0::double as shift
  from placed join targets using (named)
)
select doc_id, size, source_size, target,
  cast(size * least(floor(place * rate + shift) - floor((place - 1) * rate + shift), 3) as bigint) as taken
from ranked
"""
