"""Exact percentiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.operators.scans import Run, join_on, running


# Bins per group: enough that a task ranks about so many values even if one group holds them all.
LEAST_BINS, MOST_BINS, VALUES_PER_BIN = 64, 10_000, 1_000_000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int | None = None) -> DataFrame:
    """Rows ``keys, prob, value``. NULLs are left out.

    Values are counted, cut into bins at approximate quantiles and ranked bin by bin, so a task sees a fraction of a
    group; the bin edges only affect balance, never the result.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    if bins is None:
        counted = saved(counted)
        bins = min(MOST_BINS, max(LEAST_BINS, counted.count() // VALUES_PER_BIN))
    # Saved, so that its known size lets Spark broadcast it instead of gathering a hot key for the join.
    edges = saved(
        counted.groupBy(*keys).agg(
            F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10_000).alias("_edges"),
            F.sum("_cnt").alias("_n"),
        )
    )
    binned = join_on(counted, edges, keys)
    binned = binned.withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col("_v")))).drop("_edges")
    ranked = running(binned, keys, ["_v"], F.col("_bin"), [Run("_upto", "sum", F.col("_cnt"))])

    def covers(position):
        return (position < F.col("_upto")) & (position >= F.col("_upto") - F.col("_cnt"))

    def spot(p):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        return F.struct(
            F.lit(float(p)).alias("prob"),
            (at - F.floor(at)).alias("part"),
            covers(F.floor(at)).alias("low"),
            covers(F.ceil(at)).alias("high"),
        )

    spots = F.filter(F.array(*[spot(p) for p in probs]), lambda s: s["low"] | s["high"])
    hits = ranked.select(*keys, "_v", F.explode(spots).alias("s"))
    return (
        hits.groupBy(*keys, F.col("s.prob").alias("prob"))
        .agg(
            F.max(F.when(F.col("s.low"), F.col("_v"))).alias("_low"),
            F.max(F.when(F.col("s.high"), F.col("_v"))).alias("_high"),
            F.max("s.part").alias("_part"),
        )
        .select(*keys, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("value"))
    )
