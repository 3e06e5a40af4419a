"""Parameter axes and their combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktape.schema import Params, TapeError

# End tolerance of a range and the size a grid is flagged from.
RANGE_TOLERANCE = 1e-9
LARGE_GRID = 10_000


def range_values(start: Column, end: Column, step: Column) -> Column:
    """Array start, start+step, ... up to end, at six places; bad bounds are an error."""
    steps = F.floor((end - start) / step + RANGE_TOLERANCE).cast("int")
    values = F.transform(F.sequence(F.lit(0), steps), lambda i: F.round(start + i * step, 6))
    return (
        F.when(step <= 0, F.raise_error(F.lit("step must be > 0")).cast("array<double>"))
        .when(start > end, F.raise_error(F.lit("start must be <= end")).cast("array<double>"))
        .otherwise(values)
    )


def parse_range(spec: Column) -> Column:
    """Array of values of a ``start:end:step`` text."""
    parts = F.split(spec, ":")
    number = [F.get(parts, i).try_cast("double") for i in range(3)]
    bad = (F.size(parts) != 3) | number[0].isNull() | number[1].isNull() | number[2].isNull()
    return F.when(
        bad, F.raise_error(F.concat(F.lit("not start:end:step: "), spec)).cast("array<double>")
    ).otherwise(range_values(*number))


def spec_values(spec: str, kind: str = "float") -> list:
    """Axis values of a ``start:end:step`` text, for building :class:`Params`."""
    try:
        start, end, step = (float(v) for v in spec.split(":"))
    except ValueError as e:
        raise TapeError(f"not start:end:step: {spec}") from e
    if step <= 0 or start > end:
        raise TapeError(f"bad range: {spec}")
    values = [round(start + i * step, 6) for i in range(int((end - start) / step + RANGE_TOLERANCE) + 1)]
    return [int(round(v)) for v in values] if kind == "int" else values


def expand_grid(df: DataFrame, keys: list[str], xs: Column, ys: Column, zs: Column) -> DataFrame:
    """Every (x, y, z) of a row's three axis arrays, numbered from 1 in that order."""
    axes = df.select(*keys, xs.alias("_xs"), ys.alias("_ys"), zs.alias("_zs"))
    return (
        axes.select("*", F.posexplode("_xs").alias("_i", "x"))
        .select("*", F.posexplode("_ys").alias("_j", "y"))
        .select("*", F.posexplode("_zs").alias("_k", "z"))
        .select(
            *keys,
            ((F.col("_i") * F.size("_ys") + F.col("_j")) * F.size("_zs") + F.col("_k") + 1).alias("combo_id"),
            "x",
            "y",
            "z",
        )
    )


def axes(params: Params) -> list[Column]:
    """The three axes as array columns, ascending; with dynamic lookback ``y`` is the longest window."""
    ys = (params.y_max_s,) if params.dynamic_y else params.ys
    return [
        F.array(*[F.lit(v) for v in sorted(values)]).cast(f"array<{kind}>")
        for values, kind in ((params.xs, "double"), (ys, "bigint"), (params.zs, "double"))
    ]


def param_grid(spark: SparkSession, params: Params) -> DataFrame:
    """Parameter sets ``combo_id, x, y, z``."""
    return expand_grid(spark.range(1), [], *axes(params))


def grid_size(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values per axis, their product and whether it is large."""
    total = F.col("n_x") * F.col("n_y") * F.col("n_z")
    return (
        sets.select(*keys, "x", "y", "z")
        .distinct()
        .groupBy(*keys)
        .agg(
            F.countDistinct("x").alias("n_x"), F.countDistinct("y").alias("n_y"), F.countDistinct("z").alias("n_z")
        )
        .withColumn("total", total)
        .withColumn("large", F.col("total") > LARGE_GRID)
    )


def axes_size(df: DataFrame, keys: list[str], xs: Column, ys: Column, zs: Column) -> DataFrame:
    """:func:`grid_size` of the grids of rows with three axis arrays, which are not multiplied out.

    Rows are shuffled once, as arrays; a key's values are told apart where its rows meet. For many rows of one key, take
    :func:`grid_size`, which deals them by value.
    """
    axes = df.select(*keys, xs.alias("x"), ys.alias("y"), zs.alias("z")).where("size(x) > 0 and size(y) > 0 and size(z) > 0")
    kinds = {axis: axes.schema[axis].dataType.elementType for axis in "xyz"}

    def values(axis: str) -> Column:
        own = lambda v: [v.alias(a) if a == axis else F.lit(None).cast(kinds[a]).alias(a) for a in "xyz"]
        return F.transform(axis, lambda v: F.struct(*own(v)))

    each = axes.repartition(*keys).select(*keys, F.explode(F.concat(*[values(a) for a in "xyz"])).alias("_v"))
    return (
        each.select(*keys, "_v.x", "_v.y", "_v.z")
        .distinct()
        .groupBy(*keys)
        .agg(*[F.count(a).alias(f"n_{a}") for a in "xyz"])
        .withColumn("total", F.col("n_x") * F.col("n_y") * F.col("n_z"))
        .withColumn("large", F.col("total") > LARGE_GRID)
    )
