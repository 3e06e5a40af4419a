import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparktape.functions import pricing, timeops
from sparktape.operators import grid
from sparktape.plans import catalogue
from sparktape.schema import Params, TapeError, require_columns


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_epoch_units(spark):
    assert one(spark, timeops.normalize_epoch(F.lit(1735689605179257))) == 1735689605179
    assert one(spark, timeops.normalize_epoch(F.lit(1735689605179))) == 1735689605179
    assert one(spark, timeops.floor_to(F.lit(1700000000500), 1000)) == 1700000000000


def test_text_forms(spark):
    t = F.lit(1700000000500)
    assert one(spark, timeops.iso_millis(t)) == "2023-11-14T22:13:20.500Z"
    assert one(spark, timeops.iso_day(t)) == "2023-11-14"
    assert one(spark, timeops.day_to_millis(F.lit("2024-01-01"))) == 1704067200000
    with pytest.raises(Exception, match="invalid date"):
        one(spark, timeops.day_to_millis(F.lit("2024-13-01")))


@pytest.mark.parametrize("value,text", [(0.00000039, "0.00000039"), (100.0, "100"), (3.14, "3.14"), (0.0, "0")])
def test_plain_decimal(spark, value, text):
    assert one(spark, pricing.plain_decimal(F.lit(value))) == text


def test_parse_number(spark):
    assert one(spark, pricing.parse_number(F.lit("1.5"))) == 1.5
    assert one(spark, pricing.parse_number(F.lit("1.5abc"))) is None
    assert one(spark, pricing.parse_number(F.lit("NaN"))) is None


def test_window_membership(spark):
    s, h = 1700000000000, 3_600_000
    inside = lambda t: one(
        spark, timeops.in_window(F.lit(t), F.lit(s), F.lit(s + 24 * h), F.lit(s + h))
    )
    assert [inside(t) for t in (s, s + h, s - 1, s + h + 1, s + 24 * h)] == [True, True, False, False, False]


def test_day_split(spark):
    start, end = 1704067200000, 1704067200000 + 2 * timeops.DAY_MS
    days = one(spark, timeops.split_days(F.lit(start), F.lit(end)))
    assert [(d.day_start, d.day_end) for d in days] == [(start, start + timeops.DAY_MS), (start + timeops.DAY_MS, end)]
    assert one(spark, timeops.split_days(F.lit(start), F.lit(start))) == []
    part = one(spark, timeops.split_days(F.lit(start), F.lit(start + 10)))
    assert [(d.day_start, d.day_end) for d in part] == [(start, start + 10)]


def test_range_specs(spark):
    values = one(spark, grid.parse_range(F.lit("0.5:2.0:0.1")))
    assert values == [round(0.5 + 0.1 * i, 6) for i in range(16)]
    assert grid.spec_values("10:60:10", "int") == [10, 20, 30, 40, 50, 60]
    for bad in ("invalid", "1:10:0", "5:1:1", "a:b:c"):
        with pytest.raises(TapeError):
            grid.spec_values(bad)
        with pytest.raises(Exception):
            one(spark, grid.parse_range(F.lit(bad)))


def test_grid(spark):
    sets = grid.param_grid(spark, Params(xs=(2.0, 1.0), ys=(10, 20), zs=(5.0,)))
    assert rows(sets) == [(1, 1.0, 10, 5.0), (2, 1.0, 20, 5.0), (3, 2.0, 10, 5.0), (4, 2.0, 20, 5.0)]
    dynamic = grid.param_grid(spark, Params(xs=(1.0,), zs=(5.0, 6.0), dynamic_y=True, y_max_s=600))
    assert rows(dynamic) == [(1, 1.0, 600, 5.0), (2, 1.0, 600, 6.0)]
    large = spark.range(101).select(
        F.col("id").alias("x"), (F.col("id") % 10).alias("y"), (F.col("id") % 10).alias("z"), F.lit("a").alias("k")
    )
    assert rows(grid.grid_size(large, ["k"])) == [("a", 101, 10, 10, 10100, True)]


def test_axes_size(spark):
    """As of the grids multiplied out, by one shuffle of rows that are not."""
    data = [(1, [1.0, 2.0, None], [1, 2**60, 2**60 + 1], [0.0, -0.0]), (1, [2.0, 3.0], [1], [float("nan"), float("nan")]), (2, [], [1], [1.0]), (2, None, [1], [1.0]), (3, [1.0], [None], [2.0, 2.0]), (None, [1.0], [4, 4], [5.0])]
    df = spark.createDataFrame(data, "k int, a array<double>, b array<long>, c array<double>")
    axes = df, ["k"], F.col("a"), F.col("b"), F.col("c")
    got = grid.axes_size(*axes)
    assert sorted(rows(got, "k"), key=str) == sorted(rows(grid.grid_size(grid.expand_grid(*axes), ["k"]), "k"), key=str)
    assert (1, 3, 3, 2, 18, False) in rows(got, "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_grid_size_query_shuffles_lines_once(spark):
    plan = catalogue.queries()["grid_size"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_symbols_and_reasons(spark):
    assert one(spark, pricing.symbol_names(F.lit(" btc , ,eth,"))) == ["BTC", "ETH"]
    assert one(spark, pricing.reason_label(F.lit(2))) == "max-hold"
    assert one(spark, pricing.reason_label(F.lit(7))) == "unknown-7"
    assert one(spark, pricing.reason_code(F.lit("end-of-data"))) == 3


def test_profit_and_excursions(spark):
    e, x = F.lit(100.0), F.lit(110.0)
    fees, pnl, pct = pricing.profit(e, x, 100.0, 0.001, "long")
    assert (one(spark, fees), round(one(spark, pnl), 9), round(one(spark, pct), 9)) == (0.2, 9.8, 9.8)
    _, pnl, _ = pricing.profit(e, x, 100.0, 0.001, "short")
    assert round(one(spark, pnl), 9) == -10.2
    fees, pnl, pct = pricing.profit(e, x, 100.0, 0.001, "signal-only")
    assert (one(spark, fees), one(spark, pnl), round(one(spark, pct), 9)) == (0.0, 0.0, 10.0)
    assert one(spark, pricing.entry_price(e, 0.01, "short")) == 99.0
    assert one(spark, pricing.exit_price(e, 0.01, "signal-only")) == 100.0
    assert one(spark, pricing.percent_move(e, F.lit(0.0))) is None
    mae, mfe = pricing.excursions(e, F.lit(105.0), F.lit(90.0), "long")
    assert (one(spark, mae), one(spark, mfe)) == (10.0, 5.0)
    mae, mfe = pricing.excursions(e, F.lit(105.0), F.lit(90.0), "short")
    assert (one(spark, mae), one(spark, mfe)) == (5.0, 10.0)


@pytest.mark.parametrize(
    "change",
    [
        {"size": 0.0},
        {"capital": -1.0},
        {"fee": -0.1},
        {"slip": -0.1},
        {"hold_s": 0},
        {"xs": ()},
        {"ys": ()},
        {"zs": (0.0,)},
        {"direction": "up"},
        {"train_ratio": 0.9, "validation_ratio": 0.3},
    ],
)
def test_bad_params(change):
    with pytest.raises(TapeError):
        Params(**change)


def test_missing_columns(spark):
    with pytest.raises(TapeError, match="missing columns"):
        require_columns(spark.createDataFrame([(1, 2)], "a int, b int"), ["a", "close"])
