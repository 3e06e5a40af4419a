"""Price, profit and excursion formulas, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktape.schema import EXIT_REASONS


def parse_number(text: Column) -> Column:
    """Text to double; NULL when it is not a number, and for NaN."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def plain_decimal(x: Column) -> Column:
    """Ten places without exponent, trailing zeros and a bare dot removed."""
    return F.regexp_replace(F.format_string("%.10f", x), r"\.?0+$", "")


def percent_move(current: Column, past: Column) -> Column:
    return (current - past) / F.nullif(past, F.lit(0.0)) * 100.0


def entry_price(raw: Column, slip: float, direction: str) -> Column:
    # Sign of the entry slippage per direction.
    sign = {"long": 1.0, "short": -1.0, "signal-only": 0.0}[direction]
    return raw * (1.0 + sign * slip) if sign else raw


def exit_price(raw: Column, slip: float, direction: str) -> Column:
    # Sign of the exit slippage per direction.
    sign = {"long": -1.0, "short": 1.0, "signal-only": 0.0}[direction]
    return raw * (1.0 + sign * slip) if sign else raw


def profit(entry: Column, exit_: Column, size: float, fee: float, direction: str):
    """(fees, pnl, pnl_percent) of one trade."""
    if direction == "signal-only":
        pct = F.when(entry > 0, (exit_ - entry) / entry * 100.0).otherwise(0.0)
        return F.lit(0.0), F.lit(0.0), pct
    fees = F.lit(size * fee * 2.0)
    quantity = F.lit(size) / entry
    if direction == "long":
        pnl = quantity * exit_ - F.lit(size) - fees
    else:
        pnl = F.lit(size) - quantity * exit_ - fees
    return fees, pnl, pnl / F.lit(size) * 100.0


def excursions(entry: Column, highest: Column, lowest: Column, direction: str):
    """(mae_pct, mfe_pct), never negative."""
    up = F.when(entry > 0, F.greatest(F.lit(0.0), (highest - entry) / entry * 100.0)).otherwise(0.0)
    down = F.when(entry > 0, F.greatest(F.lit(0.0), (entry - lowest) / entry * 100.0)).otherwise(0.0)
    return (up, down) if direction == "short" else (down, up)


def move_quality(mae: Column, mfe: Column) -> Column:
    """Favourable share of the whole movement."""
    return F.when(mfe + mae > 0, mfe / (mfe + mae)).otherwise(0.5)


def quality_band(quality: Column) -> Column:
    # Band limits of the mean quality.
    return (
        F.when(quality < 0.3, "mostly-against")
        .when(quality < 0.5, "more-against-than-for")
        .otherwise("mostly-for")
    )


def reason_label(code: Column) -> Column:
    label = F.concat(F.lit("unknown-"), code.cast("string"))
    for number, text in EXIT_REASONS.items():
        label = F.when(code == number, text).otherwise(label)
    return label


def reason_code(label: Column) -> Column:
    code = F.lit(0)
    for number, text in EXIT_REASONS.items():
        code = F.when(label == text, number).otherwise(code)
    return code


def symbol_names(text: Column) -> Column:
    """Comma list to an array of trimmed upper-case names without empties."""
    return F.filter(
        F.transform(F.split(text, ","), lambda s: F.upper(F.trim(s))), lambda s: F.length(s) > 0
    )
