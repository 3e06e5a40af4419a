"""Table schemas and run parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Field names and order of a tape line.
TRADE_SCHEMA = T.StructType(
    [
        T.StructField("a", T.LongType()),
        T.StructField("p", T.StringType()),
        T.StructField("q", T.StringType()),
        T.StructField("f", T.LongType()),
        T.StructField("l", T.LongType()),
        T.StructField("T", T.LongType()),
        T.StructField("m", T.BooleanType()),
        T.StructField("M", T.BooleanType()),
    ]
)

# Candle columns here and in files.
CANDLE_COLUMNS = ["open", "high", "low", "close", "volume", "trade_count"]
CANDLE_FILE_COLUMNS = ["timestamp", "open", "high", "low", "close", "volume", "tradeCount"]

# Accepted directions and the reasons a trade can end for.
DIRECTIONS = ("signal-only", "long", "short")
EXIT_REASONS = {1: "drop-z", 2: "max-hold", 3: "end-of-data"}

# Old column names of trade logs.
LEGACY_TRADE_LOG_NAMES = {
    "max_price": "max_price_during_trade",
    "min_price": "min_price_during_trade",
}


class TapeError(ValueError):
    """Bad input data or bad parameters."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TapeError(f"missing columns: {missing}; found: {df.columns}")
    return df


@dataclass(frozen=True)
class Params:
    """Settings shared by every parameter set of a run."""

    # The defaults.
    xs: tuple[float, ...] = (0.2, 0.5, 1.0)
    ys: tuple[int, ...] = (10, 30, 60)
    zs: tuple[float, ...] = (0.1, 0.2, 0.5)
    hold_s: int = 300
    capital: float = 1000.0
    size: float = 100.0
    fee: float = 0.001
    slip: float = 0.0005
    direction: str = "signal-only"
    dynamic_y: bool = False
    y_max_s: int = 600
    top_n: int = 20
    train_ratio: float = 0.7
    validation_ratio: float = 0.3
    min_trades: int = 20
    min_win_rate: float = 40.0
    min_profit_factor: float = 1.2
    max_drawdown: float = 30.0
    skip_filters: bool = False
    chunk_ms: int = 86_400_000
    spans: tuple[int, ...] = (32,)

    def __post_init__(self) -> None:
        def check(ok: bool, text: str) -> None:
            if not ok:
                raise TapeError(text)

        check(self.direction in DIRECTIONS, f"direction must be one of {DIRECTIONS}")
        check(self.size > 0, "size must be > 0")
        check(self.capital > 0, "capital must be > 0")
        check(self.fee >= 0, "fee must be >= 0")
        check(self.slip >= 0, "slip must be >= 0")
        check(self.hold_s > 0, "hold_s must be > 0")
        check(self.top_n > 0, "top_n must be > 0")
        check(self.y_max_s > 0, "y_max_s must be > 0")
        check(self.chunk_ms > 0, "chunk_ms must be > 0")
        check(len(self.xs) > 0, "xs must not be empty")
        check(len(self.ys) > 0 or self.dynamic_y, "ys must not be empty")
        check(len(self.zs) > 0, "zs must not be empty")
        check(all(v > 0 for v in (*self.xs, *self.ys, *self.zs)), "xs, ys and zs must be > 0")
        check(
            self.train_ratio + self.validation_ratio <= 1.01,
            "train_ratio + validation_ratio must not exceed 1",
        )

    @property
    def hold_ms(self) -> int:
        return self.hold_s * 1000
