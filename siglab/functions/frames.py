"""Windows over a series' rows in time order, and what is built from them.

Every window has the series as its partition key. Several frames over one ordering share one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from siglab.config import TRADING_DAYS

KEYS = ("series_id",)


def ordered(keys: Sequence[str] = KEYS, by: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def upto(keys: Sequence[str] = KEYS, by: str = "ts") -> WindowSpec:
    return ordered(keys, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(n: int, keys: Sequence[str] = KEYS, by: str = "ts") -> WindowSpec:
    return ordered(keys, by).rowsBetween(1 - n, 0)


def full(agg: Callable[[Column], Column], x: Column, n: int, keys: Sequence[str] = KEYS) -> Column:
    """``agg`` over the last ``n`` rows where all of them have a value, else null."""
    frame = last_rows(n, keys)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def back(x: Column, n: int = 1, keys: Sequence[str] = KEYS) -> Column:
    return F.lag(x, n).over(ordered(keys))


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y, F.lit(0.0))


def change(x: Column, n: int = 1, keys: Sequence[str] = KEYS) -> Column:
    return ratio(x, back(x, n, keys)) - 1


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within bounds; null stays null, unlike with least and greatest alone."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(x.isNotNull(), F.least(F.greatest(x, as_column(low)), as_column(high)))


def compounded(returns: Column, keys: Sequence[str] = KEYS) -> Column:
    """The growth of 1 through the returns so far."""
    return F.product(1 + returns).over(upto(keys))


def below_peak(equity: Column, keys: Sequence[str] = KEYS) -> Column:
    """Equity against its highest so far, minus 1; the first value is the first peak."""
    return ratio(equity, F.max(equity).over(upto(keys))) - 1


def annual(std: Column) -> Column:
    return std * F.sqrt(F.lit(float(TRADING_DAYS)))


def rolling_volatility(returns: Column, n: int = 20, keys: Sequence[str] = KEYS) -> Column:
    return annual(full(F.stddev_pop, returns, n, keys))


def rolling_sharpe(returns: Column, n: int = 63, keys: Sequence[str] = KEYS) -> Column:
    return ratio(full(F.avg, returns, n, keys) * TRADING_DAYS, rolling_volatility(returns, n, keys))


def sharpe(mean: Column, std: Column) -> Column:
    """Yearly mean over yearly deviation, 0 where the returns don't vary."""
    return F.coalesce(ratio(mean * TRADING_DAYS, annual(std)), F.lit(0.0))
