"""Ordered-window expressions over one block of a series."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


class Frame:
    """The windows of one partitioning and order, so that all features share one sort."""

    def __init__(self, keys: tuple[str, ...] = ("symbol", "blk"), order: str = "rn"):
        self.ordered: WindowSpec = Window.partitionBy(*keys).orderBy(order)
        self.running: WindowSpec = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        self.before: WindowSpec = self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    def last(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(1 - n, 0)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(x, n).over(self.ordered)

    def span(self, x: str, n: int) -> Column:
        """Sum of the last n values of column x, once all n are present, in constant time.

        The difference of two running totals of the block (`_run[x]`, `_num[x]`); totals stay
        small as a block is short, and a run of zeros sums to exactly zero.
        """
        return F.when(self.present(x, n), self.since(x, n))

    def since(self, x: str, n: int) -> Column:
        total = F.col(f"`_run[{x}]`")
        return total - F.coalesce(self.lag(total, n), F.lit(0))

    def present(self, x: str, n: int) -> Column:
        number = F.col(f"`_num[{x}]`")
        return number - F.coalesce(self.lag(number, n), F.lit(0)) == n

    def full(self, n: int, value: Column, present: Column) -> Column:
        """`value` (an aggregate) over the last n rows, once all n have `present`."""
        return F.when(F.count(present).over(self.last(n)) == n, value.over(self.last(n)))

    def mean(self, x: Column, n: int) -> Column:
        return self.full(n, F.avg(x), x)

    def max(self, x: Column, n: int) -> Column:
        return self.full(n, F.max(x), x)

    def min(self, x: Column, n: int) -> Column:
        return self.full(n, F.min(x), x)

    def std(self, x: Column, n: int) -> Column:
        return self.full(n, F.stddev_samp(x), x)

    def std_pop(self, x: Column, n: int) -> Column:
        return self.full(n, F.stddev_pop(x), x)

    def quantile(self, x: Column, n: int, p: float) -> Column:
        """Quantile with linear interpolation, from the sorted window."""
        return self.rows(x, n, lambda v: sorted_quantile(F.sort_array(v), n, p))

    def weighted(self, x: Column, n: int) -> Column:
        """Linearly weighted mean: the newest value weighs n.

        The weights come from the position inside the block, so the sums stay small.
        """
        frame, place = self.last(n), F.col("_place")
        moment = F.sum(x * place).over(frame) - (place - n) * F.sum(x).over(frame)
        return F.when(F.count(x).over(frame) == n, moment / (n * (n + 1) / 2.0))

    def skew(self, x: Column, n: int) -> Column:
        """Bias-corrected skewness; 0 for a constant window."""
        moment = self.full(n, F.skewness(x), x) * ((n * (n - 1)) ** 0.5 / (n - 2))
        return F.when(self._constant(x, n), F.lit(0.0)).otherwise(moment)

    def kurt(self, x: Column, n: int) -> Column:
        """Bias-corrected excess kurtosis; -3 for a constant window."""
        moment = ((n + 1) * self.full(n, F.kurtosis(x), x) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
        return F.when(self._constant(x, n), F.lit(-3.0)).otherwise(moment)

    def _constant(self, x: Column, n: int) -> Column:
        frame = self.last(n)
        return (F.count(x).over(frame) == n) & (F.min(x).over(frame) == F.max(x).over(frame))

    def rows(self, x: Column, n: int, then: Callable[[Column], Column]) -> Column:
        """`then` applied to the array of the last n values, oldest first."""
        return F.when(
            F.count(x).over(self.last(n)) == n, then(F.collect_list(x).over(self.last(n)))
        )


def positive(x: Column) -> Column:
    """x where positive, 0 where not, NULL where missing."""
    return F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def sorted_quantile(values: Column, n: int, p: float) -> Column:
    """Linear-interpolated quantile of an ascending n-array."""
    place = p * (n - 1)
    low = min(math.floor(place), n - 2)
    a, b = F.get(values, F.lit(low)), F.get(values, F.lit(low + 1))
    return a + (b - a) * (place - low)


def mean_up_to(values: Column, limit: Column) -> Column:
    """Mean of the array's values that do not exceed the limit."""
    start = F.struct(limit.alias("top"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(
        values,
        start,
        lambda m, x: F.when(
            x <= m.top, F.struct(m.top.alias("top"), (m.s + x).alias("s"), (m.n + 1).alias("n"))
        ).otherwise(m),
        lambda m: F.try_divide(m.s, m.n),
    )


def mean_gap(values: Column, centre: Column, n: int) -> Column:
    """Mean absolute distance of an n-array from the centre."""
    start = F.struct(centre.alias("c"), F.lit(0.0).alias("s"))
    return F.aggregate(
        values,
        start,
        lambda m, x: F.struct(m.c.alias("c"), (m.s + F.abs(x - m.c)).alias("s")),
        lambda m: m.s / n,
    )


def log_slope_weights(lags: list[int]) -> list[float]:
    """Weights that turn values at the lags into their least-squares slope on log(lag)."""
    xs = [math.log(lag) for lag in lags]
    mean = sum(xs) / len(xs)
    norm = sum((x - mean) ** 2 for x in xs)
    return [(x - mean) / norm for x in xs]
