"""Statistics as column expressions, with vectorised functions only where Spark has no built-in."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; null where b is null or zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_ln(x: Column) -> Column:
    """Natural logarithm, null for anything not above zero."""
    return F.when(x > 0, F.ln(x))


def entropy(counts: Column) -> Column:
    """Shannon entropy of an array of counts; zero counts are ignored, null when they sum to nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(
        counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, (x / total) * F.ln(x / total)).otherwise(F.lit(0.0))
    )
    return F.when(total > 0, bits)


def herfindahl(counts: Column) -> Column:
    """Sum of squared shares of an array of counts; null when they sum to nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x / total) * (x / total)))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a proportion, clipped to [0, 1]; null for n = 0."""
    p = ratio(successes, n)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = z / scale * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    ok = n > 0
    return (
        F.when(ok, F.greatest(F.lit(0.0), centre - margin)),
        F.when(ok, F.least(F.lit(1.0), centre + margin)),
    )


def wilson_half_width(p: float, n: int, z: float = Z95) -> float:
    """Half the width of the Wilson interval of a share ``p`` of ``n``."""
    if n < 1 or not 0.0 <= p <= 1.0:
        raise ValueError(f"no interval for a share of {p} of {n}")
    return z / (1 + z * z / n) * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))


def least_n(p: float, half_width: float, z: float = Z95, most: int = 1_000_000) -> int:
    """The smallest sample whose Wilson interval at ``p`` is no wider than asked; ValueError if ``most`` is not enough."""
    low, high = 1, most
    if not 0.0 < half_width <= 1.0 or wilson_half_width(p, most, z) > half_width:
        raise ValueError(f"no sample of up to {most} gives a half width of {half_width}")
    while low < high:
        middle = (low + high) // 2
        if wilson_half_width(p, middle, z) <= half_width:
            high = middle
        else:
            low = middle + 1
    return low


def finite_n(n: int, population: int) -> int:
    """Sample size for a finite population, rounded up."""
    if n < 1 or population < 1:
        raise ValueError("sample and population hold at least one")
    return -(-population * n // (population + n - 1))


def welch_p(mean_a: Column, sd_a: Column, n_a: Column, mean_b: Column, sd_b: Column, n_b: Column) -> Column:
    """Two-sided p of equal means by Welch's statistic and the normal law; null below two values a side or without spread."""
    square = sd_a * sd_a / n_a + sd_b * sd_b / n_b
    ok = (n_a >= 2) & (n_b >= 2) & (square > 0)
    return erfc(F.when(ok, F.abs(mean_a - mean_b) / F.sqrt(square) / F.sqrt(F.lit(2.0))))


@pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function."""
    return x.map(lambda v: math.erfc(v) if v == v and v is not None else None)


def _fisher(a: float, b: float, c: float, d: float) -> float | None:
    if any(v != v or v < 0 for v in (a, b, c, d)):
        return None
    a, b, c, d = (int(v) for v in (a, b, c, d))
    row, other, column = a + b, c + d, a + c
    low, high = max(0, column - other), min(row, column)
    if low == high:
        return 1.0
    # The least arrangement by log gammas of its cells, the others by the ratio of neighbours: only the support is covered.
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    first = choose(row, low) + choose(other, column - low) - choose(row + other, column)
    k = np.arange(low, high, dtype=float)
    steps = np.log((row - k) * (column - k)) - np.log((k + 1) * (other - column + k + 1))
    p = np.exp(first + np.concatenate(([0.0], np.cumsum(steps))))
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


@pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact test of the table ((a, b), (c, d)): tables no likelier than the observed one count.

    A table with only one possible arrangement gives 1; negative or missing cells give null.
    """
    return pd.Series([_fisher(*cells) for cells in zip(a, b, c, d, strict=True)], dtype="float64")


def benjamini_hochberg(df: DataFrame, p: str, out: str, family: list[str], tie: list[str]) -> DataFrame:
    """``df`` with adjusted p values: the least p * m / rank over this rank and above, at most 1.

    Tests are adjusted within ``family``; null p stay null and out of m. A
    family is ordered in one task; it holds tests, not records.
    """
    part = [*family, F.col(p).isNull()]
    falling = Window.partitionBy(*part).orderBy(F.col(p).desc(), *[F.col(t).desc() for t in tie])
    ranked = df.withColumns({
        "_m": F.count(F.lit(1)).over(Window.partitionBy(*part)), "_above": F.row_number().over(falling)
    })
    scaled = F.col(p) * F.col("_m") / (F.col("_m") + 1 - F.col("_above"))
    least = F.min(scaled).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_m", "_above")
