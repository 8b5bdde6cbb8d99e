"""Statistical expressions: all but median_slope_of stay in the JVM."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .robust import median_slopes


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame, key: list[str], **columns: Column) -> DataFrame:
    """key and the computed columns, as a one-row generator: filters on them stay above it. Pushed below, a filter would carry
    the whole chain of array expressions in place of each name, and the plan would grow exponentially."""
    return df.select(*key, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def median_of(values: Column) -> Column:
    """Median of an array, the mean of the middle two for even sizes; null for an empty one."""
    n = F.size(values)
    middle = lambda s: (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2
    return F.when(n > 0, let(F.sort_array(values), middle))


def theil_sen_slope(points: Column) -> Column:
    """Median of the slopes of all pairs of an ordered array<struct<x,y>> with different x; 0 if there is none."""
    slopes = F.flatten(
        F.transform(points, lambda p, i: F.transform(F.filter(F.slice(points, i + 2, F.size(points)), lambda q: q["x"] != p["x"]), lambda q: (q["y"] - p["y"]) / (q["x"] - p["x"])))
    )
    return let(slopes, lambda s: F.coalesce(median_of(s), F.lit(0.0)))


@F.arrow_udf(DoubleType())
def _slopes(points: pa.Array) -> pa.Array:
    x, y = (points.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    size = pc.list_value_length(points).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(median_slopes(x, y, size), pa.float64())


def median_slope_of(points: Column) -> Column:
    """theil_sen_slope of series of any length. Arrays go to Python as Arrow columns: no row holds the n^2 / 2 slopes of its series in the
    JVM, series of one length are computed together, and the middle slope of long ones is selected by counting."""
    return _slopes(points)


def mad_sigma(values: Column) -> Column:
    """1.4826 times the median absolute deviation."""
    return let(median_of(values), lambda m: F.lit(1.4826) * median_of(F.transform(values, lambda v: F.abs(v - m))))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def pstdev_of(values: Column) -> Column:
    return let(mean_of(values), lambda m: F.sqrt(mean_of(F.transform(values, lambda v: (v - m) * (v - m)))))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true in an array of booleans."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    step = lambda s, f: F.struct(F.when(f, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(f, s["run"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(flags, start, step, lambda s: s["best"])


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


# The rational approximations of erfc (Numerical Recipes, fractional error under 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf(z: Column) -> Column:
    """P(N(0,1) <= z), by the approximation of erfc (absolute error under 1e-7)."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = F.lit(c) + t * poly
    tail = F.lit(0.5) * t * F.exp(-x * x + poly)
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def brier(p: Column, outcome: Column) -> Column:
    return F.pow(p - outcome.cast("double"), 2)


def log_loss(p: Column, outcome: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -F.when(outcome.cast("boolean"), F.log(q)).otherwise(F.log(1 - q))


# Percentiles of an ascending array: the conventions differ on purpose and are never mixed.
def pct_floor(s: Column, q: float) -> Column:
    """Element int(q * n)."""
    return F.element_at(s, (F.floor(F.lit(q) * F.size(s)) + 1).cast("int"))


def pct_clamped(s: Column, q: float) -> Column:
    """Element min(n - 1, int(q * n))."""
    return F.element_at(s, F.least(F.size(s), F.floor(F.lit(q) * F.size(s)) + 1).cast("int"))


def pct_nearest(s: Column, q: float) -> Column:
    """Element round(q * (n - 1)), halves to even."""
    return F.element_at(s, half_even(F.lit(q) * (F.size(s) - 1)) + 1)


def upper_median(s: Column) -> Column:
    """Element n // 2."""
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


# Acklam's rational approximation of the inverse normal distribution (relative error under 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column, low: float = 0.02425) -> Column:
    """z with P(N(0,1) <= z) = p, p clipped to [1e-6, 1 - 1e-6]."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    tail = lambda t: let(F.sqrt(-2 * F.log(t)), lambda s: _horner(_C, s) / _horner((*_D, 1.0), s))
    middle = let(q - 0.5, lambda r: _horner(_A, r * r) * r / _horner((*_B, 1.0), r * r))
    return F.when(q < low, tail(q)).when(q > 1 - low, -tail(1 - q)).otherwise(middle)


# Nodes and weights of the Gauss-Legendre rule of order 20 (one half; the other mirrors it).
_NODES = (0.0765265, 0.2277859, 0.3737061, 0.5108670, 0.6360537, 0.7463319, 0.8391170, 0.9122344, 0.9639719, 0.9931286)
_WEIGHTS = (0.1527534, 0.1491730, 0.1420961, 0.1316886, 0.1181945, 0.1019301, 0.0832767, 0.0626720, 0.0406014, 0.0176140)


def normal_cdf2(a: Column, b: Column, rho: Column) -> Column:
    """P(X <= a, Y <= b) of the bivariate normal distribution: the integral of its density over the correlation, by quadrature."""
    nodes = F.array(*[F.struct(F.lit(s * x).alias("x"), F.lit(w).alias("w")) for x, w in zip(_NODES, _WEIGHTS, strict=True) for s in (1, -1)])

    def term(total: Column, node: Column) -> Column:
        r = rho * (node["x"] + 1) / 2
        return total + node["w"] * F.exp(-(a * a + b * b - 2 * r * a * b) / (2 * (1 - r * r))) / F.sqrt(1 - r * r)

    inside = normal_cdf(a) * normal_cdf(b) + rho / (4 * math.pi) * F.aggregate(nodes, F.lit(0.0), term)
    return F.when(rho >= 0.999, normal_cdf(F.least(a, b))).when(rho <= -0.999, F.greatest(F.lit(0.0), normal_cdf(a) + normal_cdf(b) - 1)).otherwise(inside)


def significant(x: Column, digits: int = 4) -> Column:
    """x to so many significant digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when((x == 0) | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.bround(x / unit, 0) * unit)
