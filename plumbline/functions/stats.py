"""Aggregate expressions. Each is one Column; callers fuse as many as they like into one aggregation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew(c: Column) -> Column:
    """Adjusted for bias; null under three values, 0 without variance."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.coalesce(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def kurt(c: Column) -> Column:
    """Excess, adjusted for bias; null under four values, 0 without variance."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, F.coalesce(((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)), F.lit(0.0)))


def percent(condition: Column) -> Column:
    """How many of all rows meet it, in percent; null without rows."""
    return 100 * F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def outside(c: Column, q1: float | None, q3: float | None, guard: bool = True) -> Column:
    """Beyond 1.5 interquartile ranges of the quartiles. guard: nothing is, where both are equal."""
    if q1 is None or q3 is None or (guard and q3 <= q1):
        return F.lit(False)
    return (c < q1 - 1.5 * (q3 - q1)) | (c > q3 + 1.5 * (q3 - q1))


def variation(c: Column) -> Column:
    """Standard deviation by mean; 0 if there are no values or the mean is 0."""
    return F.when((F.count(c) > 0) & (F.avg(c) != 0), F.stddev_samp(c) / F.avg(c)).otherwise(F.lit(0.0))


def bias_flag(skewness: Column, kurtosis: Column) -> Column:
    return F.coalesce((F.abs(skewness) > 1) | (kurtosis > 3), F.lit(False))


def is_base64(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & (F.length(c) % 4 == 0) & c.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z"), F.lit(False))


def is_masked(c: Column) -> Column:
    return F.coalesce((F.length(c) <= 3) | c.endswith("***"), F.lit(False))


def penalties(kind: str, m: dict, temporal_weight: float = 10.0, most: Callable = max, size: Callable = abs, zero=0.0) -> dict:
    """What each metric takes away from 100. The only place that knows: m holds numbers, or Columns with F.greatest
    and F.abs for `most` and `size`."""
    over = lambda value, bound, weight: weight * most(value - bound, zero)
    out = {"null_percentage": 0.5 * m["null_percentage"], "duplicate_percentage": 0.2 * m["duplicate_percentage"]}
    if kind in ("integer", "float"):
        out["outlier_percentage"] = 0.5 * m["outlier_percentage"]
        out["skewness"] = over(size(m["skewness"]), 1, 10.0)
    if kind == "datetime":
        out["temporal_anomaly"] = temporal_weight * m["temporal_anomaly"]
    if kind == "string":
        out["cardinality_ratio"] = over(m["cardinality_ratio"], 0.8, 50.0)
    return out


METRICS = ("null_percentage", "duplicate_percentage", "outlier_percentage", "skewness", "temporal_anomaly", "cardinality_ratio")


def profile_score(kind: str, **m: Column) -> Column:
    """The score of a profile, 0 to 100, from Columns by metric; one that is missing or null takes nothing away."""
    known = {k: F.coalesce(m[k], F.lit(0.0)) if k in m else F.lit(0.0) for k in METRICS}
    lost = penalties(kind, known, 5.0, F.greatest, F.abs, F.lit(0.0)).values()
    return F.greatest(F.lit(100.0) - reduce(lambda x, y: x + y, lost), F.lit(0.0))


def place(c: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most c, by halving: the number of the range that c lies in."""
    if not bounds:
        return F.lit(0)
    table, halves = F.array(*map(F.lit, bounds)), F.array(*(F.lit(1 << d) for d in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(halves, F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & (F.get(table, low + step - 1) <= c), low + step).otherwise(low))
