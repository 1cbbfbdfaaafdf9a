"""Sample sizes, and samples of exactly that size, the same on every run and every cluster."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import quoted

#: Rounded deviates for the usual confidence levels; others are computed.
Z_VALUES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def z_value(confidence: float) -> float:
    return Z_VALUES.get(round(confidence, 6)) or NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def sample_size(population: int, confidence: float = 0.95, margin: float = 0.05, p: float = 0.5) -> int:
    """Cochran's size with the correction for a finite population."""
    if population <= 0:
        raise ValueError("the population must have members")
    n0 = z_value(confidence) ** 2 * p * (1 - p) / margin**2
    return math.ceil(n0 / (1 + (n0 - 1) / population))


def shuffled(df: DataFrame, seed: int, keys: list[str] | None = None) -> Column:
    """A pseudo-random order that depends on the rows (or their keys) and the seed, not on the plan."""
    return F.xxhash64(F.lit(seed), *(quoted(n) for n in keys or df.columns))


def simple(df: DataFrame, n: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Exactly n rows (all, if there are fewer): Spark keeps n per task and merges them."""
    return df.orderBy(shuffled(df, seed, keys), *(quoted(k) for k in keys or [])).limit(n)


def stratified(df: DataFrame, by: str | Column, sizes: dict, seed: int = 42, keys: list[str] | None = None, keep_null: bool = False) -> DataFrame:
    """For each stratum the listed number of rows; all rows of a stratum that isn't listed. Rows of a null
    stratum go, unless keep_null. `by`: a column or any expression.

    A stratum may hold most of the rows: a bound on the hash first keeps about twice as many as are wanted
    (counts by stratum tell the share), so the ranking window sees few rows."""
    stratum = quoted(by) if isinstance(by, str) else by
    rows = df.withColumn("_stratum", stratum)
    if not keep_null:
        rows = rows.where("_stratum is not null")
    listed = [k for k in sizes if k is not None]
    if not listed:
        return rows.drop("_stratum")
    wanted = F.try_element_at(F.create_map(*(x for k in listed for x in (F.lit(k).cast(rows.schema["_stratum"].dataType), F.lit(int(sizes[k]))))), F.col("_stratum"))
    rows = rows.withColumn("_wanted", wanted).withColumn("_order", shuffled(df, seed, keys))
    counts = rows.where("_wanted is not null").groupBy("_stratum").agg(F.count("*").alias("_size"))  # a row for each listed stratum
    rows = rows.join(F.broadcast(counts), "_stratum", "left")
    unit = F.pmod(F.col("_order"), F.lit(1 << 40)) / float(1 << 40)
    bound = (F.col("_wanted") + 8 * F.sqrt("_wanted") + 50) / F.col("_size")  # eight deviations over the wanted number
    few = rows.where("_wanted is not null").where(unit < bound)
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy(unit, "_order", *(quoted(k) for k in keys or [])))
    picked = few.withColumn("_rank", rank).where("_rank <= _wanted")
    return rows.where("_wanted is null").select(*df.columns).unionByName(picked.select(*df.columns))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by `order`. An aggregation, whose partial results leave one row a key and task."""
    first = F.min(F.struct(*(quoted(n).alias(f"o{i}") for i, n in enumerate(order)), F.struct(*(quoted(n) for n in df.columns)).alias("row"))).alias("x")
    return df.groupBy(*(quoted(k) for k in keys)).agg(first).select("x.row.*")


def index_sort(df: DataFrame, key: str) -> DataFrame:
    """Sorted by the key, nulls last; a range-partitioned sort."""
    return df.orderBy(quoted(key).asc_nulls_last())


def _setting(name: str, default: float) -> float:
    return float(os.environ.get(name, default))


@dataclass
class Sampler:
    """Samples of the size that a confidence level and a margin of error ask for; the defaults come from
    CONFIDENCE_LEVEL, MARGIN_ERROR and ESTIMATED_P of the environment."""

    df: DataFrame
    population: int | None = None
    confidence: float = field(default_factory=lambda: _setting("CONFIDENCE_LEVEL", 0.95))
    margin: float = field(default_factory=lambda: _setting("MARGIN_ERROR", 0.05))
    p: float = field(default_factory=lambda: _setting("ESTIMATED_P", 0.5))
    seed: int = 42

    @property
    def size(self) -> int:
        return sample_size(self.population or self.df.count(), self.confidence, self.margin, self.p)

    def sample(self, keys: list[str] | None = None) -> DataFrame:
        return simple(self.df, self.size, self.seed, keys)

    def stratified(self, by: str | Column, sizes: dict, keys: list[str] | None = None, keep_null: bool = False) -> DataFrame:
        return stratified(self.df, by, sizes, self.seed, keys, keep_null)
