"""Profiles that add up: a stored state for each slice of a table, a day or a partition, and their union.

A state is one row for each slice and field: counts, the mean and the central moments, the ends, and sketches of the
distinct values and of the order. States of slices are merged without reading the slices again: a new day costs its own
rows, and drift between any two spans of days costs a few rows. Merged moments, counts and ends are those of the whole
table; the sketches' errors are those of one sketch over all rows (ERRORS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import BOOLEAN, FLOAT, INTEGER, STRING, clean, distinct_key, logical_types, num, quoted

NUMBER = (INTEGER, FLOAT)
LG_K, K = 12, 200
#: One standard error of the number of distinct values, and how far a quantile's rank may be off, as shares.
ERRORS = {"approx_unique": 1.04 / 2 ** (LG_K / 2), "rank": 0.0133}
STATE = (
    "field string, kind string, rows long, present long, mean double, m2 double, m3 double, m4 double, low double, high double, "
    "trues long, chars long, distinct binary, ranks binary"
)
NAMES = [x.split()[0] for x in STATE.split(", ")]


def _own(df: DataFrame, n: str, kind: str) -> Column:
    """The state of one field as an aggregate."""
    c = clean(df, n)
    x = num(c) if kind in NUMBER else F.lit(None).cast("double")
    count = F.count(c)
    m2 = F.var_pop(x) * F.count(x)
    spread = F.var_pop(x)
    key = distinct_key(df, n).cast("string") if kind != INTEGER else c.cast("long")
    parts = {
        "field": F.lit(n), "kind": F.lit(kind), "rows": F.count("*"), "present": count, "mean": F.avg(x), "m2": m2,
        "m3": F.coalesce(F.skewness(x), F.lit(0.0)) * F.pow(spread, F.lit(1.5)) * F.count(x), "m4": (F.coalesce(F.kurtosis(x), F.lit(-3.0)) + 3) * spread * spread * F.count(x),
        "low": F.min(x), "high": F.max(x),
        "trues": F.count_if(c.cast("boolean")) if kind == BOOLEAN else F.lit(None).cast("long"), "chars": F.sum(F.length(c.cast("string"))) if kind == STRING else F.lit(None).cast("long"),
        "distinct": F.hll_sketch_agg(key, F.lit(LG_K)), "ranks": F.kll_sketch_agg_double(x, F.lit(K)) if kind in NUMBER else F.lit(None).cast("binary"),
    }
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def build(df: DataFrame, by: dict[str, Column] | None = None, fields: list[str] | None = None) -> DataFrame:
    """The states of all slices and fields in one aggregation, whose partial results are states themselves. by: the
    columns that tell slices apart."""
    kinds = logical_types(df)
    fields = fields if fields is not None else [n for n in df.columns if n not in (by or {})]
    keys = [c.alias(n) for n, c in (by or {}).items()]
    row = df.groupBy(*keys).agg(*(_own(df, n, kinds[n]).alias(f"_s{i}") for i, n in enumerate(fields)))
    return row.select(*map(quoted, by or {}), F.explode(F.array(*(F.col(f"_s{i}") for i in range(len(fields))))).alias("_s")).select(*map(quoted, by or {}), "_s.*")


def merge(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The states of the unions of slices that agree in `by`, or of all."""
    keys = [*(by or []), "field", "kind"]
    n = F.when(F.col("mean").isNotNull(), F.col("present")).otherwise(0)
    # moments about the common mean, from those about each slice's own
    common = F.sum(F.col("mean") * n).over(Window.partitionBy(*keys)) / F.nullif(F.sum(n).over(Window.partitionBy(*keys)), F.lit(0))
    s = states.withColumns({"_n": n, "_mean": common}).withColumn("_d", F.col("mean") - F.col("_mean"))
    n, d, m2, m3, m4 = (F.col(c) for c in ("_n", "_d", "m2", "m3", "m4"))
    merged = s.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.first("_mean", True).alias("mean"), F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("trues").alias("trues"), F.sum("chars").alias("chars"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )
    return merged.select(*(by or []), *NAMES)


def metrics(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by ..,) field, metric, value."""
    n, rows, var = F.col("present").cast("double"), F.col("rows"), F.try_divide("m2", "present")
    g1 = F.try_divide("m3", F.col("present") * F.pow(var, F.lit(1.5)))
    g2 = F.try_divide("m4", n * var * var) - 3
    std = F.sqrt(F.try_divide(F.col("m2"), n - 1))
    number = F.col("kind").isin(*NUMBER)
    quantile = lambda p: F.kll_sketch_get_quantile_double("ranks", F.lit(p))
    cells = {
        "rows": rows.cast("double"),
        "null_percentage": F.try_divide(100.0 * (rows - F.col("present")), rows),
        "approx_unique": F.hll_sketch_estimate("distinct").cast("double"),
        "mean": F.col("mean"),
        "std": F.when(number & (n > 1), std),
        "min": F.col("low"),
        "max": F.col("high"),
        "skewness": F.when(number & (n >= 3), F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))),
        "kurtosis": F.when(number & (n >= 4), F.coalesce(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)), F.lit(0.0))),
        "coefficient_of_variation": F.when(number, F.coalesce(F.try_divide(std, "mean"), F.lit(0.0))),
        **{m: F.when(number & (n > 0), quantile(p)) for m, p in (("approx_p25", 0.25), ("approx_median", 0.5), ("approx_p75", 0.75))},
        "true_percentage": F.try_divide(100.0 * F.col("trues"), F.col("present")),
        "avg_length": F.try_divide(F.col("chars").cast("double"), n),
    }
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in cells.items()))
    return states.select(*(by or []), "field", F.explode(parts).alias("_x")).select(*(by or []), "field", "_x.*").where("value is not null")


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """field, metric, before, now, drift_percentage of two sets of states, each taken as one."""
    a, b = (metrics(merge(s)).withColumnRenamed("value", name) for s, name in ((before, "before"), (now, "now")))
    change = F.try_divide(100.0 * (F.col("now") - F.col("before")), F.col("before"))
    return a.join(b, ["field", "metric"], "full").select("field", "metric", "before", "now", change.alias("drift_percentage"))


def save(states: DataFrame, path: str, by: list[str]) -> None:
    """Add the states of slices to a table partitioned by slice; those of a slice that is there already are replaced, so a
    run that is repeated changes nothing."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
