"""Column profiles in a few aggregations, whatever the number of columns.

One aggregation has all moments and counts of all columns; one over the distinct values of all columns, each
with its count, has distinct counts, modes and entropies, and ranges of it have the exact quantiles of all
columns; one, which needs the quartiles, the outliers. Only gaps between times are worked out column by column. Results are long frames (field, metric,
value) or one row per field.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..types import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, clean, distinct_key, is_missing, logical_types, num, quoted

NUMBER = (INTEGER, FLOAT)


def long_form(row: DataFrame, cells: dict[tuple[str, str], str]) -> DataFrame:
    """One row of many columns as rows (field, metric, value). cells: (field, metric) to column name."""
    parts = [F.struct(F.lit(f).alias("field"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for (f, m), c in cells.items()]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def repeats_percent(df: DataFrame, name: str, null_is_value: bool = True) -> Column:
    """Rows beyond the first of their value, in percent; null is a value like others, or each null counts as a repeat."""
    kinds = F.count_distinct(distinct_key(df, name))
    if null_is_value:
        kinds = kinds + F.coalesce(F.max(is_missing(df, name).cast("int")), F.lit(0))
    return F.try_divide(100.0 * (F.count("*") - kinds), F.count("*"))


def value_counts(df: DataFrame, columns: list[Column]) -> DataFrame:
    """i, v, l, s, n: how often each value of each column occurs, in one shuffle for all; v is a floating-point value, l a
    whole one, s any other as text, and all are null for null."""
    kinds = [f.dataType for f in df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).schema]
    none = {"v": F.lit(None).cast("double"), "l": F.lit(None).cast("long"), "s": F.lit(None).cast("string")}
    parts = []
    for i, (c, kind) in enumerate(zip(columns, kinds)):
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            own = {"v": F.nanvl(c.cast("double"), F.lit(None).cast("double")) + F.lit(0.0)}  # -0.0 is 0.0
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            own = {"l": c.cast("long")}
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            own = {"s": F.to_json(F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c)}
        else:
            own = {"s": c.cast("string")}
        parts.append(F.struct(F.lit(i).alias("i"), *(x.alias(k) for k, x in (none | own).items())))
    return df.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.i", "x.v", "x.l", "x.s").agg(F.count("*").alias("n"))


#: Of a row of value_counts(): whether it stands for a value, and that value as a number.
PRESENT = "v is not null or l is not null or s is not null"


def as_number() -> Column:
    return F.coalesce("v", F.col("l").cast("double"), num(F.col("s")))


def quantiles_by(per: DataFrame, shares: list[float] | dict[int, list[float]]) -> dict[int, list[float]]:
    """Exact quantiles, linear between neighbours, of counts by value (i, x, n) for all i at once, of the same shares or of
    some for each. Those without values are left out. The values are dealt into
    ranges and these summed up; only those that hold a wanted rank are ordered, a task each. What comes to the driver is
    a row for each range, and two values for each quantile."""
    ranged = per.where("x is not null").select("i", "x", "n").repartitionByRange("i", "x").withColumn("part", F.spark_partition_id()).persist()
    try:
        sizes = sorted(ranged.groupBy("i", "part").agg(F.sum("n").alias("size")).collect(), key=lambda r: (r.i, r.part))
        totals: dict[int, int] = {}
        for r in sizes:
            totals[r.i] = totals.get(r.i, 0) + r.size
        of = lambda i: shares.get(i, []) if isinstance(shares, dict) else shares
        places = {i: [((n - 1) * p, math.floor((n - 1) * p), math.ceil((n - 1) * p)) for p in of(i)] for i, n in totals.items()}
        below, holding = dict.fromkeys(totals, 0), []
        for r in sizes:
            own = sorted({k - below[r.i] for _, *ends in places[r.i] for k in ends if below[r.i] <= k < below[r.i] + r.size})
            if own:
                holding.append((r.i, r.part, below[r.i], own))
            below[r.i] += r.size
        if not holding:
            return {}
        wanted = F.broadcast(per.sparkSession.createDataFrame(holding, "i int, part int, below long, ranks array<long>"))  # two ranges at most for each quantile
        upto = F.sum("n").over(Window.partitionBy("i", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = ranged.join(wanted, ["i", "part"]).withColumn("end", upto).withColumn("begin", F.col("end") - F.col("n"))
        hit = placed.select("i", "x", "below", F.filter("ranks", lambda k: (F.col("begin") <= k) & (k < F.col("end"))).alias("ranks")).where("size(ranks) > 0")
        at = {(r.i, r.below + k): r.x for r in hit.collect() for k in r.ranks}
        between = lambda i, pos, lo, hi: at[i, lo] if at[i, lo] == at[i, hi] else (hi - pos) * at[i, lo] + (pos - lo) * at[i, hi]
        return {i: [between(i, *place) for place in own] for i, own in places.items()}
    finally:
        ranged.unpersist()


def by_value(df: DataFrame, columns: dict[Any, Column], with_quartiles: list[bool], exact: bool = True) -> tuple[dict[Any, int], dict[Any, list[float]]]:
    """(distinct non-null values, quartiles) by column; quartiles of those asked for, as far as values are numbers."""
    keys = list(columns)
    per = value_counts(df, list(columns.values()))
    asked = [i for i, q in enumerate(with_quartiles) if q]
    distinct = F.count_if(F.expr(PRESENT)).alias("kinds")
    if not asked:
        return {keys[r.i]: r.kinds for r in per.groupBy("i").agg(distinct).collect()}, {}
    if exact:
        per = per.withColumn("x", F.when(F.col("i").isin(asked), as_number())).persist()
        try:
            rows = per.groupBy("i").agg(distinct).collect()
            found = quantiles_by(per, SHARES)
        finally:
            per.unpersist()
        return {keys[r.i]: r.kinds for r in rows}, {keys[i]: q for i, q in found.items()}
    rows = per.groupBy("i").agg(distinct).collect()
    q = df.agg(*(F.percentile_approx(num(columns[keys[i]]), SHARES, 10_000).alias(f"q{i}") for i in asked)).first()
    return {keys[r.i]: r.kinds for r in rows}, {keys[i]: q[f"q{i}"] for i in asked if q[f"q{i}"]}


SHARES = [0.25, 0.5, 0.75]


def numeric(df: DataFrame, names: list[str], exact: bool = True) -> DataFrame:
    """field, metric, value for numeric columns."""
    first = []
    for i, n in enumerate(names):
        c = num(quoted(n))
        first += [
            F.count_if(is_missing(df, n)).alias(f"nulls_{i}"),
            stats.percent(c.isNull()).alias(f"null_percentage_{i}"),
            F.avg(c).alias(f"mean_{i}"),
            F.stddev_samp(c).alias(f"std_{i}"),
            F.min(c).alias(f"min_{i}"),
            F.max(c).alias(f"max_{i}"),
            stats.skew(c).alias(f"skewness_{i}"),
            stats.kurt(c).alias(f"kurtosis_{i}"),
            stats.variation(c).alias(f"coefficient_of_variation_{i}"),
        ]
    row = df.agg(F.count("*").alias("rows"), *first).first()
    text = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]  # numbers in text: 1 and 1.0 are one number, but two texts
    kinds, quartiles = by_value(df, {n: clean(df, n) for n in names} | {("number", n): num(quoted(n)) for n in text}, [True] * len(names) + [False] * len(text), exact)
    second, cells = [], {}
    plain = ("null_percentage", "mean", "std", "min", "max", "skewness", "kurtosis", "coefficient_of_variation")
    for i, n in enumerate(names):
        q = quartiles.get(n) or [None] * 3
        own = {m: row[f"{m}_{i}"] for m in plain} | {"p25": q[0], "median": q[1], "p75": q[2], "unique_count": float(kinds.get(("number", n) if n in text else n, 0))}
        own["duplicate_percentage"] = 100.0 * (row.rows - kinds.get(n, 0) - (row[f"nulls_{i}"] > 0)) / row.rows if row.rows else None
        second.append(F.coalesce(stats.percent(stats.outside(num(quoted(n)), q[0], q[2])), F.lit(0.0)).alias(f"outlier_percentage_{i}"))
        second += [F.lit(value).cast("double").alias(f"{m}_{i}") for m, value in own.items()]
        cells |= {(n, m): f"{m}_{i}" for m in (*own, "outlier_percentage")}
    wide = df.agg(*second)
    for i, n in enumerate(names):
        wide = wide.withColumn(f"flag_{i}", stats.bias_flag(F.col(f"skewness_{i}"), F.col(f"kurtosis_{i}")).cast("int"))
        wide = wide.withColumn(f"score_{i}", stats.profile_score(FLOAT, **{m: F.col(f"{m}_{i}") for m in ("null_percentage", "duplicate_percentage", "outlier_percentage", "skewness")}))
        cells[n, "bias_flag"], cells[n, "quality_score"] = f"flag_{i}", f"score_{i}"
    return long_form(wide, cells)


def strings(df: DataFrame, names: list[str]) -> DataFrame:
    """field, unique_values, total_values, null_percentage, duplicate_percentage, cardinality_ratio, avg_length, mode,
    mode_frequency, bias_flag, quality_score for text columns. The mode is the smallest of the most frequent."""
    per = value_counts(df, [clean(df, n).cast("string") for n in names])
    n, s, rows = F.col("n"), F.col("s"), F.col("rows")
    out = per.groupBy("i").agg(
        F.sum("n").alias("rows"), F.count("s").alias("unique_values"), F.coalesce(F.sum(F.when(s.isNotNull(), n)), F.lit(0)).alias("total_values"), F.count_if(s.isNull()).alias("null_kinds"),
        F.sum(F.length(s) * n).alias("chars"), F.min(F.when(s.isNotNull(), F.struct((-n).alias("n"), s.alias("s")))).alias("top"),
    )
    empty = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, field string")
    out = F.broadcast(empty).join(out, "i", "left").na.fill(0, ["rows", "unique_values", "total_values", "null_kinds"])  # a row per column, without rows too
    total = F.col("total_values")
    ratio, share = F.try_divide(F.col("unique_values").cast("double"), total), F.try_divide(-F.col("top.n").cast("double"), total)
    out = out.select(
        "field", "unique_values", "total_values", F.try_divide(100.0 * (rows - total), rows).alias("null_percentage"), F.try_divide(100.0 * (rows - F.col("unique_values") - F.col("null_kinds")), rows).alias("duplicate_percentage"),
        ratio.alias("cardinality_ratio"), F.try_divide(F.col("chars").cast("double"), total).alias("avg_length"), F.col("top.s").alias("mode"), (100 * share).alias("mode_frequency"), F.coalesce(share > 0.8, F.lit(False)).alias("bias_flag"),
    )
    return out.withColumn("quality_score", stats.profile_score(STRING, **{m: F.col(m) for m in ("null_percentage", "duplicate_percentage", "cardinality_ratio")}))


def booleans(df: DataFrame, names: list[str]) -> DataFrame:
    """field, metric, value: the shares of true and false among non-null values, in percent."""
    row = df.agg(*(x for i, n in enumerate(names) for x in (100 * F.avg(quoted(n).cast("int")), 100 * F.avg((~quoted(n)).cast("int"))))).toDF(*(f"{m}_{i}" for i in range(len(names)) for m in ("t", "f")))
    return long_form(row, {(n, m): f"{m[0]}_{i}" for i, n in enumerate(names) for m in ("true_percentage", "false_percentage")})


def dealt(per: DataFrame, value: str) -> DataFrame:
    """per, a row per distinct value, with `part`: the range of the value, between quantiles of the distinct values,
    so that no outlier leaves most of them in one range."""
    parts = max(1, int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = per.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    return per.withColumn("part", stats.place(F.col(value), sorted(set(bounds or []))))


def below(per: DataFrame) -> DataFrame:
    """part, size, below for counts by value: how many rows a range has, and how many the ranges before it."""
    sizes = per.groupBy("part").agg(F.sum("n").alias("size"))  # a row per range
    return sizes.withColumn("below", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def time_gaps(df: DataFrame, name: str) -> DataFrame:
    """gap_seconds, n: the gaps between neighbouring times and how often each occurs. Equal times are counted
    first, and the others of each range are ordered in that range; a range passes its last time on, so no single
    task orders all."""
    times = df.select(F.unix_micros(quoted(name).try_cast("timestamp")).alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("n"))
    ranged = dealt(times, "t")
    ends = ranged.groupBy("part").agg(F.max("t").alias("hi"))  # a row per range
    before = ends.withColumn("prev", F.lag("hi").over(Window.orderBy("part"))).select("part", "prev")
    inside = ranged.withColumn("lag", F.lag("t").over(Window.partitionBy("part").orderBy("t")))
    between = inside.join(F.broadcast(before), "part").select(((F.col("t") - F.coalesce("lag", "prev")) / 1e6).alias("gap_seconds"), F.lit(1).cast("long").alias("n")).where("gap_seconds is not null")
    same = ranged.where("n > 1").select(F.lit(0.0).alias("gap_seconds"), (F.col("n") - 1).alias("n"))
    return between.unionByName(same).groupBy("gap_seconds").agg(F.sum("n").alias("n"))


def temporal(df: DataFrame, name: str) -> DataFrame:
    """One row: field, median_gap, max_gap (seconds), temporal_anomaly (max over median less 2, if over 2)."""
    gaps = time_gaps(df, name).persist()
    try:
        middle = quantiles_by(gaps.select(F.lit(0).alias("i"), F.col("gap_seconds").alias("x"), "n"), [0.5]).get(0, [None])[0]
        top = gaps.agg(F.max("gap_seconds")).first()[0]
    finally:
        gaps.unpersist()
    odd = top / middle - 2 if middle and top / middle > 2 else 0.0
    return df.sparkSession.createDataFrame([(name, middle, top, odd)], "field string, median_gap double, max_gap double, temporal_anomaly double")


def entropy(df: DataFrame, names: list[str]) -> DataFrame:
    """field, entropy (nats), gini_impurity over the shares of non-null values."""
    per = value_counts(df, [clean(df, n) for n in names]).where(PRESENT)
    n = F.col("n").cast("double")
    sums = per.groupBy("i").agg(F.sum(n).alias("total"), F.sum(n * F.log(n)).alias("logs"), F.sum(n * n).alias("squares"))
    fields = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, field string")
    total = F.col("total")
    out = F.broadcast(fields).join(sums, "i", "left")
    return out.select("field", F.coalesce(F.log(total) - F.col("logs") / total, F.lit(0.0)).alias("entropy"), F.coalesce(1 - F.col("squares") / (total * total), F.lit(0.0)).alias("gini_impurity"))


def gini(df: DataFrame, name: str) -> DataFrame:
    """field, gini of a numeric column: rank-weighted sums over its distinct values; 0 without values or total.

    Ranks come from counts by value, dealt into ranges whose sizes are summed up first, so no task orders all."""
    per = dealt(df.select(num(quoted(name)).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")), "v")
    prev = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("inside", prev).join(F.broadcast(below(per)), "part").withColumn("prev", F.col("inside") + F.col("below"))
    n = F.col("n").cast("double")
    row = ranked.agg(F.sum(F.col("v") * (n * F.col("prev") + n * (n + 1) / 2)).alias("w"), F.sum(F.col("v") * n).alias("s"), F.sum(n).alias("m"))
    value = F.when(F.coalesce("s", F.lit(0.0)) != 0, (2 * F.col("w") - (F.col("m") + 1) * F.col("s")) / (F.col("m") * F.col("s"))).otherwise(0.0)
    return row.select(F.lit(name).alias("field"), value.alias("gini"))


def mad_outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """field, mad, mad_outlier_percentage: non-null values further from the median than three MADs; 0 if the MAD is 0."""
    per = value_counts(df, [num(quoted(n)) for n in names]).withColumn("x", F.col("v")).persist()

    def medians(table: DataFrame) -> list[float | None]:
        found = quantiles_by(table, [0.5])
        return [found.get(i, [None])[0] for i in range(len(names))]

    try:
        middle = medians(per)
        at = F.element_at(F.array(*(F.lit(m).cast("double") for m in middle)), F.col("i") + 1)
        mads = medians(per.withColumn("x", F.abs(F.col("x") - at)))
    finally:
        per.unpersist()
    away = [F.abs(num(quoted(n)) - F.lit(m).cast("double")) for n, m in zip(names, middle)]
    row = df.agg(*(F.coalesce(100 * F.avg((a > 3 * F.lit(m).cast("double")).cast("int")), F.lit(0.0)) if m else F.lit(0.0) for a, m in zip(away, mads))).toDF(*(f"c{i}" for i in range(len(names))))
    parts = [F.struct(F.lit(n).alias("field"), F.lit(m).cast("double").alias("mad"), F.col(f"c{i}").cast("double").alias("mad_outlier_percentage")) for i, (n, m) in enumerate(zip(names, mads))]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def null_percentages(df: DataFrame) -> DataFrame:
    """field, nulls, null_percentage for all columns, in one aggregation."""
    names = df.columns
    row = df.agg(F.count("*").alias("rows"), *(F.count_if(is_missing(df, n)).alias(f"c{i}") for i, n in enumerate(names)))
    parts = [F.struct(F.lit(n).alias("field"), F.col(f"c{i}").alias("nulls"), F.try_divide(100.0 * F.col(f"c{i}"), "rows").alias("null_percentage")) for i, n in enumerate(names)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def missing_pattern(df: DataFrame, names: list[str]) -> DataFrame:
    """field_a, field_b, correlation of the null indicators; null for a column that is always or never null."""
    hot = [is_missing(df, n).cast("double") for n in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names))]
    row = df.agg(*(F.try_divide(F.covar_pop(hot[i], hot[j]), F.stddev_pop(hot[i]) * F.stddev_pop(hot[j])).alias(f"c{i}_{j}") for i, j in pairs))
    parts = [F.struct(F.lit(names[i]).alias("field_a"), F.lit(names[j]).alias("field_b"), F.col(f"c{i}_{j}").alias("correlation")) for i, j in pairs]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row, duplicate_rows: rows beyond the first of their kind."""
    keyed = df.select(*(distinct_key(df, n).alias(f"c{i}") for i, n in enumerate(df.columns)))
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


@dataclass
class Profiler:
    """Profiles all columns by type, with metrics of one's own: register(type, name, func), where func
    takes a Column and returns an aggregate Column. One that fails is null, and the others stand."""

    custom: dict[str, dict[str, Callable[[Column], Column]]] = field(default_factory=dict)

    def register(self, kind: str, name: str, func: Callable[[Column], Column]) -> None:
        self.custom.setdefault(kind, {})[name] = func

    def report(self, df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
        """field, metric, value."""
        kinds = kinds or logical_types(df)
        of = lambda *k: [n for n, t in kinds.items() if t in k]
        parts = []
        if of(*NUMBER):
            parts.append(numeric(df, of(*NUMBER)))
        if of(STRING):
            wide = strings(df, of(STRING))
            metrics = ["unique_values", "total_values", "null_percentage", "duplicate_percentage", "cardinality_ratio", "avg_length", "mode_frequency", "quality_score"]
            parts.append(wide.select("field", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select("field", "x.*"))
        if of(BOOLEAN):
            parts.append(booleans(df, of(BOOLEAN)))
        for n in of(DATETIME):
            base = df.agg(stats.percent(is_missing(df, n)).alias("null_percentage"), repeats_percent(df, n).alias("duplicate_percentage")).withColumn("k", F.lit(1)).join(temporal(df, n).withColumn("k", F.lit(1)), "k")
            base = base.withColumn("quality_score", stats.profile_score(DATETIME, **{m: F.col(m) for m in ("null_percentage", "duplicate_percentage", "temporal_anomaly")}))
            parts.append(long_form(base, {(n, m): m for m in ("null_percentage", "duplicate_percentage", "median_gap", "max_gap", "temporal_anomaly", "quality_score")}))
        own = {(n, m): lambda f=f, n=n: f(clean(df, n)) for n, t in kinds.items() for m, f in self.custom.get(t, {}).items()}
        if own:
            from .metrics import as_number, custom

            rows = [(n, m, as_number(v)) for (n, m), v in custom(df, own).items()]
            parts.append(df.sparkSession.createDataFrame(rows, "field string, metric string, value double"))
        return reduce(DataFrame.unionByName, parts)
