"""How good a candidate is: aggregates over the old and the new value of the same row, so any number of
candidates is evaluated in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..types import DATETIME, FLOAT, INTEGER, STRING, num, seconds
from . import profile


def counted_share(df: DataFrame, c: Column) -> DataFrame:
    """One row: k, and the most frequent value's share of the non-null ones in percent."""
    per = df.select(c.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    return per.agg(F.lit(1).alias("k"), F.try_divide(100.0 * F.max("n"), F.sum("n")).alias("share"))


def imputation_error(old: Column, new: Column) -> dict[str, Column]:
    """rmse and mae over the rows that had a value."""
    d = F.when(num(old).isNotNull(), num(new) - num(old))
    return {"rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d))}


def text_accuracy(old: Column, new: Column) -> dict[str, Column]:
    """Rows with a value that kept it, in percent."""
    return {"accuracy": 100 * F.avg(F.when(old.isNotNull(), (old.cast("string") == new.cast("string")).cast("int")))}


def time_error(old: Column, new: Column) -> dict[str, Column]:
    """rmse and mae in seconds, and their mean."""
    d = F.when(seconds(old).isNotNull(), seconds(new) - seconds(old))
    rmse, mae = F.sqrt(F.avg(d * d)), F.avg(F.abs(d))
    return {"rmse": rmse, "mae": mae, "combined": (rmse + mae) / 2}


def minmax_error(new: Column) -> dict[str, Column]:
    """The share of rows outside [0, 1]; nulls count in the total."""
    return {"error": F.avg(F.coalesce(~num(new).between(0, 1), F.lit(False)).cast("int"))}


def zscore_error(new: Column) -> dict[str, Column]:
    return {"error": F.abs(F.avg(num(new))) + F.abs(F.stddev_samp(num(new)) - 1)}


def skew_reduction(old: Column, new: Column) -> dict[str, Column]:
    """By how much the absolute skewness (of the population) falls."""
    return {"reduction": F.abs(F.coalesce(F.skewness(num(old)), F.lit(0.0))) - F.abs(F.coalesce(F.skewness(num(new)), F.lit(0.0)))}


def outlier_reduction(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """One row: before, after, reduction of the outlier percentage. Quartiles first, then the shares."""
    per = profile.value_counts(df, [num(old), num(new)]).select("i", profile.as_number().alias("x"), "n")
    q = profile.quantiles_by(per, [0.25, 0.75])
    share = lambda c, b: F.coalesce(stats.percent(stats.outside(num(c), b and b[0], b and b[1])), F.lit(0.0))
    return df.agg(share(old, q.get(0)).alias("before"), share(new, q.get(1)).alias("after")).withColumn("reduction", F.col("before") - F.col("after"))


def dominance_reduction(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """One row: before, after, reduction of the most frequent value's share in percent."""
    shares = [counted_share(df, c) for c in (old, new)]
    return shares[0].withColumnRenamed("share", "before").join(shares[1].withColumnRenamed("share", "after"), "k").select("before", "after", (F.col("before") - F.col("after")).alias("reduction"))


def spread_reduction(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """One row: before, after, reduction of the mean absolute deviation of times, in seconds; nulls are ignored."""
    row = df.agg(F.avg(seconds(old)), F.avg(seconds(new))).first()
    away = [F.avg(F.abs(seconds(c) - F.lit(m).cast("double"))) for c, m in zip((old, new), row)]
    return df.agg(away[0].alias("before"), away[1].alias("after")).withColumn("reduction", F.col("before") - F.col("after"))


def badness(family: str, kind: str, name: str, old: Column, new: Column) -> Column | None:
    """How bad a candidate of a family is, as an aggregate: the less the better. None where its family has no measure for
    it: of imputations, for flags; of scales, for those that are neither a range nor a standard score."""
    if family == "impute":
        measures = {INTEGER: imputation_error, FLOAT: imputation_error, DATETIME: time_error}
        return measures[kind](old, new)["rmse"] if kind in measures else -text_accuracy(old, new)["accuracy"] if kind == STRING else None
    if family == "normalize":
        return minmax_error(new)["error"] if "minmax" in name else zscore_error(new)["error"] if "zscore" in name else None
    if family == "bias" and kind in (INTEGER, FLOAT):
        return -skew_reduction(old, new)["reduction"]
    return F.max(F.lit(0.0))
