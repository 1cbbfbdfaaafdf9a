"""Validation rules as predicates that are true where a row violates them.

Any number of predicates is counted in one aggregation (`evaluate`). Only uniqueness and references to
other tables need a shuffle of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import clean, distinct_key, is_missing, num, quoted, ts

RESULT = "rule string, field string, violations long, ok boolean"


@dataclass(frozen=True)
class Check:
    rule: str
    field: str
    violated: Column


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def positive(df: DataFrame, field: str) -> Check:
    """Under zero; zero and null are fine."""
    return Check("positive", field, _true(num(quoted(field)) < 0))


def not_future(df: DataFrame, field: str, as_of: str | None = None) -> Check:
    """Later than as_of (now, if not given); what can't be read as a time is fine."""
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return Check("not_future", field, _true(ts(quoted(field)) > now))


def not_null(df: DataFrame, field: str) -> Check:
    return Check("not_null", field, is_missing(df, field))


def in_range(df: DataFrame, field: str, lo: float | None = None, hi: float | None = None) -> Check:
    c, bad = num(quoted(field)), F.lit(False)
    if lo is not None:
        bad = bad | (c < lo)
    if hi is not None:
        bad = bad | (c > hi)
    return Check("range", field, _true(bad))


def allowed_values(df: DataFrame, field: str, values: Iterable) -> Check:
    """Not one of the values; a null violates unless None is listed."""
    values = list(values)
    member = _true(clean(df, field).isin([v for v in values if v is not None]))
    return Check("allowed_values", field, ~(member | is_missing(df, field) if None in values else member))


def full_match(c: Column, pattern: str) -> Column:
    """The whole text matches; word classes are Unicode, and a closing newline counts as text."""
    return c.rlike(rf"(?U)\A(?:{pattern})\z")


def regex(df: DataFrame, field: str, pattern: str) -> Check:
    """The text of the value doesn't match as a whole; a null is tested as the text None."""
    return Check("regex", field, ~full_match(F.coalesce(clean(df, field).cast("string"), F.lit("None")), pattern))


def string_length(df: DataFrame, field: str, lo: int | None = None, hi: int | None = None) -> Check:
    n, bad = F.length(F.coalesce(clean(df, field).cast("string"), F.lit("None"))), F.lit(False)
    if lo is not None:
        bad = bad | (n < lo)
    if hi is not None:
        bad = bad | (n > hi)
    return Check("string_length", field, bad)


def date_order(df: DataFrame, start: str, end: str) -> Check:
    """The start is later than the end; nulls are fine."""
    return Check("date_order", f"{start}, {end}", _true(ts(quoted(start)) > ts(quoted(end))))


def outlier(df: DataFrame, field: str, threshold: float = 3.0) -> Check:
    """Further from the mean than `threshold` sample deviations. One aggregation beforehand."""
    c = num(quoted(field))
    row = df.agg(F.avg(c), F.stddev_samp(c)).first()
    bad = F.abs(c - F.lit(row[0]).cast("double")) > threshold * F.lit(row[1]).cast("double")
    return Check("outlier", field, _true(bad))


def expression(df: DataFrame, name: str, condition: str) -> Check:
    """A rule between fields: the SQL condition doesn't hold. An unknown (null) outcome is fine."""
    return Check(name, condition, _true(~F.expr(condition)))


def present(df: DataFrame, field: str) -> bool:
    return field in df.columns


def evaluate(df: DataFrame, checks: list[Check]) -> DataFrame:
    """RESULT: a row per check, all counted in one aggregation."""
    row = df.agg(*(F.count_if(c.violated).alias(f"c{i}") for i, c in enumerate(checks)))
    parts = [F.struct(F.lit(c.rule).alias("rule"), F.lit(c.field).alias("field"), F.col(f"c{i}").alias("violations"), (F.col(f"c{i}") == 0).alias("ok")) for i, c in enumerate(checks)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def unique(df: DataFrame, field: str) -> DataFrame:
    """RESULT: rows beyond the first of their value; nulls are equal to each other."""
    per = df.groupBy(distinct_key(df, field).alias("k")).agg(F.count("*").alias("n"))
    bad = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return per.agg(F.lit("unique").alias("rule"), F.lit(field).alias("field"), bad.alias("violations"), (bad == 0).alias("ok"))


def orphans(df: DataFrame, field: str, reference: DataFrame, key: str) -> DataFrame:
    """The rows whose value isn't among the keys; null is none of them. Spark broadcasts the keys or shuffles by size."""
    keys = reference.select(quoted(key).alias("_key")).where("_key is not null").distinct()
    return df.join(keys, df[field] == keys["_key"], "left_anti")


def foreign_key(df: DataFrame, field: str, reference: DataFrame, key: str) -> DataFrame:
    bad = F.count("*")
    return orphans(df, field, reference, key).agg(F.lit("foreign_key").alias("rule"), F.lit(field).alias("field"), bad.alias("violations"), (bad == 0).alias("ok"))


def distribution(df: DataFrame, field: str, mean: float, std: float) -> DataFrame:
    """RESULT, 1 violation if the mean is further from the given one than the given deviation."""
    bad = F.coalesce((F.abs(F.avg(num(quoted(field))) - mean) > std).cast("long"), F.lit(0).cast("long"))
    return df.agg(F.lit("distribution").alias("rule"), F.lit(field).alias("field"), bad.alias("violations"), (bad == 0).alias("ok"))


def validate_format(df: DataFrame, field: str, pattern: str) -> DataFrame:
    """pattern, invalid_count, total_checked over the non-null values."""
    text = clean(df, field).cast("string")
    return df.agg(F.lit(pattern).alias("pattern"), F.count_if(~full_match(text, pattern)).alias("invalid_count"), F.count(text).alias("total_checked"))


#: The rules by the names that a policy may use; each makes a Check from (df, field, **options).
AVAILABLE: dict[str, Callable[..., Check]] = {
    "positive": positive,
    "not_future": not_future,
    "not_null": not_null,
    "range": in_range,
    "allowed_values": allowed_values,
    "regex": regex,
    "string_length": string_length,
    "outlier": outlier,
}
#: What generated policies call them.
ALIASES = {"no_nulls": "not_null", "positive_values": "positive", "enumerated_values": "allowed_values", "max_length": "string_length", "valid_date_format": "valid_date", "no_special_characters": "plain_text"}
AVAILABLE["valid_date"] = lambda df, field: Check("valid_date", field, ~is_missing(df, field) & ts(quoted(field)).isNull())
AVAILABLE["plain_text"] = lambda df, field: Check("plain_text", field, _true(clean(df, field).cast("string").rlike(r"[^\p{L}\p{N}\s.,;:()_/@-]")))


def named(df: DataFrame, rule: str, field: str, **options) -> Check:
    """The rule of that name or alias."""
    key = ALIASES.get(rule, rule)
    if key not in AVAILABLE:
        raise ValueError(f"no rule is called {rule}; there are {sorted(AVAILABLE)}")
    return AVAILABLE[key](df, field, **options)
