"""Logical types, and the two conversions that all operators share: to null and to number or time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, BOOLEAN, DATETIME, STRING = "integer", "float", "boolean", "datetime", "string"

_LOGICAL = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), INTEGER),
    ((T.FloatType, T.DoubleType, T.DecimalType), FLOAT),
    ((T.BooleanType,), BOOLEAN),
    ((T.TimestampType, T.TimestampNTZType, T.DateType), DATETIME),
)


def logical(kind: T.DataType) -> str:
    """The logical type of a physical one; what isn't a number, a flag or a time is a string."""
    return next((name for kinds, name in _LOGICAL if isinstance(kind, kinds)), STRING)


def logical_types(df: DataFrame) -> dict[str, str]:
    return {f.name: logical(f.dataType) for f in df.schema}


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = quoted(name)
    return F.nanvl(c, F.lit(None).cast("double")) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c


def is_missing(df: DataFrame, name: str) -> Column:
    return clean(df, name).isNull()


def num(c: Column) -> Column:
    """As a double; null where it isn't a number."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def ts(c: Column) -> Column:
    """As a timestamp; null where it isn't one."""
    return c.try_cast("timestamp")


def seconds(c: Column) -> Column:
    return F.unix_micros(ts(c)) / 1e6


def distinct_key(df: DataFrame, name: str) -> Column:
    """Something to count distinct values by; nested values by their JSON."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(quoted(name))))
    return F.to_json(quoted(name)) if isinstance(kind, (T.StructType, T.ArrayType)) else clean(df, name)


def parse_time(df: DataFrame, name: str) -> Column:
    """A timestamp from whatever the column holds: times, text, epoch seconds, a struct with year, month,
    day and perhaps hour, minute, second, or an array of those (three values for a date, six or seven with
    a time; four and five give the date alone). Null where it can't be read."""
    kind, c = df.schema[name].dataType, quoted(name)
    part = lambda get, i, default: F.coalesce(get(i).try_cast("int"), F.lit(default))
    if isinstance(kind, T.StructType):
        names = {n.lower(): n for n in kind.names}
        field = lambda n: c[names[n]] if n in names else F.lit(None)
        return F.try_make_timestamp(field("year").try_cast("int"), part(field, "month", 1), part(field, "day", 1), part(field, "hour", 0), part(field, "minute", 0), part(field, "second", 0).cast("decimal(16,6)"))
    if isinstance(kind, T.ArrayType):
        get = lambda i: F.get(c, F.lit(i))
        timed = F.size(c) >= 6
        at = lambda i: F.when(timed, part(get, i, 0)).otherwise(F.lit(0))
        micros = F.when(F.size(c) >= 7, part(get, 6, 0)).otherwise(F.lit(0))
        return F.when(F.size(c) >= 3, F.try_make_timestamp(get(0).try_cast("int"), get(1).try_cast("int"), get(2).try_cast("int"), at(3), at(4), (at(5) + micros / 1e6).cast("decimal(16,6)")))
    if logical(kind) in (INTEGER, FLOAT):
        return F.timestamp_seconds(clean(df, name).cast("double"))
    return ts(c)


def content_types(df: DataFrame, ladder: bool = False) -> dict[str, str]:
    """Logical types by content: a string column whose non-null values all read as times is a datetime
    (an empty one too). ladder: try number, then time, then the words True and False. One aggregation."""
    found = logical_types(df)
    names = [n for n, t in found.items() if t == STRING and isinstance(df.schema[n].dataType, T.StringType)]
    if not names:
        return found
    counts = []
    for i, n in enumerate(names):
        c = quoted(n)
        counts += [F.count(c).alias(f"n{i}"), F.count(num(c)).alias(f"d{i}"), F.count(ts(c)).alias(f"t{i}"), F.count_if(c.isin("True", "False")).alias(f"b{i}"), F.count_if(num(c) == F.floor(num(c))).alias(f"i{i}")]
    row = df.agg(*counts).first()
    for i, n in enumerate(names):
        total = row[f"n{i}"]
        if ladder and row[f"d{i}"] == total:
            found[n] = INTEGER if row[f"i{i}"] == total else FLOAT
        elif row[f"t{i}"] == total:
            found[n] = DATETIME
        elif ladder and row[f"b{i}"] == total:
            found[n] = BOOLEAN
    return found


def type_mismatches(df: DataFrame, expected: dict[str, str]) -> dict[str, dict[str, str]]:
    """Columns whose logical type isn't the expected one."""
    own = logical_types(df)
    return {n: {"expected": t, "actual": own[n]} for n, t in expected.items() if n in own and own[n] != t}
