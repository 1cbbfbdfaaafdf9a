"""Nested data to flat columns, by schema: structs and arrays become columns a_b_c and k_0, k_1.

The number of columns an array takes is its largest size, from one aggregation per level of nesting for all
arrays together. No row passes through Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import quoted


def parse_json(df: DataFrame, name: str) -> DataFrame:
    """A text column of JSON as structs, arrays and values, typed by what all rows hold; what isn't JSON is null."""
    parsed = F.try_parse_json(quoted(name))
    found = df.agg(F.schema_of_variant_agg(parsed)).first()[0]
    kind = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING") if found else "STRING"
    if kind in ("STRING", "VARIANT"):
        return df
    return df.withColumn(name, F.from_json(quoted(name), kind))


ERRORS = ("raise", "skip", "log")


def parse_texts(df: DataFrame, separator: str = "_", errors: str = "log") -> DataFrame:
    """All text columns that hold JSON, parsed: those with an object or an array, and those of nothing but numbers and
    flags. In a column with objects or arrays, text that isn't JSON stops the query (raise), drops its row (skip), or is
    null and kept in a column of its own (log). One aggregation for all columns."""
    if errors not in ERRORS:
        raise ValueError(f"errors are handled by {ERRORS}, not by {errors}")
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not f.name.endswith(f"{separator}error")]
    if not names:
        return df
    parsed = {n: F.try_parse_json(quoted(n)) for n in names}
    nested = lambda n: quoted(n).rlike(r"^\s*[\[{]")
    row = df.agg(*(x for i, n in enumerate(names) for x in (
        F.count(quoted(n)).alias(f"n{i}"), F.count_if(parsed[n].isNotNull()).alias(f"p{i}"), F.count_if(parsed[n].isNotNull() & nested(n)).alias(f"o{i}"),
        F.schema_of_variant_agg(F.when(parsed[n].isNotNull(), parsed[n])).alias(f"s{i}"),
    ))).first()
    for i, n in enumerate(names):
        kind = (row[f"s{i}"] or "VOID").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
        if row[f"o{i}"] and kind.startswith(("STRUCT<", "ARRAY<")):
            bad = quoted(n).isNotNull() & parsed[n].isNull()
            if errors == "raise":
                value = F.when(bad, F.raise_error(F.concat(F.lit(f"{n} isn't JSON: "), quoted(n))).cast(kind)).otherwise(F.from_json(quoted(n), kind))
            else:
                value = F.from_json(quoted(n), kind)
            if errors == "skip":
                df = df.where(~bad)
            elif errors == "log" and row[f"p{i}"] < row[f"n{i}"]:
                df = df.withColumn(f"{n}{separator}error", F.when(bad, quoted(n)))
            df = df.withColumn(n, value)
        elif row[f"n{i}"] and row[f"p{i}"] == row[f"n{i}"] and kind.split("(")[0] in ("BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN"):
            df = df.withColumn(n, quoted(n).try_cast("double" if kind.startswith("DECIMAL") else kind))
    return df


def flatten(df: DataFrame, separator: str = "_", max_depth: int | None = None, collections: bool = True, json_text: bool = False, errors: str = "log") -> DataFrame:
    """Structs (and, with collections, arrays) as columns, level by level; deeper than max_depth they stay.
    Empty arrays and structs vanish. An array within an array becomes columns too. json_text: text that holds JSON
    is read at every level, with parse_texts()."""
    depth = 0
    while max_depth is None or depth < max_depth:
        if json_text:
            df = parse_texts(df, separator, errors)
        nested = [f for f in df.schema if isinstance(f.dataType, T.StructType) or (collections and isinstance(f.dataType, T.ArrayType))]
        if not nested:
            return df
        arrays = [f.name for f in nested if isinstance(f.dataType, T.ArrayType)]
        sizes = {}
        if arrays:
            row = df.agg(*(F.max(F.size(quoted(n))).alias(f"c{i}") for i, n in enumerate(arrays))).first()
            sizes = {n: max(0, row[f"c{i}"] or 0) for i, n in enumerate(arrays)}
        out = []
        for f in df.schema:
            if f.name in sizes:
                out += [F.get(quoted(f.name), F.lit(i)).alias(f"{f.name}{separator}{i}") for i in range(sizes[f.name])]
            elif isinstance(f.dataType, T.StructType):
                out += [quoted(f.name).getField(g.name).alias(f"{f.name}{separator}{g.name}") for g in f.dataType]
            else:
                out.append(quoted(f.name))
        df = df.select(*out)
        depth += 1
    return df


def explode_positions(df: DataFrame, name: str, n: int) -> DataFrame:
    """The first n elements of an array column as columns name_0 .. in its place, null where it is shorter."""
    return df.select(*(x for c in df.columns for x in ([F.get(quoted(c), F.lit(i)).alias(f"{c}_{i}") for i in range(n)] if c == name else [quoted(c)])))


def process(*tables: DataFrame, separator: str = "_", json_text: bool = False, errors: str = "log") -> DataFrame:
    """All tables flat, as one: the union of their columns, null where a table has none."""
    flat = [flatten(t, separator, json_text=json_text, errors=errors) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)
