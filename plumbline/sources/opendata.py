"""Data sets of open-data services as a Python data source with pushed filters.

A condition of `where` goes to the service if it says the same there; what doesn't is left to Spark. The service is
asked how many rows there are, and each task reads the pages of one stretch of them, in the order of row ids.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from . import rest

LIMIT = 1_000_000
PAGE = 1_000
#: Rows of one task.
STRETCH = 20_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: The types of the service.
TYPES = {
    "number": T.DoubleType(), "money": T.DoubleType(), "percent": T.DoubleType(), "double": T.DoubleType(), "checkbox": T.BooleanType(),
    "calendar_date": T.TimestampNTZType(), "floating_timestamp": T.TimestampNTZType(),
}


def literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime.datetime):
        return f"'{value.isoformat(timespec='milliseconds')}'"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


class Conditions:
    """Spark's filters as text of the service, or None for one that it can't take."""

    COMPARE = {"EqualTo": "=", "EqualNullSafe": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}
    LIKE = {"StringStartsWith": "{}%", "StringEndsWith": "%{}", "StringContains": "%{}%"}

    def __init__(self, schema: T.StructType):
        self.kinds = {f.name: f.dataType for f in schema}

    def fits(self, kind: T.DataType, value) -> bool:
        """Whether the service compares such a value as Spark does."""
        if isinstance(kind, T.StringType):
            return isinstance(value, str)
        if isinstance(kind, T.BooleanType):
            return isinstance(value, bool)
        if isinstance(kind, T.TimestampNTZType):  # the service keeps thousandths
            return isinstance(value, datetime.datetime) and value.tzinfo is None and value.microsecond % 1000 == 0
        return isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool) and math.isfinite(value)

    def text(self, f: D.Filter, within: bool = False) -> str | None:
        name = type(f).__name__
        if name == "Not":
            # null-safe equality is true or false where the service's is null, so it can't be turned round
            inner = self.text(f.child, True)
            return None if inner is None else f"NOT ({inner})"
        if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in self.kinds or not f.attribute[0].replace("_", "").isalnum():
            return None
        field, kind, value = f.attribute[0], self.kinds[f.attribute[0]], getattr(f, "value", None)
        if name in ("IsNull", "IsNotNull"):
            return f"{field} IS {'NOT ' * (name == 'IsNotNull')}NULL"
        if name in self.COMPARE and self.fits(kind, value) and not (within and name == "EqualNullSafe"):
            return f"{field} {self.COMPARE[name]} {literal(value)}"
        if name == "In" and f.value and all(self.fits(kind, v) for v in f.value):
            return f"{field} IN ({', '.join(map(literal, f.value))})"
        if name in self.LIKE and isinstance(kind, T.StringType) and not any(c in value for c in "%_\\"):
            return f"{field} LIKE {literal(self.LIKE[name].format(value))}"
        return None


class OpenDataReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.where = [options["where"]] if options.get("where") else []
        self.most = int(options["limit"]) if options.get("limit") else None

    def pushFilters(self, filters):
        known = Conditions(self.schema)
        for f in filters:
            text = None if self.most is not None else known.text(f)  # a limit counts rows before Spark's filters
            if text is None:
                yield f
            else:
                self.where.append(text)

    def ask(self, select: str, rest_of: str = "") -> list:
        query = f"SELECT {select}" + (f" WHERE {' AND '.join(self.where)}" if self.where else "") + rest_of
        return rest.fetch({**self.options, "params": json.dumps({"$query": query}), "json_path": ""}, 0)

    def partitions(self):
        n = int(self.ask("count(*) AS n")[0]["n"])
        n = n if self.most is None else min(n, self.most)
        step = int(self.options.get("stretch", STRETCH))
        if self.options.get("tasks"):
            step = max(step, -(-n // int(self.options["tasks"])))
        return [D.InputPartition((i, min(i + step, n))) for i in range(0, n, step)] or [D.InputPartition((0, 0))]

    def read(self, partition):
        lo, hi = partition.value
        page = int(self.options.get("page", PAGE))
        for at in range(lo, hi, page):
            for r in self.ask("*", f" ORDER BY :id LIMIT {min(page, hi - at)} OFFSET {at}"):
                yield tuple(value(r.get(f.name), f.dataType) for f in self.schema)


def value(found, kind: T.DataType):
    """A value of the service as one of the column."""
    if found is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(found)
    if isinstance(kind, T.BooleanType):
        return found if isinstance(found, bool) else str(found).lower() == "true"
    if isinstance(kind, T.TimestampNTZType):
        return datetime.datetime.fromisoformat(found).replace(tzinfo=None)
    return found if isinstance(found, str) else json.dumps(found, ensure_ascii=False, sort_keys=True)


class OpenDataSource(D.DataSource):
    """format("opendata"): options url (of the rows), about (of the columns), where, limit, page, stretch, tasks."""

    @classmethod
    def name(cls):
        return "opendata"

    def schema(self):
        columns = rest.fetch({**self.options, "url": self.options["about"], "json_path": "columns"}, 0)
        return T.StructType([T.StructField(c["fieldName"], TYPES.get(c["dataTypeName"], T.StringType())) for c in columns if not c["fieldName"].startswith(":")])

    def reader(self, schema):
        return OpenDataReader(dict(self.options), schema)


def conditions_text(filters: dict[str, tuple] | None) -> str:
    """field: (operator, value), all of which must hold, as text of the service; quotes in values are doubled, names are
    checked."""
    parts = []
    for name, (op, value) in (filters or {}).items():
        if op.lower() not in rest.OPERATORS or not name.replace("_", "").isalnum():
            raise ValueError(f"not a condition: {name} {op}")
        parts.append(f"{name} {op} ({', '.join(map(literal, value))})" if op.lower() == "in" else f"{name} {op} {literal(value)}")
    return " AND ".join(parts)


def soql(filters: dict[str, tuple] | None = None, limit: int = LIMIT) -> str:
    """A whole query of the service."""
    where = conditions_text(filters)
    return "SELECT *" + (f" WHERE {where}" if where else "") + f" LIMIT {int(limit)}"


def read_socrata(spark: SparkSession, domain: str, code: str, filters: dict[str, tuple] | None = None, limit: int | None = LIMIT, schema: str | None = None, page: int = PAGE, stretch: int = STRETCH, tasks: int | None = None) -> DataFrame:
    """A data set of an open-data service. `filters` and `limit` run there; with limit=None so do the conditions of a
    later where() that the service can take. Ten tries for each page, two seconds apart. schema: else it is asked for.
    tasks: how many may ask the service at once, where it bounds that."""
    spark.dataSource.register(OpenDataSource)
    spark.conf.set(PUSHDOWN, "true")
    base = domain if "://" in domain else f"https://{domain}"
    own = {"url": f"{base}/resource/{urllib.parse.quote(code)}.json", "about": f"{base}/api/views/{urllib.parse.quote(code)}.json", "tries": 10, "wait": 2, "timeout": 60, "page": page, "stretch": stretch}
    own |= {k: v for k, v in {"where": conditions_text(filters), "limit": limit, "tasks": tasks}.items() if v}
    reader = spark.read.format("opendata").options(**{k: str(v) for k, v in own.items()})
    return (reader.schema(schema) if schema else reader).load()
