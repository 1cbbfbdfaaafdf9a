"""Tables from web services, as a Python data source: executors fetch the pages, a partition each.

Where the end is known only from an empty page, the pages are fetched one after the other in one partition.
A page that can't be fetched after some tries stops the query: a failure is never an empty table. read_api() asks for
each page once and lands the answers as a table; columns and rows both come from there.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import flatten as flat
from .landing import land


#: Answers that may be others the next time: too many requests, and failures of servers.
AGAIN = (429, 500, 502, 503, 504)


def fetch(options: dict, page: int) -> list:
    """The records of one page."""
    params = json.loads(options.get("params", "{}"))
    if options.get("pagination_param"):
        params[options["pagination_param"]] = page * int(options.get("pagination_step", 100))
    url = options["url"] + (("&" if "?" in options["url"] else "?") + urllib.parse.urlencode(params) if params else "")
    headers, body, kind = json.loads(options.get("headers", "{}")), options.get("body"), options.get("body_type", "json")
    data = None
    if body is not None:
        data = urllib.parse.urlencode(json.loads(body)).encode() if kind == "form" else body.encode()
        headers.setdefault("Content-Type", {"json": "application/json", "form": "application/x-www-form-urlencoded"}.get(kind, "text/plain"))
    request = urllib.request.Request(url, data=data, headers=headers, method=options.get("method", "GET").upper())
    tries = int(options.get("tries", 3))
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", 15))) as answer:
                found = json.loads(answer.read())
            break
        except (TimeoutError, ConnectionError, urllib.error.URLError) as error:
            refused = isinstance(error, urllib.error.HTTPError) and error.code not in AGAIN
            if refused or attempt == tries - 1:
                raise
            time.sleep(float(options.get("wait", 2)))
    for key in filter(None, options.get("json_path", "").split(".")):
        found = found[key]
    return found if isinstance(found, list) else [found]


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        pages = int(self.options.get("max_pages", 10)) if self.options.get("pagination_param") else 1
        if self.options.get("stop_if_empty", "true") == "true":
            return [InputPartition((0, pages))]
        return [InputPartition((p, p + 1)) for p in range(pages)]

    def read(self, partition):
        for page in range(*partition.value):
            records = fetch(self.options, page)
            if not records and self.options.get("stop_if_empty", "true") == "true":
                return
            for r in records:
                yield (page, json.dumps(r, ensure_ascii=False))


class RestSource(DataSource):
    """format("rest"): page, record (JSON text)."""

    @classmethod
    def name(cls):
        return "rest"

    def schema(self):
        return "page int, record string"

    def reader(self, schema):
        return RestReader(dict(self.options))


def read_api(spark: SparkSession, url: str, *, method: str = "GET", headers: dict | None = None, params: dict | None = None, body=None, body_type: str = "json", json_path: str = "", timeout: float = 15, tries: int = 3, wait: float = 2, pagination: dict | None = None, max_pages: int = 10, disaggregate: bool = True) -> DataFrame:
    """Records of a JSON service as flat columns. pagination: {param, step, stop_if_empty}. Pages are fetched when this
    is called, each once, and landed in the shared folder."""
    spark.dataSource.register(RestSource)
    own = {"url": url, "method": method, "headers": json.dumps(headers or {}), "params": json.dumps(params or {}), "body_type": body_type, "json_path": json_path, "timeout": timeout, "tries": tries, "wait": wait, "max_pages": max_pages}
    if body is not None:
        own["body"] = body if isinstance(body, str) else json.dumps(body)
    if pagination:
        own |= {"pagination_param": pagination["param"], "pagination_step": pagination.get("step", 100), "stop_if_empty": str(bool(pagination.get("stop_if_empty", True))).lower()}
    records = land(spark.read.format("rest").options(**{k: str(v) for k, v in own.items()}).load(), "api")
    parsed = flat.parse_json(records, "record").select("record.*")
    return flat.flatten(parsed) if disaggregate else parsed


OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v), "in": lambda c, v: c.isin(list(v)),
}


def conditions(filters: dict[str, tuple]) -> Column:
    """field: (operator, value), all of which must hold, as a Column."""
    out = F.lit(True)
    for name, (op, value) in filters.items():
        if op.lower() not in OPERATORS:
            raise ValueError(f"no operator is called {op}")
        out = out & OPERATORS[op.lower()](F.col(name), value)
    return out


def filtered(df: DataFrame, filters: dict[str, tuple] | None = None, limit: int | None = None) -> DataFrame:
    out = df.where(conditions(filters)) if filters else df
    return out.limit(limit) if limit is not None else out


def read_places(spark: SparkSession, base: str, call: str, key: str, **params) -> DataFrame:
    """Place search by name of the call: textsearch, nearbysearch, autocomplete, details or reviews."""
    path = {"textsearch": "results", "nearbysearch": "results", "autocomplete": "predictions", "details": "result", "reviews": "result.reviews"}[call]
    return read_api(spark, f"{base}/{'details' if call == 'reviews' else call}/json", params={**params, "key": key}, json_path=path)


def photo_url(base: str, reference: Column, key: str, width: int = 400) -> Column:
    return F.concat(F.lit(f"{base}/photo?maxwidth={width}&photo_reference="), F.url_encode(reference), F.lit("&key="), F.url_encode(F.lit(key)))
