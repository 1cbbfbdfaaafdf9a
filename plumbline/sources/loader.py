"""One interface to all sources: a loader reads a table and keeps what is known about the reading."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..types import type_mismatches
from . import files, opendata, rest

WAIT = 5.0


class Loader(ABC):
    """load() returns the table. metadata: source, status (None, success or failed), error, timestamp, columns and what
    load() was given. A failure stops the caller, or with on_error="empty" gives a table without columns."""

    source = "table"

    def __init__(self, spark: SparkSession, on_error: str = "raise"):
        self.spark, self.on_error = spark, on_error
        self.table: DataFrame | None = None
        self._seen: Observation | None = None
        self.metadata: dict = {"source": self.source, "status": None, "error": None, "timestamp": None, "filters_applied": None}

    @abstractmethod
    def read(self, **options) -> DataFrame: ...

    def load(self, **options) -> DataFrame:
        self.metadata |= options | {"filters_applied": options.get("filters"), "timestamp": datetime.now(timezone.utc).isoformat()}
        try:
            self._seen = Observation()
            self.table = self.read(**options).observe(self._seen, F.count(F.lit(1)).alias("rows"))
        except Exception as error:
            self.metadata |= {"status": "failed", "error": str(error)}
            if self.on_error != "empty":
                raise
            self.table, self._seen = self.spark.createDataFrame([], ""), None
        else:
            self.metadata |= {"status": "success", "error": None, "columns": self.table.columns}
        return self.table

    def observed(self, wait: float = 0.0) -> int | None:
        """The rows that the caller's first action on the table has read, without a job; None before it. Spark tells them
        shortly after the action: wait so many seconds for it. An action that stops early, as take() and show() do, reads
        a part."""
        if self._seen is None or self._seen._jo is None:
            return None
        until = time.monotonic() + wait
        while not (done := self._seen._jo.future().isCompleted()) and time.monotonic() < until:
            time.sleep(0.01)
        return self._seen.get["rows"] if done else None

    def row_count(self, observed: bool = False) -> int:
        """observed: the caller has read the whole table by now, so its own action counted the rows. Else, and where that
        isn't told within WAIT seconds, they are counted, once."""
        if "row_count" not in self.metadata:
            seen = self.observed(WAIT) if observed else None
            self.metadata["row_count"] = seen if seen is not None else self.table.count() if self.table is not None else 0
        return self.metadata["row_count"]

    def mismatches(self, policy: dict) -> dict[str, dict[str, str]]:
        """The columns whose type isn't that of the policy."""
        from ..plans.policy import normalised

        return type_mismatches(self.table, {f["field_name"]: f["type"] for f in normalised(policy)["fields"] if f.get("type")})


def _of(name: str, reader) -> type[Loader]:
    return type(f"{name.title()}Loader", (Loader,), {"source": name, "read": lambda self, **options: reader(self.spark, **options)})


#: By the name of the source; the options of load() are those of the function.
LOADERS: dict[str, type[Loader]] = {
    name: _of(name, reader)
    for name, reader in {"csv": files.read_csv, "parquet": files.read_parquet, "json": files.read_json, "excel": files.read_excel, "api": rest.read_api, "socrata": opendata.read_socrata, "places": rest.read_places}.items()
}


def loader(spark: SparkSession, source: str, on_error: str = "raise") -> Loader:
    if source not in LOADERS:
        raise ValueError(f"no source is called {source}; there are {sorted(LOADERS)}")
    return LOADERS[source](spark, on_error)
