"""An audit log as a table: records are appended, and read with one row for each uuid.

Each save is a folder of data and then one small commit file, which is there whole or not at all; a reader sees the
folders that the commits it lists have added and none has removed. Names are never used twice, so any number of
writers may save at once, and a job that fails leaves nothing that is seen. compact() puts all records into one folder
by one such commit, at the same path; what is saved meanwhile stays. The folders it replaced go with vacuum().
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import keep_first
from ..types import quoted
from . import landing

FORMATS = ("parquet", "csv", "json")
SCHEMA = "uuid string, timestamp string, status string, message string, record string"
#: Where a record stands in the log: the time of its commit in milliseconds, by the clock of the file system, the
#: commit, and its place there. Records of a compaction keep theirs.
STORED = f"{SCHEMA}, at long, by string, place long"


def format_of(path: str, given: str | None = None) -> str:
    if given is not None:
        if given not in FORMATS:
            raise ValueError(f"no format is called {given}; there are {FORMATS}")
        return given
    end = path.rsplit(".", 1)[-1].lower()
    return end if end in FORMATS else "parquet"


@dataclass
class AuditLog:
    spark: SparkSession
    path: str
    format: str | None = None
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.format = format_of(self.path, self.format)

    def log(self, record: dict, status: str = "ok", message: str | None = None) -> str:
        own = record.get("uuid") or str(uuid.uuid4())
        self.rows.append((own, record.get("timestamp") or datetime.now(timezone.utc).isoformat(), record.get("status", status), message, json.dumps(record, default=str, sort_keys=True)))
        return own

    def log_error(self, message: str, context: dict | None = None) -> str:
        return self.log({"context": context or {}}, "error", message)

    def save(self) -> None:
        """The records logged since the last save."""
        if self.rows:
            rows = self.spark.createDataFrame([(*r, i) for i, r in enumerate(self.rows)], f"{SCHEMA}, place long")
            self._commit(rows.selectExpr(*SCHEMA.replace(" string", "").split(", "), "cast(null as long) at", "cast(null as string) by", "place"))
            self.rows = []

    def append(self, df: DataFrame, status: str = "ok", message: str | None = None) -> None:
        """A record for each row of a table, written by its tasks. Columns uuid, timestamp, status and message take the
        places of those; all columns together are the record. A row without a uuid gets one from its values, so that a
        task that is run again logs the same."""
        record = F.to_json(F.struct(*(quoted(n) for n in df.columns)))
        own = lambda name, default: F.coalesce(*([quoted(name).cast("string")] if name in df.columns else []), default)
        now = F.lit(datetime.now(timezone.utc).isoformat())
        self._commit(
            df.select(
                own("uuid", F.sha2(record, 256)).alias("uuid"), own("timestamp", now).alias("timestamp"), own("status", F.lit(status)).alias("status"), own("message", F.lit(message).cast("string")).alias("message"), record.alias("record"),
                F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("by"), F.lit(0).cast("long").alias("place"),
            )
        )

    def _commit(self, df: DataFrame, remove: list[str] | None = None) -> None:
        name = uuid.uuid4().hex
        writer = df.write.mode("errorifexists")
        (writer.option("header", True).option("escape", '"') if self.format == "csv" else writer).format(self.format).save(f"{self.path}/data/{name}")
        landing.put_bytes(self.spark, f"{self.path}/commits/{name}.json", json.dumps({"add": name, "remove": remove or []}).encode())

    def _commits(self) -> dict[str, tuple[int, dict]]:
        folder = f"{self.path}/commits"
        return {n.removesuffix(".json"): (at, json.loads(landing.get_text(self.spark, f"{folder}/{n}"))) for n, at in landing.listed(self.spark, folder) if n.endswith(".json")}

    def _seen(self) -> dict[str, int]:
        """The folders to read, each with its commit's time: those that no commit has replaced."""
        commits = self._commits()
        gone = {f for _, c in commits.values() for f in c["remove"]}
        return {c["add"]: at for at, c in commits.values() if c["add"] not in gone}

    def _stored(self, folders: dict[str, int]) -> DataFrame:
        """The records of these folders, the first of each uuid, and where they stand."""
        reader = self.spark.read.schema(STORED)
        found = (reader.option("header", True).option("escape", '"') if self.format == "csv" else reader).format(self.format).load([f"{self.path}/data/{f}" for f in folders])
        times = self.spark.createDataFrame(list(folders.items()), "folder string, time long")
        found = found.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(times, "folder")
        found = found.withColumns({"at": F.coalesce("at", "time"), "by": F.coalesce("by", "folder")}).drop("folder", "time")
        return keep_first(found, ["uuid"], ["at", "by", "place", "timestamp", "record"])

    def load(self) -> DataFrame:
        """All saved records, the first of each uuid in the order of saving; none if nothing was saved yet."""
        folders = self._seen()
        return self._stored(folders).drop("at", "by", "place") if folders else self.spark.createDataFrame([], SCHEMA)

    def fields(self, ddl: str) -> DataFrame:
        """The log with the named entries of its records as columns."""
        return self.load().withColumn("record", F.from_json("record", ddl)).select("uuid", "timestamp", "status", "message", "record.*")

    def compact(self) -> AuditLog:
        """One folder in place of all that are there now."""
        folders = self._seen()
        if len(folders) > 1:
            self._commit(self._stored(folders), list(folders))
        return self

    def vacuum(self) -> int:
        """Delete replaced folders and their commits; for when nobody reads an older state. How many there were. A commit
        goes after those that it replaced, so that none of them is ever seen again."""
        commits = self._commits()
        gone = {f for _, c in commits.values() for f in c["remove"]}
        left = {n: c["remove"] for n, (_, c) in commits.items() if n in gone}
        n = len(left)
        while left:
            for name in [x for x, replaced in left.items() if not any(r in left for r in replaced)]:
                landing.remove(self.spark, f"{self.path}/data/{name}")
                landing.remove(self.spark, f"{self.path}/commits/{name}.json")
                del left[name]
        return n
