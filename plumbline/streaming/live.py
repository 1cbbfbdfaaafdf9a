"""Quality of streams: metrics by event-time window, and a profile of each micro-batch against the last.

Only mergeable metrics go into windows, so state is one small row per window; late rows are bounded by the
watermark. What a batch is held against is a file for each batch beside the checkpoint: a stream that is stopped, or
fails, goes on with the baseline that it would have had, and a batch that is run again finds the same one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import stats
from ..operators import metrics
from ..sources import landing
from ..types import num, quoted

#: So many batches are kept; a stream goes back by one at most.
KEPT = 100


def windowed(stream: DataFrame, time: str, fields: list[str], size: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window start and end, rows, and for each numeric field null_percentage, mean, std, min, max, approx_distinct."""
    timed = stream.withColumn("_time", quoted(time).cast("timestamp")).withWatermark("_time", late)
    own = []
    for n in fields:
        c = num(quoted(n))
        own += [stats.percent(c.isNull()).alias(f"{n}_null_percentage"), F.avg(c).alias(f"{n}_mean"), F.stddev_samp(c).alias(f"{n}_std"), F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.approx_count_distinct(c).alias(f"{n}_approx_distinct")]
    window = F.window("_time", size, slide) if slide else F.window("_time", size)
    return timed.groupBy(window.alias("w")).agg(F.count("*").alias("rows"), *own).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", *(f"{n}_{m}" for n in fields for m in ("null_percentage", "mean", "std", "min", "max", "approx_distinct")))


@dataclass
class Baselines:
    """What each batch found, a small file a batch. put() of a batch that is there already writes it anew."""

    spark: SparkSession
    path: str

    def batches(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in landing.listed(self.spark, self.path) if n.removesuffix(".json").isdigit())

    def put(self, batch: int, found: dict) -> None:
        landing.put_bytes(self.spark, f"{self.path}/{batch:012d}.json", json.dumps(found).encode())
        for old in self.batches()[:-KEPT]:
            landing.remove(self.spark, f"{self.path}/{old:012d}.json")

    def before(self, batch: int) -> dict | None:
        """What the batch before this one found, whether or not this one has been run already."""
        earlier = [n for n in self.batches() if n < batch]
        return json.loads(landing.get_text(self.spark, f"{self.path}/{earlier[-1]:012d}.json")) if earlier else None


def watch(stream: DataFrame, policy: dict, checkpoint: str, alert: Callable[[int, dict, float | None], None], threshold: float = 10.0) -> StreamingQuery:
    """Profile each micro-batch by the policy and call alert(batch, metrics, drift) where the score drifts from the batch
    before by more than threshold percent (and for the first batch, with drift None). A batch without rows is passed
    over. After a failure a batch may be run, and alert, a second time, with the same drift."""
    known = Baselines(stream.sparkSession, f"{checkpoint.rstrip('/')}-baselines")

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            found = metrics.field_metrics(batch, policy, phase="continuous_monitoring") if not batch.isEmpty() else None
        finally:
            batch.unpersist()
        if found is None:
            return
        score, last = found["global"]["average_quality_score"], known.before(number)
        change = metrics.drift(score, last and last["score"])
        if change is None or abs(change) > threshold:
            alert(number, found, change)
        known.put(number, {"score": score, "drift": change})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
