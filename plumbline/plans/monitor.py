"""Quality monitoring in phases. Each phase is a function of the table; the cleaned table serves the later ones."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, profile, sampling
from ..operators import transforms as X
from ..types import distinct_key, quoted


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each kind of row; nested values are compared by their JSON."""
    keyed = df.select(F.struct(*(distinct_key(df, n).alias(f"k{i}") for i, n in enumerate(df.columns))).alias("_k"), F.struct(*(quoted(n) for n in df.columns)).alias("_row"))
    return keyed.groupBy("_k").agg(F.first("_row").alias("_row")).select("_row.*")


def group_counts(df: DataFrame, by: str) -> DataFrame:
    return df.where(quoted(by).isNotNull()).groupBy(quoted(by)).agg(F.count("*").alias("n"))


@dataclass
class Monitor:
    df: DataFrame
    policy: dict
    registry: metrics.Registry = field(default_factory=metrics.Registry)
    historical_score: float | None = None

    def ingestion(self) -> dict:
        frameworks = self.policy.get("compliance", {}).get("compliance_frameworks", [])
        return {
            "gdpr_compliance": "Compliant" if "GDPR" in frameworks else "Not Compliant",
            "field_metrics": self.metrics("ingestion"),
            "security_baseline": self.policy.get("enforcement_requirements", {}).get("security_baseline", "none"),
        }

    def metrics(self, phase: str) -> dict:
        out = metrics.field_metrics(self.df, self.policy, self.registry, phase)
        change = metrics.drift(out["global"]["average_quality_score"], self.historical_score)
        if change is not None:
            out["global"]["drift_percentage"] = change
        return out

    def disaggregation(self) -> dict:
        """Rows by the policy's dimension (a table), and repeats of its primary key in percent."""
        by, key = self.policy.get("disaggregation_dimension"), self.policy.get("primary_key")
        if by not in self.df.columns:
            return {"disaggregation": "not asked for"}
        out: dict = {"group_counts": group_counts(self.df, by)}
        if key in self.df.columns:
            out["primary_key_duplicate_pct"] = self.df.agg(F.bround(profile.repeats_percent(self.df, key), 2)).first()[0]
        return out

    def cleaning(self) -> dict:
        """Repeated rows go, the policy's fill values come in; null shares before and after."""
        before = self.null_shares()
        self.df = X.fill_values(distinct_rows(self.df), {n: v for n, v in self.policy.get("fill_values", {}).items() if n in self.df.columns})
        after = self.null_shares()
        return {"df_clean": self.df, "post_clean_metrics": after, "impact": {n: round(before[n] - after[n], 2) for n in before}}

    def null_shares(self) -> dict[str, float]:
        return {r.field: r.null_percentage or 0.0 for r in profile.null_percentages(self.df).collect()}  # a row per column

    def indexing(self) -> dict:
        """Sorted by the primary key; the time is that of the sort."""
        key = self.policy.get("primary_key")
        if key not in self.df.columns:
            return {"indexing": "no primary key"}
        began = time.time()
        self.df = sampling.index_sort(self.df, key)
        self.df.write.format("noop").mode("overwrite").save()
        return {"indexing_time_sec": round(time.time() - began, 4)}

    def continuous_monitoring(self, threshold: float = 10.0) -> dict:
        found = self.metrics("continuous_monitoring")
        change = found["global"].get("drift_percentage")
        if change is None:
            return {"alert": "no earlier score to compare with"}
        return {"drift_percentage": change, "alert": f"drift of {change:.2f}%" if abs(change) > threshold else "drift within bounds"}

    def evaluate_phase(self, phase: str) -> dict:
        phases = ("ingestion", "disaggregation", "cleaning", "indexing", "continuous_monitoring")
        if phase not in phases:
            raise ValueError(f"no phase is called {phase}; there are {phases}")
        return getattr(self, phase)()

    def explain_scores(self) -> DataFrame:
        """field, part, metric, value: what each score is made of. part: base, custom, or score for the score itself."""
        rows = metrics.as_frame(self.df.sparkSession, {n: m for n, m in self.metrics("ingestion").items() if n != "global"})
        part = F.when(F.col("metric") == "field_quality_score", "score").when(F.col("metric").startswith("custom_"), "custom").otherwise("base")
        return rows.select("field", part.alias("part"), "metric", "value")

    def report(self) -> dict:
        out = {p: self.evaluate_phase(p) for p in ("ingestion", "disaggregation", "cleaning", "indexing", "continuous_monitoring")}
        out["custom_pipeline_measures"] = {}
        for name, (func, phases) in self.registry.pipeline.items():
            if "report" in phases:
                try:
                    out["custom_pipeline_measures"][name] = func(self, out)
                except Exception:  # a metric of the caller's that fails is None, and the others stand
                    out["custom_pipeline_measures"][name] = None
        return out | {"timestamp": time.strftime("%Y-%m-%d %H:%M:%S")}
