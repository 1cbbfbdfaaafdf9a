"""Metrics of the fields of a policy, and the scores made from them.

All fields share three aggregations (the second is over distinct values, the third needs the quartiles); only
gaps between times, and metrics of the caller's own, take jobs of their own. What comes to the driver is a row of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..types import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, clean, is_missing, logical, num, quoted
from . import profile

PHASES = ("ingestion", "cleaning", "indexing", "continuous_monitoring")


@dataclass
class Registry:
    """Metrics of one's own. A field metric is func(field policy, Column) -> aggregate Column and joins the
    shared aggregation; a pipeline metric is func(monitor, report) -> value."""

    fields: dict[str, tuple[Callable[[dict, Column], Column], tuple[str, ...]]] = field(default_factory=dict)
    pipeline: dict[str, tuple[Callable[..., Any], tuple[str, ...]]] = field(default_factory=dict)

    def register_field_metric(self, name: str, func: Callable[[dict, Column], Column], phases: tuple[str, ...] = PHASES) -> None:
        self.fields[name] = (func, tuple(phases))

    def register_pipeline_metric(self, name: str, func: Callable[..., Any], phases: tuple[str, ...] = ("report",)) -> None:
        self.pipeline[name] = (func, tuple(phases))


def _number(value) -> float:
    return 0.0 if value is None or (isinstance(value, float) and math.isnan(value)) else float(value)


def as_number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def penalties(kind: str, m: dict, temporal_weight: float = 10.0) -> dict[str, float]:
    """What each metric takes away from 100."""
    return stats.penalties(kind, {k: _number(m.get(k)) for k in stats.METRICS}, temporal_weight)


def policy_score(kind: str, m: dict) -> float:
    """The score against a policy: type and security count too."""
    lost = sum(penalties(kind, m).values()) + (0 if m.get("type_match") else 20) + (15 if m.get("security_compliant") is False else 0)
    return max(100.0 - lost, 0.0)


def profile_score(kind: str, m: dict) -> float:
    return max(100.0 - sum(penalties(kind, m, 5.0).values()), 0.0)


def security_compliant(c: Column, kind: str, security: str) -> Column:
    """Whether all values look as the policy asks: base64 if encrypted, short or starred if masked. Null without rows."""
    text = c.cast("string")
    if security == "encrypted" and kind == STRING:
        return F.every(c.isNull() | stats.is_base64(text))
    if security == "masked":
        return F.every(c.isNull() | stats.is_masked(text))
    return F.when(F.count("*") > 0, F.lit(True))


def custom(df: DataFrame, cells: dict[Any, Callable[[], Column]]) -> dict[Any, Any]:
    """Values of metrics of one's own, all in one aggregation. Where that fails, each half is worked out by itself, and
    so on; those that fail alone, when made or when run, are None."""
    if not cells:
        return {}
    try:
        row = df.agg(*(make().alias(f"c{i}") for i, make in enumerate(cells.values()))).first()
        return {k: row[f"c{i}"] for i, k in enumerate(cells)}
    except Exception:  # whatever a function of the caller's may raise
        if len(cells) == 1:
            return dict.fromkeys(cells)
    keys, half = list(cells), len(cells) // 2
    return {k: v for part in (keys[:half], keys[half:]) for k, v in custom(df, {key: cells[key] for key in part}).items()}


def field_metrics(df: DataFrame, policy: dict, registry: Registry | None = None, phase: str = "ingestion") -> dict[str, dict]:
    """Metrics by field, and under `global` their average score. Fields that aren't there have the status missing.
    Nulls count as repeats in duplicate_percentage here; a custom metric that fails is None."""
    out: dict[str, dict] = {}
    cells: list[tuple[str, str, Column]] = []
    known = {f["field_name"]: f for f in policy.get("fields", []) if f["field_name"] in df.columns}
    own: dict[tuple[str, str], Callable[[], Column]] = {}
    for n, f in known.items():
        c, kind = clean(df, n), f.get("type", STRING)
        cells.append((n, "null_percentage", stats.percent(is_missing(df, n))))
        if kind in (INTEGER, FLOAT):
            x = num(c)
            cells += [(n, "mean", F.avg(x)), (n, "std", F.stddev_samp(x)), (n, "min", F.min(x)), (n, "max", F.max(x)), (n, "skewness", F.abs(stats.skew(x)))]
        elif kind == STRING:
            cells.append((n, "values", F.count(c)))
        elif kind == BOOLEAN:
            cells.append((n, "true_percentage", 100 * F.avg(c.try_cast("boolean").cast("int"))))
        cells.append((n, "security_compliant", security_compliant(c, kind, f.get("security", "none"))))
        for name, (func, phases) in (registry.fields if registry else {}).items():
            if phase in phases:
                own[n, f"custom_{name}"] = lambda func=func, f=f, c=c: func(f, c)
    if known:
        row = df.agg(F.count("*").alias("rows"), *(agg.alias(f"c{i}") for i, (_, _, agg) in enumerate(cells))).first()
        for i, (n, m, _) in enumerate(cells):
            out.setdefault(n, {})[m] = row[f"c{i}"]
        numbers = [n for n, f in known.items() if f.get("type", STRING) in (INTEGER, FLOAT)]
        kinds, quartiles = profile.by_value(df, {n: clean(df, n) for n in known}, [n in numbers for n in known])
        for n, f in known.items():
            distinct = kinds.get(n, 0)
            out[n]["duplicate_percentage"] = 100.0 * (row.rows - distinct) / row.rows if row.rows else None
            out[n]["uniqueness_rate"] = distinct / row.rows if row.rows else None
            if "values" in out[n]:
                values = out[n].pop("values")
                out[n]["cardinality_ratio"] = distinct / values if values else None
        if numbers:
            shares = df.agg(*(stats.percent(stats.outside(num(quoted(n)), *_ends(quartiles.get(n)), guard=False)).alias(f"c{i}") for i, n in enumerate(numbers))).first()
            for i, n in enumerate(numbers):
                q = quartiles.get(n) or [None] * 3
                out[n] |= {"outlier_percentage": _number(shares[f"c{i}"]), "percentile_25": q[0], "median": q[1], "percentile_75": q[2]}
        for (n, m), value in custom(df, own).items():
            out[n][m] = value
        for n, f in known.items():
            kind = f.get("type", STRING)
            if kind == DATETIME:
                out[n] |= {k: v for k, v in profile.temporal(df, n).first().asDict().items() if k != "field"}
            out[n]["type_match"] = logical(df.schema[n].dataType) == kind
            out[n]["field_quality_score"] = policy_score(kind, out[n])
    for f in policy.get("fields", []):
        out.setdefault(f["field_name"], {"status": "missing"})
    found = [m["field_quality_score"] for m in out.values() if "field_quality_score" in m]
    out["global"] = {"average_quality_score": sum(found) / len(found) if found else None, "total_fields": len(policy.get("fields", []))}
    return out


def _ends(q: list | None) -> tuple:
    return (q[0], q[2]) if q else (None, None)


def drift(current: float | None, before: float | None) -> float | None:
    """The change in percent of what was before."""
    return None if current is None or not before else (current - before) / before * 100


def as_frame(spark: SparkSession, metrics: dict[str, dict]) -> DataFrame:
    """Numbers of a metrics dict as rows (field, metric, value)."""
    rows = [(n, m, float(v)) for n, own in metrics.items() for m, v in own.items() if isinstance(v, (int, float)) and v is not None]
    return spark.createDataFrame(rows, "field string, metric string, value double")


def column_scores(df: DataFrame, wanted: dict[Any, tuple[str, Column]]) -> dict[Any, float]:
    """The profile score of any expressions (kind, Column)."""
    return {k: m["score"] for k, m in column_metrics(df, wanted).items()}


def column_metrics(df: DataFrame, wanted: dict[Any, tuple[str, Column]]) -> dict[Any, dict[str, float]]:
    """The score of any expressions (kind, Column) and the metrics that it is made of, in three aggregations for all of
    them."""
    keys = list(wanted)
    if not keys:
        return {}
    cells: dict[tuple[int, str], Column] = {}
    numbers = [i for i, k in enumerate(keys) if wanted[k][0] in (INTEGER, FLOAT)]
    for i, k in enumerate(keys):
        c = wanted[k][1]
        cells[i, "nulls"] = F.count_if(c.isNull())
        if i in numbers:
            cells[i, "skewness"] = stats.skew(num(c))
    row = df.agg(F.count("*").alias("rows"), *(agg.alias(f"c{j}") for j, agg in enumerate(cells.values()))).first()
    found: list[dict] = [{} for _ in keys]
    for j, (i, m) in enumerate(cells):
        found[i][m] = row[f"c{j}"]
    kinds, quartiles = profile.by_value(df, {i: wanted[k][1] for i, k in enumerate(keys)}, [i in numbers for i in range(len(keys))])
    for i, k in enumerate(keys):
        nulls, distinct = found[i].pop("nulls"), kinds.get(i, 0)
        if row.rows:
            found[i] |= {"null_percentage": 100.0 * nulls / row.rows, "duplicate_percentage": 100.0 * (row.rows - distinct - (nulls > 0)) / row.rows}
            if wanted[k][0] == STRING and row.rows > nulls:
                found[i]["cardinality_ratio"] = distinct / (row.rows - nulls)
    numbers = [i for i in numbers if quartiles.get(i)]
    if numbers:
        shares = df.agg(*(stats.percent(stats.outside(num(wanted[keys[i]][1]), quartiles[i][0], quartiles[i][2])).alias(f"c{i}") for i in numbers)).first()
        for i in numbers:
            found[i]["outlier_percentage"] = shares[f"c{i}"]
    for i, k in enumerate(keys):
        if wanted[k][0] == DATETIME:
            found[i]["temporal_anomaly"] = profile.temporal(df.select(wanted[k][1].alias("x")), "x").first().temporal_anomaly
    return {k: found[i] | {"score": profile_score(wanted[k][0], found[i])} for i, k in enumerate(keys)}
