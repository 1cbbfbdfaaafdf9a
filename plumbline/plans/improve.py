"""What to improve: how many points each metric could bring back, and a linear model of past improvements."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import metrics, rules
from ..types import FLOAT

POTENTIAL = "field string, metric string, potential double"
WORTH = "Improving '%s' could raise the score by up to %.1f points."
PREDICTED = "Fixing this field could raise the global score by about %.1f points (predicted)."
ABSENT = "The field is missing; including it comes first."
#: Scores under LOW, and drifts over DRIFTED percent, are remarked on.
LOW, DRIFTED = 80, 10


def potential(kind: str, m: dict) -> dict[str, float]:
    """Points to gain by metric, none more than the score lacks."""
    room = 100 - metrics.policy_score(kind, m)
    lost = metrics.penalties(kind, m)
    if not m.get("type_match", False):
        lost["type_match"] = 20.0
    if m.get("security_compliant") is False:
        lost["security_compliant"] = 15.0
    always = ("null_percentage", "duplicate_percentage", "outlier_percentage", "temporal_anomaly")
    return {k: min(v, room) for k, v in lost.items() if v > 0 or k in always}


@dataclass(frozen=True)
class LinearModel:
    """Least squares with an intercept: the means, and the weight of each feature."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    weights: tuple[float, ...]
    level: float

    @classmethod
    def fit(cls, table: DataFrame, features: list[Column], names: list[str], target: Column) -> LinearModel | None:
        """From the covariances, one aggregation whose partial results have k * k numbers for k features; the system that
        remains, of k unknowns, is solved here. A feature that is null is 0; rows without a target are passed over. Of
        features that depend on each other the weights are the shortest."""
        import numpy as np

        y, k = target.cast("double"), len(features)
        x = [F.coalesce(f.cast("double"), F.lit(0.0)) for f in features]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = table.where(y.isNotNull()).agg(F.avg(y), *map(F.avg, x), *(F.covar_pop(c, y) for c in x), *(F.covar_pop(x[i], x[j]) for i, j in pairs)).first()
        if row[0] is None:
            return None
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 + 2 * k :]):
            gram[i, j] = gram[j, i] = v
        scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))  # features of unlike sizes
        weights = np.linalg.lstsq(gram / np.outer(scale, scale), np.array(row[1 + k : 1 + 2 * k]) / scale, rcond=None)[0] / scale
        return cls(tuple(names), tuple(row[1 : 1 + k]), tuple(map(float, weights)), row[0])

    def predict(self, features: dict[str, float]) -> float:
        return self.level + sum(w * (features.get(n, 0.0) - m) for n, m, w in zip(self.features, self.mean, self.weights))


HISTORY = "field_improvements map<string,double>, quality_score_improvement double"


def model(history: DataFrame) -> LinearModel | None:
    """The model of a table of past improvements (HISTORY): what was gained by metric, and by the score."""
    names = sorted(r[0] for r in history.select(F.explode(F.map_keys("field_improvements"))).distinct().collect())  # metrics' names
    return LinearModel.fit(history, [F.try_element_at("field_improvements", F.lit(n)) for n in names], names, F.col("quality_score_improvement"))


@dataclass
class Improver:
    """metrics: those of metrics.field_metrics; history: a table as HISTORY, or none."""

    metrics: dict[str, dict]
    policy: dict
    history: DataFrame | None = None
    _model: LinearModel | None = field(default=None, repr=False)

    def fields(self) -> list[tuple[str, str, dict]]:
        return [(f["field_name"], f.get("type", "string"), self.metrics.get(f["field_name"], {"status": "missing"})) for f in self.policy.get("fields", [])]

    def update(self, rows: DataFrame) -> None:
        """More rows for the history."""
        self.history, self._model = rows if self.history is None else self.history.unionByName(rows), None

    def predict(self, features: dict[str, float]) -> float | None:
        """What the score would gain, by the history; None without one."""
        if self._model is None and self.history is not None:
            self._model = model(self.history)
        return self._model and self._model.predict(features)

    def potentials(self, spark: SparkSession) -> DataFrame:
        """field, metric, potential: POTENTIAL. A field that isn't there has one row, without a metric."""
        known = [(n, kind, m) for n, kind, m in self.fields()]
        rows = [(n, k, float(v)) for n, kind, m in known if m.get("status") != "missing" for k, v in potential(kind, m).items()]
        return spark.createDataFrame(rows + [(n, None, None) for n, _, m in known if m.get("status") == "missing"], POTENTIAL)

    def advice(self, spark: SparkSession) -> DataFrame:
        """field, place, advice: what to mend first, from the potentials; with a history, its prediction leads."""
        worth = self.potentials(spark).where("metric is null or potential > 0")
        order = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("potential"), "metric")) - 1
        text = F.when(F.col("metric").isNull(), F.lit(ABSENT)).otherwise(F.format_string(WORTH, "metric", "potential"))
        out = worth.select("field", order.alias("place"), text.alias("advice"))
        found = [(n, self.predict(potential(kind, m))) for n, kind, m in self.fields() if m.get("status") != "missing"] if self.history is not None else []
        first = spark.createDataFrame([(n, -1, PREDICTED % v) for n, v in found if v is not None], "field string, place int, advice string")
        return out.unionByName(first) if found else out

    def recommendations(self, df: DataFrame) -> dict:
        """The advice by field, and remarks on the whole; df: the table, to test the policy's relational rules on."""
        by_field: dict[str, list[str]] = {n: [] for n, _, _ in self.fields()}
        for r in self.advice(df.sparkSession).orderBy("field", "place").collect():  # some rows a field
            by_field[r.field].append(r.advice)
        total = self.metrics.get("global", {})
        score, change = total.get("average_quality_score"), total.get("drift_percentage", 0)
        remarks = [(score is not None and score < LOW, f"The score is {score}: under {LOW}, the ingestion as a whole needs a review."), (abs(change) > DRIFTED, f"The score has drifted by {change:.1f}%.")]
        broken = [f"The relational rule '{r.field}' doesn't hold." for r in relational(df, self.policy).where("not ok").collect()]
        return {"global": [text for holds, text in remarks if holds] + broken, "fields": by_field}

    def chart(self, spark: SparkSession) -> DataFrame:
        """field, current_score, potential_score: what there is and what could be reached."""
        out = []
        for n, kind, m in self.fields():
            if "field_quality_score" in m:
                now = metrics.policy_score(kind, m)
                out.append((n, float(now), float(now + min(sum(potential(kind, m).values()), 100 - now))))
        return spark.createDataFrame(out, "field string, current_score double, potential_score double")


def relational(df: DataFrame, policy: dict) -> DataFrame:
    """rules.RESULT for the policy's relational rules {rule: an operator, fields: [left, right]}."""
    checks = []
    for r in policy.get("relational_rules", []):
        if r.get("rule") in ("<", "<=", ">", ">=", "=", "==", "!=", "<>") and len(r.get("fields", [])) == 2:
            left, right = r["fields"]
            checks.append(rules.expression(df, "relational", f"`{left}` {r['rule']} `{right}`"))
    return rules.evaluate(df, checks) if checks else df.sparkSession.createDataFrame([], rules.RESULT)


def potentials(profile: DataFrame) -> DataFrame:
    """field, metric, potential from a long frame (field, metric, value) of numeric fields."""
    zero = dict.fromkeys(stats.METRICS, F.lit(0.0))
    worth = F.lit(None).cast("double")
    for m in ("null_percentage", "duplicate_percentage", "outlier_percentage", "skewness"):
        own = stats.penalties(FLOAT, zero | {m: F.col("value")}, most=F.greatest, size=F.abs, zero=F.lit(0.0))[m]
        worth = F.when(F.col("metric") == m, own).otherwise(worth)
    return profile.select("field", "metric", worth.alias("potential")).where("potential is not null")
