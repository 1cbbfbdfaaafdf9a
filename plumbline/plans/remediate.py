"""Remediation: by policy, by type, or by trying out candidates while the score rises.

Candidates are expressions. In each step of an epoch, those of all weak columns are fitted together and
scored together; nothing is computed per column.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, metrics
from ..operators import transforms as X
from ..sources import landing
from ..types import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, clean, content_types, is_missing, logical_types, quoted

FAMILIES = ("impute", "normalize", "atypical", "bias")
IMPUTE = {INTEGER: X.impute_median, FLOAT: X.impute_median, DATETIME: X.mode_date(), BOOLEAN: X.impute_false, STRING: X.impute_empty_string}


def by_policy(df: DataFrame, policy: dict) -> tuple[DataFrame, list[dict]]:
    """Cast, fill, clip and protect the columns as the policy says, and what was done. Values are clipped only
    where no null is left; a whole number stays one."""
    fields = {f["field_name"]: f for f in policy.get("fields", []) if f["field_name"] in df.columns}
    log = [{"field": f["field_name"], "action": "missing"} for f in policy.get("fields", []) if f["field_name"] not in fields]
    if not fields:
        return df, log
    kinds = {n: f.get("type", STRING) for n, f in fields.items()}
    out = X.cast_by_type(df, {n: k for n, k in kinds.items() if k != STRING})
    nulls = out.agg(*(F.count_if(is_missing(out, n)).alias(f"c{i}") for i, n in enumerate(fields))).first()
    rounds: list[dict[str, list[X.Transform]]] = [{}, {}, {}]
    for i, (n, f) in enumerate(fields.items()):
        filled = "no_nulls" in f.get("rules", []) and nulls[f"c{i}"] > 0
        if filled:
            rounds[0][n] = [IMPUTE[kinds[n]]]
        if kinds[n] in (INTEGER, FLOAT) and (filled or not nulls[f"c{i}"]):
            rounds[1][n] = [X.winsorize_whole if kinds[n] == INTEGER else X.winsorize]
        if kinds[n] == STRING and f.get("security") == "masked":
            rounds[2][n] = [X.mask]
        elif f.get("security") == "encrypted":
            rounds[2][n] = [X.encrypt]
        log += [{"field": n, "action": t[0].name} for r in rounds for m, t in r.items() if m == n]
    whole = [n for n, k in kinds.items() if k == INTEGER]
    for r in rounds:
        out = X.transformed(out, r)
        protected = rounds[2] if r is rounds[2] else {}
        out = out.select(*(F.round(quoted(n)).cast("long").alias(n) if n in whole and n not in protected else quoted(n) for n in out.columns))
    return out, log


def by_type(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Cast by inferred type; text columns lose nulls and are cleaned."""
    kinds = kinds or content_types(df)
    out = X.cast_by_type(df, kinds)
    nulls = out.agg(*(F.count_if(is_missing(out, n)).alias(f"c{i}") for i, n in enumerate(out.columns))).first()
    return X.transformed(out, {n: [X.impute_empty_string, X.clean_text] for i, n in enumerate(out.columns) if kinds.get(n) == STRING and nulls[f"c{i}"]})


def errors(df: DataFrame, made: dict[tuple[str, str], tuple[str, Column]], family: str) -> dict[tuple[str, str], float]:
    """How bad each candidate (field, name) is, as (kind, new column), by its family's measure; all in one aggregation.
    Those that the family has no measure for are left out, and what has no value is 0."""
    cells = {(n, name): evaluate.badness(family, kind, name, clean(df, n), c) for (n, name), (kind, c) in made.items()}
    cells = {k: c for k, c in cells.items() if c is not None}
    row = df.agg(F.count("*"), *cells.values()).first() if cells else [0]
    return {k: 0.0 if v is None else v for k, v in zip(cells, row[1:])}


def best(found: dict[tuple[str, str], float], family: str) -> dict[str, str]:
    """The name of each field's best candidate: of equals the first, and of scales the range."""
    pick: dict[str, str] = {}
    for (n, name), e in found.items():
        least = found.get((n, pick.get(n)))
        if least is None or e < least or (e == least and family == "normalize" and "minmax" in name and "minmax" not in pick[n]):
            pick[n] = name
    return pick


def compare(df: DataFrame, family: str, wanted: dict[str, list[X.Transform]]) -> DataFrame:
    """field, candidate, error, chosen: the candidates of some fields, fitted, held against each other and chosen from."""
    kinds, asked = logical_types(df), [(n, t) for n, ts_ in wanted.items() for t in ts_]
    params = X.fit(df, asked)
    found = errors(df, {(n, t.name): (kinds[n], t.apply(clean(df, n), params[n, t.name])) for n, t in asked}, family)
    pick = best(found, family)
    return df.sparkSession.createDataFrame([(n, name, float(e), pick[n] == name) for (n, name), e in found.items()], "field string, candidate string, error double, chosen boolean")


@dataclass
class Remediator:
    """Tries transforms on columns under `gate`, family by family, each on the result of the one before. The best
    of a family, by its evaluator, stays if the column's score gains more than `gain`; the best epoch wins."""

    max_epochs: int = 5
    gate: float = 90.0
    gain: float = 0.5
    include: set[str] | None = None
    exclude: set[str] = field(default_factory=set)
    candidates: list[X.Transform] = field(default_factory=lambda: [X.impute_median, X.impute_empty_string, X.mode_date(), X.minmax, X.zscore, X.winsorize, X.log_shift, X.boxcox, X.yeojohnson, X.temporal_log, X.cyclical])
    mandatory: dict[str, list[X.Transform]] = field(default_factory=lambda: {STRING: [X.impute_empty_string, X.clean_text]})
    knowledge: dict[str, dict] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    _tables: list[DataFrame] = field(default_factory=list, repr=False)
    _full: set[str] = field(default_factory=set, repr=False)

    def register_rule(self, transform: X.Transform) -> None:
        self.candidates.append(transform)

    def register_mandatory_rule(self, kind: str, transform: X.Transform) -> None:
        self.mandatory.setdefault(kind, []).append(transform)

    def _open(self, n: str) -> bool:
        return n not in self.exclude and (self.include is None or n in self.include)

    def scores(self, df: DataFrame, kinds: dict[str, str]) -> dict[str, float]:
        return metrics.column_scores(df, {n: (kinds[n], clean(df, n)) for n in df.columns if self._open(n)})

    def run(self, df: DataFrame) -> tuple[DataFrame, dict[str, float]]:
        """The best table and its scores by column."""
        kinds = content_types(df)
        df = X.cast_by_type(df, {n: k for n, k in kinds.items() if k == DATETIME and logical_types(df)[n] != DATETIME})
        df = self._kept(X.transformed(df, {n: self.mandatory[k] for n, k in kinds.items() if k in self.mandatory and self._open(n)}))
        found = metrics.column_metrics(df, {n: (kinds[n], clean(df, n)) for n in df.columns if self._open(n)})
        score = {n: m["score"] for n, m in found.items()}
        self._full = {n for n, m in found.items() if m.get("null_percentage") == 0}
        best, best_score = df, dict(score)
        mean = lambda s: sum(s.values()) / max(1, len(s))
        for epoch in range(self.max_epochs):
            before = mean(score)
            accepted: dict[str, list[str]] = {}
            for family in FAMILIES:
                df, score = self._family(df, kinds, score, family, accepted)
            self.history.append({"epoch": epoch + 1, "score": mean(score), "accepted": accepted})
            if mean(score) > mean(best_score):
                best, best_score = df, dict(score)
            if mean(score) - before < self.gain:
                break
        for table in self._tables:
            if table is not best:
                landing.drop(table)
        self._tables = []
        return best, best_score

    def _kept(self, df: DataFrame) -> DataFrame:
        """The table of an accepted step, written: the next ones go back no further, even if executors are lost. The best
        one is what run() returns, and landing.drop() is for when it is done with."""
        self._tables.append(landing.land(df, "remediated"))
        return self._tables[-1]

    def _family(self, df: DataFrame, kinds: dict, score: dict, family: str, accepted: dict) -> tuple[DataFrame, dict]:
        wanted = [(n, t) for n in df.columns if n in score and score[n] < self.gate for t in self.candidates if t.family == family and kinds[n] in t.kinds]
        # no gain comes from another scale alone, as shares, repeats and skewness stay, nor from filling where nothing is null
        moved = {n for n, t in wanted if not (t.affine and self.gain > 0) and not (t.fills and n in self._full and self.gain >= 0)}
        wanted = [(n, t) for n, t in wanted if n in moved]
        if not wanted:
            return df, score
        params = X.fit(df, wanted)
        made = {(n, t.name): t.apply(clean(df, n), params[n, t.name]) for n, t in wanted}
        pick = best(errors(df, {k: (kinds[k[0]], c) for k, c in made.items()}, family), family)
        found = metrics.column_metrics(df, {n: (kinds[n], made[n, name]) for n, name in pick.items()})
        gained = {n: m["score"] for n, m in found.items()}
        take = {n: name for n, name in pick.items() if gained[n] - score[n] > self.gain}
        self._full = self._full - set(take) | {n for n in take if found[n].get("null_percentage") == 0}
        for n, name in take.items():
            accepted.setdefault(n, []).append(name)
            self.knowledge.setdefault(n, {}).setdefault(f"variants_{family}", []).append({"name": name, "gain": gained[n] - score[n]})
        if not take:
            return df, score
        return self._kept(df.select(*(made[n, take[n]].alias(n) if n in take else quoted(n) for n in df.columns))), score | {n: gained[n] for n in take}

    def save(self, folder: str) -> None:
        """What was learnt and done, as two JSON files."""
        Path(folder).mkdir(parents=True, exist_ok=True)
        (Path(folder) / "knowledge.json").write_text(json.dumps(self.knowledge, indent=1, default=float))
        (Path(folder) / "history.json").write_text(json.dumps(self.history, indent=1, default=float))

    def load(self, folder: str) -> None:
        path = Path(folder) / "knowledge.json"
        self.knowledge = json.loads(path.read_text()) if path.exists() else {}
