"""Policies: what each column is, who may see it and which rules hold; made from data, read, written, enforced.

A policy is a plain dictionary. Making one takes three aggregations whatever the number of columns: content
types, then facts about all columns, then outliers. Content is scanned over all rows, not over the first few.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import profile, rules
from ..sources import landing
from ..types import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, clean, content_types, is_missing, logical_types, num, quoted

#: Patterns of personal data in content. The first must match as a whole, the others anywhere.
EMAIL = r"^[\w\.-]+@[\w\.-]+\.[a-zA-Z]{2,}$"
PHONE = r"\+?\d{7,15}"
SSN = r"\d{3}-\d{2}-\d{4}"
IDENTIFIER = r"\d{6,10}"
#: Parts of column names that tell personal data, and those that two laws name.
HIGH = ("name", "email", "phone", "address", "id", "ssn", "passport")
MEDIUM = ("age", "gender", "location")
GDPR = ("name", "email", "address", "location", "phone", "id")
HIPAA = ("ssn", "diagnosis", "treatment", "health", "insurance")

LEVEL = {"low": 1, "medium": 2, "high": 3}
SECURITY = {"high": "encrypted", "medium": "masked", "low": "none"}
STRENGTH = {"none": 1, "masked": 2, "encrypted": 3}
ACCESS = {"high": "restricted", "medium": "internal", "low": "public"}

VIOLATION = "field string, issue string, severity string, execution_id string, timestamp string"


def _has(name: str, parts: tuple[str, ...]) -> bool:
    return any(p in name.lower() for p in parts)


def privacy_level(name: str, sensitive: bool = False) -> str:
    if _has(name, HIGH) or sensitive:
        return "high"
    return "medium" if _has(name, MEDIUM) else "low"


def transparency(name: str) -> str:
    return "public" if _has(name, ("description", "category")) else "internal"


def compliance_tags(name: str) -> list[str]:
    return [tag for tag, parts in (("GDPR", GDPR), ("HIPAA", HIPAA)) if _has(name, parts)]


def risk_level(levels: list[str]) -> str:
    """Two or more fields of a level make the level."""
    return next((x for x in ("high", "medium") if levels.count(x) >= 2), "low")


def sensitive_content(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Whether any value of each column looks like personal data; one aggregation."""
    if not names:
        return {}
    found = []
    for i, n in enumerate(names):
        text = clean(df, n).cast("string")
        found.append(F.coalesce(F.bool_or(text.rlike(EMAIL) | text.rlike(f"{PHONE}|{SSN}|{IDENTIFIER}")), F.lit(False)).alias(f"c{i}"))
    row = df.agg(*found).first()
    return {n: row[f"c{i}"] for i, n in enumerate(names)}


def integrity(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """unique (null is a value), no_nulls, contains_outliers, and what rules need: least value, distinct values."""
    kinds = logical_types(df)
    numbers = [n for n in names if kinds[n] in (INTEGER, FLOAT)]
    least = {n: F.min(num(quoted(n))) for n in numbers}
    row = df.agg(F.count("*").alias("rows"), *(F.count_if(is_missing(df, n)).alias(f"nulls{i}") for i, n in enumerate(names)), *(least[n].alias(f"lo{i}") for i, n in enumerate(names) if n in least)).first().asDict()
    distinct, quartiles = profile.by_value(df, {n: clean(df, n) for n in names}, [n in least for n in names])
    out = {}
    for i, n in enumerate(names):
        known, nulls = distinct.get(n, 0), row[f"nulls{i}"]
        out[n] = {"unique": known + min(nulls, 1) == row["rows"], "no_nulls": nulls == 0, "consistent_format": True, "contains_outliers": False, "least": row.get(f"lo{i}"), "kinds": known}
    if quartiles:
        found = df.agg(*(F.count_if(stats.outside(num(quoted(n)), q[0], q[2], guard=False)) for n, q in quartiles.items())).first()
        for n, k in zip(quartiles, found):
            out[n]["contains_outliers"] = k > 0
    return out


def inferred_rules(kind: str, facts: dict) -> list[str]:
    if kind == STRING:
        return ["no_nulls", "no_special_characters", "max_length"]
    if kind == DATETIME:
        return ["valid_date_format", "no_nulls"]
    if kind == BOOLEAN:
        return ["no_nulls"]
    out = ["no_nulls"]
    if facts["no_nulls"] and facts["least"] is not None and facts["least"] >= 0:
        out.append("positive_values")
    return [*out, "enumerated_values"] if facts["kinds"] < 10 else out


def generate(df: DataFrame, source: str = "unknown", compat_rules: bool = False) -> dict:
    """A policy for the table. compat_rules: leave the rules of all fields empty."""
    names = df.columns
    native = logical_types(df)
    kinds = content_types(df, ladder=True)
    facts = integrity(df, names)
    personal = sensitive_content(df, names)
    fields = []
    for n in names:
        level, tags = privacy_level(n, personal[n]), compliance_tags(n)
        fields.append({
            "field_name": n, "type": kinds[n] if native[n] == STRING else native[n], "required": facts[n]["no_nulls"], "rules": [] if compat_rules else inferred_rules(kinds[n], facts[n]),
            "privacy_level": level, "security": SECURITY[level], "transparency": transparency(n), "integrity": {k: facts[n][k] for k in ("unique", "no_nulls", "consistent_format", "contains_outliers")},
            "compliance_tags": tags, "data_subject": level == "high", "access_restriction": ACCESS[level], "retention_policy": "standard", "critical_field": level == "high" and facts[n]["unique"],
            "justification": f"privacy by {'name' if _has(n, HIGH + MEDIUM) else 'content'}",
        })
    return {
        "dataset_metadata": {"columns": len(names), "rows_sampled": "all", "generated_by": "plumbline", "generated_on": datetime.now(timezone.utc).isoformat(), "data_source": source, "schema_version": "1.0", "language": "en"},
        "compliance": {"compliance_frameworks": sorted({t for f in fields for t in f["compliance_tags"]}), "risk_level": risk_level([f["privacy_level"] for f in fields])},
        "enforcement_requirements": {
            "mandatory_rules": ["no_nulls", "valid_date_format"], "required_fields": [f["field_name"] for f in fields if f["required"]], "privacy_enforcement": "medium", "security_baseline": "masked",
            "allowed_transparency": ["internal", "public"], "risk_acceptance": "medium", "framework_enforcement": ["GDPR"],
        },
        "fields": fields,
    }


def normalised(policy: dict) -> dict:
    """Both dialects as one: fields as a list. A mapping's sensitive, policy, required and compliance are kept."""
    own = policy.get("fields", [])
    if isinstance(own, dict):
        own = [{"field_name": n, "type": c.get("type", STRING), "rules": c.get("rules", []), **c} for n, c in own.items()]
    return policy | {"fields": own}


def load(path: str, spark: SparkSession | None = None) -> dict:
    """A policy file; with a session, of any file system that Spark knows."""
    import yaml

    return normalised(yaml.safe_load(landing.get_text(spark, path) if spark else Path(path).read_text(encoding="utf-8")))


def save(policy: dict, path: str, spark: SparkSession | None = None) -> None:
    import yaml

    text = yaml.safe_dump(policy, sort_keys=False, allow_unicode=True)
    if spark:
        landing.put_bytes(spark, path, text.encode())
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def get_or_create(df: DataFrame, path: str) -> dict:
    """The policy of the file; where there is none, one is made from the table and saved."""
    spark = df.sparkSession
    if landing.exists(spark, path):
        return load(path, spark)
    policy = generate(df, path)
    save(policy, path, spark)
    return policy


def validate_compliance(policy: dict, region: str = "CO") -> list[str]:
    """What is wrong with the treatment that the policy asks for."""
    issues = []
    for f in normalised(policy)["fields"]:
        n = f["field_name"]
        if f.get("sensitive") and f.get("policy") not in ("mask", "drop", "anonymize"):
            issues.append(f"Sensitive field '{n}' has no fitting treatment.")
        if f.get("required") and not f.get("policy"):
            issues.append(f"Required field '{n}' has no policy.")
        if region == "CO" and f.get("compliance") != "habeas_data":
            issues.append(f"Field '{n}' isn't marked for habeas data in region CO.")
    return issues


def violations(df: DataFrame, policy: dict, execution_id: str | None = None, timestamp: str | None = None) -> DataFrame:
    """VIOLATION: where data and policy disagree. All that depends on data comes from two aggregations."""
    policy = normalised(policy)
    asked = policy.get("enforcement_requirements", {})
    there = [f["field_name"] for f in policy["fields"] if f["field_name"] in df.columns]
    facts = integrity(df, there) if there else {}
    kinds = logical_types(df)
    rows: list[tuple[str, str, str]] = []
    for f in policy["fields"]:
        n = f["field_name"]
        if n not in facts:
            rows.append((n, "Field is missing from the dataset.", "error"))
            continue
        own = set(f.get("rules", []))
        if kinds[n] != f.get("type"):
            rows.append((n, f"Expected type '{f.get('type')}' but got '{kinds[n]}'.", "warning"))
        if "no_nulls" in own and not facts[n]["no_nulls"]:
            rows.append((n, "Contains null values.", "warning"))
        if facts[n]["contains_outliers"]:
            rows.append((n, "Contains outliers.", "warning"))
        if f.get("critical_field") and not facts[n]["unique"]:
            rows.append((n, "Critical field is not unique.", "warning"))
        rows += [(n, f"Missing mandatory rule '{r}'.", "warning") for r in asked.get("mandatory_rules", []) if r not in own]
        level, least = f.get("privacy_level", "low"), asked.get("privacy_enforcement", "medium")
        if f.get("data_subject") and LEVEL.get(level, 0) < LEVEL.get(least, 0):
            rows.append((n, f"Privacy level '{level}' is below required '{least}'.", "error"))
        secure, base = f.get("security", "none"), asked.get("security_baseline", "masked")
        if STRENGTH.get(secure, 0) < STRENGTH.get(base, 0):
            rows.append((n, f"Security level '{secure}' is below baseline '{base}'.", "warning"))
        if f.get("transparency", "internal") not in asked.get("allowed_transparency", ["internal", "public"]):
            rows.append((n, f"Transparency '{f.get('transparency')}' not allowed.", "warning"))
        lacking = sorted(set(asked.get("framework_enforcement", [])) - set(f.get("compliance_tags", [])))
        if f.get("data_subject") and lacking:
            rows.append((n, f"Missing required compliance frameworks: {', '.join(lacking)}.", "warning"))
    risk, accepted = policy.get("compliance", {}).get("risk_level", "low"), asked.get("risk_acceptance", "medium")
    if LEVEL.get(risk, 0) > LEVEL.get(accepted, 0):
        rows.append(("__global__", f"Dataset risk level '{risk}' exceeds accepted '{accepted}'.", "error"))
    own_id, now = execution_id or str(uuid.uuid4()), timestamp or datetime.now(timezone.utc).isoformat()
    return df.sparkSession.createDataFrame([(*r, own_id, now) for r in rows], VIOLATION)


def rule_report(df: DataFrame, policy: dict) -> DataFrame:
    """rules.RESULT for the rules that the fields of the policy name; options come from a field's `rule_options`."""
    checks = []
    for f in normalised(policy)["fields"]:
        for r in f.get("rules", []):
            key = rules.ALIASES.get(r, r)
            options = f.get("rule_options", {}).get(r)
            if f["field_name"] in df.columns and (options or key not in ("allowed_values", "string_length", "range", "regex")):
                checks.append(rules.named(df, r, f["field_name"], **(options or {})))
    return rules.evaluate(df, checks)


ROLE = "field string, role string, lo double, hi double, kinds long, violations long"
#: A number of fewer kinds is a code.
FEW_KINDS = 20


def roles(df: DataFrame) -> DataFrame:
    """ROLE: whether a field is a fact (a number of many kinds that isn't a key) or a dimension, the range of a fact (three
    deviations about its mean), and how many rows leave it. Two aggregations and one over distinct values."""
    from ..operators import profile

    types = logical_types(df)
    kinds, _ = profile.by_value(df, {n: clean(df, n) for n in df.columns}, [False] * len(df.columns))
    numbers = [n for n, k in types.items() if k in (INTEGER, FLOAT)]
    row = df.agg(F.count("*").alias("rows"), *(x for i, n in enumerate(numbers) for x in (F.avg(num(quoted(n))).alias(f"m{i}"), F.stddev_samp(num(quoted(n))).alias(f"s{i}")))).first()
    bounds = {n: (row[f"m{i}"] - 3 * row[f"s{i}"], row[f"m{i}"] + 3 * row[f"s{i}"]) for i, n in enumerate(numbers) if FEW_KINDS <= kinds.get(n, 0) < row.rows and row[f"s{i}"] is not None}
    odd = rules.evaluate(df, [rules.in_range(df, n, *b) for n, b in bounds.items()]).collect() if bounds else []  # a row per fact
    odd = {r.field: r.violations for r in odd}
    out = [(n, "fact" if n in bounds else "dimension", *bounds.get(n, (None, None)), kinds.get(n, 0), odd.get(n, 0)) for n in df.columns]
    return df.sparkSession.createDataFrame(out, ROLE)


__all__ = ["generate", "get_or_create", "load", "save", "violations", "rule_report", "validate_compliance", "roles"]
