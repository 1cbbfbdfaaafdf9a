"""Registered queries of the engines, sources and fitted transforms, with the SQL that each must equal."""

from __future__ import annotations

import http.server
import json
import threading
from contextlib import contextmanager
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import evaluate, flatten, metrics, profile, rules, sampling, states
from .operators import transforms as X
from .plans import improve, monitor, policy, remediate
from .queries import D, ORDERS_POLICY, PARTS, add, dirty, numeric_sql, strings_sql, table, transform
from .sources import audit, files, landing, opendata, rest
from .sources.landing import folder, land
from .sources.loader import loader
from .types import content_types, parse_time

# fitted transforms: the same grids, landmarks and approximations in SQL

_X = "(SELECT o_orderkey, {v} AS x FROM d)"


def grid_sql(source: str, power: str, slope: str) -> str:
    """CTEs g (x) and b3 (lam): the best power on four grids, each finer than the last."""
    out = f"g AS {source}, s AS (SELECT count(x) AS n, sum({slope}) AS logs FROM g)"
    for step in range(X.FINER):
        lam = f"-2 + 4 * i / {X.GRID - 1}.0" if not step else f"(SELECT lam FROM b{step - 1}) + {4 / (X.GRID - 1) / (X.GRID // 2) ** (step - 1)!r} * (2 * i / {X.GRID - 1}.0 - 1)"
        out += (
            f", l{step} AS (SELECT CAST({lam} AS DOUBLE) AS lam FROM range({X.GRID}) r(i)), v{step} AS (SELECT lam, var_pop({power}) AS v FROM g, l{step} WHERE x IS NOT NULL GROUP BY lam), "
            f"b{step} AS (SELECT lam FROM (SELECT lam, (lam - 1) * logs - n / 2.0 * ln(v) AS f FROM v{step}, s WHERE v > 0) ORDER BY f DESC, abs(lam - 1), lam DESC LIMIT 1)"
        )
    return out


_BC = "CASE WHEN abs(lam) < 1e-9 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END"
_YJ = (
    "CASE WHEN x >= 0 THEN CASE WHEN abs(lam) < 1e-9 THEN ln(1 + greatest(x, 0)) ELSE (pow(greatest(x, 0) + 1, lam) - 1) / lam END "
    "ELSE CASE WHEN abs(2 - lam) < 1e-9 THEN -ln(1 - least(x, 0)) ELSE -(pow(1 - least(x, 0), 2 - lam) - 1) / (2 - lam) END END"
)
_SHIFT = "spiky + (SELECT CASE WHEN min(spiky) <= 0 THEN abs(min(spiky)) + 1 ELSE 0 END FROM d)"
add("transform_bias_boxcox", lambda s, d: transform(s, d, "bias_boxcox", "spiky"), D + ", " + grid_sql(_X.format(v=_SHIFT), _BC, "ln(x)") + f" SELECT o_orderkey, round({_BC}, 6) AS value FROM g, b3")
add(
    "transform_bias_yeojohnson", lambda s, d: transform(s, d, "bias_yeojohnson", "shifted"),
    D + ", " + grid_sql(_X.format(v="shifted"), _YJ, "sign(x) * ln(1 + abs(x))") + f", y AS (SELECT o_orderkey, {_YJ} AS y FROM g, b3) SELECT o_orderkey, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS value FROM y",
)


def _polynomials(own: tuple, r: str) -> str:
    poly = []
    for coefficients in own:
        expr = repr(float(coefficients[0]))
        for k in coefficients[1:]:
            expr = f"({expr} * ({r}) + {float(k)!r})"
        poly.append(expr)
    return f"{poly[0]} / {poly[1]}"


_NORMAL = (
    f"CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_polynomials(text.MIDDLE, '0.180625 - (p - 0.5) * (p - 0.5)')} "
    f"ELSE sign(p - 0.5) * CASE WHEN t <= 5 THEN {_polynomials(text.TAIL, 't - 1.6')} ELSE {_polynomials(text.FAR, 't - 5')} END END"
)
add(
    "transform_bias_quantile", lambda s, d: transform(s, d, "bias_quantile", "price"),
    D + f", m AS (SELECT unnest(quantile_cont(price, [i / {X.LANDMARKS - 1}.0 FOR i IN range({X.LANDMARKS})])) AS q FROM d)"
    + ", k AS (SELECT v, count(*) FILTER (WHERE q <= v) AS upto, count(*) FILTER (WHERE q < v) AS under, max(q) FILTER (WHERE q <= v) AS lo, min(q) FILTER (WHERE q > v) AS hi FROM (SELECT DISTINCT price AS v FROM d WHERE price IS NOT NULL), m GROUP BY v), "
    "h AS (SELECT v, CASE WHEN upto > under THEN (under + upto - 1) / 2.0 / 999 WHEN upto = 0 THEN 0.0 WHEN upto = 1000 THEN 1.0 ELSE (upto - 1 + (v - lo) / (hi - lo)) / 999 END AS share FROM k), "
    "p AS (SELECT v, least(greatest(share, 1e-7), 1 - 1e-7) AS p FROM h), t AS (SELECT v, p, sqrt(-ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t FROM p) "
    f"SELECT o_orderkey, round({_NORMAL}, 6) AS value FROM d LEFT JOIN t ON price = v",
)

WORDS = ["the", "of", "and", "de", "la", "que", "der", "die", "und", "le", "les"]
_TOGETHER = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.TOGETHER.items())
_APART = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.APART.items())
_CLEANED = (
    "SELECT {key}, CASE c {apart} ELSE c END AS {col} FROM (SELECT {key}, array_to_string(list_filter(string_split_regex(translate(regexp_replace(regexp_replace(CASE l {together} ELSE l END, '[:;=]-?[()]', '', 'g'), '[[:punct:]´�]', '', 'g'), "
    "'áéíóúòàèìù', 'aeiouoaeiu'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '' AND NOT list_contains({words}, w)), ' ') AS c FROM (SELECT {key}, lower({col}) AS l FROM {source}))"
)
add(
    "transform_clean_text", lambda s, d: X.transformed(table(s, d, "documents").select("doc_id", "text"), {"text": [X.text_cleaner(WORDS)]}),
    _CLEANED.format(key="doc_id", col="text", together=_TOGETHER, apart=_APART, words=str(WORDS), source="documents"),
)
#: Brand labels differ in one or two digits alone, so two of them match in six characters, and one more if they share a digit.
add(
    "transform_merge_similar", lambda s, d: X.merge_similar(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand"),
    "WITH RECURSIVE b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, string_split(substr(v, 7), '') AS digits FROM (SELECT DISTINCT p_brand AS v FROM part)), "
    "r AS (SELECT x.i AS i, y.i AS j, 2.0 * (6 + CASE WHEN list_has_any(x.digits, y.digits) THEN 1 ELSE 0 END) / (length(x.v) + length(y.v)) AS r FROM b x JOIN b y ON x.i < y.i), "
    "c AS (SELECT j, list(i) AS near FROM r WHERE r >= (SELECT quantile_cont(r, 0.75) FROM r) GROUP BY j), "
    "o AS (SELECT b.i AS j, coalesce(near, CAST([] AS BIGINT[])) AS near FROM b LEFT JOIN c ON c.j = b.i), "
    "w AS (SELECT CAST(-1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS target, CAST([] AS BIGINT[]) AS gone UNION ALL "
    "SELECT o.j, list_max(list_filter(near, lambda i: NOT list_contains(gone, i))), CASE WHEN list_max(list_filter(near, lambda i: NOT list_contains(gone, i))) IS NULL THEN gone ELSE list_append(gone, o.j) END FROM w JOIN o ON o.j = w.j + 1) "
    "SELECT p_partkey, coalesce(t.v, p_brand) AS p_brand FROM part JOIN b ON b.v = p_brand JOIN w ON w.j = b.i LEFT JOIN b t ON t.i = w.target",
)

# casts by content, remediation by type

add(
    "content_types", lambda s, d: (lambda t: s.createDataFrame([(n, k) for n, k in content_types(t, ladder=True).items()], "field string, kind string"))(dirty(s, d).selectExpr("price", "priority", "large", "code", "cast(o_orderkey as string) AS whole", "cast(placed as string) AS at", "case when large then 'True' when not large then 'False' end AS flag")),
    D + "SELECT 'price' AS field, 'float' AS kind UNION ALL SELECT 'priority', 'string' UNION ALL SELECT 'large', 'boolean' UNION ALL SELECT 'code', CASE WHEN count(code) = count(TRY_CAST(code AS DOUBLE)) THEN 'integer' ELSE 'string' END FROM d UNION ALL SELECT 'whole', 'integer' UNION ALL SELECT 'at', 'datetime' UNION ALL SELECT 'flag', 'boolean'",
)
add(
    "remediate_by_type", lambda s, d: remediate.by_type(dirty(s, d).select("o_orderkey", "priority", "code", "large")),
    D + "SELECT o_orderkey, coalesce(replace(lower(priority), '-', ''), '') AS priority, code, large FROM d",
)
add("profile_events_temporal_bounded", lambda s, d: profile.temporal(table(s, d, "events"), "ts"),
    "WITH g AS (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS gap FROM events), a AS (SELECT quantile_cont(gap, 0.5) AS med, max(gap) AS top FROM g WHERE gap IS NOT NULL) "
    "SELECT 'ts' AS field, round(med, 6) AS median_gap, round(top, 6) AS max_gap, round(CASE WHEN top > 2 * med THEN top / med - 2 ELSE 0 END, 6) AS temporal_anomaly FROM a")  # fmt: skip
add("eval_time_error", lambda s, d: dirty(s, d).agg(*(c.alias(n) for n, c in evaluate.time_error(F.col("placed"), F.timestamp_micros(F.unix_micros(F.col("placed").cast("timestamp")) + (F.col("o_orderkey") % 7) * 1_000_000)).items())),
    D + ", e AS (SELECT o_orderkey % 7 AS x FROM d WHERE placed IS NOT NULL) SELECT round(sqrt(avg(x * x)), 6) AS rmse, round(avg(x), 6) AS mae, round((sqrt(avg(x * x)) + avg(x)) / 2, 6) AS combined FROM e")


def profiled(s: SparkSession, d: str) -> DataFrame:
    own = profile.Profiler()
    own.register("float", "spread", lambda c: F.max(c) - F.min(c))
    own.register("float", "broken", lambda c: F.max("no such column"))
    return own.report(dirty(s, d).select("price", "priority", "large", "placed"))


_STRING_METRICS = ("unique_values", "total_values", "null_percentage", "duplicate_percentage", "cardinality_ratio", "avg_length", "mode_frequency", "quality_score")
_TIMES = (
    "SELECT 'placed' AS field, unnest(['null_percentage', 'duplicate_percentage', 'median_gap', 'max_gap', 'temporal_anomaly', 'quality_score']) AS metric, unnest([np, dp, med, top, odd, greatest(100 - 0.5 * np - 0.2 * dp - 5 * odd, 0)]) AS value FROM ("
    "SELECT np, dp, med, top, CASE WHEN med > 0 AND top > 2 * med THEN top / med - 2 ELSE 0 END AS odd FROM (SELECT 100.0 * (count(*) - count(placed)) / count(*) AS np, 100.0 * (count(*) - count(DISTINCT placed) - CASE WHEN count(placed) < count(*) THEN 1 ELSE 0 END) / count(*) AS dp FROM dd), "
    "(SELECT quantile_cont(gap, 0.5) AS med, max(gap) AS top FROM (SELECT (epoch_us(placed) - lag(epoch_us(placed)) OVER (ORDER BY placed)) / 1e6 AS gap FROM dd WHERE placed IS NOT NULL) WHERE gap IS NOT NULL))"
)
add(
    "profile_report", profiled,
    D.replace("WITH d AS", "WITH dd AS") + f"SELECT * FROM ({numeric_sql('dd', ['price'])}) UNION ALL SELECT field, m.metric, CASE m.metric " + " ".join(f"WHEN '{m}' THEN CAST({m} AS DOUBLE)" for m in _STRING_METRICS)
    + f" END FROM ({strings_sql('dd', ['priority'], whole=True)}), (SELECT unnest({list(_STRING_METRICS)}) AS metric) m UNION ALL SELECT 'large', 'true_percentage', 100.0 * avg(CAST(large AS INT)) FROM dd UNION ALL SELECT 'large', 'false_percentage', 100.0 * avg(1 - CAST(large AS INT)) FROM dd "
    f"UNION ALL SELECT * FROM ({_TIMES}) UNION ALL SELECT 'price', 'spread', max(price) - min(price) FROM dd UNION ALL SELECT 'price', 'broken', NULL",
    whole=True,
)

# policies

_POLICY_COLUMNS = "field string, type string, required boolean, rules string, unique boolean, outliers boolean, privacy string, security string, critical boolean"


def generated(s: SparkSession, d: str) -> DataFrame:
    made = policy.generate(table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "part")
    rows = [(f["field_name"], f["type"], f["required"], ",".join(f["rules"]), f["integrity"]["unique"], f["integrity"]["contains_outliers"], f["privacy_level"], f["security"], f["critical_field"]) for f in made["fields"]]
    return s.createDataFrame([*rows, ("*", None, None, ",".join(made["enforcement_requirements"]["required_fields"]), None, None, made["compliance"]["risk_level"], None, None)], _POLICY_COLUMNS)


def _field_sql(name: str, kind: str, level: str, number: bool) -> str:
    odd = f"(SELECT count(*) > 0 FROM part, (SELECT quantile_cont({name}, 0.25) AS a, quantile_cont({name}, 0.75) AS b FROM part) WHERE {name} < a - 1.5 * (b - a) OR {name} > b + 1.5 * (b - a))" if number else "false"
    own = f"'no_nulls' || CASE WHEN count(*) = count({name}) AND min({name}) >= 0 THEN ',positive_values' ELSE '' END || CASE WHEN count(DISTINCT {name}) < 10 THEN ',enumerated_values' ELSE '' END" if number else "'no_nulls,no_special_characters,max_length'"
    unique = f"count(DISTINCT {name}) = count(*)"
    return (
        f"SELECT '{name}' AS field, '{kind}' AS type, count(*) = count({name}) AS required, {own} AS rules, {unique} AS unique, {odd} AS outliers, {level} AS privacy, "
        f"CASE {level} WHEN 'high' THEN 'encrypted' ELSE 'none' END AS security, {level} = 'high' AND {unique} AS critical FROM part"
    )


_DIGITS = "CASE WHEN bool_or(regexp_matches(CAST({c} AS VARCHAR), '\\d{{6,}}|\\d{{3}}-\\d{{2}}-\\d{{4}}')) THEN 'high' ELSE 'low' END"
_FIELDS_SQL = " UNION ALL ".join(
    _field_sql(n, k, level, k == "integer") for n, k, level in (("p_partkey", "integer", _DIGITS.format(c="p_partkey")), ("p_name", "string", "'high'"), ("p_brand", "string", _DIGITS.format(c="p_brand")), ("p_size", "integer", _DIGITS.format(c="p_size")))
)
add(
    "policy_generate", generated,
    f"WITH f AS ({_FIELDS_SQL}) SELECT * FROM f UNION ALL SELECT '*', NULL, NULL, 'p_partkey,p_name,p_brand,p_size', NULL, NULL, CASE WHEN count(*) FILTER (WHERE privacy = 'high') >= 2 THEN 'high' ELSE 'low' END, NULL, NULL FROM f",
)

def compliance(s: SparkSession, d: str) -> DataFrame:
    """What is wrong with a policy made from part, in the dialect of a mapping: names are sensitive, brands are masked."""
    made = policy.generate(table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "part")
    own = {f["field_name"]: {"sensitive": f["privacy_level"] == "high", "required": f["required"], "policy": "mask" if f["type"] == "string" and f["privacy_level"] == "low" else None, "compliance": "habeas_data" if f["integrity"]["unique"] else None} for f in made["fields"]}
    return s.createDataFrame([(x,) for x in policy.validate_compliance({"fields": own})], "issue string")


_TREATED = "SELECT '{c}' AS field, {level} = 'high' AS sensitive, count(*) = count({c}) AS required, {string} AND {level} = 'low' AS masked, count(DISTINCT {c}) = count(*) AS marked FROM part"
add(
    "policy_compliance", compliance,
    "WITH f AS (" + " UNION ALL ".join(_TREATED.format(c=c, string=str(c in ("p_name", "p_brand")).lower(), level="'high'" if c == "p_name" else _DIGITS.format(c=c)) for c in ("p_partkey", "p_name", "p_brand", "p_size")) + ") "
    "SELECT 'Sensitive field ''' || field || ''' has no fitting treatment.' AS issue FROM f WHERE sensitive AND NOT masked UNION ALL SELECT 'Required field ''' || field || ''' has no policy.' FROM f WHERE required AND NOT masked "
    "UNION ALL SELECT 'Field ''' || field || ''' isn''t marked for habeas data in region CO.' FROM f WHERE NOT marked",
)


def policy_file(s: SparkSession, d: str) -> DataFrame:
    """A policy that is made and saved, as it is read again: its fields, and whether a second call finds the file."""
    part, path = table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), folder(s, "policy") + "/part.yaml"
    made, found = policy.get_or_create(part, path), policy.get_or_create(part.limit(0), path)
    rows = [(f["field_name"], f["type"], ",".join(f["rules"]), f["integrity"]["unique"], f["privacy_level"], made["fields"] == found["fields"]) for f in policy.load(path, s)["fields"]]
    return s.createDataFrame(rows, "field string, type string, rules string, is_unique boolean, privacy string, same boolean")


add("policy_file", policy_file, f'SELECT field, type, rules, "unique" AS is_unique, privacy, true AS same FROM ({_FIELDS_SQL})')
add(
    "policy_roles", lambda s, d: policy.roles(table(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")),
    "SELECT 'p_partkey' AS field, 'dimension' AS role, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, count(DISTINCT p_partkey) AS kinds, 0 AS violations FROM part UNION ALL SELECT 'p_brand', 'dimension', NULL, NULL, count(DISTINCT p_brand), 0 FROM part UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', CASE WHEN k BETWEEN 20 AND n - 1 THEN 'fact' ELSE 'dimension' END, CASE WHEN k BETWEEN 20 AND n - 1 THEN round(m - 3 * s, 6) END, CASE WHEN k BETWEEN 20 AND n - 1 THEN round(m + 3 * s, 6) END, k, "
        f"CASE WHEN k BETWEEN 20 AND n - 1 THEN (SELECT count(*) FROM part WHERE {c} < m - 3 * s OR {c} > m + 3 * s) ELSE 0 END FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS k, avg({c}) AS m, stddev_samp({c}) AS s FROM part)"
        for c in ("p_size", "p_retailprice")
    ),
)

# the monitor, in all its phases

MONITORED = ORDERS_POLICY | {"disaggregation_dimension": "priority", "primary_key": "o_orderkey", "fill_values": {"priority": "none", "spiky": 0.0}}


def monitored(s: SparkSession, d: str) -> DataFrame:
    registry = metrics.Registry()
    registry.register_field_metric("longest", lambda f, c: F.max(F.length(c.cast("string"))), ("ingestion",))
    registry.register_field_metric("broken", lambda f, c: F.max("no such column"), ("ingestion",))
    registry.register_pipeline_metric("phases", lambda m, found: len(found))
    source = dirty(s, d).select("o_orderkey", "spiky", "price", "priority")
    found = monitor.Monitor(source.unionByName(source.where("o_orderkey % 50 = 0")), MONITORED, registry, historical_score=90.0)
    report = found.report()
    whole = lambda phase, rows: s.createDataFrame([(phase, f, m, float(v)) for f, m, v in rows], "phase string, field string, metric string, value double")
    first = metrics.as_frame(s, report["ingestion"]["field_metrics"]).where("metric not in ('custom_broken', 'custom_longest') or field = 'priority'").select(F.lit("ingestion").alias("phase"), "field", "metric", "value")
    split, clean_up = report["disaggregation"], report["cleaning"]
    groups = split["group_counts"].select(F.lit("disaggregation").alias("phase"), F.col("priority").alias("field"), F.lit("rows").alias("metric"), F.col("n").cast("double").alias("value"))
    rest_ = whole("cleaning", [(n, "impact", v) for n, v in clean_up["impact"].items()]).unionByName(whole("disaggregation", [("o_orderkey", "primary_key_duplicate_pct", split["primary_key_duplicate_pct"])]))
    rest_ = rest_.unionByName(whole("indexing", [("*", "rows", found.df.count())])).unionByName(whole("continuous_monitoring", [("*", "drift_percentage", report["continuous_monitoring"]["drift_percentage"])]))
    rest_ = rest_.unionByName(whole("report", [("*", k, v) for k, v in report["custom_pipeline_measures"].items()]))
    return first.unionByName(groups).unionByName(rest_)


_M = f"WITH d0 AS (SELECT {PARTS} FROM orders), d AS (SELECT o_orderkey, spiky, price, priority FROM d0 UNION ALL SELECT o_orderkey, spiky, price, priority FROM d0 WHERE o_orderkey % 50 = 0), "


def _scores_sql(name: str, source: str) -> str:
    """CTE name (field, np, dp, sk, op, cr, tm, sc, score ..) over source (spiky, price, priority)."""
    number = (
        "SELECT '{c}' AS field, *, greatest(100 - 0.5 * np - 0.2 * dp - 0.5 * op - 10 * greatest(sk - 1, 0) - CASE WHEN tm = 1 THEN 0 ELSE 20 END, 0) AS score FROM (SELECT 100.0 * (count(*) - count({c})) / count(*) AS np, 100.0 * (count(*) - count(DISTINCT {c})) / count(*) AS dp, "
        "count(DISTINCT {c}) / count(*) AS ur, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS lo, max({c}) AS hi, abs(skewness({c})) AS sk, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, "
        "100.0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) AS op, CAST(NULL AS DOUBLE) AS cr, {tm} AS tm, 1 AS sc FROM {s}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {s}))"
    )
    string = (
        "SELECT 'priority', *, greatest(100 - 0.5 * np - 0.2 * dp - 50 * greatest(cr - 0.8, 0) - CASE WHEN sc = 1 THEN 0 ELSE 15 END, 0) FROM (SELECT 100.0 * (count(*) - count(priority)) / count(*) AS np, 100.0 * (count(*) - count(DISTINCT priority)) / count(*) AS dp, count(DISTINCT priority) / count(*) AS ur, "
        "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT priority) / count(priority) AS cr, 1 AS tm, CASE WHEN bool_and(priority IS NULL OR length(priority) <= 3 OR priority LIKE '%***') THEN 1 ELSE 0 END AS sc FROM {s})"
    )
    return f"{name} AS ({number.format(c='spiky', tm=1, s=source)} UNION ALL {number.format(c='price', tm=0, s=source)} UNION ALL {string.format(s=source)})"


_CELLS = {
    "null_percentage": "np", "duplicate_percentage": "dp", "uniqueness_rate": "ur", "mean": "mean", "std": "std", "min": "lo", "max": "hi", "skewness": "sk", "percentile_25": "q1", "median": "q2", "percentile_75": "q3",
    "outlier_percentage": "op", "cardinality_ratio": "cr", "type_match": "tm", "security_compliant": "sc", "field_quality_score": "score",
}
_LONG = f"SELECT 'ingestion' AS phase, field, m AS metric, v AS value FROM (SELECT field, unnest({list(_CELLS)}) AS m, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in _CELLS.values())}]) AS v FROM f) WHERE v IS NOT NULL"
add(
    "monitor_report", monitored,
    _M + _scores_sql("f", "d") + ", u AS (SELECT DISTINCT o_orderkey, spiky, price, coalesce(priority, 'none') AS priority FROM d), " + _scores_sql("h", "u")
    + f" {_LONG} UNION ALL SELECT 'ingestion', 'global', unnest(['average_quality_score', 'total_fields', 'drift_percentage']), unnest([avg(score), 4, (avg(score) - 90) / 90 * 100]) FROM f "
    "UNION ALL SELECT 'ingestion', 'priority', 'custom_longest', max(length(priority)) FROM d "
    "UNION ALL SELECT 'disaggregation', priority, 'rows', count(*) FROM d WHERE priority IS NOT NULL GROUP BY priority UNION ALL SELECT 'disaggregation', 'o_orderkey', 'primary_key_duplicate_pct', round_even(100.0 * (count(*) - count(DISTINCT o_orderkey)) / count(*), 2) FROM d "
    + "".join(f"UNION ALL SELECT 'cleaning', '{c}', 'impact', round_even((SELECT 100.0 * (count(*) - count({c})) / count(*) FROM d) - (SELECT 100.0 * (count(*) - count({c})) / count(*) FROM u), 2) " for c in ("o_orderkey", "spiky", "price", "priority"))
    + "UNION ALL SELECT 'indexing', '*', 'rows', count(*) FROM u UNION ALL SELECT 'continuous_monitoring', '*', 'drift_percentage', (avg(score) - 90) / 90 * 100 FROM h UNION ALL SELECT 'report', '*', 'phases', 6",
    whole=True,
)
add(
    "drift", lambda s, d: s.createDataFrame([(metrics.drift(metrics.field_metrics(table(s, d, "orders"), {"fields": [{"field_name": "o_totalprice", "type": "float"}]})["o_totalprice"]["mean"], 100000.0), metrics.drift(1.0, None))], "drift double, unknown double"),
    "SELECT (avg(o_totalprice) - 100000.0) / 100000.0 * 100 AS drift, CAST(NULL AS DOUBLE) AS unknown FROM orders", whole=True,
)

# improvement


def improver(s: SparkSession, d: str) -> improve.Improver:
    return improve.Improver(metrics.field_metrics(dirty(s, d), ORDERS_POLICY), ORDERS_POLICY)


_F = D + ", " + _scores_sql("f", "d")
_P = (
    "p AS (SELECT field, score, unnest(['null_percentage', 'duplicate_percentage', 'outlier_percentage', 'skewness', 'cardinality_ratio', 'type_match', 'security_compliant']) AS metric, "
    "unnest([0.5 * np, 0.2 * dp, 0.5 * op, 10 * greatest(sk - 1, 0), 50 * greatest(cr - 0.8, 0), CASE WHEN tm = 1 THEN 0 ELSE 20 END, CASE WHEN sc = 1 THEN 0 ELSE 15 END]) AS lost FROM f), "
    "q AS (SELECT field, score, metric, least(lost, 100 - score) AS potential FROM p WHERE lost > 0 OR lost IS NOT NULL AND metric IN ('null_percentage', 'duplicate_percentage', 'outlier_percentage'))"
)
add("field_potentials", lambda s, d: improver(s, d).potentials(s).where("metric is not null"), f"{_F}, {_P} SELECT field, metric, potential FROM q", whole=True)
add("improvement_chart", lambda s, d: improver(s, d).chart(s), f"{_F}, {_P} SELECT field, any_value(score) AS current_score, any_value(score) + least(sum(potential), 100 - any_value(score)) AS potential_score FROM q GROUP BY field", whole=True)
add(
    "improvement_advice", lambda s, d: improver(s, d).advice(s),
    f"{_F}, {_P} SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY potential DESC) - 1 AS INT) AS place, printf('Improving ''%s'' could raise the score by up to %.1f points.', metric, potential) AS advice FROM q WHERE potential > 0 UNION ALL SELECT 'gone', 0, 'The field is missing; including it comes first.'",
)


def predicted(s: SparkSession, d: str) -> DataFrame:
    """The model of a history table: prices by quantity and discount, as if these were what metrics had gained."""
    gained = F.create_map(F.lit("quantity"), F.col("l_quantity").cast("double"), F.lit("discount"), F.col("l_discount").cast("double"))
    history = table(s, d, "lineitem").select(gained.alias("field_improvements"), F.col("l_extendedprice").cast("double").alias("quality_score_improvement"))
    own = improve.Improver({}, {}, history)
    return s.createDataFrame([(q, own.predict({"quantity": q, "discount": 0.05})) for q in (1.0, 25.0)], "quantity double, predicted double").select("quantity", F.round("predicted", 3).alias("predicted"))


add(
    "improvement_model", predicted,
    "WITH c AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS v12, covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2 FROM lineitem) "
    "SELECT q AS quantity, round(my + (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) * (q - m1) + (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) * (0.05 - m2), 3) AS predicted FROM c, (VALUES (1.0::DOUBLE), (25.0::DOUBLE)) AS t(q)",
)
add(
    "relational_rules", lambda s, d: improve.relational(dirty(s, d), {"relational_rules": [{"rule": ">", "fields": ["spiky", "shifted"]}, {"rule": "<=", "fields": ["price", "shifted"]}, {"rule": "like", "fields": ["a", "b"]}]}),
    D + "SELECT 'relational' AS rule, '`spiky` > `shifted`' AS field, count(*) FILTER (WHERE NOT spiky > shifted) AS violations, count(*) FILTER (WHERE NOT spiky > shifted) = 0 AS ok FROM d UNION ALL SELECT 'relational', '`price` <= `shifted`', count(*) FILTER (WHERE NOT price <= shifted), count(*) FILTER (WHERE NOT price <= shifted) = 0 FROM d",
)
add(
    "stratified_by_expression", lambda s, d: sampling.stratified(dirty(s, d), F.substring("priority", 1, 1), {"2": 11, "3": 5}, keys=["o_orderkey"], keep_null=True).groupBy(F.substring("priority", 1, 1).alias("stratum")).agg(F.count("*").alias("n")),
    D + "SELECT substr(priority, 1, 1) AS stratum, CASE substr(priority, 1, 1) WHEN '2' THEN least(11, count(*)) WHEN '3' THEN least(5, count(*)) ELSE count(*) END AS n FROM d GROUP BY 1",
)
add(
    "rules_by_name", lambda s, d: (lambda t: rules.evaluate(t, [rules.named(t, "valid_date_format", "code"), rules.named(t, "no_special_characters", "code"), rules.named(t, "positive_values", "shifted"), rules.named(t, "max_length", "code", hi=3)]))(dirty(s, d)),
    D + "SELECT 'valid_date' AS rule, 'code' AS field, count(*) FILTER (WHERE NOT regexp_full_match(code, '\\d{4,6}')) AS violations, count(*) FILTER (WHERE NOT regexp_full_match(code, '\\d{4,6}')) = 0 AS ok FROM d UNION ALL SELECT 'plain_text', 'code', 0, true UNION ALL "
    "SELECT 'positive', 'shifted', count(*) FILTER (WHERE shifted < 0), count(*) FILTER (WHERE shifted < 0) = 0 FROM d UNION ALL SELECT 'string_length', 'code', count(*) FILTER (WHERE length(code) > 3), count(*) FILTER (WHERE length(code) > 3) = 0 FROM d",
)

# sources: what is written is read back, through the folder that all executors share


def csv_back(s: SparkSession, d: str) -> DataFrame:
    path = folder(s, "csv")
    dirty(s, d).select("o_orderkey", "price", "priority", "large").write.option("header", True).option("sep", ";").csv(path)
    return loader(s, "csv").load(path=path, delimiter=";").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "price", "priority", "large")


def known_of_source(s: SparkSession, d: str) -> DataFrame:
    """What a loader knows after its table was read once, by an action of the caller's."""
    path = folder(s, "csv")
    table(s, d, "orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(path)
    own = loader(s, "csv")
    found = own.load(path=path, schema="o_orderkey long, o_orderstatus string")
    before = own.observed()
    found.write.format("noop").mode("overwrite").save()
    m = own.metadata
    return s.createDataFrame([(m["source"], m["status"], ",".join(m["columns"]), before, own.row_count(observed=True))], "source string, status string, columns string, before long, rows long")


def excel_back(s: SparkSession, d: str) -> DataFrame:
    books = land(files.to_excel(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nations"), "books")
    return files.excel_tables(books, "nations").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def books_back(s: SparkSession, d: str) -> DataFrame:
    """Customers over several workbooks, one for each partition."""
    customers = table(s, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), (F.col("c_custkey") % 2 == 0).alias("even"))
    return files.excel_tables(land(files.to_excel(customers.repartition("c_custkey")), "books")).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@contextmanager
def served(s: SparkSession, answer):
    """The address of a service on the driver; answer(path, parameters) has its answers as bytes."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            body = answer(url.path, {k: v[0] for k, v in parse_qs(url.query).items()})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{s.sparkContext.getConf().get('spark.driver.host', '127.0.0.1')}:{server.server_port}"
    finally:
        server.shutdown()


def in_pages(s: SparkSession, rows: DataFrame, page: Column, read) -> DataFrame:
    """read(address) of a service that has a table's rows by page, as JSON, and an empty answer after the last."""
    path = folder(s, "pages")
    rows.withColumn("page", page.cast("int")).write.partitionBy("page").json(path)

    def answer(_, asked):
        one = f"{path}/page={int(asked['page'])}"
        lines = [x for n, _ in landing.listed(s, one) if n.startswith("part-") for x in landing.get_text(s, f"{one}/{n}").splitlines()]
        return b'{"result": {"items": [' + ",".join(lines).encode() + b"]}}"

    with served(s, answer) as url:
        return read(url)


def api_back(s: SparkSession, d: str) -> DataFrame:
    nations = table(s, d, "nation").select("n_nationkey", F.struct("n_name", F.array("n_regionkey", "n_nationkey").alias("keys")).alias("at"))
    return in_pages(s, nations, F.floor(F.col("n_nationkey") / 10), lambda url: rest.read_api(s, url, json_path="result.items", pagination={"param": "page", "step": 1}))


def api_pages(s: SparkSession, d: str) -> DataFrame:
    """Customers over many pages, until the first that is empty."""
    customers = table(s, d, "customer").select("c_custkey", F.struct("c_name", F.col("c_acctbal").cast("double").alias("c_acctbal")).alias("own"))
    found = in_pages(s, customers, F.floor(F.col("c_custkey") / 500), lambda url: rest.read_api(s, url, json_path="result.items", pagination={"param": "page", "step": 1}, max_pages=1_000_000))
    return found.select("c_custkey", "own_c_name", F.col("own_c_acctbal").cast("double").alias("own_c_acctbal"))


def open_data(s: SparkSession, d: str) -> DataFrame:
    """Orders of a service: conditions run there as far as it takes them, over the table that stands behind it."""
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
    kinds = {"o_orderkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderpriority": "text"}

    def answer(path, asked):
        if path.startswith("/api/views"):
            return json.dumps({"columns": [{"fieldName": n, "dataTypeName": k} for n, k in kinds.items()]}).encode()
        query = asked["$query"].replace(":id", "o_orderkey")
        word = next((w for w in (" WHERE ", " ORDER BY ") if w in query), None)
        select, _, more = query.partition(word) if word else (query, "", "")
        found = s.sql(f"{select} FROM {{orders}}" + (f"{word}{more}" if word else ""), orders=orders)
        return json.dumps([{k: str(v) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in found.collect()]).encode()  # a page of rows

    with served(s, answer) as url:
        asking = max(1, s.sparkContext.defaultParallelism // 2)  # the service's own work needs the other half
        found = opendata.read_socrata(s, url, "abcd-1234", limit=None, tasks=asking).where("o_totalprice > 200000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%H%' AND o_orderkey % 3 = 1")
        return land(found.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", "o_totalprice"), "opendata")


def audit_back(s: SparkSession, d: str) -> DataFrame:
    log = audit.AuditLog(s, folder(s, "audit"))
    for at in (0, 1):  # the second time each is known already
        log.append(table(s, d, "nation").select(F.concat(F.lit("u"), "n_nationkey").alias("uuid"), F.lit(f"2024-01-0{at + 1}").alias("timestamp"), F.col("n_name").alias("name"), F.lit(at).alias("time")))
    return log.fields("name string, time int").select("uuid", "timestamp", "status", "name", "time")


def log_compacted(s: SparkSession, d: str) -> DataFrame:
    log = audit.AuditLog(s, folder(s, "audit"), "json")
    for part in ("r_regionkey < 2", "r_regionkey >= 2"):
        log.append(table(s, d, "region").where(part).select(F.col("r_name").alias("message"), F.col("r_regionkey").alias("key")), status="error")
    return log.compact().load().groupBy("status", "message").agg(F.count("*").alias("n"))


def log_of_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders logged by status, one save each, compacted between, and logged again: the first save of each stays."""
    log = audit.AuditLog(s, folder(s, "audit"))
    orders = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("uuid"), F.lit("2024-01-01").alias("timestamp"), F.col("o_orderstatus").alias("message"), (F.col("o_orderkey") % 5).alias("kind"))
    for status in ("F", "O"):
        log.append(orders.where(F.col("message") == status))
    log.compact()
    log.append(orders.withColumns({"message": F.lit("late"), "timestamp": F.lit("2023-01-01")}))
    log.compact().vacuum()
    return log.fields("kind int").groupBy("message", "kind").agg(F.count("*").alias("n"))


add("source_csv", csv_back, D + "SELECT o_orderkey, round(price, 6) AS price, priority, large FROM d")
add("source_excel", excel_back, "SELECT n_nationkey, n_name, n_regionkey FROM nation")
add("source_api", api_back, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS at_n_name, CAST(n_regionkey AS BIGINT) AS at_keys_0, CAST(n_nationkey AS BIGINT) AS at_keys_1 FROM nation")
add("audit_log", audit_back, "SELECT 'u' || CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS VARCHAR) AS uuid, '2024-01-01' AS timestamp, 'ok' AS status, n_name AS name, 0 AS time FROM nation")
add("audit_log_compacted", log_compacted, "SELECT 'error' AS status, r_name AS message, 1 AS n FROM region")
add("source_metadata", known_of_source, "SELECT 'csv' AS source, 'success' AS status, 'o_orderkey,o_orderstatus' AS columns, CAST(NULL AS BIGINT) AS before, count(*) AS rows FROM orders")
add("source_excel_books", books_back, "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, round(CAST(c_acctbal AS DOUBLE), 6) AS c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
add("source_api_pages", api_pages, "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name AS own_c_name, round(CAST(c_acctbal AS DOUBLE), 6) AS own_c_acctbal FROM customer")
add("source_opendata", open_data, "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, round(CAST(o_totalprice AS DOUBLE), 6) AS o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%H%' AND o_orderkey % 3 = 1")
add("audit_log_orders", log_of_orders, "SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'late' END AS message, CAST(o_orderkey % 5 AS INT) AS kind, count(*) AS n FROM orders GROUP BY 1, 2")
_ASKED = {"o_totalprice": (">", 1000), "o_orderstatus": ("in", ["O", "F'"])}
add(
    "soql_text", lambda s, d: table(s, d, "orders").where(opendata.conditions_text(_ASKED)).select("o_orderkey", F.lit(opendata.soql(_ASKED, 7)).alias("query")),
    "SELECT o_orderkey, 'SELECT * WHERE o_totalprice > 1000 AND o_orderstatus in (''O'', ''F'''''') LIMIT 7' AS query FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('O', 'F''')",
)

# profiles that add up, times and texts in other shapes, the choice among candidates

_STATED = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
_SHARES = {"rows": "count(*)", "null_percentage": "100.0 * (count(*) - count({c})) / count(*)"}
_EXACT = {
    "number": _SHARES | {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "skewness": "skewness({c})", "kurtosis": "kurtosis({c})", "coefficient_of_variation": "stddev_samp({c}) / avg({c})"},
    "text": _SHARES | {"avg_length": "avg(length({c}))"},
}


def slices(s: SparkSession, d: str) -> DataFrame:
    """States by month of shipment, saved slice by slice and read again."""
    path = folder(s, "states")
    states.save(states.build(table(s, d, "lineitem"), {"month": F.date_format("l_shipdate", "yyyy-MM")}, _STATED), path, ["month"])
    return s.read.parquet(path)


def state_drift(s: SparkSession, d: str) -> DataFrame:
    found = slices(s, d)
    return states.drift(found.where("month < '1998-06'"), found.where("month >= '1998-06'")).where(F.col("metric").isin("rows", "mean", "std", "max"))


def _states_sql(where: str, *wanted: str) -> str:
    parts = []
    for c in _STATED:
        own = {m: x for m, x in _EXACT["text" if c == "l_returnflag" else "number"].items() if not wanted or m in wanted}
        parts.append(f"SELECT '{c}' AS field, unnest({list(own)}) AS metric, unnest([{', '.join(f'CAST({x.format(c=c)} AS DOUBLE)' for x in own.values())}]) AS value FROM lineitem WHERE {where}")
    return " UNION ALL ".join(parts)


_THEN, _NOW = (_states_sql(f"l_shipdate {op} DATE '1998-06-01'", "rows", "mean", "std", "max") for op in ("<", ">="))
add("profile_states", lambda s, d: states.metrics(states.merge(slices(s, d))).where(F.col("metric").isin(*_EXACT["number"], *_EXACT["text"])), _states_sql("true"), whole=True)
add("profile_state_drift", state_drift, f"SELECT field, metric, a.value AS before, b.value AS now, 100.0 * (b.value - a.value) / a.value AS drift_percentage FROM ({_THEN}) a JOIN ({_NOW}) b USING (field, metric)", whole=True)


def times_of_all_shapes(s: SparkSession, d: str) -> DataFrame:
    when = F.col("o_orderdate").cast("timestamp")
    at = [F.year(when), F.month(when), F.dayofmonth(when)]
    clock = [(F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int"), (F.col("o_orderkey") % 59).cast("int")]
    names = ["year", "month", "day", "hour", "minute", "second"]
    shaped = table(s, d, "orders").select(
        "o_orderkey", F.struct(*(c.alias(n) for n, c in zip(names, at))).alias("day"), F.struct(*(c.alias(n) for n, c in zip(names, [*at, *clock]))).alias("moment"), F.array(*at).alias("three"), F.array(*at, *clock).alias("six"),
        F.array(*at[:2]).alias("two"), F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("text"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("soon")).otherwise(F.date_format(when, "yyyy-MM-dd")).alias("some"),
    )
    return shaped.select("o_orderkey", *(F.unix_seconds(parse_time(shaped, n)).alias(n) for n in shaped.columns[1:]))


_DAY = "CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT)"
_CLOCK = "(o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59"
add(
    "parse_time_shapes", times_of_all_shapes,
    f"SELECT o_orderkey, {_DAY} AS day, {_DAY} + {_CLOCK} AS moment, {_DAY} AS three, {_DAY} + {_CLOCK} AS six, CAST(NULL AS BIGINT) AS two, {_DAY} AS text, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE {_DAY} END AS some FROM orders",
)


def texts_at_depth(s: SparkSession, d: str) -> DataFrame:
    """JSON text within JSON text, some of which isn't JSON."""
    inner = F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.array("c_custkey", F.col("c_custkey") + 1).alias("keys")))
    outer = F.to_json(F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 == 0, F.lit("{broken")).otherwise(inner).alias("more")))
    return flatten.flatten(table(s, d, "customer").select("c_custkey", outer.alias("j")), json_text=True, errors="log")


add(
    "flatten_json_at_depth", texts_at_depth,
    "SELECT c_custkey, c_name AS j_name, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS j_more_nation, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey AS BIGINT) END AS j_more_keys_0, "
    "CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey AS BIGINT) + 1 END AS j_more_keys_1, CASE WHEN c_custkey % 10 = 0 THEN '{broken' END AS j_more_error FROM customer",
)
_TWO = ("price", "spiky")
add(
    "choose_normalization", lambda s, d: remediate.compare(dirty(s, d), "normalize", {"price": [X.zscore, X.minmax], "spiky": [X.minmax, X.zscore]}),
    D + f", m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in _TWO)} FROM d), e AS (SELECT " + ", ".join(f"abs(avg(({c} - m_{c}) / s_{c})) + abs(stddev_samp(({c} - m_{c}) / s_{c}) - 1) AS z_{c}" for c in _TWO) + " FROM d, m) "
    + " UNION ALL ".join(f"SELECT '{c}' AS field, 'normalize_minmax' AS candidate, 0.0::DOUBLE AS error, true AS chosen FROM e UNION ALL SELECT '{c}', 'normalize_zscore', round(z_{c}, 6), false FROM e" for c in _TWO),
)
_SKEW = "(SELECT avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) FROM (SELECT {x} AS x, avg({x}) OVER () AS m FROM d))"
add(
    "choose_bias", lambda s, d: remediate.compare(dirty(s, d), "bias", {"spiky": [X.log_shift, X.same], "price": [X.log_shift]}),
    D + " UNION ALL ".join(f"SELECT '{c}' AS field, 'bias_log' AS candidate, round(abs({_SKEW.format(x=f'ln(1 + {c})')}) - abs({_SKEW.format(x=c)}), 6) AS error, true AS chosen" for c in _TWO) + " UNION ALL SELECT 'spiky', 'bias_same', 0.0, false",
)


def by_own_rules(s: SparkSession, d: str) -> DataFrame:
    """One epoch of the iterative engine with registered rules: of equal candidates the first one stays; a field that
    isn't included is left alone."""
    zero = X.Transform("impute_zero", "impute", X.NUMBER, lambda c, p: F.coalesce(c.cast("double"), F.lit(0.0)))
    engine = remediate.Remediator(max_epochs=1, gate=100.0, include={"price", "priority"}, candidates=[X.impute_median], mandatory={})
    engine.register_rule(zero)
    engine.register_mandatory_rule("string", X.impute_empty_string)
    return engine.run(dirty(s, d).select("o_orderkey", "price", "priority", "large"))[0]


add(
    "remediation_by_rules", by_own_rules,
    D + "SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)), 6) AS price, coalesce(priority, '') AS priority, large FROM d",
)
