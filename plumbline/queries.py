"""The registered queries of the data quality engine, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, flatten, metrics, profile, rules, sampling
from .operators import transforms as X
from .plans import improve, monitor, policy, remediate
from .sources import rest
from .streaming import live
from .types import parse_time, quoted, type_mismatches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that sums in another order don't differ."""
    return df.select(*((F.round(quoted(n), 6) + F.lit(0.0)).alias(n) if t in ("double", "float") else quoted(n) for n, t in df.dtypes))


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, whole: bool = False) -> None:
    """whole: doubles as they are; a mean of hundredths may lie half-way between two roundings."""
    QUERIES[name] = lambda spark, d: run(spark, d) if whole else rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


#: Orders with nulls, outliers, negative values, default dates and numbers that can't be read; the same expressions in both engines.
DIRTY = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS spiky",
    "o_totalprice - 100000 AS shifted",
    "NULLIF(o_orderpriority, '1-URGENT') AS priority",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice > 150000 END AS large",
    "CASE WHEN o_orderkey % 9 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS placed",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END AS code",
    "o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000 ELSE 0 END AS cust",
]
D = f"WITH d AS (SELECT {', '.join(DIRTY)} FROM orders) "


def dirty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*DIRTY)


# profiles

def numeric_sql(source: str, fields: list[str]) -> str:
    parts = []
    for c in fields:
        out = f"CASE WHEN q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) THEN 1 ELSE 0 END"
        values = {
            "null_percentage": "np", "duplicate_percentage": "dp", "unique_count": "u", "mean": "m", "std": "s", "min": "lo", "max": "hi", "skewness": "sk", "kurtosis": "ku", "coefficient_of_variation": "s / m",
            "p25": "q1", "median": "q2", "p75": "q3", "outlier_percentage": "op", "bias_flag": "CASE WHEN abs(sk) > 1 OR ku > 3 THEN 1 ELSE 0 END",
            "quality_score": "greatest(100 - 0.5 * np - 0.2 * dp - 0.5 * op - 10 * greatest(abs(sk) - 1, 0), 0)",
        }
        rows = " UNION ALL ".join(f"SELECT '{c}' AS field, '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM x" for k, v in values.items())
        parts.append(
            f"SELECT * FROM (WITH s AS (SELECT * FROM {source}), b AS (SELECT count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u, avg({c}) AS m, stddev_samp({c}) AS s, min({c}) AS lo, max({c}) AS hi, "
            f"quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3, skewness({c}) AS sk, kurtosis({c}) AS ku FROM s), "
            f"x AS (SELECT b.*, 100.0 * (n - k) / n AS np, 100.0 * (n - u - (CASE WHEN k < n THEN 1 ELSE 0 END)) / n AS dp, (SELECT 100.0 * avg({out}) FROM s, b) AS op FROM b) {rows})"
        )
    return " UNION ALL ".join(parts)


# the moments are those of the values, so both engines sum the same doubles; no rounding hides or makes a difference
LINE = ["l_quantity", "l_extendedprice", "l_discount"]
add("profile_lineitem", lambda s, d: profile.numeric(table(s, d, "lineitem"), LINE), numeric_sql("lineitem", LINE), whole=True)
DIRTY_NUMBERS = ["price", "spiky", "shifted"]
add("profile_orders_dirty", lambda s, d: profile.numeric(dirty(s, d), DIRTY_NUMBERS), numeric_sql(f"(SELECT {', '.join(DIRTY)} FROM orders)", DIRTY_NUMBERS), whole=True)


def strings_sql(source: str, fields: list[str], whole: bool = False) -> str:
    one = (
        "SELECT '{c}' AS field, u AS unique_values, k AS total_values, round(np, 6) AS null_percentage, round(dp, 6) AS duplicate_percentage, round(u / k, 6) AS cardinality_ratio, round(al, 6) AS avg_length, mode, "
        "round(100.0 * top / k, 6) AS mode_frequency, top / k > 0.8 AS bias_flag, round(greatest(100 - 0.5 * np - 0.2 * dp - 50 * greatest(u / k - 0.8, 0), 0), 6) AS quality_score FROM ("
        "SELECT count(DISTINCT {c}) AS u, count({c}) AS k, 100.0 * (count(*) - count({c})) / count(*) AS np, 100.0 * (count(*) - count(DISTINCT {c}) - (CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END)) / count(*) AS dp, "
        "avg(length({c})) AS al FROM {t}), (SELECT {c} AS mode, count(*) AS top FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 2 DESC, 1 LIMIT 1)"
    )
    one = one.replace("round(", "if(true, ") if whole else one
    return " UNION ALL ".join(one.format(c=c, t=source) for c in fields)


add("profile_orders_strings", lambda s, d: profile.strings(dirty(s, d), ["priority", "code"]), strings_sql(f"(SELECT {', '.join(DIRTY)} FROM orders)", ["priority", "code"]))
add("profile_part_strings", lambda s, d: profile.strings(table(s, d, "part"), ["p_brand", "p_type", "p_name"]), strings_sql("part", ["p_brand", "p_type", "p_name"]))
add(
    "profile_booleans", lambda s, d: profile.booleans(dirty(s, d), ["large"]),
    D + "SELECT 'large' AS field, 'true_percentage' AS metric, round(100.0 * avg(CAST(large AS INT)), 6) AS value FROM d UNION ALL SELECT 'large', 'false_percentage', round(100.0 * avg(1 - CAST(large AS INT)), 6) FROM d",
)
add(
    "profile_events_temporal", lambda s, d: profile.temporal(table(s, d, "events"), "ts"),
    "WITH g AS (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS gap FROM events), a AS (SELECT quantile_cont(gap, 0.5) AS med, max(gap) AS top FROM g WHERE gap IS NOT NULL) "
    "SELECT 'ts' AS field, round(med, 6) AS median_gap, round(top, 6) AS max_gap, round(CASE WHEN top > 2 * med THEN top / med - 2 ELSE 0 END, 6) AS temporal_anomaly FROM a",
)
NULLABLE = ["price", "priority", "large", "placed", "code"]
add(
    "null_percentages", lambda s, d: profile.null_percentages(dirty(s, d).select(*NULLABLE)),
    D + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_percentage FROM d" for c in NULLABLE),
)
add(
    "missing_pattern", lambda s, d: profile.missing_pattern(dirty(s, d), ["price", "priority", "placed"]),
    D + " UNION ALL ".join(f"SELECT '{a}' AS field_a, '{b}' AS field_b, round(corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT)), 6) AS correlation FROM d" for a in ("price", "priority", "placed") for b in ("price", "priority", "placed")),
)
add(
    "entropy_by_column", lambda s, d: profile.entropy(table(s, d, "part"), ["p_brand", "p_type", "p_size"]),
    " UNION ALL ".join(f"SELECT '{c}' AS field, round(-sum(p * ln(p)), 6) AS entropy, round(1 - sum(p * p), 6) AS gini_impurity FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM part GROUP BY {c})" for c in ("p_brand", "p_type", "p_size")),
)
add(
    "gini_numeric", lambda s, d: profile.gini(table(s, d, "lineitem"), "l_quantity"),
    "SELECT 'l_quantity' AS field, round((2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)), 6) AS gini FROM (SELECT l_quantity AS x, row_number() OVER (ORDER BY l_quantity) AS i FROM lineitem)",
)
add(
    "mad_outliers", lambda s, d: profile.mad_outliers(dirty(s, d), ["spiky"]),
    D + ", m AS (SELECT quantile_cont(spiky, 0.5) AS q FROM d), a AS (SELECT quantile_cont(abs(spiky - q), 0.5) AS mad FROM d, m) SELECT 'spiky' AS field, round(max(mad), 6) AS mad, round(100.0 * avg(CASE WHEN abs(spiky - q) > 3 * mad THEN 1 ELSE 0 END), 6) AS mad_outlier_percentage FROM d, m, a",
)
add("duplicate_rows", lambda s, d: profile.duplicate_rows(table(s, d, "lineitem").select("l_orderkey", "l_linenumber")), "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS duplicate_rows FROM lineitem")
add(
    "duplicate_definitions", lambda s, d: (lambda t: t.agg(profile.repeats_percent(t, "priority", False).alias("nulls_repeat"), profile.repeats_percent(t, "priority").alias("null_is_value")))(dirty(s, d)),
    D + "SELECT round(100.0 * (count(*) - count(DISTINCT priority)) / count(*), 6) AS nulls_repeat, round(100.0 * (count(*) - count(DISTINCT priority) - 1) / count(*), 6) AS null_is_value FROM d",
)

# rules

PARTS = ", ".join(DIRTY)


def rule_checks(t: DataFrame) -> list[rules.Check]:
    return [
        rules.positive(t, "shifted"), rules.not_future(t, "placed", "1996-06-01 00:00:00"), rules.not_null(t, "price"), rules.in_range(t, "spiky", 1000, 300000), rules.allowed_values(t, "priority", ["2-HIGH", "3-MEDIUM"]),
        rules.regex(t, "code", "[0-9]+"), rules.string_length(t, "code", 2, 4), rules.outlier(t, "spiky", 3), rules.named(t, "valid_date_format", "code"), rules.expression(t, "relational", "spiky > shifted"),
    ]


_RULES = {
    ("positive", "shifted"): "shifted < 0",
    ("not_future", "placed"): "placed > TIMESTAMP '1996-06-01 00:00:00'",
    ("not_null", "price"): "price IS NULL",
    ("range", "spiky"): "spiky < 1000 OR spiky > 300000",
    ("allowed_values", "priority"): "priority IS NULL OR priority NOT IN ('2-HIGH', '3-MEDIUM')",
    ("regex", "code"): "NOT regexp_full_match(code, '[0-9]+')",
    ("string_length", "code"): "length(code) < 2 OR length(code) > 4",
    ("outlier", "spiky"): "abs(spiky - (SELECT avg(spiky) FROM d)) > 3 * (SELECT stddev_samp(spiky) FROM d)",
    ("relational", "spiky > shifted"): "NOT spiky > shifted",
}
add(
    "rules_in_one_pass", lambda s, d: (lambda t: rules.evaluate(t, [c for c in rule_checks(t) if c.rule != "valid_date"]))(dirty(s, d)),
    D + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{f}' AS field, count(*) FILTER (WHERE {c}) AS violations, count(*) FILTER (WHERE {c}) = 0 AS ok FROM d" for (r, f), c in _RULES.items()),
)
for (_rule, _field), _sql in _RULES.items():
    add(
        f"rule_{_rule}", lambda s, d, r=_rule: (lambda t: rules.evaluate(t, [c for c in rule_checks(t) if c.rule == r]))(dirty(s, d)),
        D + f"SELECT '{_rule}' AS rule, '{_field}' AS field, count(*) FILTER (WHERE {_sql}) AS violations, count(*) FILTER (WHERE {_sql}) = 0 AS ok FROM d",
    )
add(
    "rule_date_order",
    lambda s, d: (lambda t: rules.evaluate(t, [rules.date_order(t, "o_orderdate", "l_shipdate")]))(table(s, d, "orders").join(table(s, d, "lineitem").select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))),
    "SELECT 'date_order' AS rule, 'o_orderdate, l_shipdate' AS field, count(*) FILTER (WHERE o_orderdate > l_shipdate) AS violations, count(*) FILTER (WHERE o_orderdate > l_shipdate) = 0 AS ok FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
)
add("rule_unique", lambda s, d: rules.unique(dirty(s, d), "priority"), D + "SELECT 'unique' AS rule, 'priority' AS field, CAST(count(*) - count(DISTINCT priority) - 1 AS BIGINT) AS violations, false AS ok FROM d")
add(
    "rule_foreign_key", lambda s, d: rules.foreign_key(dirty(s, d), "cust", table(s, d, "customer"), "c_custkey"),
    D + "SELECT 'foreign_key' AS rule, 'cust' AS field, count(*) AS violations, count(*) = 0 AS ok FROM d WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = cust)",
)
add(
    "rule_distribution", lambda s, d: rules.distribution(dirty(s, d), "spiky", 150000, 1000),
    D + "SELECT 'distribution' AS rule, 'spiky' AS field, CAST(abs(avg(spiky) - 150000) > 1000 AS BIGINT) AS violations, abs(avg(spiky) - 150000) <= 1000 AS ok FROM d",
)
add(
    "validate_format", lambda s, d: rules.validate_format(dirty(s, d), "priority", "[0-9]-[A-Z]+"),
    D + "SELECT '[0-9]-[A-Z]+' AS pattern, count(*) FILTER (WHERE NOT regexp_full_match(priority, '[0-9]-[A-Z]+')) AS invalid_count, count(priority) AS total_checked FROM d",
)
add(
    "security_checks",
    lambda s, d: (lambda t: t.agg(metrics.security_compliant(X.encrypt.apply(F.col("priority"), {}), "string", "encrypted").alias("encrypted"), metrics.security_compliant(X.mask.apply(F.col("priority"), {}), "string", "masked").alias("masked"), metrics.security_compliant(F.col("priority"), "string", "encrypted").alias("plain")))(dirty(s, d)),
    D + ", e AS (SELECT priority AS p, base64(encode(priority)) AS b, CASE WHEN length(priority) > 3 THEN substr(priority, 1, 2) || '***' ELSE priority END AS m FROM d) SELECT bool_and(b IS NULL OR (length(b) % 4 = 0 AND regexp_full_match(b, '[A-Za-z0-9+/]*={0,2}'))) AS encrypted, bool_and(m IS NULL OR length(m) <= 3 OR m LIKE '%***') AS masked, "
    "bool_and(p IS NULL OR (length(p) % 4 = 0 AND regexp_full_match(p, '[A-Za-z0-9+/]*={0,2}'))) AS plain FROM e",
)
add("anti_join_orphans", lambda s, d: rules.orphans(dirty(s, d), "cust", table(s, d, "customer"), "c_custkey").select("o_orderkey", "cust"), D + "SELECT o_orderkey, cust FROM d WHERE cust NOT IN (SELECT c_custkey FROM customer)")

# transforms

_MODE = "(SELECT {c} FROM d WHERE {c} IS NOT NULL AND {w} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
_Q = "(SELECT quantile_cont(spiky, {p}) FROM d)"
_LO, _HI = f"({_Q.format(p=0.25)} - 1.5 * ({_Q.format(p=0.75)} - {_Q.format(p=0.25)}))", f"({_Q.format(p=0.75)} + 1.5 * ({_Q.format(p=0.75)} - {_Q.format(p=0.25)}))"
_TRANSFORMS: dict[str, tuple[str, str | None]] = {
    "impute_median": ("price", "round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)), 6)"),
    "impute_mean": ("price", "round(coalesce(price, (SELECT avg(price) FROM d)), 6)"),
    "impute_mode": ("priority", f"coalesce(priority, {_MODE.format(c='priority', w='true')})"),
    "impute_empty_string": ("priority", "coalesce(priority, '')"),
    "impute_false": ("large", "coalesce(large, false)"),
    "impute_true": ("large", "coalesce(large, true)"),
    "impute_default_date": ("placed", f"epoch_us(coalesce(placed, {_EPOCH}))"),
    "impute_mode_date": ("placed", f"epoch_us(CASE WHEN placed IS NULL OR placed = {_EPOCH} THEN {_MODE.format(c='placed', w=f'placed <> {_EPOCH}')} ELSE placed END)"),
    "winsorize_iqr": ("spiky", f"round(greatest({_LO}, least({_HI}, spiky)), 6)"),
    "normalize_minmax": ("price", "round((price - (SELECT min(price) FROM d)) / (SELECT max(price) - min(price) FROM d), 6)"),
    "normalize_zscore": ("price", "round((price - (SELECT avg(price) FROM d)) / (SELECT stddev_samp(price) FROM d), 6)"),
    "bias_log": ("shifted", "round(ln(1 + shifted + (SELECT CASE WHEN min(shifted) <= 0 THEN abs(min(shifted)) + 1 ELSE 0 END FROM d)), 6)"),
    "encrypt_base64": ("priority", "base64(encode(priority))"),
    "mask": ("priority", "CASE WHEN length(priority) > 3 THEN substr(priority, 1, 2) || '***' ELSE priority END"),
    "bias_none": ("priority", "priority"),
}


def transform(s: SparkSession, d: str, name: str, field: str) -> DataFrame:
    out = X.transformed(dirty(s, d).select("o_orderkey", field), {field: [X.ALL[name]]})
    kind = out.schema[field].dataType.simpleString()
    return out.select("o_orderkey", (F.unix_micros(field) if kind.startswith("timestamp") else F.col(field)).alias("value"))


for _name, (_field, _sql) in _TRANSFORMS.items():
    add(f"transform_{_name}", lambda s, d, n=_name, f=_field: transform(s, d, n, f), _sql and D + f"SELECT o_orderkey, {_sql} AS value FROM d")
add(
    "transform_cyclical_month", lambda s, d: X.transformed(table(s, d, "orders").select("o_orderkey", "o_orderdate"), {"o_orderdate": [X.cyclical]}).select("o_orderkey", F.unix_micros("o_orderdate").alias("value")),
    "WITH y AS (SELECT year(o_orderdate) AS y FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), l AS (SELECT count(*) FILTER (WHERE month(o_orderdate) = 2 AND day(o_orderdate) = 29) > 0 AND NOT ((SELECT y FROM y) % 4 = 0 AND ((SELECT y FROM y) % 100 <> 0 OR (SELECT y FROM y) % 400 = 0)) AS stays FROM orders) "
    "SELECT o_orderkey, epoch_us(CASE WHEN stays THEN o_orderdate ELSE make_timestamp((SELECT y FROM y), month(o_orderdate), CASE WHEN stays THEN 1 ELSE day(o_orderdate) END, hour(o_orderdate), minute(o_orderdate), second(o_orderdate)::DOUBLE) END) AS value FROM orders, l",
)
#: Every order's time of day, on a day of one month.
add(
    "transform_cyclical_weekday",
    lambda s, d: X.transformed(table(s, d, "orders").selectExpr("o_orderkey", "timestamp_micros(825638400000000 + (o_orderkey % 31) * 86400000000 + (o_custkey % 86400) * 1000000) AS placed"), {"placed": [X.cyclical]}).select("o_orderkey", F.unix_micros("placed").alias("value")),
    "WITH o AS (SELECT o_orderkey, make_timestamp(825638400000000 + (o_orderkey % 31) * 86400000000 + (o_custkey % 86400) * 1000000) AS placed FROM orders), f AS (SELECT min(placed) AS f FROM o) SELECT o_orderkey, epoch_us(f) + (isodow(placed) - isodow(f)) * 86400000000 AS value FROM o, f",
)
add(
    "transform_temporal_log", lambda s, d: X.transformed(table(s, d, "orders").select("o_orderkey", "o_orderdate"), {"o_orderdate": [X.temporal_log]}).select("o_orderkey", F.round(F.unix_micros("o_orderdate") / 1e6, 1).alias("value")),
    "WITH s AS (SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 AS t, min(epoch_us(o_orderdate) / 1e6) OVER () AS lo, max(epoch_us(o_orderdate) / 1e6) OVER () AS hi FROM orders), l AS (SELECT *, ln(CASE WHEN t = lo THEN 1 ELSE t - lo END) AS v FROM s), "
    "m AS (SELECT *, min(v) OVER () AS a, max(v) OVER () AS b FROM l) SELECT o_orderkey, round((v - a) / (b - a) * (hi - lo) + lo, 1) AS value FROM m",
)
add(
    "transform_group_rare", lambda s, d: X.group_rare(table(s, d, "part").select("p_partkey", "p_type"), "p_type"),
    "WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) SELECT p_partkey, CASE WHEN n < (SELECT quantile_cont(n, 0.25) FROM c) THEN 'Other' ELSE p_type END AS p_type FROM part JOIN c USING (p_type)",
)
add("fill_values", lambda s, d: X.fill_values(dirty(s, d).select("o_orderkey", "price", "priority"), {"price": 0.0, "priority": "none"}), D + "SELECT o_orderkey, round(coalesce(price, 0), 6) AS price, coalesce(priority, 'none') AS priority FROM d")
add("cast_coerce", lambda s, d: X.cast_by_type(dirty(s, d).select("o_orderkey", "code"), {"code": "integer"}), D + "SELECT o_orderkey, TRY_CAST(code AS BIGINT) AS code FROM d")
add("parse_time_seconds", lambda s, d: (lambda t: t.select("event_id", F.unix_micros(parse_time(t, "sec")).alias("us")))(table(s, d, "events").select("event_id", F.expr("event_id * 3600").alias("sec"))), "SELECT event_id, event_id * 3600 * 1000000 AS us FROM events")

# evaluators

add("eval_imputation", lambda s, d: dirty(s, d).agg(*(c.alias(n) for n, c in evaluate.imputation_error(F.col("price"), F.coalesce("price", F.lit(0)) + F.col("o_orderkey") % 5).items())), D + "SELECT round(sqrt(avg(x * x)), 6) AS rmse, round(avg(abs(x)), 6) AS mae FROM (SELECT o_orderkey % 5 AS x FROM d WHERE price IS NOT NULL)")
add("eval_text_accuracy", lambda s, d: dirty(s, d).agg(evaluate.text_accuracy(F.col("priority"), F.expr("nullif(priority, '2-HIGH')"))["accuracy"].alias("accuracy")), D + "SELECT round(100.0 * avg(CASE WHEN priority <> '2-HIGH' THEN 1.0 END), 6) AS accuracy FROM d")
add("eval_minmax_error", lambda s, d: dirty(s, d).agg(evaluate.minmax_error(F.col("price") / 200000)["error"].alias("error")), D + "SELECT round(avg(CASE WHEN price / 200000 < 0 OR price / 200000 > 1 THEN 1.0 ELSE 0.0 END), 6) AS error FROM d")
add("eval_zscore_error", lambda s, d: dirty(s, d).agg(evaluate.zscore_error(F.col("price") / 100000)["error"].alias("error")), D + "SELECT round(abs(avg(price / 100000)) + abs(stddev_samp(price / 100000) - 1), 6) AS error FROM d")
add("eval_skew_reduction", lambda s, d: dirty(s, d).agg(evaluate.skew_reduction(F.col("spiky"), F.log("spiky"))["reduction"].alias("reduction")), D + ", g AS (SELECT count(*) AS n, skewness(spiky) AS a, skewness(ln(spiky)) AS b FROM d) SELECT round((abs(a) - abs(b)) * (n - 2) / sqrt(n * (n - 1)), 6) AS reduction FROM g")
add(
    "eval_outlier_reduction", lambda s, d: evaluate.outlier_reduction(dirty(s, d), F.col("spiky"), F.least(F.col("spiky"), F.lit(300000.0))),
    D + ", e AS (SELECT spiky AS a, least(spiky, 300000) AS b FROM d), q AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.75) AS a3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.75) AS b3 FROM e), "
    "p AS (SELECT 100.0 * avg(CASE WHEN a < a1 - 1.5 * (a3 - a1) OR a > a3 + 1.5 * (a3 - a1) THEN 1 ELSE 0 END) AS x, 100.0 * avg(CASE WHEN b < b1 - 1.5 * (b3 - b1) OR b > b3 + 1.5 * (b3 - b1) THEN 1 ELSE 0 END) AS y FROM e, q) "
    'SELECT round(x, 6) AS "before", round(y, 6) AS "after", round(x - y, 6) AS reduction FROM p',
)
add(
    "eval_dominance_reduction", lambda s, d: evaluate.dominance_reduction(table(s, d, "part"), F.col("p_brand"), F.col("p_type")),
    'WITH a AS (SELECT 100.0 * max(n) / sum(n) AS x FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)), b AS (SELECT 100.0 * max(n) / sum(n) AS y FROM (SELECT count(*) AS n FROM part GROUP BY p_type)) SELECT round(x, 6) AS "before", round(y, 6) AS "after", round(x - y, 6) AS reduction FROM a, b',
)
add(
    "eval_spread_reduction", lambda s, d: evaluate.spread_reduction(table(s, d, "orders"), F.col("o_orderdate"), F.date_trunc("year", F.col("o_orderdate").cast("timestamp"))),
    "WITH e AS (SELECT epoch_us(o_orderdate) / 1e6 AS a, epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP) / 1e6 AS b FROM orders), m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM e) "
    'SELECT round(avg(abs(a - ma)), 3) AS "before", round(avg(abs(b - mb)), 3) AS "after", round(avg(abs(a - ma)) - avg(abs(b - mb)), 3) AS reduction FROM e, m',
)
_spread = QUERIES["eval_spread_reduction"]
QUERIES["eval_spread_reduction"] = lambda s, d: _spread(s, d).select(*(F.round(c, 3).alias(c) for c in ("before", "after", "reduction")))

# policy, scores, engines

add(
    "sensitive_content", lambda s, d: (lambda t: s.createDataFrame(sorted(policy.sensitive_content(t, ["text", "source"]).items()), "field string, sensitive boolean"))(table(s, d, "documents")),
    " UNION ALL ".join(f"SELECT '{c}' AS field, bool_or(regexp_matches({c}, '^[\\w\\.-]+@[\\w\\.-]+\\.[a-zA-Z]{{2,}}$') OR regexp_matches({c}, '\\+?\\d{{7,15}}|\\d{{3}}-\\d{{2}}-\\d{{4}}|\\d{{6,10}}')) AS sensitive FROM documents" for c in ("source", "text")),
)


def levels(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "customer").select("c_name", "c_mktsegment")
    found = policy.generate(t, "customer")
    return s.createDataFrame([(f["field_name"], f["type"], f["privacy_level"], f["security"], f["access_restriction"], ",".join(f["compliance_tags"]), f["transparency"]) for f in found["fields"]], "field string, type string, privacy_level string, security string, access_restriction string, tags string, transparency string")


add(
    "privacy_levels", levels,
    "SELECT 'c_name' AS field, 'string' AS type, 'high' AS privacy_level, 'encrypted' AS security, 'restricted' AS access_restriction, 'GDPR' AS tags, 'internal' AS transparency UNION ALL "
    "SELECT 'c_mktsegment', 'string', p, CASE p WHEN 'high' THEN 'encrypted' ELSE 'none' END, CASE p WHEN 'high' THEN 'restricted' ELSE 'public' END, '', 'internal' FROM (SELECT CASE WHEN bool_or(regexp_matches(c_mktsegment, '\\d{6,}|\\d{3}-\\d{2}-\\d{4}|^[\\w\\.-]+@')) THEN 'high' ELSE 'low' END AS p FROM customer)",
)
ORDERS_POLICY = {
    "fields": [
        {"field_name": "spiky", "type": "float", "rules": ["no_nulls"], "security": "none"},
        {"field_name": "price", "type": "integer", "rules": ["no_nulls"], "security": "none"},
        {"field_name": "priority", "type": "string", "rules": ["no_nulls"], "security": "masked", "critical_field": True, "data_subject": True, "privacy_level": "low"},
        {"field_name": "gone", "type": "string"},
    ],
    "compliance": {"compliance_frameworks": ["GDPR"], "risk_level": "high"},
    "enforcement_requirements": {"mandatory_rules": ["no_nulls"], "privacy_enforcement": "medium", "security_baseline": "masked", "risk_acceptance": "medium", "framework_enforcement": ["GDPR"]},
}
add(
    "governance_violations", lambda s, d: policy.violations(dirty(s, d), ORDERS_POLICY, "run", "now"),
    D + "SELECT *, 'run' AS execution_id, 'now' AS timestamp FROM (VALUES ('spiky', 'Security level ''none'' is below baseline ''masked''.', 'warning'), ('price', 'Expected type ''integer'' but got ''float''.', 'warning'), ('price', 'Security level ''none'' is below baseline ''masked''.', 'warning'), "
    "('priority', 'Critical field is not unique.', 'warning'), ('priority', 'Privacy level ''low'' is below required ''medium''.', 'error'), ('priority', 'Missing required compliance frameworks: GDPR.', 'warning'), ('gone', 'Field is missing from the dataset.', 'error'), ('__global__', 'Dataset risk level ''high'' exceeds accepted ''medium''.', 'error')) AS v(field, issue, severity) "
    "UNION ALL SELECT f, 'Contains null values.', 'warning', 'run', 'now' FROM (SELECT 'price' AS f, count(*) - count(price) AS n FROM d UNION ALL SELECT 'priority', count(*) - count(priority) FROM d) WHERE n > 0 "
    "UNION ALL SELECT f, 'Contains outliers.', 'warning', 'run', 'now' FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS f, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n FROM d, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d)" for c in ("spiky", "price")) + ") WHERE n > 0",
)
add("policy_rule_report", lambda s, d: policy.rule_report(dirty(s, d), ORDERS_POLICY), D + " UNION ALL ".join(f"SELECT 'not_null' AS rule, '{c}' AS field, count(*) - count({c}) AS violations, count(*) = count({c}) AS ok FROM d" for c in ("spiky", "price", "priority")))


def scores(s: SparkSession, d: str) -> DataFrame:
    own = metrics.field_metrics(dirty(s, d), ORDERS_POLICY)
    return metrics.as_frame(s, own).where("metric in ('field_quality_score', 'average_quality_score')")


_SCORE = "greatest(100 - 0.5 * (100.0 * (count(*) - count({c})) / count(*)) - 0.2 * (100.0 * (count(*) - count(DISTINCT {c})) / count(*)) - {t} - {x}, 0)"
_NUM = "0.5 * (100.0 * count(*) FILTER (WHERE {c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM d) OR {c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM d)) / count(*)) - 10 * greatest(abs(skewness({c})) - 1, 0)"
add(
    "field_quality_scores", scores,
    D + ", f AS (SELECT 'spiky' AS field, " + _SCORE.format(c="spiky", t="0", x=_NUM.format(c="spiky")) + " AS v FROM d UNION ALL SELECT 'price', " + _SCORE.format(c="price", t="20", x=_NUM.format(c="price")) + " FROM d UNION ALL SELECT 'priority', "
    + _SCORE.format(c="priority", t="0", x="50 * greatest(count(DISTINCT priority) / count(priority) - 0.8, 0) - 15") + " FROM d) SELECT field, 'field_quality_score' AS metric, round(v, 6) AS value FROM f UNION ALL SELECT 'global', 'average_quality_score', round(avg(v), 6) FROM f",
)
add(
    "improvement_potential", lambda s, d: improve.potentials(profile.numeric(table(s, d, "lineitem"), LINE)),
    f"SELECT field, metric, round(CASE metric WHEN 'duplicate_percentage' THEN 0.2 * value WHEN 'skewness' THEN 10 * greatest(abs(value) - 1, 0) ELSE 0.5 * value END, 6) AS potential FROM ({numeric_sql('lineitem', LINE)}) WHERE metric IN ('duplicate_percentage', 'null_percentage', 'outlier_percentage', 'skewness')",
)
add("type_mismatches", lambda s, d: s.createDataFrame([(n, x["expected"], x["actual"]) for n, x in type_mismatches(dirty(s, d), {"price": "integer", "code": "string"}).items()], "field string, expected string, actual string"), "SELECT 'price' AS field, 'integer' AS expected, 'float' AS actual")


def remediated(s: SparkSession, d: str) -> DataFrame:
    return remediate.by_policy(dirty(s, d).select("o_orderkey", "spiky", "priority"), ORDERS_POLICY)[0]


add(
    "remediate_by_policy", remediated,
    D + f"SELECT o_orderkey, round(greatest({_LO}, least({_HI}, spiky)), 6) AS spiky, CASE WHEN length(coalesce(priority, '')) > 3 THEN substr(priority, 1, 2) || '***' ELSE coalesce(priority, '') END AS priority FROM d",
)
#: Identifiers and prices stand above the gate, and a text of five values has no candidate; so the numbers with outliers
#: are clipped if they are under the gate and gain by it, and texts lose nulls and are cleaned.
_CLIPPED = "greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), spiky))"
_SCORE = (
    "SELECT greatest(100 - 50.0 * (count(*) - count(x)) / count(*) - 20.0 * (count(*) - count(DISTINCT x) - CASE WHEN count(x) < count(*) THEN 1 ELSE 0 END) / count(*) - 50.0 * count(*) FILTER (WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) / count(*) "
    "- 10 * greatest(abs(skewness(x)) - 1, 0), 0) AS score FROM {s}, (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM {s})"
)
add(
    "iterative_remediation", lambda s, d: remediate.Remediator().run(dirty(s, d).select("o_orderkey", "price", "spiky", "priority"))[0],
    D + f", q AS (SELECT quantile_cont(spiky, 0.25) AS q1, quantile_cont(spiky, 0.75) AS q3 FROM d), c AS (SELECT d.*, {_CLIPPED} AS clipped FROM d, q), s1 AS (SELECT spiky AS x FROM c), s2 AS (SELECT clipped AS x FROM c), "
    f"g AS (SELECT u.score < 90 AND v.score - u.score > 0.5 AS taken FROM ({_SCORE.format(s='s1')}) u, ({_SCORE.format(s='s2')}) v) "
    "SELECT o_orderkey, round(price, 6) AS price, round(CASE WHEN taken THEN clipped ELSE spiky END, 6) AS spiky, coalesce(replace(lower(priority), '-', ''), '') AS priority FROM c, g",
)
add("group_counts", lambda s, d: monitor.group_counts(dirty(s, d), "priority"), D + "SELECT priority, count(*) AS n FROM d WHERE priority IS NOT NULL GROUP BY priority")
add("distinct_rows", lambda s, d: monitor.distinct_rows(table(s, d, "lineitem").select("l_returnflag", "l_linenumber")), "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem")

# relational operators, samples, nested data, streams

add(
    "filter_and_limit", lambda s, d: rest.filtered(table(s, d, "orders").orderBy("o_orderkey"), {"o_totalprice": (">", 150000), "o_orderstatus": ("in", ["F", "O"]), "o_orderpriority": ("like", "%H%")}, 50).select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%H%' ORDER BY o_orderkey LIMIT 50",
)
add("simple_sample_count", lambda s, d: sampling.Sampler(table(s, d, "orders")).sample(["o_orderkey"]).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("k")), "SELECT CAST(ceil((3.8416 * 0.25 / 0.0025) / (1 + (3.8416 * 0.25 / 0.0025 - 1) / count(*))) AS BIGINT) AS n, CAST(ceil((3.8416 * 0.25 / 0.0025) / (1 + (3.8416 * 0.25 / 0.0025 - 1) / count(*))) AS BIGINT) AS k FROM orders")
add(
    "stratified_sample_counts", lambda s, d: sampling.stratified(dirty(s, d), "priority", {"2-HIGH": 20, "3-MEDIUM": 7}, keys=["o_orderkey"]).groupBy("priority").agg(F.count("*").alias("n")),
    D + "SELECT priority, CASE priority WHEN '2-HIGH' THEN least(20, count(*)) WHEN '3-MEDIUM' THEN least(7, count(*)) ELSE count(*) END AS n FROM d WHERE priority IS NOT NULL GROUP BY priority",
)
add("keep_first", lambda s, d: sampling.keep_first(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]),
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
add("union_by_name", lambda s, d: flatten.process(table(s, d, "nation"), table(s, d, "region")), "SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region")
add("index_sort", lambda s, d: sampling.index_sort(dirty(s, d).select("price"), "price").where("price is not null"), D + "SELECT round(price, 6) AS price FROM d WHERE price IS NOT NULL ORDER BY price")
add("flatten_json", lambda s, d: flatten.flatten(flatten.parse_json(table(s, d, "events").select("event_id", "props"), "props")), "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS props_k FROM events")
add("explode_positions", lambda s, d: flatten.explode_positions(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", 64).select("vec_id", *(F.col(f"embedding_{i}").cast("double").alias(f"embedding_{i}") for i in range(64))), "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS embedding_{i}" for i in range(64)) + " FROM embeddings")
add(
    "windowed_quality", lambda s, d: live.windowed(table(s, d, "events"), "ts", ["value"], "1 hour").select(F.unix_micros("start").alias("start_us"), "rows", "value_null_percentage", "value_mean", "value_std", "value_min", "value_max"),
    "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS rows, round(100.0 * (count(*) - count(value)) / count(*), 6) AS value_null_percentage, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max FROM events GROUP BY 1",
)

from . import engine_queries  # noqa: E402, F401  (adds the queries of the engines)
