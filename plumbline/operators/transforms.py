"""Transforms of columns: fitted parameters and a Column made from them.

A transform lists stages; each stage turns a column and the parameters so far into aggregates. `fit` runs
one aggregation per stage for all columns and transforms together, so the number of jobs is that of the
longest transform, whatever the number of columns. `apply` is one select. No transform joins a table with
itself: the old and the new value are two expressions of one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..types import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, clean, num, quoted, seconds, ts
from . import categories, profile

NUMBER = (INTEGER, FLOAT)
Params = dict[str, Any]


@dataclass(frozen=True)
class Exact:
    """A parameter of a stage: exact quantiles of a number, as a list, or as one value; none without values."""

    value: Column
    shares: tuple[float, ...]
    single: bool = False


@dataclass(frozen=True)
class Transform:
    """affine: another scale alone; fills: nulls alone change."""

    name: str
    family: str
    kinds: tuple[str, ...]
    apply: Callable[[Column, Params], Column]
    stages: tuple["Callable[[Column, Params], dict[str, Column]] | Search", ...] = ()
    affine: bool = False
    fills: bool = False


def fit(df: DataFrame, wanted: list[tuple[str, Transform]]) -> dict[tuple[str, str], Params]:
    """Parameters by (field, transform name)."""
    params: dict[tuple[str, str], Params] = {(f, t.name): {} for f, t in wanted}
    for step in range(max((len(t.stages) for _, t in wanted), default=0)):
        now = [(f, t, t.stages[step]) for f, t in wanted if step < len(t.stages)]
        searches = [(params[f, t.name], clean(df, f), stage) for f, t, stage in now if isinstance(stage, Search)]
        if searches:
            search(df, searches)
        cells = [((f, t.name), key, agg) for f, t, stage in now if not isinstance(stage, Search) for key, agg in stage(clean(df, f), params[f, t.name]).items()]
        exact = [(own, key, x) for own, key, x in cells if isinstance(x, Exact)]
        for (own, key, x), q in zip(exact, quantiles(df, [x for _, _, x in exact])):
            params[own][key] = (q and q[0]) if x.single else q
        cells = [c for c in cells if not isinstance(c[2], Exact)]
        if not cells:
            continue
        row = df.agg(*(agg.alias(f"c{i}") for i, (_, _, agg) in enumerate(cells))).first()
        for i, (own, key, _) in enumerate(cells):
            params[own][key] = row[f"c{i}"]
    return params


def quantiles(df: DataFrame, wanted: list[Exact]) -> list[list[float] | None]:
    """All of them from one count of values, ordered in ranges: no task holds a column."""
    if not wanted:
        return []
    per = profile.value_counts(df, [x.value for x in wanted]).select("i", profile.as_number().alias("x"), "n")
    found = profile.quantiles_by(per, {i: list(x.shares) for i, x in enumerate(wanted)})
    return [found.get(i) or None for i in range(len(wanted))]


def transformed(df: DataFrame, chosen: dict[str, list[Transform]]) -> DataFrame:
    """df with the transforms of each field one after the other: a fit and a select for each round."""
    for step in range(max(map(len, chosen.values()), default=0)):
        now = {f: ts_[step] for f, ts_ in chosen.items() if step < len(ts_)}
        params = fit(df, list(now.items()))
        df = df.select(*(now[n].apply(clean(df, n), params[n, now[n].name]).alias(n) if n in now else quoted(n) for n in df.columns))
    return df


def _double(value) -> Column:
    return F.lit(None if value is None else float(value)).cast("double")


def _time(value) -> Column:
    return F.lit(value).cast("timestamp")


# imputation

def _filled(key: str) -> Callable[[Column, Params], Column]:
    return lambda c, p: F.coalesce(num(c), _double(p[key]))


impute_median = Transform("impute_median", "impute", NUMBER, _filled("median"), (lambda c, p: {"median": Exact(num(c), (0.5,), True)},), fills=True)
impute_mean = Transform("impute_mean", "impute", NUMBER, _filled("mean"), (lambda c, p: {"mean": F.avg(num(c))},), fills=True)
impute_mode = Transform("impute_mode", "impute", (*NUMBER, STRING, BOOLEAN), lambda c, p: F.coalesce(c, F.lit(p["mode"])), (lambda c, p: {"mode": F.mode(c, True)},), fills=True)
impute_empty_string = Transform("impute_empty_string", "impute", (STRING,), lambda c, p: F.coalesce(c.cast("string"), F.lit("")), fills=True)
impute_false = Transform("impute_false", "impute", (BOOLEAN,), lambda c, p: F.coalesce(c.cast("boolean"), F.lit(False)), fills=True)
impute_true = Transform("impute_true", "impute", (BOOLEAN,), lambda c, p: F.coalesce(c.cast("boolean"), F.lit(True)), fills=True)
EPOCH = "1970-01-01 00:00:00"
impute_default_date = Transform("impute_default_date", "impute", (DATETIME,), lambda c, p: F.coalesce(ts(c), _time(EPOCH)), fills=True)


def mode_date(fill_nulls: bool = True) -> Transform:
    """The start of the epoch stands for an unknown date and becomes the most frequent other date, the
    earliest of equals; so do nulls, unless fill_nulls is False."""

    def done(c: Column, p: Params) -> Column:
        gap = ts(c) == _time(EPOCH)
        return F.when(gap | ts(c).isNull() if fill_nulls else gap, F.coalesce(_time(p["mode"]), ts(c))).otherwise(ts(c))

    return Transform("impute_mode_date", "impute", (DATETIME,), done, (lambda c, p: {"mode": F.mode(F.when(ts(c) != _time(EPOCH), ts(c)), True)},))


# outliers

def _clip(c: Column, p: Params, rounded: bool) -> Column:
    q = p["q"]
    if not q:
        return num(c)
    lo, hi = q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])
    if rounded:
        lo, hi = float(round(lo)), float(round(hi))
    return F.when(num(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), num(c))))


_QUARTILES = (lambda c, p: {"q": Exact(num(c), (0.25, 0.75))},)
winsorize = Transform("winsorize_iqr", "atypical", NUMBER, lambda c, p: _clip(c, p, False), _QUARTILES)
winsorize_whole = Transform("winsorize_whole", "atypical", (INTEGER,), lambda c, p: _clip(c, p, True), _QUARTILES)


# scales

def _minmax(c: Column, p: Params) -> Column:
    if p["lo"] is None:
        return num(c)
    return (num(c) - p["lo"]) / ((p["hi"] - p["lo"]) or 1.0)


minmax = Transform("normalize_minmax", "normalize", NUMBER, _minmax, (lambda c, p: {"lo": F.min(num(c)), "hi": F.max(num(c))},), affine=True)
zscore = Transform("normalize_zscore", "normalize", NUMBER, lambda c, p: (num(c) - p["mean"]) / p["std"] if p["std"] else num(c), (lambda c, p: {"mean": F.avg(num(c)), "std": F.stddev_samp(num(c))},), affine=True)


def text_cleaner(words: list[str] | None = None, keep_marks: bool = False) -> Transform:
    """words: those to drop, by default the Spanish stop words that Spark brings along."""
    return Transform("normalize_text", "normalize", (STRING,), lambda c, p: text.cleaned(c.cast("string"), words, keep_marks))


clean_text = text_cleaner()


# skewness

def _least(c: Column, p: Params) -> dict[str, Column]:
    return {"lo": F.min(num(c))}


def _shifted(c: Column, p: Params) -> Column:
    """Moved above zero where the least value isn't."""
    return num(c) + (abs(p["lo"]) + 1 if p["lo"] is not None and p["lo"] <= 0 else 0.0)


log_shift = Transform("bias_log", "bias", NUMBER, lambda c, p: F.log1p(_shifted(c, p)), (_least,))


def _near_zero(lam: Column) -> Column:
    return F.abs(lam) < 1e-9


def box_cox(x: Column, lam: Column) -> Column:
    return F.when(_near_zero(lam), F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def yeo_johnson(x: Column, lam: Column) -> Column:
    up = F.when(_near_zero(lam), F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(_near_zero(2 - lam), -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


#: The likelihood is taken on a grid over [-2, 2], then on finer grids around its best point.
GRID, FINER = 17, 4


def _grid(p: Params, step: int) -> list[float]:
    if not step:
        return [-2 + 4 * i / (GRID - 1) for i in range(GRID)]
    best, width = _best(p, step - 1), 4 / (GRID - 1) / (GRID // 2) ** (step - 1)
    return [best + width * (2 * i / (GRID - 1) - 1) for i in range(GRID)]


def _best(p: Params, step: int) -> float:
    found = p.get(f"llf{step}")
    grid = _grid(p, step)
    known = [(x, -abs(lam - 1), lam) for x, lam in zip(found or [], grid) if x is not None and not math.isnan(x)]
    return max(known)[2] if known else 1.0


@dataclass(frozen=True)
class Search:
    """A stage that looks for the power of greatest likelihood. value: what is transformed; power(lambda, x) and slope are
    SQL over x: the transform, and the logarithm of its slope, divided by lambda - 1."""

    value: Callable[[Column, Params], Column]
    power: Callable[..., str]
    slope: str


def box_cox_sql(lam: float, x: str = "x") -> str:
    return f"ln({x})" if abs(lam) < 1e-9 else f"(pow({x}, {lam!r}D) - 1) / {lam!r}D"


def yeo_johnson_sql(lam: float, x: str = "x") -> str:
    up = f"log1p(greatest({x}, 0D))" if abs(lam) < 1e-9 else f"(pow(greatest({x}, 0D) + 1, {lam!r}D) - 1) / {lam!r}D"
    down = f"-log1p(-least({x}, 0D))" if abs(2 - lam) < 1e-9 else f"-(pow(1 - least({x}, 0D), {2 - lam!r}D) - 1) / {2 - lam!r}D"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def search(df: DataFrame, items: list[tuple[Params, Column, Search]]) -> None:
    """llf0, llf1 .. of each item: the log-likelihoods on its grids. The table is read once, for how often each value
    occurs; a grid is one row an item, of sums over these counts. Values are moved by what a middle one becomes, so that
    no power makes their squares drown their differences."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), s.value(c, p).alias("x")) for k, (p, c, s) in enumerate(items))))
    counts = df.select(values.alias("i")).select("i.*").where("x is not null").groupBy("k", "x").agg(F.count("*").cast("double").alias("n")).persist()
    case = lambda make: f"CASE k {' '.join(f'WHEN {k} THEN {make(k)}' for k in range(len(items)))} END"
    try:
        sums = {r.k: r for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.expr(f"sum(n * {case(lambda k: items[k][2].slope)})").alias("logs"), F.expr("sum(n * x) / sum(n)").alias("middle")).collect()}
        for step in range(FINER):
            grids = [_grid(p, step) for p, _, _ in items]
            moved = [f"{case(lambda k, i=i: items[k][2].power(grids[k][i]))} - {case(lambda k, i=i: items[k][2].power(grids[k][i], 'middle'))} AS y{i}" for i in range(GRID)]
            middle = case(lambda k: f"{sums[k].middle!r}D" if k in sums else "CAST(NULL AS DOUBLE)")
            tried = counts.selectExpr("k", "n", "x", f"{middle} AS middle").selectExpr("k", "n", *moved)
            found = {r.k: r for r in tried.groupBy("k").agg(*(F.expr(f"sum(n * y{i}) AS s{i}") for i in range(GRID)), *(F.expr(f"sum(n * y{i} * y{i}) AS q{i}") for i in range(GRID))).collect()}
            for k, (p, _, _) in enumerate(items):
                p[f"llf{step}"] = [_likelihood(lam, sums.get(k), found.get(k), i) for i, lam in enumerate(grids[k])]
    finally:
        counts.unpersist()


def _likelihood(lam: float, known, found, i: int) -> float | None:
    if known is None or known.logs is None or found is None or found[f"q{i}"] is None:
        return None
    spread = (found[f"q{i}"] - found[f"s{i}"] ** 2 / known.n) / known.n
    return (lam - 1) * known.logs - known.n / 2 * math.log(spread) if 0 < spread < math.inf else None


def _number(c: Column, p: Params) -> Column:
    return num(c)


boxcox = Transform("bias_boxcox", "bias", NUMBER, lambda c, p: box_cox(_shifted(c, p), F.lit(_best(p, FINER - 1))), (_least, Search(_shifted, box_cox_sql, "ln(x)")))


def _standard(c: Column, p: Params) -> dict[str, Column]:
    y = yeo_johnson(num(c), F.lit(_best(p, FINER - 1)))
    return {"mean": F.avg(y), "std": F.stddev_pop(y)}


def _yeojohnson(c: Column, p: Params) -> Column:
    y = yeo_johnson(num(c), F.lit(_best(p, FINER - 1)))
    return y if p["mean"] is None else (y - p["mean"]) / (p["std"] or 1.0)


yeojohnson = Transform("bias_yeojohnson", "bias", NUMBER, _yeojohnson, (Search(_number, yeo_johnson_sql, "sign(x) * log1p(abs(x))"), _standard))

LANDMARKS = 1000


def _to_normal(c: Column, p: Params) -> Column:
    marks = p["marks"]
    return text.to_normal(marks)(num(c)) if marks else num(c)


def _landmarks(c: Column, p: Params) -> dict[str, Exact]:
    k = max(1, min(LANDMARKS, p["n"]))
    return {"marks": Exact(num(c), tuple(i / max(1, k - 1) for i in range(k)))}


quantile_normal = Transform("bias_quantile", "bias", NUMBER, _to_normal, (lambda c, p: {"n": F.count(num(c))}, _landmarks))


# times

def _since(c: Column, p: Params) -> Column:
    s = seconds(c) - p["lo"]
    return F.log(F.when(s == 0, F.lit(1.0)).otherwise(s))


def _temporal_log(c: Column, p: Params) -> Column:
    if p["lo"] is None:
        return ts(c)
    span = (p["top"] - p["low"]) or 1.0
    return F.timestamp_micros(F.round(((_since(c, p) - p["low"]) / span * (p["hi"] - p["lo"]) + p["lo"]) * 1e6).cast("long"))


temporal_log = Transform(
    "bias_temporal_log", "bias", (DATETIME,), _temporal_log,
    (lambda c, p: {"lo": F.min(seconds(c)), "hi": F.max(seconds(c))}, lambda c, p: {"low": F.min(_since(c, p)), "top": F.max(_since(c, p))} if p["lo"] is not None else {"low": F.lit(None), "top": F.lit(None)}),
)


def _calendar(c: Column, p: Params) -> dict[str, Column]:
    t = ts(c)
    return {"months": F.count_distinct(F.month(t)), "days": F.count_distinct(F.weekday(t)), "year": F.mode(F.year(t), True), "first": F.min(t), "leap": F.count_if((F.month(t) == 2) & (F.dayofmonth(t) == 29))}


def _cyclical(c: Column, p: Params) -> Column:
    t, year = ts(c), p["year"]
    if p["months"] > 1:
        leap_year = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        if p["leap"] and not leap_year:
            return t
        return F.try_make_timestamp(F.lit(year), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.date_part(F.lit("SECOND"), t))
    if p["days"] > 1:
        first = F.lit(p["first"]).cast("timestamp")
        return F.timestamp_micros(F.unix_micros(first) + (F.weekday(t) - F.weekday(first)).cast("long") * 86_400_000_000)
    return t


cyclical = Transform("bias_cyclical", "bias", (DATETIME,), _cyclical, (_calendar,))
same_text = Transform("bias_none", "bias", (STRING,), lambda c, p: c)
same = Transform("bias_same", "bias", NUMBER, lambda c, p: c)

# privacy

encrypt = Transform("encrypt_base64", "security", (*NUMBER, STRING, BOOLEAN, DATETIME), lambda c, p: text.encoded(c))
mask = Transform("mask", "security", (STRING,), lambda c, p: text.masked(c))

ALL: dict[str, Transform] = {
    t.name: t
    for t in (
        impute_median, impute_mean, impute_mode, impute_empty_string, impute_false, impute_true, impute_default_date, mode_date(), winsorize, winsorize_whole, minmax, zscore, clean_text,
        log_shift, boxcox, yeojohnson, quantile_normal, temporal_log, cyclical, same_text, encrypt, mask,
    )
}


def cast_by_type(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Columns cast to logical types; what can't be read becomes null, or stops the query if strict. A
    fraction has no integer value: it is null too."""
    out = []
    for n in df.columns:
        c, kind = quoted(n), types.get(n)
        if strict:
            c = c.cast({INTEGER: "long", FLOAT: "double", BOOLEAN: "boolean", DATETIME: "timestamp", STRING: "string"}[kind]) if kind else c
        elif kind == INTEGER:
            c = c if isinstance(df.schema[n].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else F.when(num(c) == F.floor(num(c)), num(c).try_cast("long"))
        elif kind == FLOAT:
            c = num(c)
        elif kind == BOOLEAN:
            c = c.try_cast("boolean")
        elif kind == DATETIME:
            c = ts(c)
        elif kind == STRING:
            c = c.cast("string")
        out.append(c.alias(n))
    return df.select(*out)


# categories: a table of old and new labels, joined by value, which Spark broadcasts or shuffles by its size

def _label(df: DataFrame, name: str) -> Column:
    return F.coalesce(clean(df, name).cast("string"), F.lit("None"))


def relabel(df: DataFrame, name: str, labels: DataFrame) -> DataFrame:
    """labels: old, new. Values without a new label stay."""
    out = df.withColumn("_old", _label(df, name)).join(labels.select(F.col("old").alias("_old"), F.col("new").alias("_new")), "_old", "left")
    return out.select(*(F.coalesce("_new", "_old").alias(n) if n == name else quoted(n) for n in df.columns))


def rare_labels(df: DataFrame, name: str) -> DataFrame:
    """old, new: the values seen less often than the first quartile of the values' counts become Other."""
    per = df.groupBy(_label(df, name).alias("old")).agg(F.count("*").alias("n"))
    limit = per.agg(F.percentile("n", F.lit(0.25))).first()[0]
    return per.where(F.col("n") < F.lit(limit).cast("double")).select("old", F.lit("Other").alias("new"))


def group_rare(df: DataFrame, name: str) -> DataFrame:
    return relabel(df, name, rare_labels(df, name))


def similar_labels(df: DataFrame, name: str) -> DataFrame:
    """old, new: the labels of a column that are merged into others; categories.similar()."""
    return categories.similar(df.select(_label(df, name).alias("v")).distinct())


def merge_similar(df: DataFrame, name: str) -> DataFrame:
    return relabel(df, name, similar_labels(df, name))


def fill_values(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Nulls (and NaN) of each column become its value."""
    return df.select(*(F.coalesce(clean(df, n), F.lit(values[n])).alias(n) if n in values else quoted(n) for n in df.columns))


def chain(c: Column, *steps: Callable[[Column], Column]) -> Column:
    return reduce(lambda x, f: f(x), steps, c)
