"""The twelve operators of the JSON-configured transform pipeline, each a lazy DataFrame composition.

Every operator takes a frame, its configuration and the frames it may refer to by name, and returns a frame; nothing here
runs a job, except ``pivot`` without listed values, which must ask for the distinct values of one column, and ``sample``,
which counts. Unknown columns
and predicates are left out with a warning, as users of such pipelines expect; unknown operators are errors.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from datetime import date
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.functions.text import matches
from lodestream.operators.derive import translate
from lodestream.operators.quantiles import exact_quantiles, joined_by

log = logging.getLogger(__name__)

Config = Mapping[str, Any]
Operator = Callable[[DataFrame, Config, Mapping[str, DataFrame]], DataFrame]
OPERATORS: dict[str, Operator] = {}


def register_op(name: str) -> Callable[[Operator], Operator]:
    """Add an operator to the registry under ``name`` (the extension point)."""

    def put(fn: Operator) -> Operator:
        OPERATORS[name] = fn
        return fn

    return put


def execute(op: str, df: DataFrame, config: Config | None = None, inputs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    if op not in OPERATORS:
        raise ValueError(f"unknown operation {op!r}; known: {', '.join(sorted(OPERATORS))}")
    return OPERATORS[op](df, config or {}, inputs or {})


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _is_null(c: Column, kind: T.DataType) -> Column:
    """NaN counts as null."""
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def _lower(c: Column) -> Column:
    return F.lower(c.cast("string"))


def _literal(value: int | float | Decimal) -> int | float | Decimal:
    """A number as Spark has literals for: whole numbers beyond 64 bits as decimals, those beyond 38 digits as doubles."""
    if isinstance(value, float) or (isinstance(value, int) and -(1 << 63) <= value < 1 << 63):
        return value
    exact = Decimal(value)
    if exact.is_finite() and abs(exact) < Decimal(10) ** 38 and -38 <= exact.as_tuple().exponent:
        digits = len(exact.as_tuple().digits) + max(exact.as_tuple().exponent, 0)
        if max(digits, -exact.as_tuple().exponent) <= 38:
            return exact
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def _fitting(kind: T.DataType, value: Any) -> Column | None:
    """``value`` as something that columns of this type can be compared with; None if they never equal."""
    if isinstance(value, bool):
        return F.lit(value) if isinstance(kind, T.BooleanType) else None
    if isinstance(value, (int, float, Decimal)):
        return F.lit(_literal(value)) if isinstance(kind, T.NumericType) else None
    dated = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if isinstance(value, str):
        return F.lit(value) if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else F.lit(value).try_cast(kind) if dated else None
    return F.lit(value) if dated and isinstance(value, date) else None


def _compared(test: Callable[[Column, Column], Column], nan: bool = False) -> Callable[[Column, T.DataType, Any], Column]:
    """A comparison that is false for nulls and for values of another type; NaN meets nothing unless ``nan``."""

    def build(c: Column, kind: T.DataType, value: Any) -> Column:
        other = _fitting(kind, value)
        if other is None:
            return F.lit(False)
        found = F.coalesce(test(c, other), F.lit(False))
        return found if nan else found & ~_is_null(c, kind)

    return build


def _listed(c: Column, kind: T.DataType, value: Any) -> Column:
    fitting = [x for x in (_fitting(kind, v) for v in value) if x is not None] if isinstance(value, (list, tuple, set)) else []
    return F.coalesce(c.isin(*fitting), F.lit(False)) if fitting else F.lit(False)


_equal = _compared(lambda c, v: c == v)
_iequal = lambda c, k, v: F.coalesce(_lower(c) == str(v).lower(), F.lit(False))

#: Predicate -> (column, its type, value) -> condition that is never null and never fails, whatever the types.
PREDICATES: dict[str, Callable[[Column, T.DataType, Any], Column]] = {
    "equals": _equal,
    "not_equals": lambda c, k, v: ~_equal(c, k, v),
    "greater_than": _compared(lambda c, v: c > v),
    "greater_equal": _compared(lambda c, v: c >= v),
    "less_than": _compared(lambda c, v: c < v),
    "less_equal": _compared(lambda c, v: c <= v),
    "contains": lambda c, k, v: F.coalesce(_lower(c).contains(str(v).lower()), F.lit(False)),
    "not_contains": lambda c, k, v: F.coalesce(~_lower(c).contains(str(v).lower()), F.lit(True)),
    "starts_with": lambda c, k, v: F.coalesce(_lower(c).startswith(str(v).lower()), F.lit(False)),
    "ends_with": lambda c, k, v: F.coalesce(_lower(c).endswith(str(v).lower()), F.lit(False)),
    "is_null": lambda c, k, v: _is_null(c, k),
    "not_null": lambda c, k, v: ~_is_null(c, k),
    "in_list": _listed,
    "iexact": _iequal,
    "iregex": lambda c, k, v: matches(c, str(v)),
}

#: Aggregate -> column -> expression. Nulls are skipped; the sum of nothing is 0.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "avg": F.avg,
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
    "nunique": F.count_distinct,
}


@register_op("join")
def join(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Null keys meet null keys. Equal key names give one column; other right columns that clash get ``_right``."""
    right = inputs.get(config.get("right_input", config.get("right")))
    if right is None:
        raise ValueError("join needs a right input")
    how = config.get("join_type", "inner")
    how = how if how in ("inner", "left", "right", "outer") else "inner"
    left_key, right_key = config["left_key"], config.get("right_key") or config["left_key"]
    mine, theirs = df.alias("l"), right.alias("r")
    on = F.col(f"l.`{left_key}`").eqNullSafe(F.col(f"r.`{right_key}`"))
    joined = mine.join(theirs, on, how)
    out = []
    for name in df.columns:
        c = F.col(f"l.`{name}`")
        if name == left_key == right_key and how in ("right", "outer"):
            c = F.coalesce(c, F.col(f"r.`{name}`"))
        out.append(c.alias(name))
    for name in right.columns:
        if name == left_key == right_key:
            continue
        out.append(F.col(f"r.`{name}`").alias(f"{name}_right" if name in df.columns else name))
    return joined.select(*out)


def condition(df: DataFrame, spec: Config) -> Column | None:
    column, predicate = spec.get("column"), PREDICATES.get(spec.get("operator", ""))
    if column not in df.columns or predicate is None:
        log.warning("filter condition left out: %s", dict(spec))
        return None
    return predicate(quoted(column), df.schema[column].dataType, spec.get("value"))


@register_op("filter")
def filter_rows(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    found = [c for c in (condition(df, s) for s in config.get("conditions", [])) if c is not None]
    if not found:
        return df
    either = str(config.get("logic", "and")).lower() == "or"
    return df.where(reduce(lambda a, b: a | b if either else a & b, found))


@register_op("aggregate")
def aggregate(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    """Rows with a null group key are left out, as in the data frames such pipelines were written for."""
    keys = [k for k in config.get("group_by", []) if k in df.columns]
    out, medians = [], {}
    for spec in config.get("aggregations", []):
        column, name = spec.get("column"), spec.get("function", "sum")
        if column not in df.columns:
            log.warning("aggregation left out: %s", dict(spec))
            continue
        if name not in AGGREGATES:
            raise ValueError(f"unknown aggregation {name!r}")
        output = spec.get("output_name") or f"{column}_{name}"
        if name == "median":  # not in a buffer of the group's values, and put in its place below
            medians[output] = column
            out.append(F.lit(None).cast("double").alias(output))
        else:
            out.append(AGGREGATES[name](quoted(column)).alias(output))
    rows = df.where(reduce(lambda a, b: a & b, [~_is_null(quoted(k), df.schema[k].dataType) for k in keys])) if keys else df
    if not out:
        return rows.select(*map(quoted, keys)).distinct() if keys else df.limit(0)
    done = rows.groupBy(*map(quoted, keys)).agg(*out) if keys else rows.agg(*out)
    for output, column in medians.items():
        names = done.columns
        found = exact_quantiles(rows.select(*map(quoted, keys), quoted(column).alias("_ls_value")), keys, F.col("_ls_value"), [0.5], ["_ls_median"])
        both = joined_by(done, found, keys)
        done = both.select(*[F.col("_ls_median").alias(c) if c == output else quoted(c) for c in names])
    return done


@register_op("clean")
def clean(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    """In this order: duplicates, rows with nulls, fill values."""
    if config.get("remove_duplicates"):
        subset = [c for c in config.get("duplicate_columns") or [] if c in df.columns]
        df = df.dropDuplicates(subset or None)
    if config.get("drop_null_rows"):
        subset = [c for c in config.get("null_columns") or [] if c in df.columns]
        df = df.na.drop(subset=subset or None)
    value = config.get("fill_null_value")
    if value is None:
        return df
    if isinstance(value, Mapping):
        return df.na.fill({k: v for k, v in value.items() if k in df.columns})
    return df.na.fill(value)


@register_op("derive")
def derive(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    """New columns in order, each may use those before it. A bad expression is an error, never a missing column."""
    kinds = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}
    for spec in config.get("new_columns", []):
        value = F.expr(translate(spec["expression"], df.columns))
        kind = spec.get("data_type", "str")
        # Numbers are cast as they are; only text is parsed, and an int may be written with a fraction there.
        text = isinstance(df.select(value.alias("v")).schema["v"].dataType, T.StringType)
        if kind == "int" and text:
            value = F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))
        elif kind in kinds:
            value = value.try_cast(kinds[kind])
        df = df.withColumn(spec["name"], value)
    return df


@register_op("pivot")
def pivot(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    """One column for each value of ``columns``; absent cells get ``fill_value`` (0). ``pivot_values`` spares a job."""
    index, column, value = list(config["index"]), config["columns"], config["values"]
    fn, fill = AGGREGATES[config.get("agg_func", "sum")], config.get("fill_value", 0)
    rows = df.na.drop(subset=[*index, column])
    values = config.get("pivot_values") or sorted(r[0] for r in rows.select(quoted(column)).distinct().collect())
    cells = rows.groupBy(*map(quoted, index)).pivot(column, values).agg(fn(quoted(value)))
    return cells.na.fill(fill, [c for c in cells.columns if c not in index]) if fill is not None else cells


@register_op("unpivot")
def unpivot(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    ids = [c for c in config.get("id_vars") or [] if c in df.columns]
    values = [c for c in config.get("value_vars") or [c for c in df.columns if c not in ids] if c in df.columns]
    kinds = {df.schema[c].dataType.simpleString() for c in values}
    cast = df.select(*map(quoted, ids), *[quoted(c) if len(kinds) == 1 else quoted(c).cast("string").alias(c) for c in values])
    return cast.unpivot([quoted(c) for c in ids], [quoted(c) for c in values], config.get("var_name", "variable"), config.get("value_name", "value"))


@register_op("union")
def union(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    """All rows of this and the named inputs, by column name; columns that one lacks are null there."""
    for name in config.get("inputs", []):
        if name in inputs:
            df = df.unionByName(inputs[name], allowMissingColumns=True)
    return df


@register_op("rename")
def rename(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in config.get("column_mapping", {}).items() if k in df.columns})


@register_op("select")
def select(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    """The listed columns that exist, in the listed order; none of them: a frame without columns and rows."""
    found = [c for c in config.get("columns", []) if c in df.columns]
    return df.select(*map(quoted, found)) if found else df.sparkSession.createDataFrame([], T.StructType([]))


@register_op("sort")
def sort(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    """Nulls come last in either direction."""
    found = [s for s in config.get("sort_by", []) if s.get("column") in df.columns]
    order = [quoted(s["column"]).asc_nulls_last() if s.get("ascending", True) else quoted(s["column"]).desc_nulls_last() for s in found]
    return df.orderBy(*order) if order else df


#: Sizes up to this are one top-k over the data.
TOP_ROWS = 10_000


@register_op("sample")
def sample(df: DataFrame, config: Config, inputs: Mapping[str, DataFrame] = {}) -> DataFrame:
    """Exactly ``sample_size`` rows, else ``sample_fraction`` (10 %) of the rows, without replacement.

    Rows are taken in the order of a seeded hash of the whole row, so the same rows come back each time. Small sizes are
    one top-k over the data. For others one job counts the rows of each of 65,536 ranges of the hash; the ranges before
    the one in which the sample ends are taken whole by a filter, and only that one is sorted.
    """
    cells = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in df.columns]
    keyed = df.withColumn("_ls_key", F.md5(F.concat_ws("|", F.lit(str(config.get("random_state", 42))), *cells)))
    size = config.get("sample_size")
    if size is not None and int(size) <= TOP_ROWS:
        return keyed.orderBy("_ls_key").limit(int(size)).drop("_ls_key")
    spot = F.substring("_ls_key", 1, 4)
    counts = sorted((r["spot"], r["n"]) for r in keyed.groupBy(spot.alias("spot")).agg(F.count("*").alias("n")).collect())
    left = int(size) if size is not None else round(sum(n for _, n in counts) * float(config.get("sample_fraction", 0.1)))
    for last, n in counts:
        if n > left:
            part = keyed.where(spot == last).orderBy("_ls_key").limit(left)
            return keyed.where(spot < last).unionByName(part).drop("_ls_key")
        left -= n
    return df
