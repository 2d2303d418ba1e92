"""Cleaning: `fit` learns a plan from the data, `apply` is one projection.

`fit` runs the only jobs. It reads the columns that need a decision, never the
dropped ones, in one aggregate (plus the median search for numeric columns that
have nulls). The plan is a small immutable value, so the same plan cleans batch
and streaming frames and gives equal results on a retry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewash.functions.columns import (
    clean_value, col, is_numeric, is_temporal, literal_rows, row_order, value_text,
)
from tidewash.functions.parsing import (
    DateFormat, guess_date_format, integer_or_null, nanos_to_timestamp, number_or_null,
    parse_any_date, parse_date, timestamp_micros,
)
from tidewash.operators.quantiles import exact_quantiles
from tidewash.sources.headers import trim_headers

# Words in a transformation text that choose the operation.
DATE_WORDS = ("date", "time")
NUMBER_WORDS = ("numeric", "number", "float", "int")
FILL_WORDS = ("impute", "fill", "missing")
UNKNOWN = "Unknown"
# What the log says when a transform has no text.
NO_TEXT = {"direct": "imputed missing values", "background": "imputed"}

ROW_ORDER = "_row_order"


@dataclass(frozen=True)
class Step:
    """What happens to one column.

    op: drop, median, unknown, date, number, number_median, leave, or failed for
    a type that cannot be cleaned; such a column stays as it is.
    """

    column: str
    op: str
    fill: float | str | None = None
    date_format: DateFormat | None = None
    out_type: str | None = None
    message: str | None = None


@dataclass(frozen=True)
class CleanPlan:
    steps: tuple[Step, ...]
    columns: tuple[str, ...]
    source_types: tuple[str, ...]
    row_count: int

    @property
    def dropped(self) -> list[str]:
        return [s.column for s in self.steps if s.op == "drop"]

    @property
    def messages(self) -> list[str]:
        return [s.message for s in self.steps if s.message is not None]

    def step(self, column: str) -> Step | None:
        return next((s for s in self.steps if s.column == column), None)


# -- routing ------------------------------------------------------------------

def route(action: str | None, transformation: str | None) -> str:
    """drop, date, number, number_median, or impute when the column type decides."""
    if action == "drop":
        return "drop"
    if action == "transform" and transformation:
        text = transformation.lower()
        if any(w in text for w in DATE_WORDS):
            return "date"
        if any(w in text for w in NUMBER_WORDS):
            return "number_median" if any(w in text for w in FILL_WORDS) else "number"
    return "impute"


def route_column(action: Column, transformation: Column) -> Column:
    """The same choice as `route`, over a table of actions."""
    def mentions(words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(F.lower(transformation), F.lit(w)) for w in words])

    transform = action == "transform"
    return (
        F.when(action == "drop", F.lit("drop"))
        .when(transform & mentions(DATE_WORDS), F.lit("date"))
        .when(transform & mentions(NUMBER_WORDS) & mentions(FILL_WORDS), F.lit("number_median"))
        .when(transform & mentions(NUMBER_WORDS), F.lit("number"))
        .otherwise(F.lit("impute"))
    )


def log_message(column: Column, transformation: Column, mode: str = "direct") -> Column:
    shown = F.coalesce(F.nullif(transformation, F.lit("")), F.lit(NO_TEXT[mode]))
    return F.concat(F.lit("Transformed '"), column, F.lit("': "), shown)


# -- fit ----------------------------------------------------------------------

def fit(
    df: DataFrame,
    actions: Mapping[str, Mapping[str, str | None]],
    order_by: str | Sequence[str] | None = None,
    null_counts: Mapping[str, int] | None = None,
    log: str = "direct",
    later_rows: bool = False,
) -> CleanPlan:
    """Learn the plan for one table.

    ``later_rows`` makes a plan for rows that come after the fit, such as a stream:
    every fill is learned, also where the table has no gap yet, and numbers become
    double, as no column is known to stay whole.


    ``actions`` maps a column to its action, reason and transformation; names
    that the table lacks are skipped, columns without an action stay as they
    are. ``order_by`` says which row is first for the date layout (default: file
    order). ``null_counts`` from a profile of the same table spare the median
    columns without nulls their look at the data.
    """
    df = trim_headers(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    routed = {
        c: _by_type(route(a.get("action"), a.get("transformation")), types[c])
        for c, a in actions.items()
        if c in types
    }
    facts = _learn(df, routed, types, order_by, null_counts or {})
    medians = _medians(df, routed, types, facts, later_rows)
    steps = tuple(
        _step(c, op, types[c], facts, medians, actions[c], log, later_rows) for c, op in routed.items()
    )
    return CleanPlan(
        steps=steps,
        columns=tuple(types),
        source_types=tuple(t.simpleString() for t in types.values()),
        row_count=facts["rows"],
    )


def _by_type(op: str, dtype: T.DataType) -> str:
    """Settle `impute`, and the operations that a type makes trivial."""
    nested = isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    if op != "drop" and nested:
        return "failed"
    if op == "impute":
        if is_temporal(dtype):
            return "leave"
        return "median" if is_numeric(dtype) else "unknown"
    return op


def _number(df: DataFrame, name: str, dtype: T.DataType) -> Column:
    """The column as double, unreadable text as null."""
    if isinstance(dtype, T.StringType):
        return number_or_null(col(name))
    if is_temporal(dtype):
        return (timestamp_micros(col(name)) * 1000).cast("double")
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("double")
    return clean_value(df, name).cast("double")


def _learn(df, routed, types, order_by, null_counts) -> dict:
    """One aggregate: row count, nulls, integer flags and first date texts."""
    wanted = [F.count(F.lit(1)).alias("rows")]
    keys = ["rows"]
    if any(op == "date" and isinstance(types[c], T.StringType) for c, op in routed.items()):
        df = df.withColumn(ROW_ORDER, row_order(df, order_by))
    first = F.col(ROW_ORDER)
    for name, op in routed.items():
        dtype, value = types[name], clean_value(df, name)
        if op in ("median", "unknown") and name not in null_counts:
            keys.append(("present", name))
            wanted.append(F.count(value))
        elif op in ("number", "number_median"):
            keys.append(("present", name))
            wanted.append(F.count(_number(df, name, dtype)))
            if isinstance(dtype, T.StringType):
                keys.append(("integers", name))
                wanted.append(F.count(integer_or_null(col(name))))
        elif op == "date" and isinstance(dtype, T.StringType):
            keys.append(("first", name))
            wanted.append(F.min_by(value, F.when(value.isNotNull(), first)))
    row = df.agg(*[w.alias(f"f{i}") for i, w in enumerate(wanted)]).first()
    facts = dict(zip(keys, row))
    for name, nulls in null_counts.items():
        facts.setdefault(("present", name), facts["rows"] - nulls)
    return facts


def _medians(df, routed, types, facts, later_rows) -> dict[str, float | None]:
    """Medians of the numeric columns that have, or may get, something to fill."""
    values = {}
    for name, op in routed.items():
        holes = 0 < facts.get(("present", name), 0) < facts["rows"] + later_rows
        boolean_gap = op == "median" and isinstance(types[name], T.BooleanType)
        if op in ("median", "number_median") and holes and not boolean_gap:
            values[name] = _number(df, name, types[name])
    counts = {n: facts["present", n] for n in values}
    return {n: q[0] for n, q in exact_quantiles(df, values, [0.5], counts).items()}


def _step(name, op, dtype, facts, medians, action, log, later_rows) -> Step:
    text = action.get("transformation")
    message = None
    if action.get("action") == "transform":
        message = f"Transformed '{name}': {text or NO_TEXT[log]}"
    if op == "drop":
        return Step(name, "drop")
    if op == "failed":
        shown = message is not None and log == "direct"
        why = f"Failed to transform '{name}': {dtype.simpleString()} columns are not cleaned"
        return Step(name, "failed", message=why if shown else None)
    rows, present = facts["rows"] + later_rows, facts.get(("present", name), 0)  # a later row may hold a gap
    if op == "date":
        sample = facts.get(("first", name))
        return Step(name, "date", date_format=guess_date_format(sample), out_type="timestamp_ntz", message=message)
    if op in ("number", "number_median"):
        whole = isinstance(dtype, T.IntegralType) or is_temporal(dtype)
        integers = facts.get(("integers", name), present if whole else 0)
        out_type = "bigint" if rows == present and integers == rows and rows > 0 else "double"
        if isinstance(dtype, T.BooleanType) and rows == present:
            return Step(name, "leave", message=message)
        return Step(name, op, fill=medians.get(name), out_type=out_type, message=message)
    if op == "median" and present < rows:
        if isinstance(dtype, T.BooleanType) and present:
            return Step(name, "unknown", fill=UNKNOWN, out_type="string", message=message)
        return Step(name, "median", fill=medians.get(name), out_type="double", message=message)
    if op == "unknown" and present < rows:
        if present == 0:
            return Step(name, "median", out_type="double", message=message)
        return Step(name, "unknown", fill=UNKNOWN, out_type="string", message=message)
    return Step(name, "leave", message=message)


# -- apply --------------------------------------------------------------------

def apply(df: DataFrame, plan: CleanPlan) -> DataFrame:
    """Clean a batch or streaming frame: one projection, no shuffle."""
    df = trim_headers(df)
    by_name = {s.column: s for s in plan.steps}
    dropped = set(plan.dropped)
    return df.select(
        *[_cleaned(df, c, by_name.get(c)).alias(c) for c in df.columns if c not in dropped]
    )


def _cleaned(df: DataFrame, name: str, step: Step | None) -> Column:
    dtype = df.schema[name].dataType
    value = col(name)
    if step is None or step.op in ("leave", "failed"):
        return value
    if step.op == "date":
        return _as_date(value, dtype, step.date_format)
    if step.op in ("number", "number_median"):
        number = _number(df, name, dtype)
        if step.out_type == "bigint":
            if isinstance(dtype, T.StringType):
                return integer_or_null(value)
            return timestamp_micros(value) * 1000 if is_temporal(dtype) else value.cast("bigint")
        return number if step.fill is None else F.coalesce(number, F.lit(step.fill))
    if step.op == "median":
        if isinstance(dtype, T.StringType):
            return value.try_cast("double")
        number = clean_value(df, name).cast("double")
        return number if step.fill is None else F.coalesce(number, F.lit(step.fill))
    return F.coalesce(value_text(clean_value(df, name), dtype), F.lit(step.fill))


def _as_date(value: Column, dtype: T.DataType, fmt: DateFormat | None) -> Column:
    if is_temporal(dtype):
        return value.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return parse_date(value, fmt) if fmt else parse_any_date(value)
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("timestamp_ntz")
    return nanos_to_timestamp(value)


# -- reports on a run -----------------------------------------------------------


def clean_stats(df: DataFrame, plan: CleanPlan) -> DataFrame:
    """One row of run statistics; cleaning never changes the number of rows."""
    names, kept = plan.columns, len(plan.columns) - len(plan.dropped)
    texts = lambda items: F.array(*[F.lit(i) for i in items]).cast("array<string>")
    return df.sparkSession.range(1).select(
        F.lit(plan.row_count).cast("bigint").alias("initial_rows"),
        F.lit(len(names)).cast("bigint").alias("initial_cols"),
        F.lit(plan.row_count).cast("bigint").alias("final_rows"),
        F.lit(kept).cast("bigint").alias("final_cols"),
        texts(plan.dropped).alias("dropped_columns"),
        texts(plan.messages).alias("transformations_applied"),
    )


def transformation_log(df: DataFrame, plan: CleanPlan) -> DataFrame:
    """One row per logged transform, in the order of the actions."""
    rows = [(i, s.column, s.op, s.message) for i, s in enumerate(plan.steps) if s.message is not None]
    return literal_rows(df, rows, ["pos", "column", "op", "message"], ["int", "string", "string", "string"])


def before_after(df: DataFrame, plan: CleanPlan) -> DataFrame:
    """Rows and columns before and after, for the report."""
    kept = len(plan.columns) - len(plan.dropped)
    rows = [
        ("Total Rows", plan.row_count, plan.row_count),
        ("Total Features / Columns", len(plan.columns), kept),
    ]
    return literal_rows(df, rows, ["dimension", "original", "cleaned"], ["string", "bigint", "bigint"])


@dataclass(frozen=True)
class CleanResult:
    plan: CleanPlan
    data: DataFrame
    stats: DataFrame
    log: DataFrame


def clean(df: DataFrame, actions, order_by=None, null_counts=None, log: str = "direct") -> CleanResult:
    """Fit and apply in one call."""
    plan = fit(df, actions, order_by, null_counts, log)
    return CleanResult(plan, apply(df, plan), clean_stats(df, plan), transformation_log(df, plan))
