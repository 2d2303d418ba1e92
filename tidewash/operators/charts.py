"""Chart data: value counts, shares, means and point lists as small long tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewash.functions.columns import clean_value, col, is_numeric, row_order, value_text
from tidewash.session import shared_folder

log = logging.getLogger(__name__)
R = TypeVar("R")

# How many entries a chart shows, on the page and in the report.
PAGE_LIMITS = {"histogram": 10, "pie": 6, "bar": 15, "scatter": 100, "line": 50, "mean": 15}
REPORT_LIMITS = {"histogram": 10, "pie": 6, "bar": 10, "scatter": None, "line": None, "mean": 12}
MEAN_VALUES = 15         # fewer distinct x values than this are averaged
MEAN_SUFFIX = {"direct": " (Average)", "background": " (Avg)"}
KEY_BUCKETS = 1024


@dataclass(frozen=True)
class ChartSpec:
    chart_type: str
    title: str
    x_axis: str
    y_axis: str | None = None
    description: str = ""


# Column -> the chart that is suggested for it.
SUGGESTIONS = (
    ChartSpec("histogram", "Distribution of Age in Cleaned Dataset", "Age", None,
              "Visualizes the distribution of age to check for skewness and sample representation."),
    ChartSpec("bar", "Average Subscription Fee by Churn Status", "Churned_Status", "Monthly_Subscription_Fee",
              "Compares subscription fee rates between churned and retained customers."),
    ChartSpec("pie", "Gender Distribution of Customers", "Gender", None,
              "Shows the breakdown of customers by gender category."),
)


def suggest_charts(columns: Sequence[str], suggestions: Sequence[ChartSpec] = SUGGESTIONS) -> list[ChartSpec]:
    """The suggestions whose measured column exists.

    That is y where there is one; a missing x then falls back to the first column.
    """
    chosen = [s for s in suggestions if (s.y_axis or s.x_axis) in columns]
    return [s if s.x_axis in columns else replace(s, x_axis=columns[0]) for s in chosen]


def suggest_for_tables(
    columns: DataFrame, suggestions: Sequence[ChartSpec] = SUGGESTIONS, by: Sequence[str] = ("dataset",)
) -> DataFrame:
    """The same over a table of columns (`by`, `pos`, `column`): one row per table and chart.

    One aggregate per table notes which of the named columns it has; no column
    lists are gathered. A text in an aggregate makes Spark sort its rows, so these
    are cut first: to named columns, and those that stand no later than the first
    of every table (where positions begin alike, one row a table), each of them once.
    """
    has = lambda name: F.coalesce(F.bool_or(F.col("column") == name), F.lit(False))
    names = {name for s in suggestions for name in (s.x_axis, s.y_axis) if name is not None}
    last = columns.groupBy(*by).agg(F.min("pos").alias("first")).agg(F.max("first")).scalar()
    told = columns.filter(F.col("column").isin(*names) | (F.col("pos") <= last)).groupBy(*by, "column").agg(F.min("pos").alias("pos"))
    found = told.groupBy(*by).agg(
        F.min_by("column", "pos").alias("first"),
        *[has(s.y_axis or s.x_axis).alias(f"has{i}") for i, s in enumerate(suggestions)],
        *[has(s.x_axis).alias(f"x{i}") for i, s in enumerate(suggestions)],
    )
    charts = [
        F.when(
            F.col(f"has{i}"),
            F.struct(
                F.lit(s.chart_type).alias("chart_type"), F.lit(s.title).alias("title"),
                F.when(F.col(f"x{i}"), F.lit(s.x_axis)).otherwise(F.col("first")).alias("x_axis"),
                F.lit(s.y_axis).cast("string").alias("y_axis"), F.lit(s.description).alias("description"),
            ),
        )
        for i, s in enumerate(suggestions)
    ]
    return found.select(*by, F.inline(F.array_compact(F.array(*charts))))


def usable_specs(specs: DataFrame, columns: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Chart specs whose x column exists, over a table of specs and one of columns."""
    names = columns.select(*by, F.col("column").alias("x_axis"))
    return specs.join(names, [*by, "x_axis"], "left_semi")


# -- single charts ----------------------------------------------------------------

def _text(df: DataFrame, name: str) -> Column:
    return value_text(clean_value(df, name), df.schema[name].dataType)


def _number_or_text(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(number, text): exactly one is filled, by the type of the column."""
    if is_numeric(df.schema[name].dataType):
        return clean_value(df, name).cast("double"), F.lit(None).cast("string")
    return F.lit(None).cast("double"), _text(df, name)


def _numbered(top: DataFrame, *order: Column) -> DataFrame:
    """Adds pos 0, 1, ... to a result that a limit has already made small."""
    return top.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))


def _numbered_ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds pos 0, 1, ... in the order of ``keys`` to any number of rows.

    Rows are sorted into ranges and written, so their numbers stay; a row's number is its
    place in its range plus the sizes of the earlier ranges.
    """
    folder = shared_folder(rows.sparkSession, "ranges")
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    ranges = rows.sparkSession.read.parquet(folder)
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = ranges.join(F.broadcast(starts), "range")  # one row per range
    return placed.withColumn("pos", (F.col("start") + F.col("at") - F.col("first")).cast("bigint"))


def value_counts(df: DataFrame, x: str, k: int) -> DataFrame:
    """The k most frequent non-null values with their counts; ties by label."""
    tallies = (
        df.select(clean_value(df, x).alias(x)).filter(col(x).isNotNull()).groupBy(col(x)).agg(F.count(F.lit(1)).alias("value"))
    )
    top = tallies.select(_text(tallies, x).alias("label"), "value").orderBy(F.desc("value"), "label").limit(k)
    return _numbered(top, F.desc("value"), F.col("label")).select("pos", "label", "value")


def pie_shares(df: DataFrame, x: str, k: int = PAGE_LIMITS["pie"]) -> DataFrame:
    """Value counts with each one's share of the counts shown, in percent."""
    total = F.sum("value").over(Window.partitionBy())
    return value_counts(df, x, k).withColumn("share", F.bround(F.col("value") * 100.0 / total, 1))


def points(df: DataFrame, x: str, y: str, order_by: str | Sequence[str] | None = None,
           limit: int | None = PAGE_LIMITS["scatter"], sort_x: bool = False) -> DataFrame:
    """Pairs with both values present: the first ones in row order, or by x.

    Without a limit (the report's charts) all pairs come back: a scatter's
    unnumbered, a line's with ``pos`` by x. Numbers of all rows come from sorted
    ranges and the counts of the ranges before, so no task sees all rows.
    """
    pairs = df.filter(clean_value(df, x).isNotNull() & clean_value(df, y).isNotNull())
    order = [col(x).alias("kx")] if sort_x else []
    xn, xt = _number_or_text(df, x)
    yn, yt = _number_or_text(df, y)
    shaped = pairs.select(
        *order, row_order(df, order_by).alias("row"),
        _text(df, x).alias("label"), xn.alias("x"), xt.alias("x_text"), yn.alias("y"), yt.alias("y_text"),
    )
    out = ["label", "x", "x_text", "y", "y_text"]
    if limit is None and not sort_x:
        return shaped.select(*out)
    keys = ["kx", "row"] if sort_x else ["row"]
    if limit is None:
        return _numbered_ranges(shaped, keys).select("pos", *out)
    top = shaped.orderBy(*keys).limit(limit)
    return _numbered(top, *[F.col(k) for k in keys]).select("pos", *out)


def scatter_points(df: DataFrame, x: str, y: str, order_by=None, limit: int | None = PAGE_LIMITS["scatter"]) -> DataFrame:
    return points(df, x, y, order_by, limit)


def line_points(df: DataFrame, x: str, y: str, order_by=None, limit: int | None = PAGE_LIMITS["line"]) -> DataFrame:
    return points(df, x, y, order_by, limit, sort_x=True)


def bar_means(df: DataFrame, x: str, y: str, k: int = PAGE_LIMITS["mean"]) -> DataFrame:
    """Mean of y per x, keys ascending, the first k. Null keys and null y are ignored."""
    if not is_numeric(df.schema[y].dataType):
        raise TypeError(f"no mean of {y}: it is not numeric")
    means = (
        df.select(clean_value(df, x).alias("key"), clean_value(df, y).cast("double").alias("y"))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.avg("y").alias("value"))
    )
    top = means.orderBy("key").limit(k)
    label = value_text(F.col("key"), df.schema[x].dataType)
    return _numbered(top, F.col("key")).select("pos", label.alias("label"), "value")


def few_valued(df: DataFrame, names: Sequence[str], limit: int = MEAN_VALUES) -> set[str]:
    """Those of the columns that have fewer than ``limit`` distinct non-null values, in two jobs for all of them.

    Values are first counted by hash bucket, at most KEY_BUCKETS of them a column. As many
    buckets as the limit prove as many values; only below it are the values themselves counted,
    and then there are few of them.
    """
    if not names:
        return set()
    bucket = lambda x: F.when(clean_value(df, x).isNotNull(), F.pmod(F.xxhash64(clean_value(df, x)), F.lit(KEY_BUCKETS)))
    buckets = df.agg(*[F.size(F.collect_set(bucket(x))).alias(f"n{i}") for i, x in enumerate(names)]).first()
    open_ = [x for i, x in enumerate(names) if buckets[i] < limit]
    if not open_:
        return set()
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), _label(df, x).alias("label")) for i, x in enumerate(open_)])).alias("v")).select("v.*")
    counts = dict(values.filter(F.col("label").isNotNull()).distinct().groupBy("at").count().collect())
    return {x for i, x in enumerate(open_) if counts.get(i, 0) < limit}


def bar_raw(df: DataFrame, x: str, y: str, order_by=None, limit: int = PAGE_LIMITS["bar"]) -> DataFrame:
    """The first pairs as bars, for an x with many values."""
    return points(df, x, y, order_by, limit)


# -- dispatch -----------------------------------------------------------------------

COUNTS, MEANS, POINTS, NOTHING = "counts", "means", "points", "nothing"


@dataclass(frozen=True)
class _Item:
    """One chart to draw: what it shows of which columns, and how much of it."""

    number: int
    kind: str
    title: str
    shows: str
    x: str
    y: str | None = None
    limit: int | None = None
    sort_x: bool = False

    def rows(self, df: DataFrame, order_by) -> DataFrame:
        if self.shows == COUNTS:
            return _common(value_counts(df, self.x, self.limit))
        if self.shows == MEANS:
            return _common(bar_means(df, self.x, self.y, self.limit))
        return _common(points(df, self.x, self.y, order_by, self.limit, self.sort_x))


def _item(df: DataFrame, number: int, spec: ChartSpec, few: set[str], report: bool, mode: str) -> _Item:
    limits = REPORT_LIMITS if report else PAGE_LIMITS
    kind, x, y = spec.chart_type, spec.x_axis, spec.y_axis
    has_y = y is not None and y in df.columns
    item = _Item(number, kind, spec.title, NOTHING, x, y)
    if kind in ("histogram", "pie"):
        return replace(item, shows=COUNTS, limit=limits[kind])
    if kind in ("scatter", "line") and has_y:
        return replace(item, shows=POINTS, limit=limits[kind], sort_x=kind == "line")
    if kind == "bar" and has_y:
        if report:
            return replace(item, shows=MEANS, limit=limits["mean"])
        if x in few:
            return replace(item, shows=MEANS, title=spec.title + MEAN_SUFFIX[mode], limit=limits["mean"])
        return replace(item, shows=POINTS, limit=limits["bar"])
    return replace(item, shows=COUNTS, limit=limits["bar"]) if kind == "bar" or report else item


def chart_data(df: DataFrame, spec: ChartSpec, order_by=None, report: bool = False, mode: str = "direct") -> tuple[str, DataFrame | None]:
    """(title, rows) of one chart in the common shape; rows are None for a chart without data, as one whose y is absent."""
    means = not report and spec.chart_type == "bar" and spec.y_axis in df.columns
    item = _item(df, 0, spec, few_valued(df, [spec.x_axis]) if means else set(), report, mode)
    return item.title, None if item.shows == NOTHING else item.rows(df, order_by)


def _common(rows: DataFrame) -> DataFrame:
    """Every chart as (pos, label, value, x, y): texts, doubles."""
    have = rows.columns
    number = lambda c: (F.col(c) if c in have else F.lit(None)).cast("double")
    text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string")
    pos = F.col("pos") if "pos" in have else F.lit(None).cast("bigint")
    return rows.select(
        pos.alias("pos"), F.col("label"), F.coalesce(number("value"), number("y")).alias("value"),
        number("x").alias("x"), number("y").alias("y"), text("x_text").alias("x_text"), text("y_text").alias("y_text"),
    )


def _label(df: DataFrame, name: str) -> Column:
    """The text of a value; zeros of both signs are one."""
    value, kind = clean_value(df, name), df.schema[name].dataType
    return value_text(value + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else value, kind)


def _order_key(df: DataFrame, name: str) -> Column | None:
    """A value as a struct that sorts as the value does, of one type for all columns; None if there is none."""
    value, kind = clean_value(df, name), df.schema[name].dataType
    whole, number, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        whole = value.cast("bigint")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        number = value.cast("double") + F.lit(0.0)
    elif isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = value.cast("string")  # times as ISO texts sort by time
    else:
        return None
    return F.struct(whole.alias("whole"), number.alias("number"), text.alias("text"))


def grouped_charts(df: DataFrame, items: Sequence[_Item]) -> DataFrame:
    """The rows of all charts of counts and means, in one pass over ``df``.

    Every row gives one (group, key, label, y) for each pair of columns that is charted; groups
    are merged before they move, and ranked up to the longest chart on both sides of the shuffle.
    """
    groups = list(dict.fromkeys((i.shows, i.x, i.y if i.shows == MEANS else None) for i in items))
    tagged = []
    for at, (shows, x, y) in enumerate(groups):
        label = _label(df, x)
        key = _order_key(df, x) if shows == MEANS else None
        value = clean_value(df, y).cast("double") if shows == MEANS else F.lit(None).cast("double")
        none = F.lit(None).cast("struct<whole:bigint,number:double,text:string>")
        tagged.append(F.struct(F.lit(at).alias("group"), (none if key is None else key).alias("key"), label.alias("label"), value.alias("y")))
    rows = df.select(F.explode(F.array(*tagged)).alias("t")).select("t.*").filter(F.col("label").isNotNull())
    tallies = rows.groupBy("group", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    longest = max(i.limit for i in items)
    first = Window.partitionBy("group").orderBy(F.when(F.col("key").isNull(), -F.col("n")), "key", "label")
    ranked = tallies.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= longest)
    charts = df.sparkSession.createDataFrame(
        [(i.number, i.kind, i.title, groups.index((i.shows, i.x, i.y if i.shows == MEANS else None)), i.limit, i.shows == MEANS) for i in items],
        "chart_id int, chart_type string, title string, chart_group int, most int, is_mean boolean",
    )
    met = ranked.join(F.broadcast(charts), (F.col("group") == F.col("chart_group")) & (F.col("rank") <= F.col("most")))
    return met.select(
        "chart_id", "chart_type", "title", (F.col("rank") - 1).cast("bigint").alias("pos"), "label",
        F.when(F.col("is_mean"), F.col("mean")).otherwise(F.col("n").cast("double")).alias("value"), *[F.lit(None).cast(t).alias(c) for c, t in NO_POINT.items()],
    )


NO_POINT = {"x": "double", "y": "double", "x_text": "string", "y_text": "string"}
CHART_ROWS = "chart_id int, chart_type string, title string, pos bigint, label string, value double, x double, y double, x_text string, y_text string"


def render_charts(df: DataFrame, specs: Sequence[ChartSpec], order_by=None, report: bool = False, mode: str = "direct") -> DataFrame | None:
    """All charts of a list as one long table; a chart that fails, also at run time, or lacks its x column is left out.

    All counts and means take one pass together; only when that fails is each of them tried
    alone. A chart without data, as one whose y column is absent, is one row without pos and
    label. Rows of charts with a limit come to the driver; the report's others are written.
    """
    spark = df.sparkSession
    wanted = [(i, s) for i, s in enumerate(specs) if s.x_axis in df.columns]
    numeric = lambda s: s.y_axis in df.columns and is_numeric(df.schema[s.y_axis].dataType)
    bars = {} if report else {s.x_axis: None for _, s in wanted if s.chart_type == "bar" and s.y_axis in df.columns}
    few = _tried(lambda: few_valued(df, list(bars)), "distinct values")
    if few is None:  # a column fails: each by itself
        few = {x for x in bars if _tried(lambda x=x: few_valued(df, [x]), x)}
    items = []
    for number, spec in wanted:
        item = _item(df, number, spec, few, report, mode)
        if item.shows == MEANS and not numeric(spec):
            log.warning("chart %s skipped: %s is not numeric", spec.title, spec.y_axis)
        else:
            items.append(item)
    together = [i for i in items if i.shows == COUNTS or (i.shows == MEANS and _order_key(df, i.x) is not None)]
    found = _tried(lambda: grouped_charts(df, together).collect(), "charts of counts and means") if together else []
    alone = [i for i in items if i.shows != NOTHING and (found is None or i not in together)]
    rows, frames = list(found or []), []
    for item in alone:
        named = lambda item=item: item.rows(df, order_by).select(F.lit(item.number).alias("chart_id"), F.lit(item.kind).alias("chart_type"), F.lit(item.title).alias("title"), "*")
        if item.limit is None:
            frames += [f for f in [_tried(lambda: _written(named()), item.title)] if f is not None]
        else:
            rows += _tried(lambda: named().collect(), item.title) or []
    rows += [(i.number, i.kind, i.title, *[None] * 7) for i in items if i.shows == NOTHING]
    if rows or not frames:
        frames.append(spark.createDataFrame(rows, CHART_ROWS))
    return reduce(DataFrame.unionByName, frames) if items else None


def _tried(run: Callable[[], R], what: str) -> R | None:
    try:
        return run()
    except (TypeError, PySparkException, Py4JJavaError) as problem:
        log.warning("%s skipped: %s", what, problem)
        return None


def _written(rows: DataFrame) -> DataFrame:
    folder = shared_folder(rows.sparkSession, "chart")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(CHART_ROWS).parquet(folder)
