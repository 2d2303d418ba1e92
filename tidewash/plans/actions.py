"""The action map as a table: one row per dataset and column.

Later entries replace earlier ones. That is always an aggregate with a partial
step (`max_by`), never a window over all entries of one column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewash.operators.joins import spread_join

FIELDS = ("action", "reason", "transformation")


def _entry() -> Column:
    return F.struct(*FIELDS)


def _unpack(df: DataFrame, keep: Sequence[str], entry: str = "entry") -> DataFrame:
    return df.select(*keep, *[F.col(f"{entry}.{f}").alias(f) for f in FIELDS])


def action_map(recommendations: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """One entry per column: a repeated column keeps its place and takes the last entry."""
    keys = [*by, "column"]
    merged = recommendations.groupBy(*keys).agg(
        F.min("pos").alias("pos"), F.max_by(_entry(), "pos").alias("entry")
    )
    return _unpack(merged, [*by, "pos", "column"])


def action_counts(actions: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return actions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("action") == a).alias(a) for a in ("keep", "drop", "transform")],
    )


def latest_actions(versions: DataFrame, by: Sequence[str] = ("dataset",), version: str = "version") -> DataFrame:
    """Only the entries of the newest version: a new map replaces the old one as a whole.

    Rows are matched on dataset and version with the newest version of each dataset.
    """
    newest = versions.groupBy(*by).agg(F.max(version).alias(version))
    return versions.join(newest, [*by, version], "left_semi")


def override_actions(actions: DataFrame, overrides: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Grid edits: a given action or transformation wins, the rest of the entry stays."""
    keys = [*by, "column"]
    changed = overrides.select(
        *keys, F.col("action").alias("new_action"), F.col("transformation").alias("new_transformation")
    )
    return (
        actions.join(changed, keys, "left")
        .withColumn("action", F.coalesce("new_action", "action"))
        .withColumn("transformation", F.coalesce("new_transformation", "transformation"))
        .drop("new_action", "new_transformation")
    )


def fold_edits(
    actions: DataFrame | None, edits: DataFrame, by: Sequence[str] = ("session_id",), turn: str = "turn"
) -> DataFrame:
    """The action map after all edits: per column the entry of the latest turn.

    Within a turn the last edit counts, by ``pos`` where the edits have one (two
    spellings of a name may meet in one column). The base entries count as turn -1,
    so base and edits merge in one aggregate.
    """
    keys = [*by, "column"]
    place = F.col("pos") if "pos" in edits.columns else F.lit(0)
    rows = edits.select(*keys, F.col(turn).cast("bigint").alias("turn"), place.cast("int").alias("pos"), *FIELDS)
    if actions is not None:
        base = actions.select(*keys, F.lit(-1).cast("bigint").alias("turn"), F.lit(0).alias("pos"), *FIELDS)
        rows = base.unionByName(rows)
    return _unpack(rows.groupBy(*keys).agg(F.max_by(_entry(), F.struct("turn", "pos")).alias("entry")), keys)


def resolve_names(edits: DataFrame, actions: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Edit names take the spelling of the first existing entry that differs only in case."""
    known = actions.groupBy(*by, F.lower("column").alias("lowered")).agg(F.min_by("column", "pos").alias("existing"))
    lowered = edits.withColumn("lowered", F.lower("column"))
    return (
        spread_join(lowered, known, [*by, "lowered"], "left")
        .withColumn("column", F.coalesce("existing", "column"))
        .drop("lowered", "existing")
    )


def match_actions(actions: DataFrame, columns: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Actions whose column exists; the others are left out."""
    return actions.join(columns, [*by, "column"], "left_semi")


def rules_table(actions: DataFrame, keep: Sequence[str] = ("dataset", "pos", "column")) -> DataFrame:
    """The report's table: upper-cased action and the reason with its transformation."""
    extra = F.concat(F.lit(" (Transformation: "), F.col("transformation"), F.lit(")"))
    has_extra = F.coalesce(F.col("transformation") != "", F.lit(False))
    return actions.select(
        *keep,
        F.upper(F.coalesce("action", F.lit("keep"))).alias("action"),
        F.concat(F.coalesce("reason", F.lit("")), F.when(has_extra, extra).otherwise("")).alias("explanation"),
    )
