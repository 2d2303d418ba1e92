"""Lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A key with more rows is dealt out, in slots of about so many; at most so many keys and slots a key.
HOT_ROWS = 10_000
MAX_HOT = 1000
MAX_SLOTS = 4096
_SLOT, _SLOTS = "_slot", "_slots"


def hot_slots(facts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys that hold most rows, measured, each with its number of slots; None if there are none.

    Beyond the ``MAX_HOT`` largest keys none can hold more than a thousandth of the rows.
    """
    named = facts.select(*keys).dropna()
    counts = named.groupBy(*keys).count().filter(F.col("count") > hot_rows).orderBy(F.desc("count"), *keys).limit(MAX_HOT).collect()
    if not counts:
        return None
    unit = max(hot_rows, counts[-1]["count"] if len(counts) == MAX_HOT else 0)
    rows = [(*(r[k] for k in keys), min(MAX_SLOTS, math.ceil(r["count"] / unit))) for r in counts]
    schema = T.StructType([*(T.StructField(k, facts.schema[k].dataType) for k in keys), T.StructField(_SLOTS, T.IntegerType())])
    return facts.sparkSession.createDataFrame(rows, schema)


def spread_join(
    facts: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", condition: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Joins rows that may share one hot key with a table that has few rows per key.

    One aggregate finds the keys that hold most rows. Each of their rows, equal ones too, takes
    one of the key's slots in turn, and the table's rows of that key are repeated for every slot,
    so a hot key is met by as many tasks as its rows need; other keys are joined as they are.
    The table's other columns must not be named like columns of the facts.
    """
    keys = list(keys)
    slots = hot_slots(facts, keys, hot_rows)
    turn = F.monotonically_increasing_id()
    if slots is None:
        dealt, repeated = facts.withColumn(_SLOT, F.lit(0)), table.withColumn(_SLOT, F.lit(0))
    else:
        dealt = facts.join(F.broadcast(slots), keys, "left").withColumn(_SLOT, F.pmod(turn, F.coalesce(_SLOTS, F.lit(1))).cast("int")).drop(_SLOTS)
        each = F.explode(F.sequence(F.lit(0), F.coalesce(_SLOTS, F.lit(1)) - 1))
        repeated = table.join(F.broadcast(slots), keys, "left").withColumn(_SLOT, each).drop(_SLOTS)
    # Rows without a key meet nothing; they need not meet in one task.
    without = reduce(or_, [F.col(k).isNull() for k in keys])
    dealt = dealt.withColumn(_SLOT, F.when(without, F.pmod(turn, F.lit(MAX_SLOTS)).cast("int")).otherwise(F.col(_SLOT)))
    names = {k: f"_{k}" for k in [*keys, _SLOT]}
    test = F.lit(True) if condition is None else condition
    for left, right in names.items():
        test = test & (F.col(left) == F.col(right))
    return dealt.join(repeated.withColumnsRenamed(names), test, how).drop(_SLOT, *names.values())
