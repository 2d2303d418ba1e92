"""The same operators on unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewash.operators.edits import FULL_KEYWORDS, edit_requests
from tidewash.plans.actions import FIELDS
from tidewash.plans.cleaning import CleanPlan, apply

#: Folders of single batches that a folded stream has at most before they become one.
COMPACT_EVERY = 16

# The state of a session that has no job.
IDLE = {"status": "idle", "result": None, "error": None, "progress": 0, "progress_msg": ""}


def read_stream(spark: SparkSession, folder: str, glob: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files that match a name pattern in a folder."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def clean_stream(stream: DataFrame, plan: CleanPlan) -> DataFrame:
    """A fitted plan on a stream: stateless, with the medians of the fit."""
    return apply(stream, plan)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is there and appends it to parquet files, each row once."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


@dataclass(frozen=True)
class Fold:
    """What a stream keeps of each key: rows of a batch, and any rows folded before, fold to one row.

    ``rows`` turns messages into rows, ``merge`` folds rows of a key (in any order and grouping),
    ``result`` reads them. ``seen``, where there is one, is the time of the newest message of a
    key, by which it expires.
    """

    keys: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    result: Callable[[DataFrame], DataFrame]
    seen: str | None = None


def _time(name: str | None) -> Column:
    return (F.col(name) if name else F.lit(None)).cast("timestamp").alias("seen")


def edits_fold(columns: Sequence[str] | DataFrame, text: str = "text", by: Sequence[str] = ("session_id",), keywords=FULL_KEYWORDS, time: str | None = None) -> Fold:
    """The entry of each session's columns. Ordered by turn, not by arrival: a late message cannot replace a newer one."""
    keys = (*by, "column")

    def rows(messages: DataFrame) -> DataFrame:
        edits = edit_requests(messages, columns, text, by, keywords)
        return edits.select(*keys, F.struct(*FIELDS, "turn").alias("entry"), _time(time))

    def merge(found: DataFrame) -> DataFrame:
        return found.groupBy(*keys).agg(F.max_by("entry", "entry.turn").alias("entry"), F.max("seen").alias("seen"))

    return Fold(keys, rows, merge, lambda found: found.select(*keys, "entry.*"), "seen" if time else None)


def jobs_fold(time: str | None = None) -> Fold:
    """The state of each session's job from its events.

    A `set` event replaces the whole state, its result (a JSON text) included; an `update` event
    changes progress and its message, and only counts behind a `set`. Events are ordered by seq.
    """
    def rows(events: DataFrame) -> DataFrame:
        is_set = F.col("kind") == "set"
        base = F.when(is_set, F.struct("seq", "status", "result", "error", "progress", "progress_msg"))
        step = F.when(~is_set, F.struct("seq", "progress", "progress_msg"))
        return events.select("session_id", base.alias("base"), step.alias("step"), _time(time))

    def merge(found: DataFrame) -> DataFrame:
        newest = [F.max_by(name, f"{name}.seq").alias(name) for name in ("base", "step")]
        return found.groupBy("session_id").agg(*newest, F.max("seen").alias("seen"))

    def result(found: DataFrame) -> DataFrame:
        newer = F.col("step.seq") > F.col("base.seq")
        return found.filter(F.col("base").isNotNull()).select(
            "session_id", *[F.col(f"base.{name}").alias(name) for name in ("status", "result", "error")],
            *[F.when(newer, F.col(f"step.{name}")).otherwise(F.col(f"base.{name}")).alias(name) for name in ("progress", "progress_msg")],
        )

    return Fold(("session_id",), rows, merge, result, "seen" if time else None)


def folded(messages: DataFrame, fold: Fold) -> DataFrame:
    """The fold of a table of messages."""
    return fold.result(fold.merge(fold.rows(messages)))


def current_edits(
    messages: DataFrame, columns: Sequence[str] | DataFrame, text: str = "text",
    by: Sequence[str] = ("session_id",), keywords=FULL_KEYWORDS,
) -> DataFrame:
    """The entry of each session's columns after all messages of a table."""
    return folded(messages, edits_fold(columns, text, by, keywords))


def job_states(events: DataFrame) -> DataFrame:
    """The state of each session's job from a table of events."""
    return folded(events, jobs_fold())


def fold_to_table(
    stream: DataFrame, fold: Fold, path: str, checkpoint: str, keep: str | None = None, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Folds a stream into a table that holds one row of each key, whatever the number of batches.

    A batch is folded by itself and written as a folder of its own, so the stream keeps no state
    in its operators. Every ``compact_every`` batches all folders are folded into one; there keys
    expire that were not seen for ``keep`` (an interval such as "30 days") before the newest
    message. A batch that is written anew after a failure replaces its folder, and a compaction
    counts only when it is complete, so no message counts twice and none is lost. Returns the
    ended query.
    """
    if keep is not None and fold.seen is None:
        raise ValueError("keys expire by the time of their messages: name its column")
    folders = FoldedFolders(stream.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        fold.merge(fold.rows(batch)).write.mode("overwrite").parquet(folders.batch(number))
        base, batches = folders.current()
        if len(batches) >= compact_every:
            last = max(batches)
            _expired(fold.merge(folders.read()), fold, keep).write.mode("overwrite").parquet(folders.base(last))
            folders.drop_before(last, base)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_of(spark: SparkSession, path: str, fold: Fold, keep: str | None = None) -> DataFrame:
    """What the fold says of each key in a table written by ``fold_to_table``."""
    return fold.result(_expired(fold.merge(FoldedFolders(spark, path).read()), fold, keep))


def _expired(rows: DataFrame, fold: Fold, keep: str | None) -> DataFrame:
    """``rows`` without the keys last seen more than ``keep`` before the newest message of all."""
    if keep is None:
        return rows
    newest = rows.agg(F.max(fold.seen)).first()[0]
    return rows if newest is None else rows.filter(F.col(fold.seen).isNull() | (F.col(fold.seen) >= F.lit(newest) - F.expr(f"INTERVAL {keep}")))


class FoldedFolders:
    """The folders of a folded stream: batch=N of one batch, base=N of all batches up to N.

    A base is complete when its writer has left its mark. The newest complete one and the batches
    after it are the table. What a newer base made needless is deleted one compaction later, so a
    reader that listed the folders just before still finds them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batch(self, number: int) -> str:
        return f"{self.path}/batch={number}"

    def base(self, number: int) -> str:
        return f"{self.path}/base={number}"

    def _numbers(self, kind: str) -> list[int]:
        folder = self.fs_path(self.path)
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        marked = [name for name in names if name.startswith(f"{kind}=") and self.fs.exists(self.fs_path(f"{self.path}/{name}/_SUCCESS"))]
        return sorted(int(name.partition("=")[2]) for name in marked)

    def current(self) -> tuple[int | None, list[int]]:
        """The newest base, and the batches after it."""
        base = max(self._numbers("base"), default=None)
        return base, [n for n in self._numbers("batch") if base is None or n > base]

    def read(self) -> DataFrame:
        base, batches = self.current()
        paths = [self.base(base)] if base is not None else []
        return self.spark.read.parquet(*paths, *map(self.batch, batches))

    def drop_before(self, number: int, base: int | None) -> None:
        """Deletes what the base before ``number`` (None: there was none) had replaced already."""
        old = [self.batch(n) for n in self._numbers("batch") if base is not None and n <= base]
        old += [self.base(n) for n in self._numbers("base") if n < (number if base is None else base)]
        for folder in old:
            self.fs.delete(self.fs_path(folder), True)


def state_of(states: DataFrame, sessions: DataFrame) -> DataFrame:
    """The state of each asked session; one without a job is idle."""
    known = states.withColumn("known", F.lit(True))
    joined = sessions.select("session_id").join(known, "session_id", "left")
    value = lambda name: F.when(F.col("known"), F.col(name)).otherwise(F.lit(IDLE[name]))
    types = {"status": "string", "result": "string", "error": "string", "progress": "int", "progress_msg": "string"}
    return joined.select("session_id", *[value(n).cast(t).alias(n) for n, t in types.items()])
