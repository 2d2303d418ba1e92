"""Records of quoted CSV files that are read by many tasks, though cells may hold line breaks.

Files are read as physical lines, in splits. Whether a line begins inside a quoted cell hangs on
all lines before it, so every split first tells what it does to a reader that comes in outside or
inside a cell: leave it, turn it, or bring it to one of both. A prefix over these few maps gives
the true state at the beginning of every split; then each task joins its lines to records. What a
record has in several splits is put together by the split where it begins.

A quote counts only at the beginning of a cell; inside a quoted cell two quotes are one. Where no
line leaves a cell open, none of this is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewash.session import shared_folder

#: A whole cell; and what a line holds that leaves a cell open, for a reader that comes in outside or inside a cell.
CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
OPEN_FROM_OUTSIDE = rf'(?:{CELL},)*+"(?:[^"]++|"")*+'
OPEN_FROM_INSIDE = rf'(?:[^"]++|"")*+(?:"[^,]*+,{OPEN_FROM_OUTSIDE})?'
FROM_OUTSIDE, FROM_INSIDE = re.compile(OPEN_FROM_OUTSIDE, re.S), re.compile(OPEN_FROM_INSIDE, re.S)
BLANK = re.compile(r"[ \t\r]*")
#: Splits that begin inside a cell are broadcast up to this number, of some 200 bytes each.
MAX_BROADCAST = 50_000

WHOLE, PIECE, HEADER = 0, 1, 2


def physical_lines(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """(file, block, line): the lines of each file, with the place where their split begins."""
    lines = spark.read.option("lineSep", "\n").text(files)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def first_look(lines: DataFrame) -> tuple[bool, bool]:
    """Whether any line leaves a cell open for a reader that comes in outside; and whether any holds a carriage return before its end."""
    line = F.col("line")
    opens = line.contains('"') & line.rlike(rf"(?s)\A{OPEN_FROM_OUTSIDE}\z")
    returns = F.instr(F.rtrim(line, F.lit("\r")), "\r") > 0
    found = lines.agg(F.max(opens).alias("opens"), F.max(returns).alias("returns")).first()
    return bool(found["opens"]), bool(found["returns"])


def n_cells(record: Column) -> Column:
    return F.regexp_count(F.concat(F.lit(","), record), F.lit(rf"(?s),{CELL}"))


def _after(line: str, inside: bool) -> bool:
    """Whether a reader is inside a cell after a line that holds a quote."""
    return bool((FROM_INSIDE if inside else FROM_OUTSIDE).fullmatch(line))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches cut where a split of a file begins; the flag is set at its first lines."""
    now: tuple | None = None
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            own = (batch["file"][at].as_py(), batch["block"][at].as_py())
            same = pc.and_(pc.equal(batch["file"], own[0]), pc.equal(batch["block"], own[1]))
            other = pc.index(same.slice(at), False).as_py()
            to = batch.num_rows if other < 0 else at + other
            yield own != now, batch.slice(at, to - at)
            now, at = own, to


def split_maps(lines: DataFrame) -> DataFrame:
    """Per split: the state after it for a reader that comes in outside or inside, and whether a record begins there for the latter."""
    schema = "file string, block bigint, from_outside boolean, from_inside boolean, begins boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: list | None = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({name.split()[0]: [value] for name, value in zip(schema.split(", "), row)})

        for fresh, batch in _splits(batches):
            if fresh:
                if row is not None:
                    yield told()
                row = [batch["file"][0].as_py(), batch["block"][0].as_py(), False, True, False]
            quoted = pc.indices_nonzero(pc.match_substring(batch["line"], '"')).to_pylist()
            row[4] = row[4] or not row[3]
            for at in quoted:
                line = batch["line"][at].as_py()
                row[2], row[3] = _after(line, row[2]), _after(line, row[3])
                row[4] = row[4] or (not row[3] and at + 1 < batch.num_rows)
        if row is not None:
            yield told()

    return lines.mapInArrow(run, schema)


def split_states(maps: DataFrame) -> DataFrame:
    """``maps`` with the true state at the beginning and end of each split, and ``opener``, the split where its first piece begins."""
    in_file = Window.partitionBy("file").orderBy("block")
    fixed = F.col("from_outside") == F.col("from_inside")
    turns = F.col("from_outside") & ~F.col("from_inside")
    marked = maps.withColumn("fixes", F.sum(fixed.cast("int")).over(in_file))
    since = Window.partitionBy("file", "fixes").orderBy("block")
    # After the last split that brings every reader to one state (or the file's beginning), turns are counted.
    base = F.first(F.when(fixed, F.col("from_outside")).otherwise(F.lit(False))).over(since)
    turned = F.sum((turns & ~fixed).cast("int")).over(since) % 2 == 1
    ended = marked.withColumn("after", base != turned)
    inside = F.coalesce(F.lag("after").over(in_file), F.lit(False))
    known = ended.withColumn("inside", inside).withColumn("begins", ~F.col("inside") | F.col("begins"))
    open_here = F.when(F.col("after") & F.col("begins"), F.col("block"))
    opener = F.last(open_here, ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1
    return known.withColumn("opener", opener).withColumn("last", last).select("file", "block", "inside", "after", "opener", "last")


def joined_lines(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(file, opener, block, kind, record): whole records, pieces of records that go over splits, and each file's header."""
    entered = states.where("inside").select("file", "block", "opener")
    if entered.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        met = lines.join(F.broadcast(entered), ["file", "block"], "left")
    else:
        numbered = lines.withColumn("n", F.monotonically_increasing_id())
        met = numbered.join(entered, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "n")
    schema = "file string, opener bigint, block bigint, kind int, record string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, opener, inside, header = None, 0, None, False, False
        held: list[str] = []  # the lines of the record that goes on
        held_kind, out = WHOLE, []

        def keep(kind: int, record: str) -> None:
            nonlocal header
            record = record[:-1] if record.endswith("\r") and kind == WHOLE else record
            if kind == WHOLE:
                if BLANK.fullmatch(record):
                    return
                if header:
                    kind, header = HEADER, False
            out.append((file, opener if kind == PIECE else None, block, kind, record))

        def finish() -> None:
            """The end of a split: lines held are a piece of a record, which may have begun here."""
            nonlocal held, opener
            if held:
                if header:
                    raise ValueError(f"the header of {file} does not end in its first split")
                opener = block if held_kind == WHOLE else opener
                keep(PIECE, "\n".join(held))
            held = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "opener", "block", "kind", "record"])

        for fresh, batch in _splits(batches):
            if fresh:
                finish()
                file, block, opener = (batch[name][0].as_py() for name in ("file", "block", "opener"))
                inside = opener is not None
                held_kind, header = PIECE if inside else WHOLE, block == 0
            quoted = pc.match_substring(batch["line"], '"').to_pylist()
            for line, has_quote in zip(batch["line"].to_pylist(), quoted):
                after = _after(line, inside) if has_quote else inside
                held.append(line)
                inside = after
                if not inside:
                    keep(held_kind, "\n".join(held))
                    held, held_kind = [], WHOLE
            yield rows()
            out.clear()
        finish()
        yield rows()

    return met.select("file", "block", "line", "opener").mapInArrow(run, schema)


def records(spark: SparkSession, files: str | list[str]) -> tuple[list[str], DataFrame]:
    """The headers found, and all other records (column ``record``) of the files, from a table in the shared folder."""
    lines = physical_lines(spark, files)
    folder = shared_folder(spark, "csv-splits")
    split_states(split_maps(lines)).write.parquet(folder)
    states = spark.read.parquet(folder)
    if not states.where("last AND after").isEmpty():
        raise ValueError("a quoted cell does not end before its file does")
    folder = shared_folder(spark, "csv-records")
    joined_lines(lines, states).write.parquet(folder)
    found = spark.read.parquet(folder)
    headers = [r["record"] for r in found.where(F.col("kind") == HEADER).select("record").distinct().limit(1000).collect()]
    pieces = found.where(F.col("kind") == PIECE).groupBy("file", "opener").agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("pieces"))
    whole = F.regexp_replace(F.array_join("pieces.record", "\n"), r"\r\z", "")
    return headers, found.where(F.col("kind") == WHOLE).select("record").unionByName(pieces.select(whole.alias("record")))
