"""Removal of passages that repeat, by overlapping windows of three lines.

A line ends at a line break, or at a full stop, question or exclamation mark that follows a
letter or digit and is followed by a blank, so a passage is found wherever it stands in a
paragraph. Three consecutive lines are a window. A window seen before, in a smaller doc_id
or earlier in the same document, is a repeat; the lines of all repeats of a document are
merged and removed, the rest stays as it was, byte for byte.

Windows are written once. One aggregate on their 64-bit hash, merged before it moves, tells
which repeat; only those rows go on, and 96 bits of hash and their length tell them apart.
Copies of a hot window are reduced by partial aggregates and met by joins that Spark splits.

Only DataFrame functions are used. Defined results: null texts stay null and have no lines;
fewer than three lines make no window; windows below ``min_chars`` characters are left
alone; rows that agree in doc_id and text are one document and are treated alike; null ids
come first; an empty table stays empty. All columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.shared import table, whole_row, written

LINES = 3
#: Shorter windows (three words that are sentences) repeat by chance.
MIN_CHARS = 24
LINE_END = r"(?<=\n)|(?<=[\p{L}\p{N}][.!?] )"
TRAIL = " \t\r\n"


def split_lines(text: Column) -> Column:
    """The lines with their ends; together they are the text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), LINE_END), "")


def line_windows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per window: doc_id, key of the document, position (from 1), two hashes, length."""
    lines = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("key"),
        F.transform(split_lines(F.col("text")), lambda x: F.rtrim(x, F.lit(TRAIL))).alias("lines"),
    )
    # No filter on the number of lines: Spark would cut the text once for the filter and once for the windows.
    starts = F.when(F.size("lines") >= LINES, F.sequence(F.lit(1), F.size("lines") - (LINES - 1))).otherwise(F.array().cast("array<int>"))
    window = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("pos"), F.xxhash64(*_lines_at(i)).alias("h1"), F.hash(*_lines_at(i)).alias("h2"),
            sum((F.length(x) for x in _lines_at(i)), F.lit(0)).alias("chars"),
        ),
    )
    return (
        lines.select("doc_id", "key", F.explode(window).alias("w")).select("doc_id", "key", "w.*")
        .where(F.col("chars") >= min_chars)
    )


def _lines_at(i: Column) -> list[Column]:
    return [F.get("lines", i - 1 + k) for k in range(LINES)]


def repeated_positions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document (doc_id, key) with repeats: the sorted positions where a repeat begins."""
    windows = written(line_windows(docs, min_chars), "windows")
    # Both short tables are written so that each side of a join has its own shuffle, which Spark can split at a hot window.
    twice = written(windows.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h1"), "repeated-hashes")
    again = written(windows.join(twice, "h1", "left_semi"), "repeats")
    place = F.struct("doc_id", "key", "pos")
    identity = ["h1", "h2", "chars"]
    first = again.groupBy(*identity).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last"))
    later = again.join(written(first.drop("last"), "first-places"), identity).where(place > F.col("first"))
    return later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("pos")).alias("repeats"))


def marked_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each row of ``docs`` as ``row``, its number of lines, of removed lines, and the text that stays."""
    repeats = repeated_positions(docs, min_chars).select(
        F.col("doc_id").alias("in_doc"), F.col("key").alias("in_key"), "repeats"
    )
    rows = docs.select(whole_row(docs).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    met = rows.join(repeats, (F.col("key") == F.col("in_key")) & F.col("row.doc_id").eqNullSafe(F.col("in_doc")), "left")
    lines = met.select("row", "repeats", split_lines(F.col("row.text")).alias("lines"))
    # A repeat covers the LINES lines from its start on; what lies between covers is kept.
    starts = F.concat(F.array(F.lit(1)), F.transform("repeats", lambda p: p + LINES))
    stops = F.concat(F.col("repeats"), F.array(F.size("lines") + 1))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice("lines", a, F.greatest(b - a, F.lit(0)))))
    return lines.select(
        "row", "lines", F.when(F.col("repeats").isNotNull(), kept).alias("kept")
    ).select(
        "row", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("kept").isNotNull(), F.array_join("kept", "")).otherwise(F.col("row.text")).alias("text"),
    )


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the repeated passages; n_chars, where there is one, follows the text."""
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n_chars)
    return marked_lines(docs, min_chars).select(row.alias("row")).select("row.*")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = marked_lines(table(spark, sf_dir, "documents"))
    return marked.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, text,
         list_filter(string_split(regexp_replace(coalesce(text, ''), '(\n|[\p{L}\p{N}][.!?] )', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ls
  FROM documents
), starts AS (
  SELECT DISTINCT doc_id, text, ls, unnest(range(1, len(ls) - 1)) AS i FROM docs WHERE len(ls) >= 3
), win AS (
  SELECT doc_id, text, i, list_transform(ls[i : i + 2], lambda x: rtrim(x, E' \t\r\n')) AS w FROM starts
), ranked AS (
  SELECT doc_id, text, i, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, text, i) AS r
  FROM win WHERE len(w[1]) + len(w[2]) + len(w[3]) >= 24
), gone AS (
  SELECT doc_id, text, list_distinct(flatten(list([i, i + 1, i + 2]))) AS p FROM ranked WHERE r > 1 GROUP BY doc_id, text
), kept AS (
  SELECT d.doc_id, d.text, len(d.ls) AS n_lines, coalesce(len(p), 0) AS n_removed,
         array_to_string(list_filter(d.ls, lambda x, j: NOT list_contains(coalesce(p, []), j)), '') AS stays
  FROM docs d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE stays END AS text
FROM kept
"""
