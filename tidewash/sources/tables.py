"""CSV scan with inferred types, and the sinks of a cleaned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewash.functions.columns import col
from tidewash.functions.parsing import integer_or_null, na_to_null, number_or_null
from tidewash.sources import csv_records

TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")


MALFORMED = "_malformed"


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Comma separated files with one header, missing tokens as null, types inferred.

    Cells are read as text, then one aggregate decides the type of each column; it also counts
    rows with more cells than the header, which are an error, as are files whose headers
    differ. Files are read in splits, by many tasks, also where cells hold line breaks: then
    records are put together first and kept in the shared folder. Only carriage returns that
    stand alone, which may or may not end a record, make each file one task (and become line feeds in cells).
    """
    files = path if isinstance(path, str) else list(path)
    opens, returns = csv_records.first_look(csv_records.physical_lines(spark, files))
    reader = spark.read.option("inferSchema", False).option("escape", '"').option("multiLine", returns)
    if opens and not returns:
        headers, records = csv_records.records(spark, files)
        cells = [_cells(spark, header) for header in headers]
    else:
        heading = reader.option("header", False).csv(files).first()
        cells = [[] if heading is None else list(heading)]
    if any(other != cells[0] for other in cells):
        raise ValueError(f"the files have different headers: {headers[:5]}")
    names = header_names(cells[0])
    malformed = MALFORMED
    while malformed in names:
        malformed += "_"
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, malformed]])
    if opens and not returns:
        numbered = ", ".join(f"c{i} string" for i in range(len(schema)))
        options = {"escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": f"c{len(names)}"}
        raw = records.select(F.from_csv("record", numbered, options).alias("r")).select("r.*").toDF(*schema.names)
    else:
        # Spark holds each file's header against the schema; where names had to be changed, that cannot be.
        same = names == cells[0]
        raw = reader.option("header", True).option("enforceSchema", not same).option("columnNameOfCorruptRecord", malformed).schema(schema).csv(files)
    return infer_types(raw, malformed=malformed)


def _cells(spark: SparkSession, record: str) -> list[str | None]:
    n = spark.range(1).select(csv_records.n_cells(F.lit(record))).first()[0]
    schema = ", ".join(f"c{i} string" for i in range(n))
    return list(spark.range(1).select(F.from_csv(F.lit(record), schema, {"escape": '"', "multiLine": "true"})).first()[0])


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Distinct column names: a repeated name gets .1, .2, ..., an empty one its position."""
    names: list[str] = []
    taken = {c for c in cells if c}
    for i, cell in enumerate(cells):
        name, repeat = cell or f"Unnamed: {i}", 0
        while name in names or (repeat and name in taken):
            repeat += 1
            name = f"{cell or f'Unnamed: {i}'}.{repeat}"
        names.append(name)
    return names


def infer_types(raw: DataFrame, columns: Sequence[str] | None = None, malformed: str | None = None) -> DataFrame:
    """Text columns typed by their content; the column ``malformed`` holds records that have too many cells or too few.

    bigint if every cell is a whole number, double if all present cells are
    numbers (or none is present), boolean if every cell is true or false, else
    text. Missing cells turn a whole number column into double, as they do in
    a pandas frame, and leave a true/false column as text.
    """
    texts = [
        f.name for f in raw.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns) and f.name != malformed
    ]
    if not texts:
        return raw
    cells = {c: na_to_null(col(c)) for c in texts}
    counted = []
    for i, c in enumerate(texts):
        v = cells[c]
        counted += [
            F.count(v).alias(f"n{i}"),
            F.count(number_or_null(v)).alias(f"d{i}"),
            F.count(integer_or_null(v)).alias(f"i{i}"),
            F.count_if(v.isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"b{i}"),
        ]
    width = len(raw.columns) - 1
    too_wide = F.count_if(csv_records.n_cells(col(malformed)) > width) if malformed else F.lit(0)
    facts = raw.agg(F.count(F.lit(1)).alias("rows"), too_wide.alias("too_wide"), *counted).first()
    if facts["too_wide"]:
        raise ValueError(f"{facts['too_wide']} rows have more cells than the header")

    def typed(name: str):
        if name not in cells:
            return col(name)
        i, v = texts.index(name), cells[name]
        present, rows = facts[f"n{i}"], facts["rows"]
        if facts[f"d{i}"] == present:
            whole = present == rows and facts[f"i{i}"] == present and rows > 0
            return integer_or_null(v) if whole else number_or_null(v)
        if facts[f"b{i}"] == present == rows:
            return v.isin(*TRUE_WORDS)
        return v

    return raw.select(*[typed(c).alias(c) for c in raw.columns if c != malformed])


def write_cleaned(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The cleaned table as parquet or as CSV with a header; no index column.

    CSV holds times as their text, with the fraction of a second where there is one.
    """
    if fmt == "csv":
        times = (T.TimestampType, T.TimestampNTZType)
        texts = [col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, times) else col(f.name) for f in df.schema.fields]
        df.select(*texts).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
