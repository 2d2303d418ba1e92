"""Column names of a table as read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def trim_headers(df: DataFrame) -> DataFrame:
    """Blanks around column names removed; two names that become equal are an error."""
    trimmed = [c.strip() for c in df.columns]
    if trimmed == df.columns:
        return df
    if len(set(trimmed)) < len(trimmed):
        raise ValueError(f"column names are not distinct after trimming: {trimmed}")
    return df.toDF(*trimmed)
