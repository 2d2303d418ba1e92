"""A dirty sample table: identifiers, noise, duplicates, gaps and date texts.

Every draw is a hash of the row key, so rows do not depend on how the data is
partitioned, and a retried task makes the same rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The names that profiles are drawn from, and the first identifier.
NAMES = ("John Doe", "Jane Smith", "Bob Jones", "Alice Green", "Charlie Brown", "Emily White")
FIRST_ID = 1000


def _uniform(key: Column, what: str, seed: int) -> Column:
    """A number in [0, 1) for this row and purpose."""
    return F.pmod(F.xxhash64(key, F.lit(what), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))


def _between(key: Column, what: str, seed: int, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    return F.lit(low) + F.floor(_uniform(key, what, seed) * (high - low + 1)).cast("bigint")


def dirty_rows(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One dirty row per row of ``keys``; ``key`` is a whole number from 0."""
    k = F.col(key)
    age = _between(k, "age", seed, 18, 69)
    fee = F.bround(F.lit(20.0) + _uniform(k, "fee", seed) * 100.0, 2)
    gender = _between(k, "gender", seed, 0, 2)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _uniform(k, "radius", seed)))
    noise = radius * F.cos(F.lit(2.0 * math.pi) * _uniform(k, "angle", seed))
    chance = (
        F.lit(0.1)
        + F.when(fee > 80, 0.4).otherwise(0.0)
        + F.when(age > 50, 0.2).otherwise(0.0)
    )
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), _between(k, "name", seed, 0, len(NAMES) - 1).cast("int"))
    return keys.select(
        F.format_string("USR_%06d", k + FIRST_ID).alias("User_ID_Hash"),
        F.concat_ws(" ", name, _between(k, "number", seed, 1, 100).cast("string")).alias("Customer_Profile_Name"),
        F.when(_uniform(k, "gap", seed) > 0.05, age.cast("double")).alias("Age"),
        F.when(gender == 0, "Male").when(gender == 1, "Female").alias("Gender"),
        fee.alias("Monthly_Subscription_Fee"),
        fee.alias("Duplicated_Fee"),
        noise.alias("System_Noise_Signal"),
        F.lit(None).cast("string").alias("Null_Column_All_Empty"),
        F.format_string("2025-%02d-%02d", _between(k, "month", seed, 1, 12), _between(k, "day", seed, 1, 28)).alias("Registration_Date"),
        F.when(_uniform(k, "churn", seed) < chance, 1).otherwise(0).cast("bigint").alias("Churned_Status"),
    )


def dirty_table(spark: SparkSession, rows: int = 150, seed: int = 42) -> DataFrame:
    return dirty_rows(spark.range(rows), "id", seed)
