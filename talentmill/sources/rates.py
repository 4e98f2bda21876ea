"""Landed exchange-rate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cbr(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Daily XML of a central bank: value per unit in RUB, decimal commas."""
    rows = spark.read.format("xml").option("rowTag", "Valute").schema("CharCode string, Nominal string, Value string").load(path)
    number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("decimal(18,6)")
    return rows.select(F.lit(day).cast("date").alias("rate_date"), F.upper(F.trim("CharCode")).alias("base_currency"), F.lit("RUB").alias("target_currency"), (number("Value") / number("Nominal")).cast("decimal(18,6)").alias("rate")).where("rate is not null")


def read_ecb(spark: SparkSession, path: str) -> DataFrame:
    """CSV of reference rates: units of each currency per EUR."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("TIME_PERIOD").try_cast("date").alias("rate_date"), F.upper("CURRENCY").alias("base_currency"), F.lit("EUR").alias("target_currency"), F.col("OBS_VALUE").try_cast("decimal(18,6)").alias("rate")).where("rate is not null and rate_date is not null")
