"""Seed files and rows of target JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.urls import strip
from millrace.schemas import CRAWL_TARGET


def seed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines that are neither blank nor comments; null lines are dropped."""
    line = strip(F.col(column))
    return lines.withColumn(column, line).filter((F.col(column) != "") & ~F.startswith(column, F.lit("#")))


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """(value): one address for each line of a text file."""
    return seed_lines(spark.read.text(path))


def full_address(text: Column) -> Column:
    """What a user types, as an address: a bare domain gets https://."""
    t = strip(text)
    return F.when(t == "", t).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))


def target_json(targets: DataFrame) -> DataFrame:
    """(value): one JSON line for each target, as it is appended to ingest."""
    return targets.select(F.to_json(F.struct(*targets.columns)).alias("value"))


def read_target_json(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, CRAWL_TARGET).alias("t")).select("t.*")
