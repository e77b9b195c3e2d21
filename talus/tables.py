"""Reading the tables of a data folder, and name keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def name_key(value: Column) -> Column:
    r"""Upper case, trimmed, runs of ASCII white space made one space; null stays null, a blank gives ''."""
    return F.upper(F.trim(F.regexp_replace(value, r"\s+", " ")))


def is_blank(value: Column) -> Column:
    """True for null and for strings of ASCII white space only."""
    return value.isNull() | value.rlike(r"^\s*$")
