"""Behaviour tables and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.columns import number

# Column order of a behaviour table.
BEHAVIOUR_COLUMNS = [
    "animal_id",
    "day_month_year",
    "location",
    "stun_parameter",
    "time_start",
    "recovery_stage",
    "time_to_stage",
    "time_seconds_stage",
    "stun_time",
    "video_time_to_stage",
    "weight",
    "sex",
    "cl",
    "comments",
]


def read_behaviour(spark: SparkSession, path: str) -> DataFrame:
    """One row per animal and stage; a blank time means the stage was not seen."""
    schema = StructType([StructField(c, StringType()) for c in BEHAVIOUR_COLUMNS])
    raw = spark.read.csv(path, header=True, schema=schema)
    return raw.withColumns({c: number(F.col(c)) for c in ("time_seconds_stage", "weight", "cl")})


def save_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result table; ``fmt`` is ``parquet`` or ``csv``."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def load_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
