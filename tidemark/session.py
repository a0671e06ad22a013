"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Groups with more rows than this are never handled by a single task.
HOT_ROWS = ("spark.tidemark.hotGroupRows", 2_000_000)
# Saved tables with more rows than this are joined by shuffle, not broadcast.
BROADCAST_ROWS = ("spark.tidemark.broadcastRows", 200_000)
# Cells of a linear model's largest factor are kept in one row per level up to this many a level.
LISTED_CELLS = ("spark.tidemark.listedCells", 100)


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def setting(spark: SparkSession, option: tuple[str, int]) -> int:
    name, default = option
    return int(spark.conf.get(name, str(default)))


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def stage_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def save_stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts the lineage, so later stages neither recompute ``df`` nor depend
    on the executors that produced it.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
