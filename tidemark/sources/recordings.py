"""Folders of sampled recordings: one CSV file per recording."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.columns import number

# Column order of the files, whatever their own header says.
SIGNALS = [
    "raw_eeg",
    "beta",
    "alpha",
    "delta",
    "theta",
    "raw_eeg_sef",
    "raw_eeg_median_0_500hz",
    "all_05_32_hz",
    "raw_eeg_median_05_32hz",
]
RECORDING_COLUMNS = ["time", *SIGNALS, "comments"]
RECORDING_SCHEMA = StructType([StructField(c, StringType()) for c in RECORDING_COLUMNS])


def read_recordings(
    spark: SparkSession,
    folder: str,
    skip_rows: int = 2,
    exclude: str = "double",
    columns: list[str] | None = None,
    recursive: bool = False,
) -> DataFrame:
    """All ``*.csv`` files of a folder as text columns plus ``source_file``.

    Files whose name contains ``exclude`` are ignored. The first ``skip_rows``
    data rows of every file hold units and are dropped.
    """
    rows = recording_rows(spark, folder, columns or RECORDING_COLUMNS, exclude, recursive)
    if skip_rows:
        kept = StructType([*rows.schema.fields[:-2]])
        return rows.mapInArrow(_drop_leading(skip_rows), kept)
    return rows.drop("__path", "__block")


def recording_rows(
    spark: SparkSession, folder: str, names: list[str], exclude: str, recursive: bool
) -> DataFrame:
    """All rows of the files with ``source_file`` and the place of their split."""
    schema = StructType([StructField(c, StringType()) for c in names])
    raw = (
        spark.read.option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", str(recursive).lower())
        .csv(folder, header=True, schema=schema)
        .where(~F.lower(F.col("_metadata.file_name")).contains(exclude.lower()))
    )
    return raw.select(
        *names,
        F.url_decode(F.col("_metadata.file_name")).alias("source_file"),
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__block"),
    )


def _drop_leading(skip_rows: int):
    """Drop the first rows of each file; a task reads a file split front to back.

    Only the split at offset 0 holds a file's first rows, so nothing is shuffled
    and a huge file is still read by many tasks.
    """

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            path = batch.column("__path").dictionary_encode()
            codes = path.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            block = batch.column("__block").to_numpy(zero_copy_only=False)
            keep = np.ones(batch.num_rows, dtype=bool)
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                name = (path.dictionary[codes[start]].as_py(), int(block[start]))
                if name != current:
                    current, seen = name, 0
                if name[1] == 0 and seen < skip_rows:
                    keep[start : start + skip_rows - seen] = False
                seen += end - start
            keep_columns = batch.select(batch.schema.names[:-2])
            yield keep_columns.filter(pa.array(keep))

    return drop


def clean_recordings(
    raw: DataFrame, numeric: list[str] | None = None, comment: str = "comments"
) -> DataFrame:
    """Numbers from text; rows with a missing number go, blank comments stay."""
    numeric = numeric or SIGNALS
    typed = raw.withColumns(
        {**{c: number(F.col(c)) for c in numeric}, comment: F.coalesce(F.col(comment), F.lit(""))}
    )
    return typed.na.drop(subset=numeric)
