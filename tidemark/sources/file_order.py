"""Row numbers that follow the lines of each file, for files read in any number of splits.

A split is read front to back by one task, so a row's place in its split is known while
reading. The rows are saved once; the splits' row counts, summed over the earlier splits of the
file, then turn that place into the row's number in the file. Nothing is sorted, and no file is
read by a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.groups import attach
from tidemark.session import save_stage
from tidemark.sources.recordings import RECORDING_COLUMNS, recording_rows


def read_in_file_order(
    spark: SparkSession, folder: str, skip_rows: int = 2, exclude: str = "double",
    columns: list[str] | None = None, recursive: bool = False, row: str = "row",
) -> DataFrame:
    """As :func:`read_recordings`, with ``row``: 0 for a file's first row after the unit rows.

    The number depends on the file alone, not on how it is split. Give it to ``Roles.order``,
    and rows of equal time keep the order of the file.
    """
    names = columns or RECORDING_COLUMNS
    rows = recording_rows(spark, folder, names, exclude, recursive)
    schema = StructType([*rows.schema.fields, StructField("__at", LongType())])
    placed = save_stage(rows.mapInArrow(_place_in_split, schema))
    splits = placed.groupBy("__path", "__block").agg((F.max("__at") + 1).alias("__rows"))
    earlier = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select(
        "__path", "__block", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__at") - skip_rows
    numbered = attach(placed, before, ["__path", "__block"], "inner").withColumn(row, number)
    return numbered.where(F.col(row) >= 0).select(*names, "source_file", row)


def _place_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place among the rows of its file split."""
    current, seen = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        path = batch.column("__path").dictionary_encode()
        codes = path.indices.to_numpy(zero_copy_only=False)
        block = batch.column("__block").to_numpy(zero_copy_only=False)
        new = (np.diff(codes, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)
        starts = np.flatnonzero(new)
        place = np.empty(batch.num_rows, np.int64)
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            split = (path.dictionary[codes[start]].as_py(), int(block[start]))
            if split != current:
                current, seen = split, 0
            place[start:end] = np.arange(seen, seen + end - start)
            seen += end - start
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(place)], names=[*batch.schema.names, "__at"])
