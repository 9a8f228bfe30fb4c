"""Rows of text files in the order they have in the file.

Spark cuts a file in splits and reads these in any order. A row is placed by its split's first byte (``_metadata``) and its place
among the split's rows; row numbers add the rows of the file's earlier splits. Only the splits' counts are ordered, never the
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_order() -> Column:
    """What a file's rows sort by: file, first byte of the split, place among the task's rows. For a frame just read."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("place"))


def row_numbers_in_file(rows: DataFrame, name: str = "row_idx", order: str = "order") -> DataFrame:
    """``rows`` with their number from 0 in their file, by ``order`` (a ``file_order``, taken after all filters)."""
    split = [F.col(f"{order}.file").alias("file_"), F.col(f"{order}.begin").alias("begin_")]
    splits = rows.groupBy(*split).agg(F.count("*").alias("n_"), F.min(f"{order}.place").alias("low_"))
    earlier = F.coalesce(F.sum("n_").over(Window.partitionBy("file_").orderBy("begin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select("file_", "begin_", (earlier - F.col("low_")).alias("shift_"))
    placed = rows.withColumns({"file_": F.col(f"{order}.file"), "begin_": F.col(f"{order}.begin")}).join(shifts, ["file_", "begin_"])
    return placed.withColumn(name, F.col(f"{order}.place") + F.col("shift_")).drop("file_", "begin_", "shift_")
