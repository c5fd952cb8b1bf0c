"""What lossy and packing chunk filters do to values, as column expressions over whole chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frame import ArrayFrame


def half_away(x: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    low = F.floor(F.abs(x)).cast("double")
    return F.when(F.abs(x) - low >= 0.5, low + 1).otherwise(low) * F.signum(x)


def decimal_scale(frame: ArrayFrame, digits: int) -> ArrayFrame:
    """Values as they read back after decimal scaling relative to their chunk's minimum.

    Chunks bound the window's partitions, so none grows with the dataset.
    """
    least = F.min("value").over(Window.partitionBy("chunk"))
    scale = float(10**digits)
    rows = frame.with_chunk().withColumn("low", least)
    offset = half_away(F.col("value") * scale - F.col("low") * scale)
    return frame._with(rows.withColumn("value", offset / scale + F.col("low")).drop("chunk", "low"))


def min_bits(frame: ArrayFrame, filled: bool = False) -> DataFrame:
    """chunk, min_value, minbits: bits that hold an integer chunk's offsets from its minimum, and a fill code if there is one."""
    span = F.col("high") - F.col("low") + (2 if filled else 1)
    found = frame.with_chunk().groupBy("chunk").agg(F.min("value").cast("long").alias("low"), F.max("value").cast("long").alias("high"))
    width = F.when(span <= 1, F.lit(0)).otherwise(F.length(F.bin(span - 1)))
    return found.select("chunk", F.col("low").alias("min_value"), width.cast("long").alias("minbits"))
