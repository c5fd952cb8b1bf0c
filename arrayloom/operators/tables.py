"""MATLAB's table-like values on DataFrames: timetables, categoricals, datetimes, durations, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regular_times(df: DataFrame, ordinal: str, start_ms: float, step_ms: float, name: str = "row_time_ms") -> DataFrame:
    """A regular timetable's row times, by arithmetic on the row's ordinal."""
    return df.withColumn(name, F.lit(float(start_ms)) + F.col(ordinal) * F.lit(float(step_ms)))


def categorical_labels(code: Column, categories: list[str]) -> Column:
    """Category names of 1-based codes; 0 is undefined and null."""
    names = F.array(*[F.lit(c) for c in categories])
    return F.when((code >= 1) & (code <= len(categories)), F.try_element_at(names, code.cast("int")))


def datetime_nanoseconds(millis: Column, sub_ms: Column | None = None) -> Column:
    """Nanoseconds since 1970 of a time held as milliseconds and the rest below them."""
    return (millis + (F.coalesce(sub_ms, F.lit(0.0)) if sub_ms is not None else F.lit(0.0))) * 1e6


def duration_seconds(millis: Column) -> Column:
    return millis / 1000


def to_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map from keys to values; keys must differ. For maps that fit a row."""
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("map"))
