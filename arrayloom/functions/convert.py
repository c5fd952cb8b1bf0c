"""Numeric conversion between element types, as column expressions.

Integers saturate, floats are cut towards zero and saturate, NaN becomes 0, and doubles round to the
nearest float. Spark's own casts raise or wrap in these cases, so values are clamped first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatchError

#: Element types and the Spark type that holds each without loss (fixed values).
ELEMENTS = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(),
}


def bits(element: str) -> int:
    return int(element[1:])


def limits(element: str) -> tuple[int, int]:
    """Least and greatest value of an integer type."""
    n = bits(element)
    return (0, (1 << n) - 1) if element[0] == "u" else (-(1 << n - 1), (1 << n - 1) - 1)


def _wide(value: int) -> Column:
    return F.lit(value).cast("long") if -(1 << 63) <= value < 1 << 63 else F.lit(str(value)).cast("decimal(20,0)")


def convert(column: Column, source: str, target: str) -> Column:
    """column, of the element type source, as the element type target."""
    if source not in ELEMENTS or target not in ELEMENTS:
        raise TypeMismatchError(f"no conversion from {source} to {target}")
    to = ELEMENTS[target]
    if source == target:
        return column.cast(to)
    if target[0] == "f":
        return column.cast("double").cast(to) if source == "u64" else column.cast(to)
    low, high = limits(target)
    if source[0] == "f":
        x = column.cast("double")
        # The bounds are powers of two, exact as doubles; at or beyond them the limit itself is meant.
        inside = F.when(x >= float(high + 1), F.lit(0.0)).when(x <= float(low) - (1.0 if bits(target) < 53 else 0.0), F.lit(0.0)).when(F.isnan(x), F.lit(0.0)).otherwise(x)
        whole = F.when(inside < 0, F.ceil(inside)).otherwise(F.floor(inside)) if bits(target) < 64 else _whole64(inside, target)
        clamped = F.when(column.isNull(), F.lit(None)).when(F.isnan(x), F.lit(0).cast(to)).when(x >= float(high + 1), _wide(high).cast(to)).when(x <= float(low) - (1.0 if bits(target) < 53 else 0.0), _wide(low).cast(to))
        return clamped.otherwise(whole.cast(to)).cast(to)
    have_low, have_high = limits(source)
    value = column.cast("decimal(20,0)") if source == "u64" else column
    if have_low < low:
        value = F.greatest(value, _wide(low).cast("decimal(20,0)") if source == "u64" else _wide(low))
    if have_high > high:
        value = F.least(value, _wide(high).cast("decimal(20,0)") if source == "u64" else _wide(high))
    return F.when(column.isNull(), F.lit(None)).otherwise(value).cast(to)


def _whole64(x: Column, target: str) -> Column:
    """A double within a 64-bit type's limits, cut towards zero."""
    if target == "i64":
        return x.cast("long")
    half = float(1 << 63)
    upper = (x - half).cast("long").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(x >= half, upper).otherwise(F.when(x < half, x).otherwise(F.lit(0.0)).cast("long").cast("decimal(20,0)"))


def fixed_string(column: Column, padding: str) -> Column:
    """A fixed-length string's value: up to the first null ('nullterm'), without trailing nulls ('nullpad') or blanks ('spacepad')."""
    if padding == "nullterm":
        return F.substring_index(column, "\0", 1)
    if padding == "nullpad":
        return F.rtrim(column, F.lit("\0"))
    if padding == "spacepad":
        return F.rtrim(column, F.lit(" "))
    raise TypeMismatchError(f"no padding {padding}")


def enum_labels(column: Column, members: dict[str, int]) -> Column:
    """The member name of each code, null for a code without one."""
    pairs = [x for name, code in members.items() for x in (F.lit(code), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), column.cast("int"))


def enum_codes(column: Column, members: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[x for name, code in members.items() for x in (F.lit(name), F.lit(code))]), column)
