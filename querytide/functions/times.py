"""Integer time arithmetic. Times are epoch seconds unless a caller uses a finer clock throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("bigint")


def floor_to(time: Column, width: int) -> Column:
    """Largest multiple of `width` that is not after `time`."""
    return time - F.pmod(time, F.lit(width).cast("bigint"))


def ceil_to(time: Column, width: int) -> Column:
    """Smallest multiple of `width` that is not before `time`."""
    return time + F.pmod(-time, F.lit(width).cast("bigint"))


def cell(time: Column, width: int) -> Column:
    """Number of the `width`-long cell that holds `time`."""
    return F.call_function("div", floor_to(time, width), F.lit(width).cast("bigint"))


def bucket_start(time: Column, bucket: int) -> Column:
    return floor_to(time, bucket)


def slot(time: Column, bucket: int, slots: int) -> Column:
    """Position of the time's bucket in a ring of `slots` buckets."""
    return F.pmod(cell(time, bucket), F.lit(slots).cast("bigint"))


def rfc3339(time: Column) -> Column:
    """UTC text with as many fraction digits as the value needs. The session time zone must be UTC."""
    micros = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(micros, r"\.?0+$", ""), F.lit("Z"))
