"""Tolerant casts: what cannot be read becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidates for the one format of a date column, tried in this order on its first value.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy-MM", "MMM yyyy")


def to_number(c: Column) -> Column:
    """Text or number to double; unreadable and NaN are NULL."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def date_format_of(df: DataFrame, column: str) -> str | None:
    """The first format that reads the column's first non-null value (of the smallest value, so that reruns agree); None for other types."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return None
    tries = [F.when(F.try_to_timestamp(F.trim(F.col("v")), F.lit(f)).isNotNull(), F.lit(f)) for f in DATE_FORMATS]
    return df.agg(F.min(column).alias("v")).select(F.coalesce(*tries)).first()[0]


def to_date(df: DataFrame, column: str, fmt: str | None) -> Column:
    """A zone-less timestamp; unreadable values are NULL. Numbers are epoch nanoseconds, as dates and timestamps are taken as they are."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.trim(c), F.lit(fmt or DATE_FORMATS[0])).cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        return F.timestamp_micros((c / 1000).cast("long")).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def normalized(c: Column) -> Column:
    """Trimmed, lower-cased, without blanks, underscores, hyphens, dots and slashes."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-./]+", "")


def clipped(c: Column, least: float = 0.0) -> Column:
    """At least `least`; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(least)))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def band(c: Column, bands: tuple[tuple[float, str], ...], missing: str = "unknown") -> Column:
    """The label of the first band that the value does not exceed."""
    value = finite(c)
    out = F.when(value.isNull(), missing)
    for high, label in bands:
        out = out.when(value <= high, label)
    return out
