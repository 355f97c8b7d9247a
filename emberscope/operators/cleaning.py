"""Standardising raw posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.functions.text import flatten_lines
from emberscope.functions.times import parse_utc, to_local
from emberscope.schemas import COUNT_COLUMNS, RAW_TO_STANDARD


def rename_to_standard(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Standard column names in standard order; a missing source column is null."""
    present = set(raw.columns)
    columns = [
        (F.col(old) if old in present else F.lit(None).cast("string")).alias(new)
        for old, new in RAW_TO_STANDARD.items()
    ]
    return raw.select(*columns, *[F.col(k) for k in keep])


def to_count(value: Column) -> Column:
    """Unparsable or missing numbers become 0; fractions are truncated."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9.0e18)
    return F.when(usable, number.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def standardize_posts(raw: DataFrame, zone: str = "Asia/Tokyo", keep: Sequence[str] = ()) -> DataFrame:
    """Raw text columns to the standard post table, in local time of ``zone``."""
    out = rename_to_standard(raw, keep)
    return out.withColumns(
        {
            "timestamp": to_local(F.col("timestamp"), zone),
            **{c: to_count(F.col(c)) for c in COUNT_COLUMNS},
            "tweet_id": F.col("tweet_id").cast("string"),
            "content": flatten_lines(F.col("content")),
        }
    )


def drop_undated(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("timestamp").isNotNull())


def undated_count(posts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Posts in all and posts without a time; reads only the time column and those of ``by``."""
    return posts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("timestamp").isNull()).alias("undated")
    )


def strict_utc(df: DataFrame, column: str) -> DataFrame:
    """Timestamp text to UTC; text that cannot be read fails the job, null rows are dropped."""
    return df.withColumn(column, parse_utc(F.col(column), strict=True)).filter(F.col(column).isNotNull())


def lenient_utc(df: DataFrame, column: str) -> DataFrame:
    """Timestamp text to UTC; rows that cannot be read are dropped."""
    return df.withColumn(column, parse_utc(F.col(column))).filter(F.col(column).isNotNull())


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.na.fill(0, subset=present) if present else df


def between_times(df: DataFrame, start: Column | str, end: Column | str, column: str = "timestamp") -> DataFrame:
    """Rows inside a range closed on both ends; bare column and bounds, so it reaches the scan."""
    low = F.lit(start).cast("timestamp_ntz") if isinstance(start, str) else start
    high = F.lit(end).cast("timestamp_ntz") if isinstance(end, str) else end
    return df.filter(F.col(column).between(low, high))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of nulls, from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "null_count")


def as_double(df: DataFrame) -> DataFrame:
    """Cast every numeric column to double."""
    return df.withColumns(
        {
            f.name: F.col(f.name).cast("double")
            for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType)
        }
    )
