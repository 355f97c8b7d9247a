"""Scaling to zero mean and unit population deviation, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardise(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Scale with statistics of ``fitted_on`` (default: the same rows); constant columns are only centred."""
    source = df if fitted_on is None else fitted_on
    stats = source.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("s")
    ).scalar()
    scaled = df.withColumn("_stats", stats)
    unit = {
        c: (F.col(c) - F.col("_stats")[f"m_{c}"])
        / F.coalesce(F.nullif(F.col("_stats")[f"s_{c}"], F.lit(0.0)), F.lit(1.0))
        for c in columns
    }
    return scaled.withColumns(unit).drop("_stats")
