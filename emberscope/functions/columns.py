"""Plan-time helpers for choosing and checking columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve_column(df: DataFrame, candidates: Sequence[str], fall_back_to_first: bool = False) -> str:
    """Name of the first candidate present in ``df``."""
    present = set(df.columns)
    for name in candidates:
        if name in present:
            return name
    if fall_back_to_first and df.columns:
        return df.columns[0]
    raise ValueError(f"none of {list(candidates)} found in {df.columns}")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail while the plan is built when a required column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns of ``df`` in schema order, without the excluded ones."""
    skip = set(exclude)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and infinities become 0."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; null when the denominator is zero or either side is null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def share(condition: Column, total: Column | None = None) -> Column:
    """Aggregate: rows meeting ``condition`` over ``total`` (all rows by default)."""
    return ratio(F.count_if(condition), F.count(F.lit(1)) if total is None else total)


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep the features that exist, cleaned to finite doubles, beside ``keep``."""
    present = set(df.columns)
    return df.select(
        *[F.col(k) for k in keep],
        *[finite_or_zero(F.col(f)).alias(f) for f in features if f in present],
    )
