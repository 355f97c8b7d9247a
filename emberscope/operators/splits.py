"""Stratified hold-out, folds and hold-one-topic-out parts.

All are functions of the row key alone, so they do not change with
partitioning, retries or row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.operators.sizing import hash_rank


def stratified_split(
    df: DataFrame, label: str = "is_controversy", keys: Sequence[str] = ("topic", "timestamp"), test_share: float = 0.2
) -> DataFrame:
    """Mark ``ceil(share * n)`` rows of each label as test rows; rows without a label are a group of their own."""
    ranked = hash_rank(df, keys, by=[label])
    sizes = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * test_share).alias("_cut"))
    sizes = sizes.withColumnRenamed(label, "_label")
    return (
        ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
        .withColumn("is_test", (F.col("rank") <= F.col("_cut")).cast("int"))
        .drop("rank", "_cut", "_label")
    )


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = "is_controversy", keys: Sequence[str] = ("topic", "timestamp")
) -> DataFrame:
    """Fold number 0..k-1, dealt out within each label."""
    ranked = hash_rank(df, keys, by=[label], salt="fold")
    return ranked.withColumn("fold", F.pmod(F.col("rank"), F.lit(k)).cast("int")).drop("rank")


def hold_out_topic(df: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Training rows (other topics) and test rows (this topic)."""
    return df.filter(F.col("topic") != topic), df.filter(F.col("topic") == topic)
