"""Composite feature columns.

Each function adds columns to a table with one row per topic and window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.functions.columns import ratio_or_zero
from emberscope.schemas import HIGH_NEGATIVE, HIGH_VOLUME


def flame_score(volume: Column, negative_rate: Column) -> Column:
    return volume * negative_rate


def against_count(volume: Column, against_rate: Column) -> Column:
    return volume * against_rate


def sentiment_polarity(against_rate: Column, favor_rate: Column) -> Column:
    return against_rate - favor_rate


def with_core_composites(df: DataFrame) -> DataFrame:
    """Flame score, critical post count and stance polarity; existing columns stay."""
    c = F.col
    wanted = {
        "flame_score": lambda: flame_score(c("volume"), c("negative_rate")),
        "against_count": lambda: against_count(c("volume"), c("stance_against_rate")),
        "sentiment_polarity": lambda: sentiment_polarity(
            c("stance_against_rate"), c("stance_favor_rate")
        ),
    }
    return df.withColumns({k: f() for k, f in wanted.items() if k not in df.columns})


def with_fallbacks(df: DataFrame) -> DataFrame:
    """Fill in sentiment score and stance means from what the table has."""
    cols = set(df.columns)
    extra: dict[str, Column] = {}
    if "sentiment_avg_score" not in cols:
        extra["sentiment_avg_score"] = (
            F.col("sentiment_score") if "sentiment_score" in cols else -F.col("negative_rate")
        )
    for side in ("against", "favor", "neutral"):
        if f"stance_{side}_mean" not in cols:
            extra[f"stance_{side}_mean"] = F.col(f"stance_{side}_rate")
    return df.withColumns(extra) if extra else df


def with_engagement(df: DataFrame) -> DataFrame:
    """Average, total, maximum and per-post engagement from like, repost and reply columns.

    Sums stay null when a side is missing; only the rate is filled with 0.
    """
    c = F.col
    kinds = ("like", "retweet", "reply")
    if "avg_like_count" not in df.columns:
        return df.withColumns(
            {n: F.lit(0.0) for n in
             ("avg_engagement", "total_engagement", "max_engagement", "engagement_rate")}
        )
    total = c("total_like_count") + c("total_retweet_count") + c("total_reply_count")
    return df.withColumns(
        {
            "avg_engagement": c("avg_like_count") + c("avg_retweet_count") + c("avg_reply_count"),
            "total_engagement": total,
            "max_engagement": F.greatest(*[c(f"max_{k}_count") for k in kinds]),
            "engagement_rate": ratio_or_zero(total, c("volume")),
        }
    )


def with_engagement_composites(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "flame_engagement_score": c("total_engagement") * c("negative_rate"),
            "against_engagement_score": c("total_engagement") * c("stance_against_rate"),
        }
    )


def with_logs(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.withColumns(
        {
            f"{prefix}negative_rate_log": F.log1p(F.col(f"{prefix}negative_rate") * 100),
            "volume_log": F.log1p(F.col("volume")),
        }
    )


def with_high_flags(
    df: DataFrame,
    volume_min: float = HIGH_VOLUME,
    negative_min: float = HIGH_NEGATIVE,
    dictionary: bool = False,
) -> DataFrame:
    """0/1 flags for high volume, high negativity and both."""
    tag, rate = ("dict_", "dict_negative_rate") if dictionary else ("", "negative_rate")
    busy = F.col("volume") >= volume_min
    bad = F.col(rate) >= negative_min
    return df.withColumns(
        {
            "is_high_volume": busy.cast("int"),
            f"is_{tag}high_negative": bad.cast("int"),
            f"is_both_{tag}high": (busy & bad).cast("int"),
        }
    )


def with_dictionary_composites(
    df: DataFrame, volume_min: float = HIGH_VOLUME, negative_min: float = HIGH_NEGATIVE
) -> DataFrame:
    """Flame score, logs and flags computed from the dictionary rate."""
    out = df.withColumn("dict_flame_score", F.col("volume") * F.col("dict_negative_rate"))
    return with_high_flags(with_logs(out, "dict_"), volume_min, negative_min, dictionary=True)


def with_spread_features(df: DataFrame) -> DataFrame:
    """Negative engagement (volume stands in when engagement is absent), polarization, momentum."""
    c = F.col
    if "total_engagement" in df.columns:
        reach = F.coalesce(c("total_engagement"), F.lit(0.0))
    else:
        reach = c("volume")
    return df.withColumns(
        {
            "negative_engagement": c("negative_rate") * reach,
            "polarization": c("stance_favor_rate") * c("stance_against_rate"),
            "negative_momentum": c("delta_negative_rate") * c("volume"),
        }
    )


def with_virtual_engagement(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """Reproducible stand-in engagement for ablations on data without counts.

    A hash of the row key gives the factor in [0.5, 1.5), so the value does not
    depend on row order or partitioning.
    """
    c = F.col
    unit = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    out = df.withColumn("avg_engagement", c("flame_score") * (unit + 0.5))
    out = out.withColumn("total_engagement", c("avg_engagement") * c("volume"))
    out = out.withColumn("engagement_rate", c("total_engagement") / (c("volume") + 1))
    return with_engagement_composites(out)
