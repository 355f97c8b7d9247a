"""Joining hourly series into the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.functions.columns import resolve_column
from emberscope.functions.composites import (
    with_core_composites,
    with_engagement,
    with_engagement_composites,
)
from emberscope.operators.series import KEYS, relative_change, with_first_difference

# Output columns of the feature table, in order.
FEATURE_TABLE_COLUMNS = [
    "volume", "negative_rate", "stance_against_rate", "stance_favor_rate",
    "stance_neutral_rate", "delta_volume", "delta_negative_rate", "delta_against_rate",
    "delta_volume_rate", "sentiment_avg_score", "stance_against_mean", "stance_favor_mean",
    "stance_neutral_mean", "avg_engagement", "total_engagement", "max_engagement",
    "engagement_rate", "delta_engagement", "delta_engagement_rate", "avg_like_count",
    "avg_retweet_count", "avg_reply_count",
]
ZERO_FILLED = [
    "negative_rate", "stance_against_rate", "stance_favor_rate", "stance_neutral_rate",
    "stance_against_mean", "stance_favor_mean", "stance_neutral_mean",
]


def sentiment_input(series: DataFrame) -> DataFrame:
    """The four columns the feature table needs; ``time`` may name the key, score defaults to 0."""
    time = resolve_column(series, ["timestamp", "time"])
    score = F.col("avg_score") if "avg_score" in series.columns else F.lit(0.0)
    return series.select(
        "topic",
        F.col(time).alias("timestamp"),
        "count",
        score.alias("avg_score"),
        "negative_rate",
    )


def join_series(sentiment: DataFrame, stance: DataFrame) -> DataFrame:
    """Full outer join of the two hourly series on topic and hour."""
    return sentiment.join(stance, KEYS, "full_outer")


def with_deltas(df: DataFrame) -> DataFrame:
    out = with_first_difference(
        df,
        ["volume", "negative_rate", "stance_against_rate", "total_engagement"],
        {"stance_against_rate": "delta_against_rate", "total_engagement": "delta_engagement"},
    )
    return out.withColumns(
        {
            "delta_volume_rate": relative_change("volume"),
            "delta_engagement_rate": relative_change("total_engagement"),
        }
    )


def feature_table(joined: DataFrame) -> DataFrame:
    """Joined hourly evidence to the feature table, one row per topic and hour."""
    base = joined.withColumns(
        {
            "volume": F.coalesce(F.col("count"), F.lit(0)).cast("double"),
            "sentiment_avg_score": F.coalesce(F.col("avg_score"), F.lit(0.0)),
            **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in ZERO_FILLED},
        }
    )
    full = with_deltas(with_engagement(base))
    return full.select(
        *KEYS, *[F.col(c).cast("double").alias(c) for c in FEATURE_TABLE_COLUMNS]
    )


def with_model_features(features: DataFrame) -> DataFrame:
    """Composites used by the classifiers."""
    return with_engagement_composites(with_core_composites(features))


def add_dictionary_rates(features: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """Left join of dictionary rates; all zero when there is no dictionary series."""
    if dictionary is None:
        return features.withColumns(
            {"dict_negative_rate": F.lit(0.0), "dict_positive_rate": F.lit(0.0)}
        )
    rates = dictionary.select(*KEYS, "dict_negative_rate", "dict_positive_rate")
    return features.join(rates, KEYS, "left")


def add_engagement(features: DataFrame, engagement: DataFrame) -> DataFrame:
    """Left join of the engagement series on topic and hour."""
    keep = engagement.select(*KEYS, "total_engagement", "avg_engagement")
    return features.drop("total_engagement", "avg_engagement").join(keep, KEYS, "left")
