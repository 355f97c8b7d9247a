"""Schemas and fixed values shared by the stages."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names, feature lists, thresholds and labels that must
# equal the published ones for results to match.
# ---------------------------------------------------------------------------
RAW_POST_COLUMNS = [
    "date", "id", "url", "content", "user", "user_displayname",
    "reply_count", "retweet_count", "like_count",
]
RAW_TO_STANDARD = {
    "date": "timestamp",
    "id": "tweet_id",
    "url": "url",
    "content": "content",
    "user": "user_id",
    "user_displayname": "user_name",
    "reply_count": "reply_count",
    "retweet_count": "retweet_count",
    "like_count": "like_count",
}
COUNT_COLUMNS = ["reply_count", "retweet_count", "like_count"]

FEATURES_10 = [
    "volume", "negative_rate", "stance_against_rate", "stance_favor_rate",
    "stance_neutral_rate", "delta_volume", "delta_volume_rate", "flame_score",
    "against_count", "sentiment_polarity",
]
ADDED_FEATURES = [
    "delta_negative_rate", "delta_against_rate", "sentiment_avg_score",
    "stance_against_mean", "stance_favor_mean", "stance_neutral_mean",
]
FEATURES_16 = FEATURES_10 + ADDED_FEATURES
FEATURES_14 = FEATURES_16  # published under this number, with ten features and six added ones
FEATURES_17 = FEATURES_16 + ["topic_encoded"]
ENGAGEMENT_FEATURES = [
    "avg_engagement", "total_engagement", "engagement_rate",
    "flame_engagement_score", "against_engagement_score",
]
ENGAGEMENT_BASE = [
    "volume", "negative_rate", "stance_against_rate", "stance_favor_rate",
    "stance_neutral_rate", "delta_volume", "delta_volume_rate",
]
BASE_FEATURES = [
    "volume", "delta_volume", "negative_rate", "delta_negative_rate",
    "stance_favor_rate", "stance_against_rate", "stance_neutral_rate",
]
EXTENDED_FEATURES = BASE_FEATURES + [
    "flame_score", "against_count", "negative_rate_log", "volume_log",
    "sentiment_polarity", "is_high_volume", "is_high_negative", "is_both_high",
]
NEW_FEATURES = [
    "negative_engagement", "volume_spike_ratio", "polarization", "negative_momentum",
]
OPTIMIZED_FEATURES = BASE_FEATURES + ["flame_score", "against_count", "sentiment_polarity"]
OPTIMIZED_WITH_NEW = OPTIMIZED_FEATURES + [
    "negative_engagement", "negative_momentum", "polarization",
]
WITHOUT_STANCE_FEATURES = [
    "volume", "delta_volume", "negative_rate", "delta_negative_rate", "flame_score",
    "negative_rate_log", "volume_log", "is_high_volume", "is_high_negative", "is_both_high",
]
DICT_FEATURES = [
    "volume", "delta_volume", "dict_negative_rate", "delta_dict_negative_rate",
    "stance_favor_rate", "stance_against_rate", "stance_neutral_rate",
    "dict_flame_score", "against_count", "dict_negative_rate_log", "volume_log",
    "sentiment_polarity", "is_high_volume", "is_dict_high_negative", "is_both_dict_high",
]
BERT_AND_DICT_FEATURES = [
    "volume", "delta_volume", "negative_rate", "delta_negative_rate", "flame_score",
    "negative_rate_log", "is_high_negative", "dict_negative_rate",
    "delta_dict_negative_rate", "dict_flame_score", "dict_negative_rate_log",
    "is_dict_high_negative", "stance_favor_rate", "stance_against_rate",
    "stance_neutral_rate", "against_count", "volume_log", "sentiment_polarity",
    "is_high_volume", "is_both_high", "is_both_dict_high",
]
FEATURE_SETS = {
    "base": BASE_FEATURES,
    "extended": EXTENDED_FEATURES,
    "extended_new": EXTENDED_FEATURES + NEW_FEATURES,
    "optimized": OPTIMIZED_FEATURES,
    "optimized_new": OPTIMIZED_WITH_NEW,
}
SENTIMENT_FEATURE_SETS = {
    "bert_only": EXTENDED_FEATURES,
    "dict_only": DICT_FEATURES,
    "bert_and_dict": BERT_AND_DICT_FEATURES,
}
ENGAGEMENT_FEATURE_SETS = {
    "base_7": ENGAGEMENT_BASE,
    "extended_10": ENGAGEMENT_BASE + ["flame_score", "against_count", "sentiment_polarity"],
    "engagement_15": ENGAGEMENT_BASE + ["flame_score", "against_count", "sentiment_polarity"] + ENGAGEMENT_FEATURES,
}
STANCE_FEATURE_SETS = {
    "with_stance": EXTENDED_FEATURES,
    "without_stance": WITHOUT_STANCE_FEATURES,
}
FEATURE_CATEGORIES = {
    "volume": "時系列",
    "delta_volume": "差分",
    "delta_volume_rate": "差分",
    "negative_rate": "感情",
    "sentiment_score": "感情",
    "sentiment_polarity": "感情",
    "sentiment_avg_score": "感情",
    "stance_against_rate": "立場",
    "stance_favor_rate": "立場",
    "stance_neutral_rate": "立場",
    "stance_against_mean": "立場",
    "stance_favor_mean": "立場",
    "stance_neutral_mean": "立場",
    "delta_against_rate": "差分",
    "delta_negative_rate": "差分",
    "avg_engagement": "エンゲージ",
    "total_engagement": "エンゲージ",
    "engagement_rate": "エンゲージ",
    "flame_score": "複合",
    "against_count": "立場",
}
DEFAULT_CATEGORY = "その他"
FILE_SUFFIXES = [
    "_sentiment_1h", "_sentiment_30m", "_sentiment_10m", "_stance", "_analyzed",
    "_bert", "_feature_table",
]
HEADER_KEYS = {"query": "検索クエリ", "collected_at": "取得日時", "original_count": "取得件数"}
TEXT_CANDIDATES = ["content", "text", "body", "tweet"]
TIME_CANDIDATES = ["timestamp", "created_at", "date"]
SCORE_BANDS = [(80, "critical"), (60, "high"), (40, "medium"), (20, "low")]
LOWEST_BAND = "normal"
ALERT_BANDS = [(60, "warning"), (40, "caution")]
LOWEST_ALERT = "calm"
DEFAULT_SENTIMENT = {"positive": 0.33, "neutral": 0.34, "negative": 0.33}
DEFAULT_STANCE = {"favor": 0.33, "against": 0.33, "neutral": 0.34}
HIGH_VOLUME = 50
HIGH_NEGATIVE = 0.2
POLARITY_CUT = 0.5
TOKEN_CLASS_CUT = 0.1
PERIOD_GAP_SECONDS = 7200
TOP_TERMS = 30

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
RAW_POST_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_POST_COLUMNS])

STANDARD_POST_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("tweet_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("reply_count", T.LongType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("like_count", T.LongType()),
    ]
)

LEXICON_SCHEMA = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("polarity", T.DoubleType())]
)

INTERVAL_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("start", T.TimestampNTZType()),
        T.StructField("end", T.TimestampNTZType()),
        T.StructField("label", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
