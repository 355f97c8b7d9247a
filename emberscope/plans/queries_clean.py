"""Queries: cleaning, filters, text functions and de-duplication."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.functions import columns as col
from emberscope.functions import composites as comp
from emberscope.functions import scores as sc
from emberscope.functions import text as tx
from emberscope.functions import times as tm
from emberscope.operators import cleaning as cl
from emberscope.operators import dedupe as dd
from emberscope.operators import features as feat
from emberscope.operators import lexicon as lex
from emberscope.operators import reports as rep
from emberscope.operators import series as ser
from emberscope.plans.bindings import Tables
from emberscope.plans.registry import query
from emberscope.schemas import EXTENDED_FEATURES
from emberscope.sources import posts as src

C = F.col


def raw_posts(t: Tables) -> DataFrame:
    """Posts as raw text columns with the faults the clean-up handles.

    ``url`` is left out on purpose; times alternate between ``Z``, naive and
    unreadable text, and some counts are not numbers.
    """
    k = C("like_count")
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return t.text_posts.select(
        F.when(k < 10, F.lit("unknown")).when(k < 50, iso).otherwise(stamp).alias("date"),
        F.when(k != 20, C("tweet_id")).alias("id"),
        "content",
        C("user_id").alias("user"),
        F.concat(F.lit("user "), "user_id").alias("user_displayname"),
        F.when(k < 20, F.lit("abc")).otherwise(C("reply_count").cast("string")).alias("reply_count"),
        F.concat(C("retweet_count").cast("string"), F.lit(".9")).alias("retweet_count"),
        F.when(k < 90, k.cast("string")).alias("like_count"),
        "topic",
        "row_pos",
    )


RAW_SQL = """SELECT CASE WHEN like_count < 10 THEN 'unknown'
                  WHEN like_count < 50 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(millisecond("timestamp") % 1000 AS VARCHAR), 3, '0') || 'Z'
                  ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS "date",
             CASE WHEN like_count <> 20 THEN tweet_id END AS id, d.text AS content, user_id AS "user",
             'user ' || user_id AS user_displayname,
             CASE WHEN like_count < 20 THEN 'abc' ELSE CAST(reply_count AS VARCHAR) END AS reply_count,
             CAST(retweet_count AS VARCHAR) || '.9' AS retweet_count,
             CASE WHEN like_count < 90 THEN CAST(like_count AS VARCHAR) END AS like_count, topic, row_pos
      FROM posts p LEFT JOIN documents d ON d.doc_id = p.doc_id"""
STAMP_SQL = """CASE WHEN "date" LIKE '%Z' THEN try_cast(replace(replace("date", 'T', ' '), 'Z', '') AS TIMESTAMP)
                    ELSE try_cast("date" AS TIMESTAMP) END"""


@query(
    "p1_rename_to_standard",
    f"""SELECT "date" AS "timestamp", id AS tweet_id, CAST(NULL AS VARCHAR) AS url, md5(content) AS content_md5,
               "user" AS user_id, user_displayname AS user_name, reply_count, retweet_count, like_count
        FROM ({RAW_SQL})""",
)
def _p1(t: Tables) -> DataFrame:
    out = cl.rename_to_standard(raw_posts(t))
    return out.withColumn("content_md5", F.md5("content")).drop("content")


@query(
    "p2_numeric_coercion",
    f"""SELECT row_pos, coalesce(CAST(trunc(try_cast(reply_count AS DOUBLE)) AS BIGINT), 0) AS reply_count,
               coalesce(CAST(trunc(try_cast(retweet_count AS DOUBLE)) AS BIGINT), 0) AS retweet_count,
               coalesce(CAST(trunc(try_cast(like_count AS DOUBLE)) AS BIGINT), 0) AS like_count FROM ({RAW_SQL})""",
)
def _p2(t: Tables) -> DataFrame:
    names = ("reply_count", "retweet_count", "like_count")
    return raw_posts(t).select("row_pos", *[cl.to_count(C(n)).alias(n) for n in names])


@query("p3_id_as_text", "SELECT CAST(event_id AS VARCHAR) AS tweet_id, event_type AS topic FROM events")
def _p3(t: Tables) -> DataFrame:
    return t.events.select(C("event_id").cast("string").alias("tweet_id"), C("event_type").alias("topic"))


@query(
    "p4_flatten_text",
    """SELECT doc_id, md5(replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), '')) AS flat_md5 FROM documents""",
)
def _p4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.flatten_lines(C("text"))).alias("flat_md5"))


@query(
    "p5_to_local_time",
    f"""SELECT row_pos, {STAMP_SQL} + INTERVAL 9 HOUR AS local_time FROM ({RAW_SQL})""",
)
def _p5(t: Tables) -> DataFrame:
    return raw_posts(t).select("row_pos", tm.to_local(C("date")).alias("local_time"))


@query(
    "p6_drop_undated",
    f"""SELECT row_pos, {STAMP_SQL} + INTERVAL 9 HOUR AS "timestamp" FROM ({RAW_SQL}) WHERE {STAMP_SQL} IS NOT NULL""",
)
def _p6(t: Tables) -> DataFrame:
    dated = raw_posts(t).select("row_pos", tm.to_local(C("date")).alias("timestamp"))
    return cl.drop_undated(dated)


@query(
    "p6_undated_count",
    f"""SELECT count(*) AS n, count(*) FILTER (WHERE {STAMP_SQL} IS NULL) AS undated FROM ({RAW_SQL})""",
)
def _p6b(t: Tables) -> DataFrame:
    return cl.undated_count(raw_posts(t).select(tm.to_local(C("date")).alias("timestamp")))


@query("p7_strict_utc", """SELECT event_id, ts AS utc_time FROM events WHERE ts IS NOT NULL""")
def _p7(t: Tables) -> DataFrame:
    text = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS'Z'").alias("utc_time"))
    return cl.strict_utc(text, "utc_time")


@query(
    "p8_lenient_utc",
    f"""SELECT row_pos, {STAMP_SQL} AS "date" FROM ({RAW_SQL}) WHERE {STAMP_SQL} IS NOT NULL""",
)
def _p8(t: Tables) -> DataFrame:
    return cl.lenient_utc(raw_posts(t).select("row_pos", "date"), "date")


@query("p9_resolve_text_column", "SELECT doc_id, length(text) AS n_chars FROM documents")
def _p9(t: Tables) -> DataFrame:
    name = col.resolve_column(t.documents, ["content", "text", "body", "tweet"], fall_back_to_first=True)
    return t.documents.select("doc_id", F.char_length(name).cast("bigint").alias("n_chars"))


@query(
    "p10_resolve_time_column",
    """SELECT min("timestamp") AS first_time, max("timestamp") AS last_time FROM posts""",
)
def _p10(t: Tables) -> DataFrame:
    name = col.resolve_column(t.posts, ["created_at", "date", "timestamp"])
    return t.posts.agg(F.min(name).alias("first_time"), F.max(name).alias("last_time"))


@query("p11_required_columns", "SELECT topic, count(*) AS n FROM posts GROUP BY 1")
def _p11(t: Tables) -> DataFrame:
    checked = col.require_columns(t.posts, ["timestamp", "topic", "tweet_id"])
    return checked.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p12_time_range",
    """SELECT event_id, event_type, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-10 23:00:00'""",
)
def _p12(t: Tables) -> DataFrame:
    rows = cl.between_times(t.events, "2024-01-05 00:00:00", "2024-01-10 23:00:00", "ts")
    return rows.select("event_id", "event_type", "ts")


@query(
    "p13_dates_and_hours",
    """SELECT DISTINCT strftime("timestamp", '%Y-%m-%d') AS "date", CAST(hour("timestamp") AS BIGINT) AS "hour" FROM posts""",
)
def _p13(t: Tables) -> DataFrame:
    return rep.dates_and_hours(t.posts)


@query(
    "p14_alert_filters",
    """SELECT f.topic, f."timestamp", f.volume,
              CAST(coalesce(f.volume > m + 2 * s, FALSE) AS INTEGER) AS high_volume,
              CAST(f.negative_rate >= 0.7 AS INTEGER) AS high_negative,
              CAST(f.stance_against_rate >= 0.5 AS INTEGER) AS high_against,
              CAST(f.delta_volume > 0 AND f.volume > m AS INTEGER) AS rapid_rise
       FROM features f JOIN (SELECT topic, avg(volume) AS m, stddev_samp(volume) AS s FROM features GROUP BY 1) q
            ON q.topic = f.topic""",
)
def _p14(t: Tables) -> DataFrame:
    return rep.with_alerts(t.features).select("topic", "timestamp", "volume", *rep.ALERT_RULES)


@query(
    "p15_numeric_columns",
    """SELECT topic, volume, negative_rate, stance_against_rate, stance_favor_rate, stance_neutral_rate, delta_volume
       FROM (SELECT topic, "timestamp", volume, negative_rate, stance_against_rate, stance_favor_rate,
                    stance_neutral_rate, delta_volume FROM features)""",
    doubles=["negative_rate", "stance_against_rate", "stance_favor_rate", "stance_neutral_rate", "delta_volume", "volume"],
)
def _p15(t: Tables) -> DataFrame:
    table = t.features.select(
        "topic", "timestamp", "volume", "negative_rate", "stance_against_rate",
        "stance_favor_rate", "stance_neutral_rate", "delta_volume",
    )
    return table.select("topic", *col.numeric_columns(table, exclude=["is_controversy"]))


@query(
    "p16_feature_projection",
    """SELECT topic, "timestamp", volume, delta_volume, negative_rate, delta_negative_rate, stance_favor_rate,
              stance_against_rate, stance_neutral_rate, flame_score, against_count, sentiment_polarity FROM composites""",
    doubles=["volume", "delta_volume", "negative_rate", "delta_negative_rate", "stance_favor_rate",
             "stance_against_rate", "stance_neutral_rate", "flame_score", "against_count", "sentiment_polarity"],
)
def _p16(t: Tables) -> DataFrame:
    return col.select_features(t.composites, EXTENDED_FEATURES, keep=["topic", "timestamp"])


@query(
    "p17_zero_fill",
    """SELECT topic, "timestamp", coalesce(negative_rate, 0) AS negative_rate,
              coalesce(stance_against_rate, 0) AS stance_against_rate, flame_score FROM scoring_series""",
    doubles=["negative_rate", "stance_against_rate", "flame_score"],
)
def _p17(t: Tables) -> DataFrame:
    series = ser.scoring_series(t.analysed)
    filled = cl.fill_zero(series, ["negative_rate", "stance_against_rate", "absent_column"])
    return filled.select("topic", "timestamp", "negative_rate", "stance_against_rate", "flame_score")


@query("p18_negative_flag", "SELECT tweet_id, sentiment_score, is_negative FROM substring_posts")
def _p18(t: Tables) -> DataFrame:
    return t.substring_posts.select("tweet_id", "sentiment_score", "is_negative")


@query("p19_class_filter", """SELECT topic, "timestamp", volume FROM labelled WHERE is_controversy = 1""")
def _p19(t: Tables) -> DataFrame:
    return t.labelled.filter("is_controversy = 1").select("topic", "timestamp", "volume")


@query(
    "p20_default_scores",
    """SELECT tweet_id, 'NEUTRAL' AS stance_label, 0.33::DOUBLE AS stance_favor, 0.33::DOUBLE AS stance_against,
              0.34::DOUBLE AS stance_neutral FROM posts""",
)
def _p20(t: Tables) -> DataFrame:
    from emberscope.operators.scoring import with_default_stance

    return with_default_stance(t.posts).select(
        "tweet_id", "stance_label", "stance_favor", "stance_against", "stance_neutral"
    )


URL_SQL = tx.URL_PATTERN
SPACE_SQL = f"[{tx.SPACE}]+"


@query(
    "f1_clean_for_terms",
    f"""SELECT doc_id, md5(replace(replace(replace(regexp_replace(regexp_replace(text, '{tx.LOOSE_URL_PATTERN}', '', 'g'),
               '{tx.ASCII_MENTION_PATTERN}', '', 'g'), 'RT ', ''), chr(10), ' '), chr(9), ' ')) AS clean_md5 FROM documents""",
)
def _f1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.clean_for_terms(C("text"))).alias("clean_md5"))


@query(
    "f2_clean_for_lexicon",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{tx.URL_PATTERN}', '', 'g'),
               '{tx.MENTION_PATTERN}', '', 'g'), '{tx.HASHTAG_PATTERN}', '', 'g')) AS clean_md5 FROM documents""",
)
def _f2(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.clean_for_lexicon(C("text"))).alias("clean_md5"))


@query(
    "f3_collapse_spaces",
    f"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{SPACE_SQL}', ' ', 'g'))) AS clean_md5 FROM documents""",
)
def _f3(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.collapse_spaces(C("text"))).alias("clean_md5"))


@query(
    "f4_tokenize",
    f"""SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, md5(array_to_string(k, ' ')) AS tokens_md5
        FROM (SELECT doc_id, regexp_extract_all(text, '{tx.TOKEN_PATTERN}') AS k FROM documents)""",
)
def _f4(t: Tables) -> DataFrame:
    tokens = t.documents.select("doc_id", tx.tokenize(C("text")).alias("k"))
    return tokens.select(
        "doc_id", F.size("k").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("k", " ")).alias("tokens_md5"),
    )


@query(
    "f5_discretise_polarity",
    """SELECT row_pos, CASE WHEN g > 0.5 THEN 1 ELSE -1 END AS polarity
       FROM (SELECT row_pos, (like_count - 50) / 50.0::DOUBLE AS g FROM posts) WHERE g > 0.5 OR g < -0.5""",
)
def _f5(t: Tables) -> DataFrame:
    graded = t.posts.select("row_pos", ((C("like_count") - 50) / F.lit(50.0)).alias("polarity"))
    return lex.discretised(graded)


@query(
    "f6_token_polarity",
    "SELECT doc_id, positive_score, negative_score, polarity, sentiment, word_count FROM doc_polarity",
    doubles=["positive_score", "negative_score", "polarity"],
)
def _f6(t: Tables) -> DataFrame:
    return t.doc_polarity.drop("has_text")


@query(
    "f7_softmax",
    "SELECT doc_id, bert_positive, bert_neutral, bert_negative FROM doc_sentiment",
    doubles=["bert_positive", "bert_neutral", "bert_negative"],
)
def _f7(t: Tables) -> DataFrame:
    return t.doc_sentiment.select("doc_id", "bert_positive", "bert_neutral", "bert_negative")


@query("f8_argmax_label", "SELECT doc_id, bert_label FROM doc_sentiment")
def _f8(t: Tables) -> DataFrame:
    return t.doc_sentiment.select("doc_id", "bert_label")


@query(
    "f9_threshold_label",
    """SELECT doc_id, CASE WHEN bert_negative >= 0.4 THEN 'NEGATIVE' WHEN bert_positive >= 0.4 THEN 'POSITIVE'
              ELSE 'NEUTRAL' END AS label FROM doc_sentiment""",
)
def _f9(t: Tables) -> DataFrame:
    label = sc.threshold_label(C("bert_negative"), C("bert_positive"))
    return t.doc_sentiment.select("doc_id", label.alias("label"))


@query("f10_hour_floor", "SELECT event_id, date_trunc('hour', ts) AS \"hour\" FROM events")
def _f10(t: Tables) -> DataFrame:
    return t.events.select("event_id", tm.bin_start(C("ts"), "1 hour").alias("hour"))


@query(
    "f11_zone_format",
    """SELECT event_id, strftime(date_trunc('hour', ts) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || '+09:00' AS local_hour FROM events""",
)
def _f11(t: Tables) -> DataFrame:
    local = tm.from_utc(tm.hour_floor(C("ts")), "Asia/Tokyo")
    return t.events.select("event_id", tm.format_with_offset(local).alias("local_hour"))


@query(
    "f12_core_composites",
    """SELECT topic, "timestamp", flame_score, against_count, sentiment_polarity FROM composites""",
    doubles=["flame_score", "against_count", "sentiment_polarity"],
)
def _f12(t: Tables) -> DataFrame:
    return comp.with_core_composites(t.features).select(
        "topic", "timestamp", "flame_score", "against_count", "sentiment_polarity"
    )


@query(
    "f13_fallback_composites",
    """SELECT topic, "timestamp", -negative_rate AS sentiment_avg_score, stance_against_rate AS stance_against_mean,
              stance_favor_rate AS stance_favor_mean, stance_neutral_rate AS stance_neutral_mean FROM features""",
    doubles=["sentiment_avg_score", "stance_against_mean", "stance_favor_mean", "stance_neutral_mean"],
)
def _f13(t: Tables) -> DataFrame:
    bare = t.features.drop("sentiment_avg_score", "stance_against_mean", "stance_favor_mean", "stance_neutral_mean")
    return comp.with_fallbacks(bare).select(
        "topic", "timestamp", "sentiment_avg_score", "stance_against_mean", "stance_favor_mean", "stance_neutral_mean"
    )


@query(
    "f14_engagement_composites",
    """SELECT topic, "timestamp", avg_engagement, total_engagement, max_engagement, engagement_rate FROM features""",
    doubles=["avg_engagement", "total_engagement", "max_engagement", "engagement_rate"],
)
def _f14(t: Tables) -> DataFrame:
    hourly = ser.hourly_stance(t.scored).withColumn("volume", C("stance_count"))
    out = comp.with_engagement(hourly).select(
        "topic", "timestamp", "avg_engagement", "total_engagement", "max_engagement", "engagement_rate"
    )
    return cl.as_double(out)


@query(
    "f15_engagement_by_stance",
    """SELECT topic, "timestamp", flame_engagement_score, against_engagement_score FROM composites""",
    doubles=["flame_engagement_score", "against_engagement_score"],
)
def _f15(t: Tables) -> DataFrame:
    return comp.with_engagement_composites(t.features).select(
        "topic", "timestamp", "flame_engagement_score", "against_engagement_score"
    )


@query(
    "f16_logs",
    """SELECT topic, "timestamp", ln(1 + negative_rate * 100) AS negative_rate_log, ln(1 + volume) AS volume_log FROM features""",
    doubles=["negative_rate_log", "volume_log"],
)
def _f16(t: Tables) -> DataFrame:
    return comp.with_logs(t.features).select("topic", "timestamp", "negative_rate_log", "volume_log")


@query(
    "f17_high_flags",
    """SELECT topic, "timestamp", CAST(volume >= 5 AS INTEGER) AS is_high_volume,
              CAST(negative_rate >= 0.2 AS INTEGER) AS is_high_negative,
              CAST(volume >= 5 AND negative_rate >= 0.2 AS INTEGER) AS is_both_high FROM features""",
)
def _f17(t: Tables) -> DataFrame:
    return comp.with_high_flags(t.features, volume_min=5).select(
        "topic", "timestamp", "is_high_volume", "is_high_negative", "is_both_high"
    )


@query(
    "f18_spread_features",
    """SELECT topic, "timestamp", negative_rate * coalesce(total_engagement, 0) AS negative_engagement,
              negative_rate * volume AS negative_engagement_fallback,
              stance_favor_rate * stance_against_rate AS polarization,
              delta_negative_rate * volume AS negative_momentum FROM features""",
    doubles=["negative_engagement", "negative_engagement_fallback", "polarization", "negative_momentum"],
)
def _f18(t: Tables) -> DataFrame:
    fallback = comp.with_spread_features(t.features.drop("total_engagement"))
    keep = fallback.withColumnRenamed("negative_engagement", "negative_engagement_fallback")
    joined = comp.with_spread_features(
        keep.drop("polarization", "negative_momentum").join(
            t.features.select("topic", "timestamp", "total_engagement"), ["topic", "timestamp"]
        )
    )
    return joined.select(
        "topic", "timestamp", "negative_engagement", "negative_engagement_fallback", "polarization", "negative_momentum"
    )


@query(
    "f19_dictionary_composites",
    """SELECT f.topic, f."timestamp", f.volume * d.dict_negative_rate AS dict_flame_score,
              ln(1 + d.dict_negative_rate * 100) AS dict_negative_rate_log,
              CAST(d.dict_negative_rate >= 0.2 AS INTEGER) AS is_dict_high_negative,
              CAST(f.volume >= 5 AND d.dict_negative_rate >= 0.2 AS INTEGER) AS is_both_dict_high,
              coalesce(d.dict_negative_rate - lag(d.dict_negative_rate) OVER (PARTITION BY f.topic ORDER BY f."timestamp"), 0) AS delta_dict_negative_rate
       FROM features f LEFT JOIN dict_series d ON d.topic = f.topic AND d."timestamp" = f."timestamp" """,
    doubles=["dict_flame_score", "dict_negative_rate_log", "delta_dict_negative_rate"],
)
def _f19(t: Tables) -> DataFrame:
    joined = feat.add_dictionary_rates(t.features, ser.dictionary_series(t.dict_posts))
    out = comp.with_dictionary_composites(joined, volume_min=5)
    out = ser.with_first_difference(out, ["dict_negative_rate"])
    return out.select(
        "topic", "timestamp", "dict_flame_score", "dict_negative_rate_log", "is_dict_high_negative",
        "is_both_dict_high", "delta_dict_negative_rate",
    )


LEVEL_SQL = """CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium'
                    WHEN score >= 20 THEN 'low' ELSE 'normal' END"""


@query(
    "f20_score_bands",
    f"""SELECT model, topic, "timestamp", score, {LEVEL_SQL} AS level FROM (
          SELECT model, topic, "timestamp", CAST(trunc(probability * 100) AS INTEGER) AS score FROM rules)""",
)
def _f20(t: Tables) -> DataFrame:
    scored = t.rules.withColumn("score", sc.percent_score(C("probability")))
    return scored.select("model", "topic", "timestamp", "score", sc.score_level(C("score")).alias("level"))


@query(
    "f21_alert_class",
    """SELECT model, topic, "timestamp", CASE WHEN score >= 60 THEN 'warning' WHEN score >= 40 THEN 'caution' ELSE 'calm' END AS alert
       FROM (SELECT model, topic, "timestamp", trunc(probability * 100) AS score FROM rules)""",
)
def _f21(t: Tables) -> DataFrame:
    score = sc.percent_score(C("probability"))
    return t.rules.select("model", "topic", "timestamp", sc.alert_class(score).alias("alert"))


@query(
    "f22_topic_prefixed_text",
    """SELECT tweet_id, md5(topic || ' [SEP] ' || coalesce(d.text, '')) AS input_md5
       FROM posts p LEFT JOIN documents d ON d.doc_id = p.doc_id""",
)
def _f22(t: Tables) -> DataFrame:
    return t.text_posts.select("tweet_id", F.md5(tx.topic_prefixed(C("topic"), C("content"))).alias("input_md5"))


@query(
    "f23_interval_bounds",
    """SELECT topic, CAST(lo AS TIMESTAMP) + INTERVAL 5 HOUR AS "start",
              CAST(hi AS TIMESTAMP) + INTERVAL 23 HOUR AS end_open, CAST(lo AS TIMESTAMP) + INTERVAL 12 HOUR AS end_set
       FROM (SELECT topic, CAST(min("timestamp") AS DATE) AS lo, CAST(max("timestamp") AS DATE) AS hi FROM posts GROUP BY 1)""",
)
def _f23(t: Tables) -> DataFrame:
    days = t.posts.groupBy("topic").agg(
        F.to_date(F.min("timestamp")).alias("lo"), F.to_date(F.max("timestamp")).alias("hi")
    )
    none = F.lit(None)
    return days.select(
        "topic",
        tm.interval_start(C("lo"), F.lit(5)).alias("start"),
        tm.interval_end(none.cast("date"), none.cast("int"), C("hi")).alias("end_open"),
        tm.interval_end(C("lo"), F.lit(12), C("hi")).alias("end_set"),
    )


@query(
    "f24_percent_format",
    """SELECT model, round(f1 * 100, 2) AS f1_percent, round(accuracy * 100, 2) AS accuracy_percent FROM model_metrics""",
)
def _f24(t: Tables) -> DataFrame:
    from emberscope.operators.metrics import binary_metrics

    m = binary_metrics(t.rules, ["model"])
    return m.select(
        "model", F.round(C("f1") * 100, 2).alias("f1_percent"),
        F.round(C("accuracy") * 100, 2).alias("accuracy_percent"),
    )


@query("f25_virtual_engagement")
def _f25(t: Tables) -> DataFrame:
    key = F.concat_ws("|", "topic", C("timestamp").cast("string"))
    out = comp.with_virtual_engagement(t.composites, key)
    return out.select("topic", "timestamp", "flame_score", "volume", "avg_engagement", "total_engagement", "engagement_rate")


def two_files(t: Tables) -> DataFrame:
    """Every post twice, as if collected into two files; some have no id."""
    base = t.posts.withColumn("tweet_id", F.when(C("like_count") > 0, C("tweet_id")))
    return base.withColumn("source_file", F.lit("a.csv")).unionByName(
        base.withColumn("source_file", F.lit("b.csv"))
    )


TWO_FILES_SQL = """SELECT CASE WHEN like_count > 0 THEN tweet_id END AS tweet_id, row_pos, topic, "timestamp", doc_id, f.source_file
      FROM posts, (VALUES ('a.csv'), ('b.csv')) AS f(source_file)"""


@query(
    "a17_dedupe_ids",
    f"""SELECT tweet_id, topic, "timestamp", source_file FROM (
          SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY source_file, row_pos) AS rn FROM ({TWO_FILES_SQL})) WHERE rn = 1""",
)
def _a17(t: Tables) -> DataFrame:
    return dd.dedupe_posts(two_files(t)).select("tweet_id", "topic", "timestamp", "source_file")


@query(
    "a17_removed_count",
    f"""SELECT count(*) AS rows_before, count(DISTINCT coalesce(tweet_id, 'none')) AS rows_after,
               count(*) - count(DISTINCT coalesce(tweet_id, 'none')) AS rows_removed FROM ({TWO_FILES_SQL})""",
)
def _a17b(t: Tables) -> DataFrame:
    return dd.removed_count(two_files(t), ["tweet_id"])


@query(
    "a18_dedupe_content",
    """SELECT md5(content) AS content_md5, tweet_id, topic FROM (
         SELECT d.text AS content, p.tweet_id, p.topic,
                row_number() OVER (PARTITION BY d.text ORDER BY p.row_pos) AS rn
         FROM posts p LEFT JOIN documents d ON d.doc_id = p.doc_id) WHERE rn = 1""",
)
def _a18(t: Tables) -> DataFrame:
    # The digest is taken where posts meet their text; of the text itself, nothing is left to shuffle with the rows.
    posts = t.text_posts.select("content", F.md5("content").alias("content_md5"), "tweet_id", "topic", "row_pos")
    kept = dd.dedupe_content(posts, order=["row_pos"])
    return kept.select("content_md5", "tweet_id", "topic")


@query(
    "a19_merge_hourly",
    """SELECT topic, "timestamp", "count", source_file FROM (
         SELECT topic, "timestamp", "count", source_file,
                row_number() OVER (PARTITION BY topic, "timestamp" ORDER BY source_file) AS rn
         FROM (SELECT topic, "timestamp", "count", 'a' AS source_file FROM hourly_sentiment WHERE "count" > 1
               UNION ALL SELECT topic, "timestamp", "count" * 10, 'b' FROM hourly_sentiment)) WHERE rn = 1""",
)
def _a19(t: Tables) -> DataFrame:
    hourly = ser.hourly_sentiment(t.scored).select("topic", "timestamp", "count")
    both = hourly.filter("count > 1").withColumn("source_file", F.lit("a")).unionByName(
        hourly.select("topic", "timestamp", (C("count") * 10).alias("count"), F.lit("b").alias("source_file"))
    )
    return dd.merge_hourly(both)


@query(
    "s7_query_from_file_name",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '_extra' WHEN event_id % 3 = 1 THEN 'tweets_2024'
              ELSE 'raw_' || event_type END AS query_name FROM events""",
)
def _s7(t: Tables) -> DataFrame:
    third = C("event_id") % 3
    name = (
        F.when(third == 0, F.concat(F.lit("tweets_"), "event_type", F.lit("_20240101_extra_1234.csv")))
        .when(third == 1, F.lit("tweets_2024.csv"))
        .otherwise(F.concat(F.lit("raw_"), "event_type", F.lit(".csv")))
    )
    return t.events.select("event_id", src.query_from_file_name(name).alias("query_name"))


@query(
    "s8_topic_from_path",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'unknown' ELSE event_type END AS topic_name FROM events""",
)
def _s8(t: Tables) -> DataFrame:
    kind = C("event_id") % 4
    path = (
        F.when(kind == 0, F.concat(F.lit("data/original/"), "event_type", F.lit("/part.csv")))
        .when(kind == 1, F.concat(F.lit("/x/outputs/"), "event_type", F.lit("/y.csv")))
        .when(kind == 2, F.concat(F.lit("data/processed/"), "event_type", F.lit("_2024_sentiment_1h.csv")))
        .otherwise(F.lit("data/original/20240101.csv"))
    )
    return t.events.select("event_id", src.topic_from_path(path).alias("topic_name"))


PIECE_CHARACTERS = 1 << 18


def pieces(texts: pd.Series, characters: int = PIECE_CHARACTERS) -> Iterator[pd.Series]:
    """The texts in order, in runs that end with the text that brings them to ``characters``; null has none.

    A word as a Python string takes some sixty bytes, so the words of a whole Arrow batch are many times its size.
    """
    before = texts.fillna("").str.len().cumsum().shift(fill_value=0) // characters
    for _, piece in texts.groupby(before.to_numpy(), sort=False):
        yield piece


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_tokenizer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A user-supplied tokenizer: set up once per task, then fed Arrow batches, whose words leave piece by piece."""
    pattern = re.compile(r"\w+")
    for texts in batches:
        for piece in pieces(texts):
            yield piece.map(lambda s: pattern.findall(s or ""))


@query(
    "d5_tokenizer_plugin",
    "SELECT doc_id, positive_score, negative_score, word_count FROM doc_hits",
    doubles=["positive_score", "negative_score"],
)
def _d5(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    return lex.token_weights(docs, t.lexicon, "text", tokenizer=word_tokenizer).drop("text")
