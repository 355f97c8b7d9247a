"""Queries: time series, joins, feature table, labels and ordered-series columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberscope.operators import features as feat
from emberscope.operators import labels as lab
from emberscope.operators import lexicon as lex
from emberscope.operators import reports as rep
from emberscope.operators import series as ser
from emberscope.plans.bindings import Tables
from emberscope.plans.registry import query

C = F.col
KEYS = ["topic", "timestamp"]

FEATURE_DOUBLES = [
    "volume", "negative_rate", "stance_against_rate", "stance_favor_rate", "stance_neutral_rate",
    "delta_volume", "delta_negative_rate", "delta_against_rate", "delta_volume_rate",
    "sentiment_avg_score", "stance_against_mean", "stance_favor_mean", "stance_neutral_mean",
    "avg_engagement", "total_engagement", "max_engagement", "engagement_rate",
    "delta_engagement", "delta_engagement_rate", "avg_like_count", "avg_retweet_count",
    "avg_reply_count",
]


@query(
    "flagship_flare_up_table",
    """SELECT topic, "timestamp", volume, negative_rate, stance_against_rate, delta_volume, delta_volume_rate,
              flame_score, is_controversy FROM labelled""",
    doubles=["volume", "negative_rate", "stance_against_rate", "delta_volume", "delta_volume_rate", "flame_score"],
)
def _flagship(t: Tables) -> DataFrame:
    out = t.labelled.select(
        *KEYS, "volume", "negative_rate", "stance_against_rate", "delta_volume",
        "delta_volume_rate", "flame_score", "is_controversy",
    )
    return out.orderBy(F.desc("flame_score"), "topic", "timestamp")


def _filled_counts_sql(minutes: int) -> str:
    return f"""SELECT g.topic, g."timestamp", coalesce(c.n, 0) AS "count" FROM (
          SELECT topic, unnest(generate_series(lo, hi, INTERVAL {minutes} MINUTE)) AS "timestamp" FROM (
            SELECT topic, time_bucket(INTERVAL {minutes} MINUTE, min("timestamp")) AS lo,
                   time_bucket(INTERVAL {minutes} MINUTE, max("timestamp")) AS hi FROM posts GROUP BY 1)) g
        LEFT JOIN (SELECT topic, time_bucket(INTERVAL {minutes} MINUTE, "timestamp") AS b, count(*) AS n
                   FROM posts GROUP BY 1, 2) c ON c.topic = g.topic AND c.b = g."timestamp" """


@query("a1_post_counts_1h", _filled_counts_sql(60))
def _a1(t: Tables) -> DataFrame:
    return ser.post_counts(t.posts, "1 hour")


@query("a1_post_counts_30m", _filled_counts_sql(30))
def _a1b(t: Tables) -> DataFrame:
    return ser.post_counts(t.posts, "30 minutes")


@query("a1_post_counts_10m", _filled_counts_sql(10))
def _a1c(t: Tables) -> DataFrame:
    return ser.post_counts(t.posts, "10 minutes")


@query(
    "a2_resolution_summary",
    " UNION ALL ".join(
        f"""SELECT topic, '{w}' AS width, count(*) AS windows, avg("count") AS mean_count, max("count") AS max_count,
                   min("count") AS min_count FROM ({_filled_counts_sql(m)}) GROUP BY 1"""
        for w, m in (("10 minutes", 10), ("30 minutes", 30), ("1 hour", 60))
    ),
    doubles=["mean_count"],
)
def _a2(t: Tables) -> DataFrame:
    return ser.resolution_summary(t.posts)


@query(
    "a2_resolution_summary_odd",
    " UNION ALL ".join(
        f"""SELECT topic, '{w}' AS width, count(*) AS windows, avg("count") AS mean_count, max("count") AS max_count,
                   min("count") AS min_count FROM ({_filled_counts_sql(m)}) GROUP BY 1"""
        for w, m in (("10 minutes", 10), ("15 minutes", 15), ("6 hours", 360))
    ),
    doubles=["mean_count"],
)
def _a2b(t: Tables) -> DataFrame:
    """Widths of which one does not divide another."""
    return ser.resolution_summary(t.posts, ("10 minutes", "15 minutes", "6 hours"))


@query(
    "a3_lexicon_series",
    """SELECT g.topic, g."timestamp", coalesce(s.n, 0) AS "count", s.avg_score, s.negative_rate
       FROM topic_hours g LEFT JOIN (
         SELECT topic, date_trunc('hour', "timestamp") AS b, count(sentiment_score) AS n, avg(sentiment_score) AS avg_score,
                avg(CASE WHEN is_negative THEN 1 ELSE 0 END) AS negative_rate FROM substring_posts GROUP BY 1, 2) s
       ON s.topic = g.topic AND s.b = g."timestamp" """,
    doubles=["avg_score", "negative_rate"],
)
def _a3(t: Tables) -> DataFrame:
    return ser.lexicon_series(t.substring_posts)


@query(
    "a4_hourly_sentiment",
    """SELECT topic, "timestamp", "count", positive_prob, neutral_prob, negative_prob FROM hourly_sentiment""",
    doubles=["positive_prob", "neutral_prob", "negative_prob"],
)
def _a4(t: Tables) -> DataFrame:
    return ser.hourly_sentiment(t.scored).select(*KEYS, "count", "positive_prob", "neutral_prob", "negative_prob")


@query(
    "a5_label_counts",
    """SELECT topic, "timestamp", positive_count, neutral_count, negative_count FROM hourly_sentiment""",
)
def _a5(t: Tables) -> DataFrame:
    return ser.hourly_sentiment(t.scored).select(*KEYS, "positive_count", "neutral_count", "negative_count")


@query(
    "a6_label_rates",
    """SELECT topic, "timestamp", positive_rate, neutral_rate, negative_rate, avg_score FROM hourly_sentiment""",
    doubles=["positive_rate", "neutral_rate", "negative_rate", "avg_score"],
)
def _a6(t: Tables) -> DataFrame:
    return ser.hourly_sentiment(t.scored).select(*KEYS, "positive_rate", "neutral_rate", "negative_rate", "avg_score")


@query(
    "a7_hourly_stance",
    """SELECT topic, "timestamp", stance_against_rate, stance_favor_rate, stance_neutral_rate, stance_against_mean,
              stance_favor_mean, stance_neutral_mean, stance_count FROM hourly_stance""",
    doubles=["stance_against_rate", "stance_favor_rate", "stance_neutral_rate", "stance_against_mean",
             "stance_favor_mean", "stance_neutral_mean"],
)
def _a7(t: Tables) -> DataFrame:
    cols = [f"stance_{s}_{k}" for k in ("rate", "mean") for s in ("against", "favor", "neutral")]
    return ser.hourly_stance(t.scored).select(*KEYS, *cols, "stance_count")


@query(
    "a8_hourly_engagement",
    """SELECT topic, "timestamp", avg_like_count, avg_retweet_count, avg_reply_count, max_like_count, max_retweet_count,
              max_reply_count, total_like_count, total_retweet_count, total_reply_count FROM hourly_stance""",
    doubles=["avg_like_count", "avg_retweet_count", "avg_reply_count"],
)
def _a8(t: Tables) -> DataFrame:
    return ser.by_window(t.posts).agg(*ser.engagement_aggregates())


def _dict_series_sql(bucket: str) -> str:
    return f"""SELECT topic, {bucket} AS "timestamp", count(*) AS volume,
               count(*) FILTER (WHERE sentiment = 'positive') AS dict_positive_count,
               count(*) FILTER (WHERE sentiment = 'negative') AS dict_negative_count,
               count(*) FILTER (WHERE sentiment = 'neutral') AS dict_neutral_count,
               avg(polarity) AS dict_avg_polarity,
               CAST(count(*) FILTER (WHERE sentiment = 'positive') AS DOUBLE) / count(*) AS dict_positive_rate,
               CAST(count(*) FILTER (WHERE sentiment = 'negative') AS DOUBLE) / count(*) AS dict_negative_rate,
               CAST(count(*) FILTER (WHERE sentiment = 'neutral') AS DOUBLE) / count(*) AS dict_neutral_rate
        FROM dict_posts GROUP BY 1, 2"""


DICT_DOUBLES = ["dict_avg_polarity", "dict_positive_rate", "dict_negative_rate", "dict_neutral_rate"]


@query("a9_dictionary_series_1h", _dict_series_sql("date_trunc('hour', \"timestamp\")"), doubles=DICT_DOUBLES)
def _a9(t: Tables) -> DataFrame:
    return ser.dictionary_series(t.dict_posts)


@query(
    "a9_dictionary_series_3h",
    _dict_series_sql("time_bucket(INTERVAL 3 HOUR, \"timestamp\", TIMESTAMP '2000-01-01 00:00:00')"),
    doubles=DICT_DOUBLES,
)
def _a9b(t: Tables) -> DataFrame:
    return ser.dictionary_series(t.dict_posts, "3 hours")


@query(
    "a9_dictionary_series_7h",
    _dict_series_sql("time_bucket(INTERVAL 7 HOUR, \"timestamp\", TIMESTAMP '2024-01-01 00:00:00')"),
    doubles=DICT_DOUBLES,
)
def _a9d(t: Tables) -> DataFrame:
    return ser.dictionary_series(t.dict_posts, "7 hours")


@query("a9_dictionary_series_1d", _dict_series_sql("date_trunc('day', \"timestamp\")"), doubles=DICT_DOUBLES)
def _a9c(t: Tables) -> DataFrame:
    return ser.dictionary_series(t.dict_posts, "1 day")


@query(
    "a10_scoring_series",
    """SELECT topic, "timestamp", volume, negative_rate, stance_favor_rate, stance_against_rate, stance_neutral_rate,
              delta_volume, delta_negative_rate, flame_score, against_count, sentiment_polarity FROM scoring_series""",
    doubles=["negative_rate", "stance_favor_rate", "stance_against_rate", "stance_neutral_rate", "delta_volume",
             "delta_negative_rate", "flame_score", "against_count", "sentiment_polarity"],
)
def _a10(t: Tables) -> DataFrame:
    return ser.scoring_series(t.analysed)


@query("a11_engagement_series", """SELECT * FROM engagement_series""", doubles=["avg_engagement"])
def _a11(t: Tables) -> DataFrame:
    return ser.engagement_series(t.posts)


@query("j1_outer_join_features", """SELECT * FROM features""", doubles=FEATURE_DOUBLES)
def _j1(t: Tables) -> DataFrame:
    sentiment = feat.sentiment_input(ser.hourly_sentiment(t.scored))
    return feat.feature_table(feat.join_series(sentiment, ser.hourly_stance(t.scored)))


@query("feature_table_one_pass", """SELECT * FROM features""", doubles=FEATURE_DOUBLES)
def _features(t: Tables) -> DataFrame:
    return t.features


@query(
    "s13_sentiment_input",
    """SELECT topic, "timestamp", "count", 0.0::DOUBLE AS avg_score, negative_rate FROM hourly_sentiment""",
    doubles=["avg_score", "negative_rate"],
)
def _s13(t: Tables) -> DataFrame:
    series = ser.hourly_sentiment(t.scored).withColumnRenamed("timestamp", "time").drop("avg_score")
    return feat.sentiment_input(series)


@query(
    "j2_left_join_dictionary",
    """SELECT f.topic, f."timestamp", f.volume, d.dict_negative_rate, d.dict_positive_rate
       FROM features f LEFT JOIN dict_series d ON d.topic = f.topic AND d."timestamp" = f."timestamp" """,
    doubles=["volume", "dict_negative_rate", "dict_positive_rate"],
)
def _j2(t: Tables) -> DataFrame:
    base = t.features.select(*KEYS, "volume")
    return feat.add_dictionary_rates(base, ser.dictionary_series(t.dict_posts))


@query(
    "j2_dictionary_absent",
    """SELECT topic, "timestamp", volume, 0.0::DOUBLE AS dict_negative_rate, 0.0::DOUBLE AS dict_positive_rate FROM features""",
    doubles=["volume", "dict_negative_rate", "dict_positive_rate"],
)
def _j2b(t: Tables) -> DataFrame:
    return feat.add_dictionary_rates(t.features.select(*KEYS, "volume"), None)


@query(
    "j3_left_join_engagement",
    """SELECT f.topic, f."timestamp", f.volume, e.total_engagement, e.avg_engagement
       FROM features f LEFT JOIN engagement_series e ON e.topic = f.topic AND e."timestamp" = f."timestamp" """,
    doubles=["volume", "avg_engagement"],
)
def _j3(t: Tables) -> DataFrame:
    return feat.add_engagement(t.features.select(*KEYS, "volume"), ser.engagement_series(t.posts))


@query("j5_interval_labels", """SELECT topic, "timestamp", volume, is_controversy FROM labelled""")
def _j5(t: Tables) -> DataFrame:
    return t.labelled.select(*KEYS, "volume", "is_controversy")


@query("j5_interval_labels_by_day", """SELECT topic, "timestamp", volume, is_controversy FROM labelled""")
def _j5b(t: Tables) -> DataFrame:
    """Intervals cut into days beforehand, so neighbours touch at midnight, give the same labels."""
    days = F.explode(F.sequence(F.to_date("start"), F.to_date("end"), F.expr("INTERVAL '1 day'")))
    cut = t.intervals.withColumn("day", days).select(
        "topic", F.greatest("start", C("day").cast("timestamp_ntz")).alias("start"),
        F.least("end", F.date_add("day", 1).cast("timestamp_ntz")).alias("end"),
    )
    return lab.apply_intervals(t.composites, cut).select(*KEYS, "volume", "is_controversy")


@query(
    "j5_interval_labels_zoned",
    """SELECT c.topic, c."timestamp", CASE WHEN EXISTS (SELECT 1 FROM intervals i WHERE i.topic = c.topic
            AND c."timestamp" BETWEEN i."start" - INTERVAL 9 HOUR AND i."end" - INTERVAL 9 HOUR) THEN 1 ELSE 0 END AS is_controversy
       FROM features c""",
)
def _j5c(t: Tables) -> DataFrame:
    out = lab.apply_intervals(t.features.select(*KEYS), t.intervals, interval_zone="Asia/Tokyo")
    return out.select(*KEYS, "is_controversy")


RAW_PERIODS_SQL = """SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS "position",
              CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "start",
              CASE WHEN event_id % 7 = 0 THEN NULL
                   ELSE strftime(ts + to_hours(CAST(event_id % 11 - 3 AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS "end",
              CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'l' || event_id END AS "label",
              CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'd' END AS description FROM events"""


@query("s11_usable_intervals", f"""SELECT topic, "start", "end", coalesce("label", 'period_' || "position") AS "label",
        coalesce(description, '') AS description FROM (SELECT * REPLACE (try_cast("start" AS TIMESTAMP) AS "start",
        try_cast("end" AS TIMESTAMP) AS "end") FROM ({RAW_PERIODS_SQL})) WHERE "start" <= "end" """)
def _s11(t: Tables) -> DataFrame:
    """A label table of one text row per event, with gaps, unreadable and inverted bounds."""
    id_ = C("event_id")
    stamp = "yyyy-MM-dd HH:mm:ss"
    raw = t.events.select(
        C("event_type").alias("topic"),
        F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("position"),
        F.when(id_ % 5 == 0, None).when(id_ % 5 == 1, "soon").otherwise(F.date_format("ts", stamp)).alias("start"),
        F.when(id_ % 7 != 0, F.date_format(F.timestamp_add("HOUR", (id_ % 11 - 3).cast("int"), C("ts")), stamp)).alias("end"),
        F.when(id_ % 3 != 0, F.concat(F.lit("l"), id_.cast("string"))).alias("label"),
        F.when(id_ % 4 != 0, "d").alias("description"),
    )
    return lab.usable_intervals(raw)


@query(
    "j8_label_count_lookup",
    """SELECT h.topic, h."timestamp", coalesce(l.n, 0) AS negative_count
       FROM (SELECT DISTINCT topic, date_trunc('hour', "timestamp") AS "timestamp" FROM scored) h
       LEFT JOIN (SELECT topic, date_trunc('hour', "timestamp") AS b, count(*) AS n FROM scored
                  WHERE bert_label = 'NEGATIVE' GROUP BY 1, 2) l ON l.topic = h.topic AND l.b = h."timestamp" """,
)
def _j8(t: Tables) -> DataFrame:
    return ser.by_window(t.scored).agg(F.count_if(C("bert_label") == "NEGATIVE").alias("negative_count"))


@query(
    "j6_substring_score",
    "SELECT doc_id, sentiment_score FROM doc_substring",
)
def _j6(t: Tables) -> DataFrame:
    return t.doc_substring


@query("j6_substring_score_grams", "SELECT doc_id, sentiment_score FROM doc_substring")
def _j6b(t: Tables) -> DataFrame:
    """The lookup used for lexicons too long for one test per word."""
    scored = lex.substring_score(t.doc_texts, t.substring_lexicon, "text", contains_words=0)
    return scored.select("doc_id", "sentiment_score")


@query("j6_substring_score_join", "SELECT doc_id, sentiment_score FROM doc_substring")
def _j6c(t: Tables) -> DataFrame:
    """The index used for lexicons too large for literals."""
    docs = t.doc_texts
    scored = lex.substring_score(docs, t.substring_lexicon, "text", contains_words=0, inline_words=0)
    return scored.select("doc_id", "sentiment_score")


@query(
    "j7_token_join",
    "SELECT doc_id, positive_score, negative_score, word_count FROM doc_hits",
    doubles=["positive_score", "negative_score"],
)
def _j7(t: Tables) -> DataFrame:
    """The join used for lexicons too large for literals."""
    docs = t.doc_texts
    out = lex.token_weights(docs, t.lexicon, "text", inline_words=0)
    return out.drop("text")


@query(
    "j7_token_literals",
    "SELECT doc_id, positive_score, negative_score, word_count FROM doc_hits",
    doubles=["positive_score", "negative_score"],
)
def _j7b(t: Tables) -> DataFrame:
    out = lex.token_weights(t.doc_texts, t.lexicon, "text")
    return out.drop("text")




@query(
    "s10_lexicon_last_wins",
    """SELECT word, polarity FROM (
         SELECT word, polarity, row_number() OVER (PARTITION BY word ORDER BY line_no DESC) AS rn FROM (
           SELECT lang AS word, CASE WHEN n_chars > 1000 THEN 1 ELSE -1 END AS polarity, doc_id AS line_no FROM documents)) WHERE rn = 1""",
)
def _s10(t: Tables) -> DataFrame:
    lines = t.documents.select(
        C("lang").alias("word"),
        F.when(C("n_chars") > 1000, 1).otherwise(-1).alias("polarity"),
        C("doc_id").alias("line_no"),
    )
    return lex.last_duplicate_wins(lines)


@query(
    "a21_top_terms",
    """WITH k AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(
            replace(replace(replace(regexp_replace(regexp_replace(text, 'http[^\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{Z}]+', '', 'g'),
            '@[A-Za-z0-9_]+', '', 'g'), 'RT ', ''), chr(10), ' '), chr(9), ' '), '[\\p{L}\\p{N}_]+'), lambda x, i: {'w': x, 'i': i})) AS s FROM documents)
       SELECT word, "count" FROM (SELECT s.w AS word, count(*) AS "count", min(CAST(doc_id AS HUGEINT) * 1000000000 + s.i) AS f FROM k GROUP BY 1)
       ORDER BY "count" DESC, f LIMIT 30""",
)
def _a21(t: Tables) -> DataFrame:
    return lex.top_terms(t.doc_texts, 30, text="text", order="doc_id")


@query(
    "m28_default_sentiment",
    "SELECT tweet_id, bert_label, bert_positive, bert_neutral, bert_negative FROM scored",
    doubles=["bert_positive", "bert_neutral", "bert_negative"],
)
def _m28(t: Tables) -> DataFrame:
    return t.scored.select("tweet_id", "bert_label", "bert_positive", "bert_neutral", "bert_negative")


@query(
    "w1_first_difference",
    """SELECT topic, "timestamp", delta_volume, delta_negative_rate, delta_against_rate, delta_engagement FROM features""",
    doubles=["delta_volume", "delta_negative_rate", "delta_against_rate", "delta_engagement"],
)
def _w1(t: Tables) -> DataFrame:
    return t.features.select(*KEYS, "delta_volume", "delta_negative_rate", "delta_against_rate", "delta_engagement")


@query(
    "w2_relative_change",
    """SELECT topic, "timestamp", delta_volume_rate, delta_engagement_rate FROM features""",
    doubles=["delta_volume_rate", "delta_engagement_rate"],
)
def _w2(t: Tables) -> DataFrame:
    return t.features.select(*KEYS, "delta_volume_rate", "delta_engagement_rate")


@query(
    "w3_relative_change_eps",
    """SELECT topic, "timestamp", (volume - p) / (p + 1e-6) AS delta_volume_rate FROM (
         SELECT topic, "timestamp", volume, coalesce(lag(volume) OVER (PARTITION BY topic ORDER BY "timestamp"), volume) AS p FROM features)""",
    doubles=["delta_volume_rate"],
)
def _w3(t: Tables) -> DataFrame:
    return t.features.select(*KEYS, ser.relative_change_eps("volume").alias("delta_volume_rate"))


@query(
    "w4_close_windows",
    """SELECT topic, period, min("timestamp") AS "start", max("timestamp") AS "end", count(*) AS windows FROM (
         SELECT topic, "timestamp", CAST(sum(n) OVER (PARTITION BY topic ORDER BY "timestamp") AS BIGINT) AS period FROM (
           SELECT topic, "timestamp", CASE WHEN date_diff('second', lag("timestamp") OVER (PARTITION BY topic ORDER BY "timestamp"), "timestamp") <= 7200
                  THEN 0 ELSE 1 END AS n FROM features WHERE volume >= 4)) GROUP BY 1, 2""",
)
def _w4(t: Tables) -> DataFrame:
    return ser.join_close_windows(t.features.filter("volume >= 4").select(*KEYS), 7200)


BEST_SQL = """SELECT topic, controversy_score, rn FROM (
      SELECT topic, controversy_score, row_number() OVER (PARTITION BY topic ORDER BY controversy_score DESC, "timestamp") AS rn
      FROM controversy WHERE controversy_score > 0) WHERE rn <= 20"""


@query(
    "w4_suggested_periods",
    f"""SELECT topic, period, min("timestamp") AS "start", max("timestamp") AS "end", count(*) AS windows FROM (
         SELECT topic, "timestamp", CAST(sum(n) OVER (PARTITION BY topic ORDER BY "timestamp") AS BIGINT) AS period FROM (
           SELECT c.topic, c."timestamp", CASE WHEN date_diff('second', lag(c."timestamp") OVER (PARTITION BY c.topic ORDER BY c."timestamp"), c."timestamp") <= 7200
                  THEN 0 ELSE 1 END AS n
           FROM controversy c JOIN (SELECT topic, quantile_cont(controversy_score, 0.5) AS cut FROM ({BEST_SQL}) GROUP BY 1) q
                ON q.topic = c.topic WHERE c.controversy_score > q.cut)) GROUP BY 1, 2""",
)
def _w4b(t: Tables) -> DataFrame:
    return lab.suggested_periods(t.features)


@query(
    "w5_z_score",
    """SELECT topic, "timestamp", CASE WHEN s > 0 THEN (volume - m) / s ELSE 0 END AS volume_spike_ratio
       FROM features, (SELECT avg(volume) AS m, stddev_samp(volume) AS s FROM features)""",
    doubles=["volume_spike_ratio"],
)
def _w5(t: Tables) -> DataFrame:
    return ser.with_z_score(t.features).select(*KEYS, "volume_spike_ratio")


@query(
    "w6_mean_plus_two_sd",
    """SELECT topic, avg(volume) AS mean_value, stddev_samp(volume) AS sd_value,
              avg(volume) + 2 * stddev_samp(volume) AS threshold FROM features GROUP BY 1""",
    doubles=["mean_value", "sd_value", "threshold"],
)
def _w6(t: Tables) -> DataFrame:
    return ser.topic_thresholds(t.features)


@query(
    "w7_controversy_score",
    """SELECT topic, "timestamp", controversy_score FROM controversy""",
    doubles=["controversy_score"],
)
def _w7(t: Tables) -> DataFrame:
    return ser.with_controversy_score(t.features).select(*KEYS, "controversy_score")


@query(
    "w10_latest_window",
    """SELECT topic, "timestamp", volume, flame_score FROM (
         SELECT *, row_number() OVER (PARTITION BY topic ORDER BY "timestamp" DESC) AS rn FROM composites) WHERE rn = 1""",
    doubles=["volume", "flame_score"],
)
def _w10(t: Tables) -> DataFrame:
    return ser.latest_window(t.composites.select(*KEYS, "volume", "flame_score"))


@query(
    "w11_label_encoding",
    """SELECT tweet_id, topic, dense_rank() OVER (ORDER BY coalesce(topic, 'unknown')) - 1 AS topic_encoded FROM posts""",
)
def _w11(t: Tables) -> DataFrame:
    return ser.with_encoded(t.posts).select("tweet_id", "topic", "topic_encoded")


@query(
    "w11_encode_unseen",
    """SELECT tweet_id, CASE topic WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END AS topic_encoded
       FROM posts""",
)
def _w11b(t: Tables) -> DataFrame:
    codes = ser.encoder(t.posts.filter("topic <> 'error'"))
    out = ser.encode_with(t.posts, codes)
    return out.select("tweet_id", C("topic_encoded").cast("int").alias("topic_encoded"))


@query(
    "a24_top_score_median",
    f"""SELECT topic, quantile_cont(controversy_score, 0.5) AS cut FROM ({BEST_SQL}) GROUP BY 1""",
    doubles=["cut"],
)
def _a24(t: Tables) -> DataFrame:
    return lab.top_score_median(ser.with_controversy_score(t.features))


@query("t1_sort_by_time", """SELECT topic, "timestamp", volume FROM features""")
def _t1(t: Tables) -> DataFrame:
    return t.features.select(*KEYS, "volume").orderBy("timestamp", "topic")


@query(
    "t2_first_alerts",
    """SELECT topic, rule, "timestamp", position FROM (
         SELECT topic, rule, "timestamp", row_number() OVER (PARTITION BY topic, rule ORDER BY "timestamp") AS position FROM (
           SELECT f.topic, f."timestamp", 'high_volume' AS rule FROM features f JOIN s ON s.topic = f.topic WHERE f.volume > m + 2 * sd
           UNION ALL SELECT topic, "timestamp", 'high_negative' FROM features WHERE negative_rate >= 0.7
           UNION ALL SELECT topic, "timestamp", 'high_against' FROM features WHERE stance_against_rate >= 0.5
           UNION ALL SELECT f.topic, f."timestamp", 'rapid_rise' FROM features f JOIN s ON s.topic = f.topic
                     WHERE f.delta_volume > 0 AND f.volume > m)) WHERE position <= 10""".replace(
        "SELECT topic, rule, \"timestamp\", position FROM (",
        "WITH s AS (SELECT topic, avg(volume) AS m, stddev_samp(volume) AS sd FROM features GROUP BY 1) SELECT topic, rule, \"timestamp\", position FROM (",
        1,
    ),
)
def _t2(t: Tables) -> DataFrame:
    return rep.first_alerts(t.features)


@query(
    "t3_top_scores",
    """SELECT topic, "timestamp", controversy_score FROM controversy WHERE controversy_score > 0
       ORDER BY round(controversy_score, 9) DESC, topic, "timestamp" LIMIT 20""",
    doubles=["controversy_score"],
)
def _t3(t: Tables) -> DataFrame:
    scored = ser.with_controversy_score(t.features).filter("controversy_score > 0")
    return (
        scored.select(*KEYS, "controversy_score")
        .orderBy(F.desc(F.round("controversy_score", 9)), "topic", "timestamp")
        .limit(20)
    )


