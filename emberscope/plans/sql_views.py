"""The same derived views as SQL, for checking plans against another engine."""

from __future__ import annotations

import re

from emberscope.functions.text import HASHTAG_PATTERN, MENTION_PATTERN, TOKEN_PATTERN, URL_PATTERN
from emberscope.plans.constants import (
    EVAL_MODELS,
    INTERVALS,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    SUBSTRING_LEXICON,
)


def _in_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _values(rows: list[tuple]) -> str:
    def one(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


CLEAN = (
    f"regexp_replace(regexp_replace(regexp_replace(text, '{URL_PATTERN}', '', 'g'), "
    f"'{MENTION_PATTERN}', '', 'g'), '{HASHTAG_PATTERN}', '', 'g')"
)

DELTA = "coalesce({x} - lag({x}) OVER w, 0)"
CHANGE = "coalesce(({x} - lag({x}) OVER w) / nullif(lag({x}) OVER w, 0), 0)"

VIEWS: dict[str, str] = {
    "posts": """
        SELECT CAST(event_id AS VARCHAR) AS tweet_id, event_id AS row_pos, ts AS "timestamp",
               event_type AS topic, CAST(user_id AS VARCHAR) AS user_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS like_count,
               CAST(floor("value") AS BIGINT) AS retweet_count,
               event_id % 7 AS reply_count,
               event_id % (SELECT count(*) FROM documents) AS doc_id
        FROM events""",
    "doc_tokens": f"""
        SELECT doc_id, text,
               regexp_extract_all({CLEAN}, '{TOKEN_PATTERN}') AS tokens
        FROM documents""",
    "doc_hits": f"""
        SELECT doc_id, text IS NOT NULL AS has_text, len(tokens) AS word_count,
               CAST(len(list_filter(tokens, lambda t: t IN {_in_list(POSITIVE_WORDS)})) AS DOUBLE) AS positive_score,
               CAST(len(list_filter(tokens, lambda t: t IN {_in_list(NEGATIVE_WORDS)})) AS DOUBLE) AS negative_score
        FROM doc_tokens""",
    "doc_polarity": """
        SELECT *, CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment
        FROM (SELECT *, coalesce((positive_score - negative_score) / nullif(positive_score + negative_score, 0), 0) AS polarity
              FROM doc_hits)""",
    "doc_sentiment": """
        SELECT doc_id, has_text, bert_positive, bert_neutral, bert_negative,
               CASE WHEN bert_positive = greatest(bert_positive, bert_neutral, bert_negative) THEN 'POSITIVE'
                    WHEN bert_neutral = greatest(bert_positive, bert_neutral, bert_negative) THEN 'NEUTRAL'
                    ELSE 'NEGATIVE' END AS bert_label
        FROM (SELECT doc_id, has_text, ep / s AS bert_positive, eu / s AS bert_neutral, en / s AS bert_negative
              FROM (SELECT *, ep + eu + en AS s
                    FROM (SELECT doc_id, has_text, exp(positive_score - m) AS ep, exp(0.0::DOUBLE - m) AS eu,
                                 exp(negative_score - m) AS en
                          FROM (SELECT *, greatest(positive_score, 0, negative_score) AS m FROM doc_hits))))""",
    "doc_substring": "SELECT doc_id, CAST("
    + " + ".join(
        f"(CASE WHEN contains(text, '{w}') THEN {p} ELSE 0 END)" for w, p in SUBSTRING_LEXICON
    )
    + " AS BIGINT) AS sentiment_score FROM documents",
    "doc_stance": """
        SELECT doc_id, stance_label,
               CASE stance_label WHEN 'AGAINST' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS stance_against,
               CASE stance_label WHEN 'FAVOR' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS stance_favor,
               CASE stance_label WHEN 'NEUTRAL' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS stance_neutral
        FROM (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'AGAINST' WHEN l.quality = 1 THEN 'FAVOR'
                                    ELSE 'NEUTRAL' END AS stance_label
              FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "scored": """
        SELECT p.*, s.has_text, s.bert_label, s.bert_positive, s.bert_neutral, s.bert_negative,
               t.stance_label, t.stance_against, t.stance_favor, t.stance_neutral
        FROM posts p LEFT JOIN doc_sentiment s ON s.doc_id = p.doc_id
        LEFT JOIN doc_stance t ON t.doc_id = p.doc_id""",
    "hourly_sentiment": """
        SELECT topic, date_trunc('hour', "timestamp") AS "timestamp",
               count(CASE WHEN has_text THEN 1 END) AS "count",
               avg(bert_positive) AS positive_prob, avg(bert_neutral) AS neutral_prob,
               avg(bert_negative) AS negative_prob,
               count(*) FILTER (WHERE bert_label = 'POSITIVE') AS positive_count,
               count(*) FILTER (WHERE bert_label = 'NEUTRAL') AS neutral_count,
               count(*) FILTER (WHERE bert_label = 'NEGATIVE') AS negative_count,
               CAST(count(*) FILTER (WHERE bert_label = 'POSITIVE') AS DOUBLE) / nullif(count(CASE WHEN has_text THEN 1 END), 0) AS positive_rate,
               CAST(count(*) FILTER (WHERE bert_label = 'NEUTRAL') AS DOUBLE) / nullif(count(CASE WHEN has_text THEN 1 END), 0) AS neutral_rate,
               CAST(count(*) FILTER (WHERE bert_label = 'NEGATIVE') AS DOUBLE) / nullif(count(CASE WHEN has_text THEN 1 END), 0) AS negative_rate,
               avg(bert_positive) - avg(bert_negative) AS avg_score
        FROM scored GROUP BY 1, 2""",
    "hourly_stance": """
        SELECT topic, date_trunc('hour', "timestamp") AS "timestamp",
               CAST(count(*) FILTER (WHERE stance_label = 'AGAINST') AS DOUBLE) / count(*) AS stance_against_rate,
               CAST(count(*) FILTER (WHERE stance_label = 'FAVOR') AS DOUBLE) / count(*) AS stance_favor_rate,
               CAST(count(*) FILTER (WHERE stance_label = 'NEUTRAL') AS DOUBLE) / count(*) AS stance_neutral_rate,
               avg(stance_against) AS stance_against_mean, avg(stance_favor) AS stance_favor_mean,
               avg(stance_neutral) AS stance_neutral_mean, count(*) AS stance_count,
               avg(like_count) AS avg_like_count, avg(retweet_count) AS avg_retweet_count,
               avg(reply_count) AS avg_reply_count, max(like_count) AS max_like_count,
               max(retweet_count) AS max_retweet_count, max(reply_count) AS max_reply_count,
               CAST(sum(like_count) AS BIGINT) AS total_like_count,
               CAST(sum(retweet_count) AS BIGINT) AS total_retweet_count,
               CAST(sum(reply_count) AS BIGINT) AS total_reply_count
        FROM scored GROUP BY 1, 2""",
    "features": f"""
        SELECT topic, "timestamp", volume, negative_rate, stance_against_rate, stance_favor_rate,
               stance_neutral_rate,
               {DELTA.format(x='volume')} AS delta_volume,
               {DELTA.format(x='negative_rate')} AS delta_negative_rate,
               {DELTA.format(x='stance_against_rate')} AS delta_against_rate,
               {CHANGE.format(x='volume')} AS delta_volume_rate,
               sentiment_avg_score, stance_against_mean, stance_favor_mean, stance_neutral_mean,
               avg_engagement, total_engagement, max_engagement,
               coalesce(total_engagement / nullif(volume, 0), 0) AS engagement_rate,
               {DELTA.format(x='total_engagement')} AS delta_engagement,
               {CHANGE.format(x='total_engagement')} AS delta_engagement_rate,
               avg_like_count, avg_retweet_count, avg_reply_count
        FROM (SELECT coalesce(s.topic, t.topic) AS topic, coalesce(s."timestamp", t."timestamp") AS "timestamp",
                     CAST(coalesce(s."count", 0) AS DOUBLE) AS volume,
                     coalesce(s.negative_rate, 0) AS negative_rate,
                     coalesce(s.avg_score, 0) AS sentiment_avg_score,
                     coalesce(stance_against_rate, 0) AS stance_against_rate,
                     coalesce(stance_favor_rate, 0) AS stance_favor_rate,
                     coalesce(stance_neutral_rate, 0) AS stance_neutral_rate,
                     coalesce(stance_against_mean, 0) AS stance_against_mean,
                     coalesce(stance_favor_mean, 0) AS stance_favor_mean,
                     coalesce(stance_neutral_mean, 0) AS stance_neutral_mean,
                     avg_like_count, avg_retweet_count, avg_reply_count,
                     avg_like_count + avg_retweet_count + avg_reply_count AS avg_engagement,
                     CAST(total_like_count + total_retweet_count + total_reply_count AS DOUBLE) AS total_engagement,
                     CAST(greatest(max_like_count, max_retweet_count, max_reply_count) AS DOUBLE) AS max_engagement
              FROM hourly_sentiment s FULL OUTER JOIN hourly_stance t
                   ON s.topic = t.topic AND s."timestamp" = t."timestamp") AS j
        WINDOW w AS (PARTITION BY topic ORDER BY "timestamp")""",
    "composites": """
        SELECT *, volume * negative_rate AS flame_score, volume * stance_against_rate AS against_count,
               stance_against_rate - stance_favor_rate AS sentiment_polarity,
               total_engagement * negative_rate AS flame_engagement_score,
               total_engagement * stance_against_rate AS against_engagement_score
        FROM features""",
    "raw_intervals": "SELECT * FROM (VALUES "
    + _values(INTERVALS)
    + ') AS v(topic, "position", "start", "end", "label", description)',
    "intervals": """
        SELECT topic, "start", "end", coalesce("label", 'period_' || "position") AS "label",
               coalesce(description, '') AS description
        FROM (SELECT topic, "position", try_cast("start" AS TIMESTAMP) AS "start",
                     try_cast("end" AS TIMESTAMP) AS "end", "label", description FROM raw_intervals)
        WHERE "start" <= "end" """,
    "labelled": """
        SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM intervals i WHERE i.topic = c.topic
                         AND c."timestamp" BETWEEN i."start" AND i."end") THEN 1 ELSE 0 END AS is_controversy
        FROM composites c""",
    "controversy": """
        SELECT *, (CASE WHEN max(volume) OVER (PARTITION BY topic) > 0
                        THEN volume / max(volume) OVER (PARTITION BY topic) ELSE 0 END)
                  * negative_rate * stance_against_rate AS controversy_score
        FROM labelled""",
    "dict_posts": """
        SELECT p.*, d.positive_score, d.negative_score, d.polarity, d.sentiment, d.word_count
        FROM posts p LEFT JOIN doc_polarity d ON d.doc_id = p.doc_id""",
    "substring_posts": """
        SELECT p.*, d.sentiment_score, d.sentiment_score < 0 AS is_negative
        FROM posts p LEFT JOIN doc_substring d ON d.doc_id = p.doc_id""",
    "dict_series": """
        SELECT topic, date_trunc('hour', "timestamp") AS "timestamp", count(*) AS volume,
               count(*) FILTER (WHERE sentiment = 'positive') AS dict_positive_count,
               count(*) FILTER (WHERE sentiment = 'negative') AS dict_negative_count,
               count(*) FILTER (WHERE sentiment = 'neutral') AS dict_neutral_count,
               avg(polarity) AS dict_avg_polarity,
               CAST(count(*) FILTER (WHERE sentiment = 'positive') AS DOUBLE) / count(*) AS dict_positive_rate,
               CAST(count(*) FILTER (WHERE sentiment = 'negative') AS DOUBLE) / count(*) AS dict_negative_rate,
               CAST(count(*) FILTER (WHERE sentiment = 'neutral') AS DOUBLE) / count(*) AS dict_neutral_rate
        FROM dict_posts GROUP BY 1, 2""",
    "engagement_series": """
        SELECT topic, date_trunc('hour', "timestamp") AS "timestamp",
               CAST(sum(coalesce(like_count, 0) + coalesce(retweet_count, 0)) AS BIGINT) AS total_engagement,
               avg(coalesce(like_count, 0) + coalesce(retweet_count, 0)) AS avg_engagement,
               CAST(sum(like_count) AS BIGINT) AS total_likes,
               CAST(sum(retweet_count) AS BIGINT) AS total_retweets
        FROM posts GROUP BY 1, 2""",
    "scoring_base": """
        SELECT topic, date_trunc('hour', "timestamp") AS "timestamp", count(bert_label) AS volume,
               avg(CASE WHEN bert_label = 'NEGATIVE' THEN 1 ELSE 0 END) AS negative_rate,
               avg(stance_favor) AS stance_favor_rate, avg(stance_against) AS stance_against_rate,
               avg(stance_neutral) AS stance_neutral_rate
        FROM scored GROUP BY 1, 2""",
    "topic_hours": """
        SELECT topic, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS "timestamp"
        FROM (SELECT topic, date_trunc('hour', min("timestamp")) AS lo, date_trunc('hour', max("timestamp")) AS hi
              FROM posts GROUP BY 1)""",
    "scoring_series": """
        SELECT *, coalesce(volume - lag(volume) OVER w, 0) AS delta_volume,
               coalesce(negative_rate - lag(negative_rate) OVER w, 0) AS delta_negative_rate,
               volume * negative_rate AS flame_score, volume * stance_against_rate AS against_count,
               stance_against_rate - stance_favor_rate AS sentiment_polarity
        FROM (SELECT g.topic, g."timestamp", coalesce(b.volume, 0) AS volume, b.negative_rate,
                     b.stance_favor_rate, b.stance_against_rate, b.stance_neutral_rate
              FROM topic_hours g LEFT JOIN scoring_base b ON b.topic = g.topic AND b."timestamp" = g."timestamp") AS f
        WINDOW w AS (PARTITION BY topic ORDER BY "timestamp")""",
    "rule_base": """
        SELECT *, CASE WHEN max(volume) OVER (PARTITION BY topic) > 0
                       THEN volume / max(volume) OVER (PARTITION BY topic) ELSE 0 END AS volume_norm
        FROM labelled""",
    "rules": " UNION ALL ".join(
        f"""SELECT topic, "timestamp", is_controversy AS label, volume, negative_rate, flame_score,
               '{name}' AS model, CAST({expr} AS DOUBLE) AS probability FROM rule_base"""
        for name, expr in EVAL_MODELS.items()
    ),
    "predictions": "SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM rules",
    "model_metrics": """
        SELECT model, n, tp, fp, fn, tn, CAST(tp + tn AS DOUBLE) / n AS accuracy,
               coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
               coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
               coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1
        FROM (SELECT model, count(*) AS n, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                     count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                     count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                     count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
              FROM predictions GROUP BY 1)""",
    "topic_metrics": """
        SELECT topic, model, n, CAST(tp + tn AS DOUBLE) / n AS accuracy,
               coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
               coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
               coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1
        FROM (SELECT topic, model, count(*) AS n, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                     count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                     count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                     count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
              FROM predictions GROUP BY 1, 2)""",
    "importance": " UNION ALL ".join(
        f"SELECT topic AS model, '{f}' AS feature, "
        f"coalesce(round(abs(covar_pop({f}, is_controversy) / nullif(stddev_pop({f}) * stddev_pop(is_controversy), 0)), 6), 0) "
        "AS importance FROM labelled GROUP BY topic"
        for f in (
            "volume", "negative_rate", "stance_against_rate", "stance_favor_rate",
            "stance_neutral_rate", "delta_volume", "delta_volume_rate", "flame_score",
            "against_count", "sentiment_polarity", "delta_negative_rate", "delta_against_rate",
            "sentiment_avg_score", "stance_against_mean", "stance_favor_mean",
            "stance_neutral_mean", "engagement_rate", "max_engagement",
        )
    ),
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    ordered = [n for n in VIEWS if n in needed]
    if not ordered:
        return body
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    return f"WITH {views}\nSELECT * FROM (\n{body}\n) AS answer"
