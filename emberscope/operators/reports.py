"""Summaries, top-k lists, leaderboards and topic status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.functions.columns import ratio
from emberscope.operators.sizing import exact_quantiles
from emberscope.schemas import DEFAULT_CATEGORY, FEATURE_CATEGORIES

ALERT_RULES = ("high_volume", "high_negative", "high_against", "rapid_rise")


def topic_balance(labelled: DataFrame, label: str = "is_controversy") -> DataFrame:
    """Rows, positives and positive rate per topic."""
    return labelled.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).cast("bigint").alias("positives"),
        F.round(F.avg(label), 3).alias("positive_rate"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each category; the total comes from the grouped counts."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", ratio(F.col("n"), total))


def feature_summary(features: DataFrame) -> DataFrame:
    """Row count, period, means and maxima per topic."""
    return features.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        *[F.avg(c).alias(f"mean_{c}") for c in
          ("volume", "negative_rate", "stance_against_rate", "stance_favor_rate")],
        *[F.max(c).alias(f"max_{c}") for c in ("volume", "negative_rate", "stance_against_rate")],
    )


def peaks(features: DataFrame, columns: Sequence[str] = ("volume", "delta_volume", "delta_volume_rate", "negative_rate")) -> DataFrame:
    """Largest value of each column per topic and the earliest time it occurs."""
    aggs = []
    for c in columns:
        first = F.struct(F.col(c), -F.unix_micros(F.col("timestamp").cast("timestamp")))
        aggs += [F.max(c).alias(f"max_{c}"), F.max_by("timestamp", first).alias(f"at_{c}")]
    return features.groupBy("topic").agg(*aggs)


def hours_of_day(posts: DataFrame) -> DataFrame:
    return (
        posts.groupBy(F.hour("timestamp").cast("bigint").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def dates_and_hours(posts: DataFrame) -> DataFrame:
    """Distinct calendar dates and hours of day with posts."""
    return posts.select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("date"),
        F.hour("timestamp").cast("bigint").alias("hour"),
    ).distinct()


def topic_dataset_summary(posts: DataFrame, most_listed: int = 1000) -> DataFrame:
    """Posts, period, days, source files and queries per topic.

    Posts are first reduced to one row per topic, file and query, so no list
    grows with the posts; of a topic's queries the first ``most_listed`` by name
    are listed, and ``query_count`` counts them all.
    """
    each = posts.groupBy("topic", "source_file", "query").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")
    )
    out = each.groupBy("topic").agg(
        F.sum("n").alias("n"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count_distinct("source_file").alias("files"),
        F.count_distinct("query").alias("query_count"),
    )
    names = each.select("topic", "query").distinct().filter(F.col("query").isNotNull())
    place = F.row_number().over(Window.partitionBy("topic").orderBy("query"))
    first = names.withColumn("_place", place).filter(F.col("_place") <= most_listed)
    listed = first.groupBy(F.col("topic").alias("_topic")).agg(
        F.array_join(F.array_sort(F.collect_list("query")), ",").alias("queries")
    )
    joined = out.join(listed, F.col("topic").eqNullSafe(F.col("_topic")), "left").drop("_topic")
    seconds = F.timestamp_diff("SECOND", F.col("start"), F.col("end"))
    return joined.withColumns(
        {"queries": F.coalesce("queries", F.lit("")), "days": (F.floor(seconds / 86400) + 1).cast("bigint")}
    )


def sentiment_summary(posts: DataFrame) -> DataFrame:
    """Posts, negatives, negative percent and mean score overall."""
    return posts.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_negative")).alias("negatives"),
        F.coalesce(
            ratio(F.count_if(F.col("is_negative")), F.count(F.lit(1))) * 100, F.lit(0.0)
        ).alias("negative_percent"),
        F.avg("sentiment_score").alias("mean_score"),
    )


def with_alerts(features: DataFrame, negative_min: float = 0.7, against_min: float = 0.5, sigmas: float = 2.0) -> DataFrame:
    """One 0/1 column per alert rule, against the topic's own mean and deviation."""
    stats = features.groupBy("topic").agg(
        F.avg("volume").alias("_mean"), F.stddev_samp("volume").alias("_sd")
    )
    c = F.col
    rules = {
        "high_volume": c("volume") > c("_mean") + sigmas * c("_sd"),
        "high_negative": c("negative_rate") >= negative_min,
        "high_against": c("stance_against_rate") >= against_min,
        "rapid_rise": (c("delta_volume") > 0) & (c("volume") > c("_mean")),
    }
    flagged = features.join(stats, "topic").withColumns(
        {k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in rules.items()}
    )
    return flagged.drop("_mean", "_sd")


def first_alerts(features: DataFrame, n: int = 10, **limits) -> DataFrame:
    """The earliest ``n`` windows of each alert list per topic."""
    flagged = with_alerts(features, **limits)
    long = flagged.unpivot(["topic", "timestamp"], list(ALERT_RULES), "rule", "hit").filter("hit = 1")
    order = Window.partitionBy("topic", "rule").orderBy("timestamp")
    return (
        long.withColumn("position", F.row_number().over(order).cast("bigint"))
        .filter(F.col("position") <= n)
        .select("topic", "rule", "timestamp", "position")
    )


def top_per_topic(df: DataFrame, by: str, n: int, ties: str = "timestamp") -> DataFrame:
    """Largest ``n`` rows per topic; Spark cuts each partition before the shuffle."""
    order = Window.partitionBy("topic").orderBy(F.desc(by), F.asc(ties))
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def top_n(df: DataFrame, by: str, n: int, ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(ties)).limit(n)


def by_label_profile(labelled: DataFrame, label: str = "is_controversy") -> DataFrame:
    """Mean volume and negative rate of labelled and other windows."""
    return labelled.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("volume").alias("mean_volume"),
        F.avg("negative_rate").alias("mean_negative_rate"),
    )


def box_profile(labelled: DataFrame, feature: str, label: str = "is_controversy") -> DataFrame:
    """Minimum, quartiles and maximum of a feature per label."""
    return exact_quantiles(labelled, feature, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [label])


def score_summary(scored: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Latest, mean and maximum score and number of windows per topic."""
    return scored.groupBy(*by).agg(
        F.max_by("score", "timestamp").cast("bigint").alias("latest_score"),
        F.avg("score").alias("mean_score"),
        F.max("score").cast("bigint").alias("max_score"),
        F.count(F.lit(1)).alias("windows"),
    )


def leaderboard(results: DataFrame, metric: str = "f1", ties: str = "model") -> DataFrame:
    """Rank over a results table (one row per model, small by construction)."""
    order = Window.orderBy(F.desc(metric), F.asc(ties))
    return results.withColumn("rank", F.row_number().over(order).cast("bigint"))


def rank_within_all(importance: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Rank of the selected features inside the full ranking."""
    return leaderboard(importance, "importance", "feature").filter(F.col("feature").isin(list(selected)))


def mean_importance(importance: DataFrame, n: int | None = None) -> DataFrame:
    """Mean importance per feature over models, optionally the ``n`` largest."""
    out = importance.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return top_n(out, "importance", n, "feature") if n else out


def category_table(df: DataFrame) -> DataFrame:
    """The fixed feature-to-category lookup as a small local table."""
    rows = ", ".join(f"('{f}', '{c}')" for f, c in FEATURE_CATEGORIES.items())
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(feature, category)")


def with_category(df: DataFrame) -> DataFrame:
    """Category of each feature; unknown features get the default."""
    looked_up = df.join(F.broadcast(category_table(df)), "feature", "left")
    return looked_up.withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY)))


def category_totals(categorised: DataFrame) -> DataFrame:
    return categorised.groupBy("category").agg(
        F.sum("importance").alias("total_importance"), F.count(F.lit(1)).alias("features")
    )


def importance_gain(importance: DataFrame, added: Sequence[str], strong: float = 2.0) -> DataFrame:
    """Sum and share of the added features' importance, and how many exceed ``strong``."""
    is_added = F.col("feature").isin(list(added))
    part = F.coalesce(F.sum(F.when(is_added, F.col("importance"))), F.lit(0.0))
    return importance.agg(
        part.alias("added_importance"),
        F.sum("importance").alias("total_importance"),
        (ratio(part, F.sum("importance")) * 100).alias("added_percent"),
        F.count_if(is_added & (F.col("importance") > strong)).alias("strong_added"),
    )


def result_difference(
    left: DataFrame, right: DataFrame, on: str, metric: str, suffixes: tuple[str, str], keep: Sequence[str] = ()
) -> DataFrame:
    """Inner join of two result sets and the difference of a metric in points; ``keep`` names columns of the second."""
    a = left.select(on, F.col(metric).alias(f"{metric}{suffixes[0]}"))
    b = right.select(on, *keep, F.col(metric).alias(f"{metric}{suffixes[1]}"))
    return a.join(b, on).withColumn(
        f"{metric}_diff", (F.col(f"{metric}{suffixes[1]}") - F.col(f"{metric}{suffixes[0]}")) * 100
    )


def degraded_and_improved(diff: DataFrame, column: str, improved_min: float = 1.0) -> DataFrame:
    """Rows that got worse (most first) and rows that clearly got better (most first)."""
    bad = diff.filter(F.col(column) < 0).withColumn("change", F.lit("degraded"))
    good = diff.filter(F.col(column) > improved_min).withColumn("change", F.lit("improved"))
    return bad.orderBy(column).unionByName(good.orderBy(F.desc(column)))


def run_deltas(results: DataFrame, metric: str, run: str, base: str) -> DataFrame:
    """Point and percent improvement of every other run over the run ``base``, per model."""
    before = results.filter(F.col(run) == base).select("model", F.col(metric).alias("before"))
    after = results.filter(F.col(run) != base).select("model", run, F.col(metric).alias("after"))
    return after.join(before, "model").withColumns(
        {
            "points": (F.col("after") - F.col("before")) * 100,
            "percent": ratio(F.col("after") - F.col("before"), F.col("before")) * 100,
        }
    )


def best_combination(standard: DataFrame, cross: DataFrame) -> DataFrame:
    """Model with the best mean of hold-out and cross-topic F1."""
    both = standard.select("model", F.col("f1").alias("standard_f1")).join(
        cross.select("model", F.col("f1").alias("cross_f1")), "model"
    )
    both = both.withColumn("mean_f1", (F.col("standard_f1") + F.col("cross_f1")) / 2)
    return both.orderBy(F.desc("mean_f1"), F.asc("model")).limit(1)


def topic_status(topics: DataFrame, artefacts: dict[str, DataFrame]) -> DataFrame:
    """One boolean per artefact for every topic."""
    out = topics
    for name, have in artefacts.items():
        mark = have.select("topic").distinct().withColumn(name, F.lit(True))
        out = out.join(mark, "topic", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def all_topics(*sources: DataFrame) -> DataFrame:
    """Distinct union of topic names."""
    out = sources[0].select("topic").distinct()
    for s in sources[1:]:
        out = out.union(s.select("topic").distinct())
    return out.distinct()


def complement(df: DataFrame, held_out: DataFrame, key: str = "topic") -> DataFrame:
    """Rows whose key is not in the held-out part."""
    return df.join(held_out.select(key).distinct(), key, "left_anti")
