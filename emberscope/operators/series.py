"""Time windows, gap filling and ordered-series columns.

Posts are reduced to one row per topic and window with map-side partial
aggregation; windows over ``topic`` run only on that reduced table, whose size
per topic is bounded by the length of the observed period.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.functions.columns import ratio, ratio_or_zero, share
from emberscope.functions.times import DAY_SECONDS, bin_start, bin_start_from, width_seconds
from emberscope.operators.sizing import broadcast_if_small, global_rank

KEYS = ["topic", "timestamp"]
GAP_PIECE = 1440


def by_window(posts: DataFrame, width: str = "1 hour", time: str = "timestamp", keys: Sequence[str] = ("topic",)):
    """Grouping of posts by topic and tumbling window start.

    Windows start at midnight.  A width that does not divide a day counts from
    midnight of the topic's first day, which takes one small extra aggregate; its
    row per topic is broadcast once its size is known, so the posts stay in place.
    """
    if DAY_SECONDS % width_seconds(width) == 0:
        binned = posts.withColumn("_bin", bin_start(F.col(time), width))
    else:
        first = posts.groupBy(*keys).agg(
            F.to_date(F.min(time)).cast("timestamp_ntz").alias("_origin")
        )
        first = broadcast_if_small(first.withColumnsRenamed({k: f"_first_{k}" for k in keys}))
        same = [F.col(k).eqNullSafe(F.col(f"_first_{k}")) for k in keys]
        binned = posts.join(first, same).withColumn("_bin", bin_start_from(F.col(time), width, F.col("_origin")))
    return binned.filter(F.col("_bin").isNotNull()).groupBy(*keys, F.col("_bin").alias("timestamp"))


def gap_fill(
    series: DataFrame,
    width: str,
    fill: Mapping[str, Column | float | int] | None = None,
    keys: Sequence[str] = ("topic",),
    by: Sequence[str] = (),
) -> DataFrame:
    """Insert the empty windows between the first and last window of each topic.

    Every row expands to itself and the empty windows before the next row, in
    one ordered pass; measures of inserted rows are null unless ``fill`` says
    otherwise.  A gap of any length is cut into pieces of ``GAP_PIECE`` windows
    that are expanded one at a time, so no row ever holds a long gap.
    """
    fill = fill or {}
    step, seconds = F.expr(f"INTERVAL '{width}'"), width_seconds(width)
    following = F.lead("timestamp").over(Window.partitionBy(*keys, *by).orderBy("timestamp"))
    windows = F.coalesce(F.floor(F.timestamp_diff("SECOND", F.col("timestamp"), following) / seconds), F.lit(1)).cast("long")
    cut = series.withColumn("_windows", F.greatest(windows, F.lit(1).cast("long")))
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_windows") - 1) / GAP_PIECE))
    cut = cut.withColumn("_piece", F.explode(pieces))
    start = F.timestamp_add("SECOND", F.col("_piece") * (GAP_PIECE * seconds), F.col("timestamp"))
    length = F.least(F.lit(GAP_PIECE).cast("long"), F.col("_windows") - F.col("_piece") * GAP_PIECE)
    cut = cut.withColumn("_start", start).withColumn("_end", F.timestamp_add("SECOND", (length - 1) * seconds, F.col("_start")))
    out = cut.withColumn("_bin", F.explode(F.sequence("_start", "_end", step)))
    real = F.col("_bin") == F.col("timestamp")
    fixed = {*keys, *by, "timestamp"}
    columns = []
    for field in series.schema.fields:
        name = field.name
        if name == "timestamp":
            columns.append(F.col("_bin").alias("timestamp"))
        elif name in fixed:
            columns.append(F.col(name))
        else:
            value = fill.get(name)
            empty = value if isinstance(value, Column) else F.lit(value)
            columns.append(
                F.when(real, F.col(name)).otherwise(empty.cast(field.dataType)).alias(name)
            )
    return out.select(*columns)


def post_counts(posts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Posts per window with empty windows at 0."""
    counts = by_window(posts, width).agg(F.count(F.lit(1)).alias("count"))
    return gap_fill(counts, width, {"count": 0})


def resolution_summary(posts: DataFrame, widths: Sequence[str] = ("10 minutes", "30 minutes", "1 hour")) -> DataFrame:
    """Window count, mean, maximum and minimum per topic for several widths.

    The posts are read and shuffled once, on the grid of the greatest common
    divisor of all widths and a day; every width is summed up from that grid,
    also where one does not divide another.
    """
    grid = f"{math.gcd(DAY_SECONDS, *map(width_seconds, widths))} seconds"
    finest = by_window(posts, grid).agg(F.count(F.lit(1)).alias("count"))
    parts = []
    for width in widths:
        coarse = by_window(finest, width).agg(F.sum("count").alias("count"))
        filled = gap_fill(coarse, width, {"count": 0})
        parts.append(
            filled.groupBy("topic").agg(
                F.lit(width).alias("width"),
                F.count(F.lit(1)).alias("windows"),
                F.avg("count").alias("mean_count"),
                F.max("count").alias("max_count"),
                F.min("count").alias("min_count"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lexicon_series(posts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count, mean score and negative share per window; empty windows have null means."""
    series = by_window(posts, width).agg(
        F.count("sentiment_score").alias("count"),
        F.avg("sentiment_score").alias("avg_score"),
        F.avg(F.col("is_negative").cast("int")).alias("negative_rate"),
    )
    return gap_fill(series, width, {"count": 0})


def sentiment_aggregates(content: str = "content") -> list[Column]:
    """Counts, mean probabilities and label counts of scored posts."""
    label = F.col("bert_label")
    return [
        F.count(content).alias("count"),
        F.avg("bert_positive").alias("positive_prob"),
        F.avg("bert_neutral").alias("neutral_prob"),
        F.avg("bert_negative").alias("negative_prob"),
        F.count_if(label == "POSITIVE").alias("positive_count"),
        F.count_if(label == "NEUTRAL").alias("neutral_count"),
        F.count_if(label == "NEGATIVE").alias("negative_count"),
    ]


def with_sentiment_rates(series: DataFrame) -> DataFrame:
    """Label rates over the post count and the net score; a zero count gives null rates."""
    rates = {f"{s}_rate": ratio(F.col(f"{s}_count"), F.col("count")) for s in ("positive", "neutral", "negative")}
    return series.withColumns(rates).withColumn(
        "avg_score", F.col("positive_prob") - F.col("negative_prob")
    )


def hourly_sentiment(posts: DataFrame, content: str = "content", width: str = "1 hour") -> DataFrame:
    """Sparse window sentiment of scored posts."""
    return with_sentiment_rates(by_window(posts, width).agg(*sentiment_aggregates(content)))


def stance_aggregates() -> list[Column]:
    label = F.col("stance_label")
    out = [share(label == s.upper()).alias(f"stance_{s}_rate") for s in ("against", "favor", "neutral")]
    out += [F.avg(f"stance_{s}").alias(f"stance_{s}_mean") for s in ("against", "favor", "neutral")]
    return [*out, F.count(F.lit(1)).alias("stance_count")]


def engagement_aggregates() -> list[Column]:
    kinds = ("like", "retweet", "reply")
    return [
        *[F.avg(f"{k}_count").alias(f"avg_{k}_count") for k in kinds],
        *[F.max(f"{k}_count").alias(f"max_{k}_count") for k in kinds],
        *[F.sum(f"{k}_count").alias(f"total_{k}_count") for k in kinds],
    ]


def hourly_stance(posts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Sparse window stance shares over all rows, with engagement."""
    return by_window(posts, width).agg(*stance_aggregates(), *engagement_aggregates())


def hourly_evidence(posts: DataFrame, content: str = "content", width: str = "1 hour") -> DataFrame:
    """Sentiment, stance and engagement per window in one pass over the posts.

    Equals the full outer join of ``hourly_sentiment`` and ``hourly_stance``
    when both scores sit on the same posts.
    """
    return with_sentiment_rates(
        by_window(posts, width).agg(
            *sentiment_aggregates(content), *stance_aggregates(), *engagement_aggregates()
        )
    )


def dictionary_series(posts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Dictionary sentiment per window; windows without posts are absent."""
    cls = F.col("sentiment")
    counted = by_window(posts, width).agg(
        F.count(F.lit(1)).alias("volume"),
        *[F.count_if(cls == s).alias(f"dict_{s}_count") for s in ("positive", "negative", "neutral")],
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("dict_avg_polarity"),
    )
    return counted.withColumns(
        {f"dict_{s}_rate": ratio(F.col(f"dict_{s}_count"), F.col("volume"))
         for s in ("positive", "negative", "neutral")}
    )


def engagement_series(posts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Likes plus reposts per window: sum, mean and the two totals."""
    both = F.coalesce(F.col("like_count"), F.lit(0)) + F.coalesce(F.col("retweet_count"), F.lit(0))
    return by_window(posts, width).agg(
        F.sum(both).alias("total_engagement"),
        F.avg(both).alias("avg_engagement"),
        F.sum("like_count").alias("total_likes"),
        F.sum("retweet_count").alias("total_retweets"),
    )


def scoring_aggregates() -> list[Column]:
    return [
        F.count("is_negative").alias("volume"),
        F.avg(F.col("is_negative").cast("int")).alias("negative_rate"),
        F.avg("stance_favor").alias("stance_favor_rate"),
        F.avg("stance_against").alias("stance_against_rate"),
        F.avg("stance_neutral").alias("stance_neutral_rate"),
    ]


def scoring_series(posts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Window features of the scorer: gap-filled, with first differences and composites."""
    filled = gap_fill(by_window(posts, width).agg(*scoring_aggregates()), width, {"volume": 0})
    c = F.col
    out = with_first_difference(filled, ["volume", "negative_rate"])
    return out.withColumns(
        {
            "flame_score": c("volume") * c("negative_rate"),
            "against_count": c("volume") * c("stance_against_rate"),
            "sentiment_polarity": c("stance_against_rate") - c("stance_favor_rate"),
        }
    )


def _ordered(keys: Sequence[str] = ("topic",)):
    return Window.partitionBy(*keys).orderBy("timestamp")


def first_difference(name: str, keys: Sequence[str] = ("topic",)) -> Column:
    """Change from the previous row of the topic; 0 when either side is missing."""
    x = F.col(name)
    return F.coalesce(x - F.lag(x).over(_ordered(keys)), F.lit(0)).cast("double")


def with_first_difference(df: DataFrame, names: Sequence[str], renamed: Mapping[str, str] | None = None) -> DataFrame:
    renamed = renamed or {}
    return df.withColumns({renamed.get(n, f"delta_{n}"): first_difference(n) for n in names})


def relative_change(name: str, keys: Sequence[str] = ("topic",)) -> Column:
    """Change over the previous value; 0 for the first row, 0/0 and x/0."""
    x = F.col(name)
    before = F.lag(x).over(_ordered(keys))
    return ratio_or_zero(x - before, before)


def relative_change_eps(name: str, keys: Sequence[str] = ("topic",), eps: float = 1e-6) -> Column:
    """Change over the previous value plus ``eps``; the first row is its own predecessor."""
    x = F.col(name).cast("double")
    before = F.coalesce(F.lag(x).over(_ordered(keys)), x)
    return F.coalesce((x - before) / (before + eps), F.lit(0.0))


def with_z_score(df: DataFrame, name: str = "volume", out: str = "volume_spike_ratio") -> DataFrame:
    """Deviation from the overall mean in sample standard deviations; 0 if there is none."""
    stats = df.agg(F.avg(name).alias("m"), F.stddev_samp(name).alias("s"))
    mean = stats.select("m").scalar()
    sd = stats.select("s").scalar()
    return df.withColumns({"_m": mean, "_s": sd}).withColumn(
        out, F.when(F.col("_s") > 0, (F.col(name) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    ).drop("_m", "_s")


def topic_thresholds(df: DataFrame, name: str = "volume", sigmas: float = 2.0) -> DataFrame:
    """Mean, sample deviation and mean + k sd per topic."""
    stats = df.groupBy("topic").agg(
        F.avg(name).alias("mean_value"), F.stddev_samp(name).alias("sd_value")
    )
    return stats.withColumn("threshold", F.col("mean_value") + sigmas * F.col("sd_value"))


def with_controversy_score(df: DataFrame) -> DataFrame:
    """Volume over the topic's maximum, times negative rate, times against rate."""
    top = F.max("volume").over(Window.partitionBy("topic"))
    norm = F.when(top > 0, F.col("volume") / top).otherwise(F.lit(0.0))
    return df.withColumn(
        "controversy_score", norm * F.col("negative_rate") * F.col("stance_against_rate")
    )


def join_close_windows(df: DataFrame, gap_seconds: int) -> DataFrame:
    """Merge rows of a topic at most ``gap_seconds`` apart into periods (gap inclusive)."""
    w = _ordered()
    gap = F.timestamp_diff("SECOND", F.lag("timestamp").over(w), F.col("timestamp"))
    starts = df.withColumn("_new", F.when(gap <= gap_seconds, 0).otherwise(1))
    marked = starts.withColumn("period", F.sum("_new").over(w))
    return marked.groupBy("topic", "period").agg(
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.count(F.lit(1)).alias("windows"),
    )


def latest_window(df: DataFrame) -> DataFrame:
    """Last window of each topic."""
    row = F.max_by(F.struct(*[c for c in df.columns if c != "topic"]), F.col("timestamp"))
    return df.groupBy("topic").agg(row.alias("r")).select("topic", "r.*")


def with_encoded(df: DataFrame, column: str = "topic", out: str = "topic_encoded") -> DataFrame:
    """Alphabetical code 0..n-1 of a category; null counts as ``unknown``."""
    coded = broadcast_if_small(encoder(df, column).withColumnsRenamed({"code": out, "_value": "_known"}))
    value = F.coalesce(F.col(column), F.lit("unknown"))
    return df.join(coded, value == F.col("_known"), "left").drop("_known")


def encoder(df: DataFrame, column: str = "topic") -> DataFrame:
    """Sorted distinct values with their code."""
    values = df.select(F.coalesce(F.col(column), F.lit("unknown")).alias("_value")).distinct()
    ranked = global_rank(values, F.substring("_value", 1, 2), [F.col("_value")])
    return ranked.select("_value", (F.col("rank") - 1).alias("code"))


def encode_with(df: DataFrame, codes: DataFrame, column: str = "topic", out: str = "topic_encoded") -> DataFrame:
    """Codes fitted on another table; unseen values get -1."""
    known = broadcast_if_small(codes.select(F.col("_value").alias("_known"), F.col("code").alias("_code")))
    value = F.coalesce(F.col(column), F.lit("unknown"))
    joined = df.join(known, value == F.col("_known"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1))).drop("_known", "_code")
