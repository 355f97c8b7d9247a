"""Labelled periods: loading rules, interval join, suggested periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberscope.functions.times import parse_utc, to_utc
from emberscope.operators.reports import top_per_topic
from emberscope.operators.series import join_close_windows, with_controversy_score
from emberscope.schemas import PERIOD_GAP_SECONDS

def usable_intervals(raw: DataFrame) -> DataFrame:
    """Text intervals ``topic, position, start, end, label, description`` to usable ones.

    Incomplete, unparsable and inverted intervals are dropped; an interval
    without a label is named after its position.
    """
    parsed = raw.withColumns({"start": parse_utc(F.col("start")), "end": parse_utc(F.col("end"))})
    kept = parsed.filter(F.col("start") <= F.col("end"))
    return kept.select(
        "topic",
        "start",
        "end",
        F.coalesce(F.col("label"), F.concat(F.lit("period_"), F.col("position").cast("string"))).alias("label"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
    )


def apply_intervals(
    features: DataFrame, intervals: DataFrame, out: str = "is_controversy", interval_zone: str | None = None
) -> DataFrame:
    """Flag rows inside any interval of their topic, both ends included.

    A sweep: intervals are cut into topic-days, and the bounds and the rows of a
    topic-day form one ordered stream, in which a running count tells how many
    intervals are open at each row.  At the same time, starts come before rows
    and rows before ends.  A busy topic is spread over its days, overlaps and
    long periods cost their bounds only, and no size decides on the plan.  Rows
    without topic or time are in no interval.  ``interval_zone`` is the zone of
    the interval bounds when the feature times are UTC.
    """
    bounds = intervals
    if interval_zone:
        bounds = bounds.withColumns(
            {c: to_utc(F.col(c), interval_zone) for c in ("start", "end")}
        )
    whole = bounds.filter(F.col("topic").isNotNull() & (F.col("start") <= F.col("end"))).select("topic", "start", "end")
    days = F.sequence(F.to_date("start"), F.to_date("end"), F.expr("INTERVAL '1 day'"))
    daily = whole.withColumn("_day", F.explode(days))
    first = F.greatest(F.col("start"), F.col("_day").cast("timestamp_ntz"))
    next_day = F.date_add("_day", 1).cast("timestamp_ntz")
    events = F.array(
        F.struct(first.alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_step")),
        F.struct(F.least(F.col("end"), next_day).alias("_at"), F.lit(2).alias("_kind"), F.lit(-1).alias("_step")),
    )
    steps = daily.select(F.col("topic").alias("_topic"), "_day", F.inline(events))
    # Equal bounds are one event, so a moment at which very many intervals start or end is a single row.
    steps = steps.groupBy("_topic", "_day", "_at", "_kind").agg(F.sum("_step").alias("_step"))
    rows = features.withColumns(
        {
            "_topic": F.col("topic"), "_day": F.to_date("timestamp"), "_at": F.col("timestamp"),
            "_kind": F.lit(1), "_step": F.lit(0).cast("long"),
        }
    )
    stream = rows.unionByName(steps, allowMissingColumns=True)
    order = Window.partitionBy("_topic", "_day").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = stream.withColumn("_open", F.sum("_step").over(order)).filter("_kind = 1")
    kept = [c for c in features.columns if c != out]
    return swept.select(*kept, (F.coalesce("_open", F.lit(0)) > 0).cast("int").alias(out))


def suggested_periods(features: DataFrame, top: int = 20, gap_seconds: int = PERIOD_GAP_SECONDS) -> DataFrame:
    """Periods of high controversy score per topic.

    The cut is the median of the topic's ``top`` best positive scores; windows
    above it are merged when close.
    """
    scored = with_controversy_score(features)
    cut = top_score_median(scored, top)
    high = scored.join(cut, "topic").filter(F.col("controversy_score") > F.col("cut"))
    return join_close_windows(high.select("topic", "timestamp"), gap_seconds)


def top_score_median(scored: DataFrame, top: int = 20) -> DataFrame:
    best = top_per_topic(scored.filter(F.col("controversy_score") > 0), "controversy_score", top)
    return best.groupBy("topic").agg(F.percentile("controversy_score", F.lit(0.5)).alias("cut"))
