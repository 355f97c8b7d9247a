"""Structured Streaming jobs: hourly features and scored alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberscope.functions.scores import alert_class
from emberscope.functions.times import width_seconds
from emberscope.operators.scoring import score_windows
from emberscope.operators.series import scoring_aggregates

LATENESS = "2 hours"
ORDER_LATENESS = "1 day"
CARRIED = ["volume", "negative_rate"]


def read_stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Parquet files as a stream; new files below ``path`` are picked up as they appear."""
    return spark.readStream.options(**options).schema(schema).parquet(path)


def streaming_features(posts: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Window features per topic from a stream of scored posts.

    Posts later than ``lateness`` are ignored; a window is final, and is
    emitted once, when the watermark passes its end.
    """
    timed = posts.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    windows = (
        timed.withWatermark("event_time", lateness)
        .groupBy("topic", F.window("event_time", width).alias("window"))
        .agg(*scoring_aggregates())
    )
    return windows.select(
        "topic",
        F.col("window.start").cast("timestamp_ntz").alias("timestamp"),
        "volume", "negative_rate", "stance_favor_rate", "stance_against_rate", "stance_neutral_rate",
    )


def with_previous_window(
    windows: DataFrame, width: str = "1 hour", lateness: str = ORDER_LATENESS, idle_windows: int = 0, expire: str = "7 days"
) -> DataFrame:
    """Each topic's final windows and the empty ones between them, with the change from the window before.

    One state row per topic holds its last window.  Empty windows, of volume 0 and without other measures, come
    out as soon as a later window shows the gap; of a silent topic, event-time timers emit the first
    ``idle_windows`` of them when their time is over.  A topic that is silent for ``expire`` is forgotten: its
    next window is a first one, so no state outlives its topic and no gap grows without bound.  Windows that
    come more than ``lateness`` after a later one are ignored.
    """
    step, expiry = pd.Timedelta(seconds=width_seconds(width)), pd.Timedelta(seconds=width_seconds(expire))
    deltas = [T.StructField(f"delta_{c}", T.DoubleType()) for c in CARRIED]
    output = T.StructType([*windows.schema.fields, *deltas])
    kept = T.StructType([T.StructField("last", T.TimestampType()), T.StructField("idle", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in CARRIED]])
    names = [f.name for f in output.fields]
    measures = [f.name for f in windows.schema.fields if f.name not in ("topic", "timestamp")]

    def empty(topic: object, times: pd.DatetimeIndex) -> pd.DataFrame:
        rows = pd.DataFrame({"topic": [topic] * len(times), "timestamp": times})
        return rows.assign(**{n: 0 if n == "volume" else None for n in measures})

    def with_deltas(rows: pd.DataFrame, before: tuple) -> pd.DataFrame:
        for c, last in zip(CARRIED, before):
            values = rows[c].astype("float64")
            shifted = values.shift(1)
            shifted.iloc[0] = np.nan if last is None else last
            rows[f"delta_{c}"] = (values - shifted).fillna(0.0)
        return rows[names]

    def remember(state: GroupState, rows: pd.DataFrame, idle: int) -> None:
        last = rows["timestamp"].iloc[-1]
        values = [None if pd.isna(rows[c].iloc[-1]) else float(rows[c].iloc[-1]) for c in CARRIED]
        state.update((last.to_pydatetime(), idle, *values))
        # The next empty window is over a step after the next one starts; without it, wait for the topic to expire.
        wake = last + 2 * step if idle < idle_windows else last - idle * step + expiry
        state.setTimeoutTimestamp(max(int(wake.tz_localize("UTC").timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, idle, *before = state.get if state.exists else (None, 0, *[None] * len(CARRIED))
        last = None if last is None else pd.Timestamp(last).tz_localize(None)
        if state.hasTimedOut:
            now = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            if last - idle * step + expiry <= now:
                state.remove()
                return
            due = int((now - last) / step) - 1
            times = pd.date_range(last + step, periods=max(0, min(due, idle_windows - idle)), freq=step)
            if len(times):
                rows = with_deltas(empty(key[0], times), before)
                remember(state, rows, idle + len(times))
                yield rows
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values("timestamp", ignore_index=True)
        if last is not None:
            rows = rows[rows["timestamp"] > last].reset_index(drop=True)
        if not len(rows):
            return
        if last is not None and rows["timestamp"].iloc[0] - (last - idle * step) > expiry:
            last, before = None, [None] * len(CARRIED)
        def joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.concat([p.astype(object) for p in parts], ignore_index=True).infer_objects()

        parts, at = [], last
        for k, time in enumerate(rows["timestamp"]):
            if at is not None and time - at > step:
                if at != last and time - at > expiry:
                    yield with_deltas(joined(parts), before)
                    parts, before = [], [None] * len(CARRIED)
                else:
                    parts.append(empty(key[0], pd.date_range(at + step, time - step, freq=step)))
            parts.append(rows.iloc[k : k + 1])
            at = time
        out = with_deltas(joined(parts), before)
        remember(state, out, 0)
        yield out

    timed = windows.withColumn("_event_time", F.col("timestamp").cast("timestamp")).withWatermark("_event_time", lateness)
    return timed.groupBy("topic").applyInPandasWithState(advance, output, kept, "append", GroupStateTimeout.EventTimeTimeout)


def streaming_alerts(windows: DataFrame, model: PipelineModel, columns: Sequence[str], **state) -> DataFrame:
    """Score, level and alert of each final window and of the empty ones; ``state`` is passed on to ``with_previous_window``."""
    c = F.col
    full = with_previous_window(windows, **state).withColumns(
        {
            "flame_score": c("volume") * c("negative_rate"),
            "against_count": c("volume") * c("stance_against_rate"),
            "sentiment_polarity": c("stance_against_rate") - c("stance_favor_rate"),
        }
    )
    scored = score_windows(full, model, columns)
    return scored.withColumn("alert", alert_class(c("score")))


def run_available(stream: DataFrame, path: str, checkpoint: str, partition: str | None = "topic") -> None:
    """Process everything available, appending to a parquet table; a rerun resumes."""
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition:
        writer = writer.partitionBy(partition)
    writer.option("path", path).option("checkpointLocation", checkpoint).start().awaitTermination()


def stream_to_table(build: Callable[[], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """Run a job over the available input and return its output table."""
    stream = build()
    run_available(stream, path, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
