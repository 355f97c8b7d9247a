"""Queries: streaming jobs run over the supplied events as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.functions.scores import alert_class, score_level
from emberscope.plans.bindings import Tables
from emberscope.plans.queries_models import scoring_model
from emberscope.plans.registry import query
from emberscope.schemas import OPTIMIZED_FEATURES
from emberscope.session import shared_dir
from emberscope.streaming import windows as win

C = F.col


class StreamTables(Tables):
    """The same bindings with events read as a stream."""

    def table(self, name: str) -> DataFrame:
        static = super().table(name)
        if name != "events":
            return static
        return win.read_stream(self.spark, f"{self.dir}/events*.parquet", static.schema)


def feature_stream(t: Tables) -> tuple[DataFrame, str]:
    """Table of final windows written by the streaming job, and its folder."""
    live = StreamTables(t.spark, t.dir)
    root = shared_dir(t.spark, "stream")
    out = win.stream_to_table(
        lambda: win.streaming_features(live.analysed), f"{root}/features", f"{root}/features-log"
    )
    return out, root


FINAL_SQL = """SELECT topic, "timestamp", volume, negative_rate, stance_favor_rate, stance_against_rate, stance_neutral_rate
     FROM scoring_base WHERE "timestamp" + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""
RATES = ["negative_rate", "stance_favor_rate", "stance_against_rate", "stance_neutral_rate"]


@query("r1_streaming_features", FINAL_SQL, doubles=RATES)
def _r1(t: Tables) -> DataFrame:
    return feature_stream(t)[0]


UP_TO_FINAL_SQL = f"""SELECT s.* FROM scoring_series s JOIN (SELECT topic AS t, max("timestamp") AS last FROM ({FINAL_SQL}) GROUP BY 1)
     ON t = s.topic AND s."timestamp" <= last"""


def delta_stream(t: Tables) -> tuple[DataFrame, DataFrame, str]:
    """The table of final windows, the same as a stream, and the jobs' folder."""
    table, root = feature_stream(t)
    return table, win.read_stream(t.spark, f"{root}/features", table.schema), root


@query(
    "r2_streaming_deltas",
    f'SELECT topic, "timestamp", volume, delta_volume, delta_negative_rate FROM ({UP_TO_FINAL_SQL})',
    doubles=["delta_volume", "delta_negative_rate"],
)
def _r2(t: Tables) -> DataFrame:
    """Empty windows included, as in the batch series."""
    _, final, root = delta_stream(t)
    out = win.stream_to_table(
        lambda: win.with_previous_window(final, expire="3650 days"), f"{root}/deltas", f"{root}/deltas-log"
    )
    return out.select("topic", "timestamp", "volume", "delta_volume", "delta_negative_rate")


def alert_stream(t: Tables) -> DataFrame:
    _, final, root = delta_stream(t)
    model, _ = scoring_model(t)
    return win.stream_to_table(
        lambda: win.streaming_alerts(final, model, OPTIMIZED_FEATURES, expire="3650 days"), f"{root}/alerts", f"{root}/alerts-log"
    )


@query("r2_streaming_alerts")
def _r2b(t: Tables) -> DataFrame:
    return alert_stream(t)


@query(
    "r2_alert_windows",
    f"""SELECT topic, "timestamp", volume, coalesce(negative_rate, 0) AS negative_rate, TRUE AS score_fits, TRUE AS level_fits FROM ({UP_TO_FINAL_SQL})""",
    doubles=["negative_rate"],
)
def _r2c(t: Tables) -> DataFrame:
    """The windows of the alerts, and whether score, level and alert follow from the probability."""
    out = alert_stream(t)
    bands = (C("level") == score_level(C("score"))) & (C("alert") == alert_class(C("score")))
    fits = C("probability").between(0, 1) & (C("score") == F.floor(C("probability") * 100))
    volume = C("volume").cast("bigint").alias("volume")
    return out.select("topic", "timestamp", volume, "negative_rate", fits.alias("score_fits"), bands.alias("level_fits"))
