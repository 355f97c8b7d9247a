"""Post scoring by a pluggable batch scorer, and window scoring by a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.functions.columns import finite_or_zero
from emberscope.functions.scores import percent_score, score_level
from emberscope.operators.series import latest_window, scoring_series
from emberscope.schemas import DEFAULT_SENTIMENT, DEFAULT_STANCE

# A scorer takes a list of texts and returns one list of class probabilities per class name.
BatchScorer = Callable[[list[str]], dict[str, Sequence[float]]]


def with_default_stance(posts: DataFrame) -> DataFrame:
    """Neutral stance for pipelines without a stance scorer."""
    return posts.withColumns(
        {"stance_label": F.lit("NEUTRAL"), **{f"stance_{k}": F.lit(v) for k, v in DEFAULT_STANCE.items()}}
    )


def with_default_sentiment(posts: DataFrame) -> DataFrame:
    return posts.withColumns(
        {"bert_label": F.lit("NEUTRAL"), **{f"bert_{k}": F.lit(v) for k, v in DEFAULT_SENTIMENT.items()}}
    )


def score_posts(
    posts: DataFrame,
    make_scorer: Callable[[], BatchScorer],
    classes: Sequence[str],
    prefix: str,
    text: str = "content",
    batch_size: int = 32,
) -> DataFrame:
    """Class probabilities from a user-supplied scorer, loaded once per task.

    Columns ``<prefix>_<class>`` and ``<prefix>_label`` are added; the first
    class listed wins ties.  Posts stream through Arrow batches and are passed
    to the scorer ``batch_size`` texts at a time.
    """
    added = [T.StructField(f"{prefix}_{c.lower()}", T.DoubleType()) for c in classes]
    schema = T.StructType([*posts.schema.fields, *added, T.StructField(f"{prefix}_label", T.StringType())])
    names = list(classes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            texts = ["" if v is None else v for v in frame[text]]
            parts = [scorer(texts[i : i + batch_size]) for i in range(0, len(texts), batch_size)]
            probs = pd.DataFrame({c: [x for p in parts for x in p[c]] for c in names}, index=frame.index)
            out = frame.copy()
            for c in names:
                out[f"{prefix}_{c.lower()}"] = probs[c]
            out[f"{prefix}_label"] = probs.idxmax(axis=1) if len(probs) else pd.Series(dtype=str)
            yield out

    return posts.mapInPandas(run, schema)


def analyse_posts(
    posts: DataFrame,
    sentiment: Callable[[DataFrame], DataFrame],
    stance: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Sentiment, negative flag and stance; without a stance scorer all posts are neutral."""
    scored = sentiment(posts)
    scored = scored.withColumn("is_negative", F.col("bert_label") == "NEGATIVE")
    return stance(scored) if stance else with_default_stance(scored)


def score_windows(features: DataFrame, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Probability, 0-100 score and level of each window; missing features count as 0."""
    clean = features.withColumns({c: finite_or_zero(F.col(c)) for c in columns})
    scored = model.transform(clean)
    return (
        scored.withColumn("probability", vector_to_array("probability")[1])
        .withColumn("score", percent_score(F.col("probability")))
        .select("topic", "timestamp", "volume", "negative_rate", "probability", "score", score_level(F.col("score")).alias("level"))
    )


def score_series(analysed: DataFrame, model: PipelineModel, columns: Sequence[str], width: str = "1 hour") -> DataFrame:
    """Scores of all windows of analysed posts."""
    return score_windows(scoring_series(analysed, width), model, columns)


def current_score(scored: DataFrame, topics: DataFrame) -> DataFrame:
    """Latest window of every topic; a topic without windows scores 0, level ``unknown``."""
    latest = latest_window(scored)
    return topics.select("topic").distinct().join(latest, "topic", "left").withColumns(
        {
            "score": F.coalesce(F.col("score"), F.lit(0)),
            "level": F.coalesce(F.col("level"), F.lit("unknown")),
        }
    )
