"""The stages from raw files to scores, each a function from table to table.

Stages are written at three points (standardised posts, features, labelled
windows); everything between them is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.operators import cleaning as cl
from emberscope.operators import dedupe as dd
from emberscope.operators import features as feat
from emberscope.operators import labels as lab
from emberscope.operators import metrics as met
from emberscope.operators import modelling as mo
from emberscope.functions.columns import numeric_columns
from emberscope.operators import series as ser
from emberscope.operators.splits import stratified_split
from emberscope.schemas import FEATURES_16
from emberscope.sources import posts as src
from emberscope.sources import tables as tab

Scorer = Callable[[DataFrame], DataFrame]


ROW_BITS = (1 << 33) - 1


def standardise(
    spark: SparkSession, raw_path: str | Sequence[str], zone: str = "Asia/Tokyo", undated: str | None = None, **read
) -> DataFrame:
    """Raw CSV folders to de-duplicated standard posts with their topic.

    Posts without a readable time are left out; ``undated`` names a table that
    tells per topic and file how many there are.
    """
    raw = src.read_raw_posts(spark, raw_path, **read)
    place = ["source_path", "file_offset", "row_pos"]
    posts = cl.standardize_posts(raw.withColumn("row_pos", F.col("row_pos").bitwiseAND(ROW_BITS)), zone, keep=["topic", *place])
    if undated:
        per_file = cl.undated_count(posts, ["topic", "source_path"])
        tab.write_table(per_file, undated, partition=None, order=None)
    return dd.keep_first(cl.drop_undated(posts), ["topic", "tweet_id"], place).drop(*place)


def features(posts: DataFrame, sentiment: Scorer, stance: Scorer) -> DataFrame:
    """Standard posts to the feature table with composites."""
    return feat.with_model_features(feat.feature_table(ser.hourly_evidence(stance(sentiment(posts)))))


def label(table: DataFrame, intervals: DataFrame, interval_zone: str | None = None) -> DataFrame:
    return lab.apply_intervals(table, intervals, interval_zone=interval_zone)


def raw_to_labelled(
    spark: SparkSession,
    raw_path: str,
    out: str,
    sentiment: Scorer,
    stance: Scorer,
    intervals: DataFrame,
    zone: str = "Asia/Tokyo",
    force: bool = False,
    **read,
) -> DataFrame:
    """Run all stages, keeping the tables that already exist unless forced."""
    if force or not tab.exists(spark, f"{out}/standardized"):
        posts = standardise(spark, raw_path, zone, undated=f"{out}/undated", **read)
        tab.write_table(posts, f"{out}/standardized")
    posts = tab.read_topics(spark, f"{out}/standardized")
    tab.write_if_absent(features(posts, sentiment, stance), f"{out}/features", force)
    table = tab.read_topics(spark, f"{out}/features")
    tab.write_if_absent(label(table, intervals), f"{out}/labelled", force)
    return tab.read_topics(spark, f"{out}/labelled")


def train_unified(
    labelled: DataFrame, columns: Sequence[str] = FEATURES_16, preset: mo.Preset = mo.UNIFIED, min_recall: float = 0.8,
    path: str | None = None, oversample: bool = False,
) -> dict[str, DataFrame]:
    """Train on all topics: hold-out metrics, per-topic accuracy, fold metrics, importance, misses.

    ``oversample`` balances the classes of the rows of each fit, never those a model is judged by; the class
    weight then has nothing left to do.
    """
    if oversample:
        preset = replace(preset, oversampled=True, weighted=False)
    rows = mo.with_parts(labelled.withColumn("label", F.col("is_controversy")))
    trained = mo.train_and_hold_out(rows, "unified", columns, preset, min_recall)
    scored = trained.scored.withColumn(
        "prediction", (F.col("probability") >= trained.threshold).cast("int")
    )
    hold_out = rows.filter("is_test = 1").select("topic", "timestamp", *columns)
    result = {
        "metrics": met.with_binary_metrics(met.confusion(scored)),
        "metrics_at_half": met.binary_metrics(trained.scored),
        "probabilities": trained.scored,
        "roc_auc": met.roc_auc(trained.scored),
        "topic_accuracy": met.topic_accuracy(scored),
        "folds": mo.summarise(
            mo.cross_validate(rows.drop("fold"), {"unified": (columns, preset)}), ["model"]
        ),
        "importance": mo.importance_table([trained], rows.filter("is_test = 1")),
        "missed": met.missed_positives(
            scored.join(hold_out, ["topic", "timestamp"]), [c for c in ("volume", "negative_rate", "flame_score") if c in columns]
        ),
    }
    if path:
        record = {"features": list(columns), "threshold": trained.threshold, "train_seconds": trained.train_seconds}
        tab.save_model(trained.model, path, record)
    return result


def train_single_topics(
    labelled: DataFrame, columns: Sequence[str] | None = None, presets: dict[str, mo.Preset] | None = None, path: str | None = None
) -> dict[str, DataFrame]:
    """A model of its own for every topic: hold-out metrics with area, and importance, per topic and preset.

    A fifth of each label's rows is held out.  Without ``columns`` all numeric ones but the label are features.
    A topic with one label only has nothing to learn and is left out; ``path`` keeps the models.
    """
    rows = labelled.withColumn("label", F.col("is_controversy"))
    names = list(columns or [c for c in numeric_columns(labelled) if c != "is_controversy"])
    stratum = rows.withColumn("stratum", F.concat_ws("|", "topic", "label"))
    parts = mo.materialise(stratified_split(stratum, "stratum").drop("stratum"), "single-topics")
    classes = parts.filter("is_test = 0").groupBy("topic").agg(F.count_distinct("label").alias("classes"))
    topics = sorted(r["topic"] for r in classes.filter("classes > 1").collect() if r["topic"] is not None)
    presets = presets or {"boosted": mo.SINGLE_TOPIC, "random_forest": mo.SINGLE_TOPIC_FOREST}

    def task(topic: str, name: str) -> Callable[[], tuple[DataFrame, DataFrame]]:
        def run() -> tuple[DataFrame, DataFrame]:
            own = parts.filter(F.col("topic") == topic)
            model = mo.fit(own.filter("is_test = 0"), names, presets[name])
            if path:
                tab.save_model(model, f"{path}/{topic}/{name}", {"features": names, "threshold": 0.5})
            scored = mo.predict(model, own.filter("is_test = 1"), names)
            known = mo.importances(mo.Trained(name, model, names, 0.5, 0.0, scored)) or []
            mark = {"topic": F.lit(topic), "model": F.lit(name)}
            weights = labelled.sparkSession.createDataFrame(known, "feature string, importance double")
            return scored.withColumns(mark), weights.withColumns(mark)

        return run

    done = mo.in_parallel([task(topic, name) for topic in topics for name in presets])
    if not done:
        raise ValueError("no topic has rows of both labels")
    scored, weights = (reduce(DataFrame.unionByName, parts_) for parts_ in zip(*done))
    by = ["topic", "model"]
    area = met.roc_auc(scored, by)
    return {"metrics": met.binary_metrics(scored, by).join(area, by, "left"), "importance": weights}
