"""Post tables, scores, features and labels derived from the supplied tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.functions.columns import ratio_or_zero
from emberscope.functions.scores import argmax_label, softmax
from emberscope.operators import features as feat
from emberscope.operators import labels as lab
from emberscope.operators import lexicon as lex
from emberscope.operators import series as ser
from emberscope.operators.sizing import spread_small_input
from emberscope.plans.constants import (
    EVAL_MODELS,
    INTERVALS,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    SUBSTRING_LEXICON,
)
from emberscope.schemas import ADDED_FEATURES, FEATURES_10

IMPORTANCE_FEATURES = [*FEATURES_10, *ADDED_FEATURES, "engagement_rate", "max_engagement"]


def _sql_literal(value: object) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return f"'{value}'" if isinstance(value, str) else str(value)


def local_rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Fixed rows as a local relation, whose exact size the planner knows."""
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


class Tables:
    """Lazy DataFrames over one folder of supplied tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("labels")

    @cached_property
    def posts(self) -> DataFrame:
        """Events as posts; ``doc_id`` points at the document that is the post's text."""
        n_docs = self.documents.agg(F.count(F.lit(1))).scalar()
        return self.events.select(
            F.col("event_id").cast("string").alias("tweet_id"),
            F.col("event_id").alias("row_pos"),
            F.col("ts").alias("timestamp"),
            F.col("event_type").alias("topic"),
            F.col("user_id").cast("string").alias("user_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("like_count"),
            F.floor("value").cast("bigint").alias("retweet_count"),
            (F.col("event_id") % 7).alias("reply_count"),
            (F.col("event_id") % n_docs).alias("doc_id"),
        )

    @cached_property
    def text_posts(self) -> DataFrame:
        """Posts with their text."""
        docs = self.documents.select("doc_id", F.col("text").alias("content"))
        return self.posts.join(docs, "doc_id", "left")

    @cached_property
    def lexicon(self) -> DataFrame:
        rows = [(w, 1) for w in POSITIVE_WORDS] + [(w, -1) for w in NEGATIVE_WORDS]
        return local_rows(self.spark, rows, "word, polarity")

    @cached_property
    def substring_lexicon(self) -> DataFrame:
        return local_rows(self.spark, SUBSTRING_LEXICON, "word, polarity")

    @cached_property
    def raw_intervals(self) -> DataFrame:
        return local_rows(
            self.spark, INTERVALS, "topic, position, start, end, label, description"
        )

    @cached_property
    def intervals(self) -> DataFrame:
        return lab.usable_intervals(self.raw_intervals)

    @cached_property
    def doc_texts(self) -> DataFrame:
        """Document texts, spread over the cores when the table is small."""
        return spread_small_input(self.documents.select("doc_id", "text"), "doc_id")

    @cached_property
    def doc_polarity(self) -> DataFrame:
        """Dictionary sentiment per distinct text, not per post."""
        scored = lex.with_token_sentiment(self.doc_texts, self.lexicon, "text")
        return scored.select(
            "doc_id", F.col("text").isNotNull().alias("has_text"),
            "positive_score", "negative_score", "polarity", "sentiment", "word_count",
        )

    @cached_property
    def doc_sentiment(self) -> DataFrame:
        """Default class probabilities: softmax of the lexicon hits."""
        p = softmax(
            {
                "POSITIVE": F.col("positive_score"),
                "NEUTRAL": F.lit(0.0),
                "NEGATIVE": F.col("negative_score"),
            }
        )
        out = self.doc_polarity.select(
            "doc_id", "has_text", *[v.alias(f"bert_{k.lower()}") for k, v in p.items()]
        )
        ordered = [(k, F.col(f"bert_{k.lower()}")) for k in p]
        return out.withColumn("bert_label", argmax_label(ordered))

    @cached_property
    def doc_substring(self) -> DataFrame:
        return lex.substring_score(
            self.doc_texts, self.substring_lexicon, "text"
        ).select("doc_id", "sentiment_score")

    def with_stance(self, df: DataFrame) -> DataFrame:
        """Stance from the document labels; unlabelled text is neutral."""
        out = df.join(self.labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
        label = (
            F.when(F.col("toxic") == 1, "AGAINST").when(F.col("quality") == 1, "FAVOR").otherwise("NEUTRAL")
        )
        out = out.withColumn("stance_label", label).drop("quality", "toxic")
        return out.withColumns(
            {
                f"stance_{s}": F.when(F.col("stance_label") == s.upper(), 0.8).otherwise(0.1)
                for s in ("against", "favor", "neutral")
            }
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Posts with sentiment and stance; both joins use the same key."""
        return self.with_stance(self.posts.join(self.doc_sentiment, "doc_id", "left")).withColumn(
            "content", F.when(F.col("has_text"), F.lit(True))
        )

    @cached_property
    def dict_posts(self) -> DataFrame:
        return self.posts.join(self.doc_polarity, "doc_id", "left")

    @cached_property
    def substring_posts(self) -> DataFrame:
        return lex.with_negative_flag(self.posts.join(self.doc_substring, "doc_id", "left"))

    @cached_property
    def features(self) -> DataFrame:
        return feat.feature_table(ser.hourly_evidence(self.scored))

    @cached_property
    def composites(self) -> DataFrame:
        return feat.with_model_features(self.features)

    @cached_property
    def labelled(self) -> DataFrame:
        return lab.apply_intervals(self.composites, self.intervals)

    @cached_property
    def analysed(self) -> DataFrame:
        """Scored posts as the window scorer wants them."""
        return self.scored.withColumn("is_negative", F.col("bert_label") == "NEGATIVE")

    @cached_property
    def rules(self) -> DataFrame:
        """Labelled windows times rule scores, one row per model."""
        top = F.max("volume").over(ser.Window.partitionBy("topic"))
        base = self.labelled.withColumn(
            "volume_norm", F.when(top > 0, F.col("volume") / top).otherwise(F.lit(0.0))
        )
        models = F.array(
            *[
                F.struct(F.lit(name).alias("model"), F.expr(expr).cast("double").alias("probability"))
                for name, expr in EVAL_MODELS.items()
            ]
        )
        return base.select(
            "topic", "timestamp", F.col("is_controversy").alias("label"), "volume",
            "negative_rate", "flame_score", F.inline(models),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        return self.rules.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))

    @cached_property
    def importance(self) -> DataFrame:
        """Absolute correlation of each feature with the label, per topic as the model."""
        y = F.col("is_controversy").cast("double")
        wide = self.labelled.groupBy("topic").agg(
            *[
                F.abs(ratio_or_zero(F.covar_pop(f, y), F.stddev_pop(f) * F.stddev_pop(y))).alias(f)
                for f in IMPORTANCE_FEATURES
            ]
        )
        long = wide.unpivot("topic", IMPORTANCE_FEATURES, "feature", "importance")
        return long.select(
            F.col("topic").alias("model"), "feature", F.round("importance", 6).alias("importance")
        )
