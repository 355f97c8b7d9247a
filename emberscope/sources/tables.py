"""Reading and writing stage tables, results and models."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = "topic", order: str | None = "timestamp", mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write a stage table, one folder per topic, ordered by time inside each file.

    Rows are not gathered per topic: every task writes its own file into the
    topic folders, so a topic with most of the rows is written by many tasks.
    """
    writer_df = df
    keys = [k for k in (partition, order) if k and k in df.columns]
    if keys:
        writer_df = df.sortWithinPartitions(*keys)
    writer = writer_df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    if partition:
        writer = writer.partitionBy(partition)
    writer.format(fmt).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table was written to ``path``."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)


def write_if_absent(df: DataFrame, path: str, force: bool = False, **kwargs) -> None:
    """Skip the work when the table exists, unless forced."""
    write_table(df, path, mode="overwrite" if force else "ignore", **kwargs)


def replace_topics(df: DataFrame, path: str) -> None:
    """Overwrite only the topic partitions present in ``df``."""
    writer = df.sortWithinPartitions("topic", "timestamp").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("topic").parquet(path)


def read_topics(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Stage table with its topic column; a topic list prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("topic").isin(topics)) if topics else df


def write_json_row(spark: SparkSession, record: Mapping[str, Any], path: str) -> None:
    """One metadata record as JSON."""
    spark.createDataFrame([dict(record)]).coalesce(1).write.mode("overwrite").json(path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    """Model metadata files, one indented record each, to ``model, feature, importance``."""
    schema = "model string, model_name string, feature_importance map<string,double>"
    options = {"multiLine": "true", "recursiveFileLookup": "true"}
    meta = spark.read.options(**options).schema(schema).json(path)
    name = F.coalesce("model_name", "model").alias("model")
    return meta.select(name, F.explode("feature_importance").alias("feature", "importance"))


def save_model(model: PipelineModel, path: str, record: Mapping[str, Any]) -> None:
    """Fitted pipeline with its metadata (features, threshold, metrics) beside it."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    write_json_row(spark, record, f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """Fitted pipeline and its metadata record."""
    record = spark.read.json(f"{path}/metadata").first().asDict(recursive=True)
    return PipelineModel.load(f"{path}/model"), record
