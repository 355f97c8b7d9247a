"""Queries: file scans and sinks, run over files written from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.operators import cleaning as cl
from emberscope.operators import modelling as mo
from emberscope.plans import jobs
from emberscope.plans.bindings import Tables
from emberscope.plans.queries_models import training_rows
from emberscope.plans.registry import query
from emberscope.schemas import FEATURES_10, HEADER_KEYS, RAW_POST_COLUMNS
from emberscope.session import shared_dir
from emberscope.sources import posts as src
from emberscope.sources import tables as tab

C = F.col


def raw_rows(t: Tables) -> DataFrame:
    """Documents as raw posts, one topic per language; texts keep commas, quotes, ``#`` and newlines."""
    missing = {c: F.lit(None).cast("string") for c in RAW_POST_COLUMNS}
    known = {
        "date": F.lit("2024-01-01T00:00:00.000Z"),
        "id": C("doc_id").cast("string"),
        "content": C("text"),
        "user": C("source"),
        "like_count": C("n_chars").cast("string"),
    }
    return t.documents.select(
        *[{**missing, **known}[c].alias(c) for c in RAW_POST_COLUMNS], C("lang").alias("topic")
    )


def export_raw(t: Tables) -> str:
    """Write raw post CSVs, one folder per topic, each with a ``#`` header file."""
    root = shared_dir(t.spark, "raw")
    (
        raw_rows(t).write.partitionBy("topic").option("header", "true").option("escape", '"')
        .option("nullValue", "").option("emptyValue", "").csv(root)
    )
    counts = t.documents.groupBy(C("lang").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    values = {
        "query": F.concat(F.lit("about "), "topic"),
        "collected_at": F.lit("2024-02-01 09:30:00"),
        "original_count": C("n").cast("string"),
    }
    lines = [F.concat(F.lit(f"# {HEADER_KEYS[k]}: "), v) for k, v in values.items()]
    header = counts.select("topic", F.concat_ws("\n", *lines).alias("value"))
    # Text files carry no header flag, so the comment lines go into files of their own.
    header.write.mode("append").partitionBy("topic").option("compression", "none").text(f"{root}-heads")
    return root


@query(
    "s2_scan_csv",
    """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS topic, source AS "user", md5(text) AS content_md5,
              n_chars AS like_count FROM documents""",
)
def _s2(t: Tables) -> DataFrame:
    raw = src.read_raw_posts(t.spark, export_raw(t))
    return raw.select("id", "topic", "user", F.md5("content").alias("content_md5"), cl.to_count(C("like_count")).alias("like_count"))


@query("s3_bad_rows", "SELECT lang AS topic, count(*) AS good, count(*) AS bad FROM documents GROUP BY 1")
def _s3(t: Tables) -> DataFrame:
    """Every good line is followed by one with an unexpected number of fields."""
    root = shared_dir(t.spark, "ragged")
    fields = ["2024-01-01", C("doc_id").cast("string"), "u", "text", "user", "name", "1", "2", "3"]
    good = F.concat_ws(",", *[f if not isinstance(f, str) else F.lit(f) for f in fields])
    lines = t.documents.select(
        C("lang").alias("topic"), F.explode(F.array(good, F.concat(good, F.lit(",4,5,6")))).alias("value")
    )
    lines.write.partitionBy("topic").text(root)
    raw = src.read_raw_posts(
        t.spark, root, multi_line=False, keep_bad_rows=True, header=False, glob="*.txt"
    )
    return raw.groupBy("topic").agg(
        F.count_if(~C("bad_row")).alias("good"), F.count_if("bad_row").alias("bad")
    )


@query(
    "s4_comment_metadata",
    """SELECT lang AS topic, 'about ' || lang AS "query", '2024-02-01 09:30:00' AS collected_at, count(*) AS original_count
       FROM documents GROUP BY 1, 2""",
)
def _s4(t: Tables) -> DataFrame:
    heads = f"{export_raw(t)}-heads"
    return src.read_comment_metadata(t.spark, heads, glob="*.txt").drop("source_file")


@query("s6_recursive_files", "SELECT DISTINCT lang AS topic FROM documents")
def _s6(t: Tables) -> DataFrame:
    files = src.list_files(t.spark, export_raw(t))
    return files.select(src.file_topic(C("path")).alias("topic")).distinct()


@query("s1_topics_from_folders", "SELECT DISTINCT lang AS topic FROM documents")
def _s1(t: Tables) -> DataFrame:
    return src.list_topics(t.spark, export_raw(t))


DIC_SQL = "SELECT lang AS word, CAST((n_chars % 21) - 10 AS DOUBLE) / 10 AS score FROM documents"


@query(
    "s9_polarity_dictionary",
    f"""SELECT word, CASE WHEN score > 0.5 THEN 1 ELSE -1 END AS polarity, count(*) AS n FROM ({DIC_SQL})
        WHERE score > 0.5 OR score < -0.5 GROUP BY 1, 2""",
)
def _s9(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "dictionary")
    score = ((C("n_chars") % 21) - 10).cast("double") / 10
    t.documents.select(
        F.concat_ws(":", "lang", F.lit("読み"), F.lit("名詞"), score.cast("string")).alias("value")
    ).write.text(root)
    lexicon = src.read_polarity_dictionary(t.spark, root)
    return lexicon.groupBy("word", "polarity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s10_read_lexicon",
    """SELECT word, polarity FROM (
         SELECT lang AS word, CAST(max(n_chars) AS DOUBLE) AS polarity FROM documents GROUP BY 1)""",
    doubles=["polarity"],
)
def _s10(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "lexicon")
    words = t.documents.groupBy(C("lang").alias("word")).agg(F.max("n_chars").cast("double").alias("polarity"))
    words.write.option("header", "true").csv(root)
    return src.read_lexicon(t.spark, root)


@query(
    "s14_partitioned_table",
    """SELECT topic, "timestamp", volume, is_controversy FROM labelled WHERE topic = 'error'""",
)
def _s14(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "table")
    tab.write_table(t.labelled.select("topic", "timestamp", "volume", "is_controversy"), root)
    return tab.read_topics(t.spark, root, ["error"])


@query(
    "s16_write_if_absent",
    """SELECT topic, count(*) AS n FROM features GROUP BY 1""",
)
def _s16(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "once")
    table = t.features.select("topic", "timestamp", "volume")
    tab.write_if_absent(table, root)
    tab.write_if_absent(table.limit(1), root)
    tab.replace_topics(table.filter("topic = 'error'"), root)
    return tab.read_topics(t.spark, root).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("s15_metadata_record", "SELECT 'labelled' AS name, count(*) AS n, max(volume) AS max_volume FROM labelled")
def _s15(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "record")
    row = t.labelled.agg(F.count(F.lit(1)).alias("n"), F.max("volume").alias("max_volume")).first()
    tab.write_json_row(t.spark, {"name": "labelled", **row.asDict()}, root)
    return t.spark.read.schema("name string, n bigint, max_volume double").json(root)


@query("s17_save_load_model")
def _s17(t: Tables) -> DataFrame:
    rows = training_rows(t)
    root = shared_dir(t.spark, "model")
    tab.save_model(mo.fit(rows, FEATURES_10, mo.PRESETS["logistic"]), root, {"features": FEATURES_10, "threshold": 0.5})
    model, record = tab.load_model(t.spark, root)
    return mo.predict(model, rows, record["features"])


@query("s17_reloaded_model", 'SELECT topic, "timestamp", is_controversy AS label, TRUE AS same FROM labelled')
def _s17b(t: Tables) -> DataFrame:
    """A reloaded model says the same of every row as the one that was saved."""
    rows = training_rows(t)
    root = shared_dir(t.spark, "model")
    saved = mo.fit(rows, FEATURES_10, mo.PRESETS["logistic"])
    tab.save_model(saved, root, {"features": FEATURES_10, "threshold": 0.5})
    model, record = tab.load_model(t.spark, root)
    before = mo.predict(saved, rows, FEATURES_10).withColumnRenamed("probability", "before")
    after = mo.predict(model, rows, record["features"])
    return after.join(before, ["topic", "timestamp", "label"]).select(
        "topic", "timestamp", "label", (C("probability") == C("before")).alias("same")
    )


@query(
    "s18_importance_from_metadata",
    "SELECT model, feature, importance FROM importance",
    doubles=["importance"],
)
def _s18(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "metadata")
    per_model = t.importance.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("feature_importance")
    )
    record = F.to_json(F.struct(C("model").alias("model_name"), "feature_importance"), {"pretty": "true"})
    per_model.select(C("model").alias("folder"), record.alias("value")).write.partitionBy("folder").text(root)
    return tab.read_importances(t.spark, root)


def export_posts(t: Tables) -> str:
    """Write the posts as raw CSVs, one folder per topic, every post twice."""
    root = shared_dir(t.spark, "posts")
    text = {c: F.lit(None).cast("string") for c in RAW_POST_COLUMNS}
    text |= {
        "date": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "id": C("tweet_id"),
        "content": C("doc_id").cast("string"),
        "user": C("user_id"),
        **{c: C(c).cast("string") for c in ("reply_count", "retweet_count", "like_count")},
    }
    rows = t.posts.select(*[v.alias(k) for k, v in text.items()], "topic")
    rows.unionByName(rows).write.partitionBy("topic").option("header", "true").csv(root)
    return root


@query(
    "raw_files_to_labelled",
    """SELECT topic, "timestamp", volume, negative_rate, delta_volume_rate, engagement_rate, flame_score, is_controversy
       FROM labelled""",
    doubles=["volume", "negative_rate", "delta_volume_rate", "engagement_rate", "flame_score"],
)
def _raw_to_labelled(t: Tables) -> DataFrame:
    """All stages, from CSV files to labelled windows; post text is looked up by document number."""

    def sentiment(posts: DataFrame) -> DataFrame:
        return posts.withColumn("doc_id", C("content").cast("bigint")).join(t.doc_sentiment, "doc_id", "left")

    out = jobs.raw_to_labelled(
        t.spark, export_posts(t), shared_dir(t.spark, "stages"), sentiment, t.with_stance, t.intervals,
        zone="UTC", multi_line=False,
    )
    return out.select(
        "topic", "timestamp", "volume", "negative_rate", "delta_volume_rate", "engagement_rate",
        "flame_score", "is_controversy",
    )


@query("unified_training")
def _unified(t: Tables) -> DataFrame:
    result = jobs.train_unified(t.labelled)
    return result["metrics"].select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")
