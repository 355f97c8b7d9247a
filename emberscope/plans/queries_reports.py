"""Queries: summaries, leaderboards, set operations and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.functions.columns import finite_or_zero
from emberscope.operators import cleaning as cl
from emberscope.operators import metrics as met
from emberscope.operators import reports as rep
from emberscope.operators import series as ser
from emberscope.operators import splits as sp
from emberscope.operators.scaling import standardise
from emberscope.plans.bindings import Tables
from emberscope.plans.registry import query
from emberscope.schemas import ADDED_FEATURES, DEFAULT_CATEGORY, FEATURE_CATEGORIES

C = F.col
KEYS = ["topic", "timestamp"]


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("s1_discover_topics", "SELECT DISTINCT event_type AS topic FROM events")
def _s1(t: Tables) -> DataFrame:
    return rep.all_topics(t.posts)


@query(
    "a12_topic_balance",
    """SELECT topic, count(*) AS n, CAST(sum(is_controversy) AS BIGINT) AS positives,
              round(avg(is_controversy), 3) AS positive_rate FROM labelled GROUP BY 1""",
    doubles=["positive_rate"],
)
def _a12(t: Tables) -> DataFrame:
    return rep.topic_balance(t.labelled)


@query(
    "a13_distribution",
    """SELECT sentiment, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM dict_posts) AS share
       FROM dict_posts GROUP BY 1""",
    doubles=["share"],
)
def _a13(t: Tables) -> DataFrame:
    return rep.distribution(t.dict_posts, "sentiment")


@query(
    "a14_feature_summary",
    """SELECT topic, count(*) AS n, min("timestamp") AS first_time, max("timestamp") AS last_time,
              avg(volume) AS mean_volume, avg(negative_rate) AS mean_negative_rate,
              avg(stance_against_rate) AS mean_stance_against_rate, avg(stance_favor_rate) AS mean_stance_favor_rate,
              max(volume) AS max_volume, max(negative_rate) AS max_negative_rate,
              max(stance_against_rate) AS max_stance_against_rate FROM features GROUP BY 1""",
    doubles=["mean_volume", "mean_negative_rate", "mean_stance_against_rate", "mean_stance_favor_rate",
             "max_negative_rate", "max_stance_against_rate", "max_volume"],
)
def _a14(t: Tables) -> DataFrame:
    return rep.feature_summary(t.features)


def _peak_sql(name: str) -> str:
    return (
        f"max({name}) AS max_{name}, "
        f"arg_max(\"timestamp\", struct_pack(v := {name}, t := -epoch_us(\"timestamp\"))) AS at_{name}"
    )


@query(
    "a15_peaks",
    f"""SELECT topic, {', '.join(_peak_sql(n) for n in ('volume', 'delta_volume', 'delta_volume_rate', 'negative_rate'))}
        FROM features GROUP BY 1""",
    doubles=["max_volume", "max_delta_volume", "max_delta_volume_rate", "max_negative_rate"],
)
def _a15(t: Tables) -> DataFrame:
    return rep.peaks(t.features)


@query("a16_hours_of_day", 'SELECT CAST(hour("timestamp") AS BIGINT) AS "hour", count(*) AS n FROM posts GROUP BY 1')
def _a16(t: Tables) -> DataFrame:
    return rep.hours_of_day(t.posts)


@query(
    "a20_dataset_summary",
    """SELECT topic, count(*) AS n, min("timestamp") AS "start", max("timestamp") AS "end",
              count(DISTINCT reply_count) AS files,
              string_agg(DISTINCT 'q' || (like_count % 3), ',' ORDER BY 'q' || (like_count % 3)) AS queries,
              count(DISTINCT 'q' || (like_count % 3)) AS query_count,
              CAST(floor(date_diff('second', min("timestamp"), max("timestamp")) / 86400) + 1 AS BIGINT) AS days
       FROM posts GROUP BY 1""",
)
def _a20(t: Tables) -> DataFrame:
    filed = t.posts.withColumns(
        {
            "source_file": C("reply_count").cast("string"),
            "query": F.concat(F.lit("q"), (C("like_count") % 3).cast("string")),
        }
    )
    return rep.topic_dataset_summary(filed)


@query(
    "a22_mean_importance",
    """SELECT feature, importance FROM (SELECT feature, avg(importance) AS importance FROM importance GROUP BY 1)
       ORDER BY round(importance, 9) DESC, feature LIMIT 10""",
    doubles=["importance"],
)
def _a22(t: Tables) -> DataFrame:
    mean = rep.mean_importance(t.importance).withColumn("importance", F.round("importance", 9))
    return rep.top_n(mean, "importance", 10, "feature")


CATEGORY_SQL = (
    "CASE feature " + " ".join(f"WHEN '{f}' THEN '{c}'" for f, c in FEATURE_CATEGORIES.items())
    + f" ELSE '{DEFAULT_CATEGORY}' END"
)


@query(
    "j9_feature_category",
    f"SELECT model, feature, importance, {CATEGORY_SQL} AS category FROM importance",
    doubles=["importance"],
)
def _j9(t: Tables) -> DataFrame:
    return rep.with_category(t.importance)


@query(
    "a23_category_totals",
    f"""SELECT category, sum(importance) AS total_importance, count(*) AS features FROM (
          SELECT {CATEGORY_SQL} AS category, importance FROM (
            SELECT feature, avg(importance) AS importance FROM importance GROUP BY 1)
          ORDER BY round(importance, 9) DESC, feature LIMIT 10) GROUP BY 1""",
    doubles=["total_importance"],
)
def _a23(t: Tables) -> DataFrame:
    mean = rep.mean_importance(t.importance).withColumn("importance", F.round("importance", 9))
    top = rep.top_n(mean, "importance", 10, "feature")
    return rep.category_totals(rep.with_category(top)).orderBy(F.desc("total_importance"))


def _box_sql(feature: str) -> str:
    return f"""SELECT is_controversy, min({feature}) AS lowest, quantile_cont({feature}, 0.25) AS q1,
                      quantile_cont({feature}, 0.5) AS median, quantile_cont({feature}, 0.75) AS q3,
                      max({feature}) AS highest FROM labelled GROUP BY 1"""


BOX_DOUBLES = ["lowest", "q1", "median", "q3", "highest"]


@query("a25_box_volume", _box_sql("volume"), doubles=BOX_DOUBLES)
def _a25(t: Tables) -> DataFrame:
    return rep.box_profile(t.labelled, "volume")


@query("a25_box_negative_rate", _box_sql("negative_rate"), doubles=BOX_DOUBLES)
def _a25b(t: Tables) -> DataFrame:
    return rep.box_profile(t.labelled, "negative_rate")


@query("a25_box_against_rate", _box_sql("stance_against_rate"), doubles=BOX_DOUBLES)
def _a25c(t: Tables) -> DataFrame:
    return rep.box_profile(t.labelled, "stance_against_rate")


@query(
    "a26_profile_by_label",
    """SELECT is_controversy, count(*) AS n, avg(volume) AS mean_volume, avg(negative_rate) AS mean_negative_rate
       FROM labelled GROUP BY 1""",
    doubles=["mean_volume", "mean_negative_rate"],
)
def _a26(t: Tables) -> DataFrame:
    return rep.by_label_profile(t.labelled)


@query(
    "a27_score_summary",
    """SELECT topic, model, arg_max(score, "timestamp") AS latest_score, avg(score) AS mean_score, max(score) AS max_score,
              count(*) AS windows FROM (
         SELECT topic, model, "timestamp", CAST(trunc(probability * 100) AS BIGINT) AS score FROM rules)
       GROUP BY 1, 2""",
    doubles=["mean_score"],
)
def _a27(t: Tables) -> DataFrame:
    from emberscope.functions.scores import percent_score

    return rep.score_summary(t.rules.withColumn("score", percent_score(C("probability"))), ["topic", "model"])


NULLABLE = ["negative_rate", "stance_favor_rate", "flame_score", "volume"]


@query(
    "a28_null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM scoring_series" for c in NULLABLE
    ),
)
def _a28(t: Tables) -> DataFrame:
    return cl.null_counts(ser.scoring_series(t.analysed), NULLABLE)


@query("a29_topic_count", "SELECT count(DISTINCT topic) AS topics FROM posts")
def _a29(t: Tables) -> DataFrame:
    return t.posts.agg(F.count_distinct("topic").alias("topics"))


@query(
    "a30_sentiment_summary",
    """SELECT count(*) AS n, count(*) FILTER (WHERE is_negative) AS negatives,
              CAST(count(*) FILTER (WHERE is_negative) AS DOUBLE) / count(*) * 100 AS negative_percent,
              avg(sentiment_score) AS mean_score FROM substring_posts""",
    doubles=["negative_percent", "mean_score"],
)
def _a30(t: Tables) -> DataFrame:
    return rep.sentiment_summary(t.substring_posts)


@query("a31_confusion", "SELECT model, tp, fp, fn, tn FROM model_metrics")
def _a31(t: Tables) -> DataFrame:
    return met.confusion(t.predictions, ["model"])


@query("s5_union_files", """SELECT topic, "timestamp", volume FROM (
         SELECT topic, "timestamp", volume FROM features UNION ALL
         SELECT topic, "timestamp", CAST(NULL AS DOUBLE) AS volume FROM dict_series)""")
def _s5(t: Tables) -> DataFrame:
    a = t.features.select(*KEYS, "volume")
    b = ser.dictionary_series(t.dict_posts).select(*KEYS)
    return a.unionByName(b, allowMissingColumns=True)


@query("s12_labelled_topic", """SELECT topic, "timestamp", volume, is_controversy FROM labelled WHERE topic IN ('error', 'click')""")
def _s12(t: Tables) -> DataFrame:
    return t.labelled.filter(C("topic").isin("error", "click")).select(*KEYS, "volume", "is_controversy")


@query("u1_union_topics", "SELECT topic, count(*) AS n, CAST(sum(is_controversy) AS BIGINT) AS positives FROM labelled GROUP BY 1")
def _u1(t: Tables) -> DataFrame:
    error, rest = t.labelled.filter("topic = 'error'"), t.labelled.filter("topic <> 'error'")
    both = error.unionByName(rest)
    return both.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("is_controversy").alias("positives"))


@query(
    "u2_distinct_topics",
    """SELECT event_type AS topic FROM events UNION SELECT topic FROM intervals UNION SELECT source FROM documents""",
)
def _u2(t: Tables) -> DataFrame:
    return rep.all_topics(t.posts, t.intervals, t.documents.select(C("source").alias("topic")))


@query(
    "u3_topic_status",
    """SELECT topic, TRUE AS original, topic IN (SELECT topic FROM intervals) AS label_config,
              topic IN (SELECT topic FROM features) AS feature,
              topic IN (SELECT topic FROM labelled WHERE is_controversy = 1) AS labelled_positive
       FROM (SELECT DISTINCT topic FROM posts)""",
)
def _u3(t: Tables) -> DataFrame:
    return rep.topic_status(
        rep.all_topics(t.posts),
        {
            "original": t.posts,
            "label_config": t.intervals,
            "feature": t.features,
            "labelled_positive": t.labelled.filter("is_controversy = 1"),
        },
    )


@query(
    "u3_topics_missing_labels",
    """SELECT DISTINCT topic FROM posts WHERE topic NOT IN (SELECT topic FROM intervals)""",
)
def _u3b(t: Tables) -> DataFrame:
    return rep.all_topics(rep.complement(t.posts, t.intervals))


@query(
    "j4_join_result_sets",
    """SELECT topic, model, f1_a, f1_b, (f1_b - f1_a) * 100 AS f1_diff FROM (
         SELECT a.topic, b.model, a.f1 AS f1_a, b.f1 AS f1_b FROM topic_metrics a JOIN topic_metrics b
              ON a.topic = b.topic AND a.model = 'blend' AND b.model <> 'blend')""",
    doubles=["f1_a", "f1_b", "f1_diff"],
)
def _j4(t: Tables) -> DataFrame:
    """Every other model against the first."""
    m = met.binary_metrics(t.rules, ["topic", "model"])
    return rep.result_difference(m.filter("model = 'blend'"), m.filter("model <> 'blend'"), "topic", "f1", ("_a", "_b"), ["model"])


@query(
    "t6_degraded_improved",
    """SELECT topic, model, f1_diff, CASE WHEN f1_diff < 0 THEN 'degraded' ELSE 'improved' END AS change FROM (
         SELECT a.topic, b.model, (b.f1 - a.f1) * 100 AS f1_diff FROM topic_metrics a JOIN topic_metrics b
              ON a.topic = b.topic AND a.model = 'blend' AND b.model <> 'blend') WHERE f1_diff < 0 OR f1_diff > 1""",
    doubles=["f1_diff"],
)
def _t6(t: Tables) -> DataFrame:
    m = met.binary_metrics(t.rules, ["topic", "model"])
    base = m.filter("model = 'blend'").select("topic", C("f1").alias("base_f1"))
    diff = m.filter("model <> 'blend'").join(base, "topic")
    diff = diff.select("topic", "model", ((C("f1") - C("base_f1")) * 100).alias("f1_diff"))
    return rep.degraded_and_improved(diff, "f1_diff")


@query(
    "j10_hold_out_parts",
    """SELECT part, count(*) AS n, CAST(sum(is_controversy) AS BIGINT) AS positives FROM (
         SELECT CASE WHEN topic = 'error' THEN 'test' ELSE 'train' END AS part, is_controversy FROM labelled) GROUP BY 1""",
)
def _j10(t: Tables) -> DataFrame:
    _, test = sp.hold_out_topic(t.labelled, "error")
    train = rep.complement(t.labelled, test.select("topic"))
    both = train.select(F.lit("train").alias("part"), "is_controversy").unionByName(
        test.select(F.lit("test").alias("part"), "is_controversy")
    )
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("is_controversy").alias("positives"))


@query(
    "j11_semi_filter",
    f"SELECT model, feature, importance FROM importance WHERE feature IN {_list(ADDED_FEATURES)}",
    doubles=["importance"],
)
def _j11(t: Tables) -> DataFrame:
    values = ", ".join(f"('{f}')" for f in ADDED_FEATURES)
    wanted = t.spark.sql(f"SELECT * FROM VALUES {values} AS v(feature)")
    return t.importance.join(F.broadcast(wanted), "feature", "left_semi").select("model", "feature", "importance")


@query(
    "w8_leaderboard",
    """SELECT model, f1, accuracy, row_number() OVER (ORDER BY f1 DESC, model) AS "rank" FROM model_metrics""",
    doubles=["f1", "accuracy"],
)
def _w8(t: Tables) -> DataFrame:
    m = met.binary_metrics(t.rules, ["model"]).select("model", "f1", "accuracy")
    return rep.leaderboard(m)


@query(
    "w9_rank_within_all",
    f"""SELECT feature, importance, "rank" FROM (
          SELECT feature, importance, row_number() OVER (ORDER BY round(importance, 9) DESC, feature) AS "rank"
          FROM (SELECT feature, avg(importance) AS importance FROM importance GROUP BY 1))
        WHERE feature IN {_list(ADDED_FEATURES)}""",
    doubles=["importance"],
)
def _w9(t: Tables) -> DataFrame:
    mean = rep.mean_importance(t.importance).withColumn("importance", F.round("importance", 9))
    return rep.rank_within_all(mean, ADDED_FEATURES)


@query(
    "t4_top_importance",
    """SELECT feature, importance FROM (SELECT feature, avg(importance) AS importance FROM importance GROUP BY 1)
       ORDER BY round(importance, 9) DESC, feature LIMIT 15""",
    doubles=["importance"],
)
def _t4(t: Tables) -> DataFrame:
    mean = rep.mean_importance(t.importance).withColumn("importance", F.round("importance", 9))
    return rep.top_n(mean, "importance", 15, "feature")


@query(
    "t5_best_and_worst",
    """SELECT arg_max(model, struct_pack(v := f1, m := model)) AS best_model, max(f1) AS best_f1,
              arg_min(model, struct_pack(v := f1, m := model)) AS worst_model, min(f1) AS worst_f1 FROM model_metrics""",
    doubles=["best_f1", "worst_f1"],
)
def _t5(t: Tables) -> DataFrame:
    m = met.binary_metrics(t.rules, ["model"])
    key = F.struct("f1", "model")
    return m.agg(
        F.max_by("model", key).alias("best_model"), F.max("f1").alias("best_f1"),
        F.min_by("model", key).alias("worst_model"), F.min("f1").alias("worst_f1"),
    )


SCALED = ["volume", "negative_rate", "stance_against_rate", "flame_score"]


@query(
    "m2_standardise",
    f"""SELECT topic, "timestamp", {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in SCALED)} FROM labelled,
          (SELECT {', '.join(f'avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}' for c in SCALED)} FROM labelled)""",
    doubles=SCALED,
)
def _m2(t: Tables) -> DataFrame:
    return standardise(t.labelled, SCALED).select(*KEYS, *SCALED)


@query(
    "m7_class_weight",
    """SELECT topic, count(*) FILTER (WHERE is_controversy = 0) AS n_neg, count(*) FILTER (WHERE is_controversy = 1) AS n_pos,
              coalesce(CAST(count(*) FILTER (WHERE is_controversy = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE is_controversy = 1), 0), 1) AS pos_weight
       FROM labelled GROUP BY 1""",
    doubles=["pos_weight"],
)
def _m7(t: Tables) -> DataFrame:
    return met.class_weight(t.labelled, ["topic"])


HASH_SQL = "md5(topic || '|' || CAST(\"timestamp\" AS VARCHAR))"
FOLD_SQL = "md5(topic || '|' || CAST(\"timestamp\" AS VARCHAR) || '|fold')"


@query(
    "m9_stratified_split",
    f"""SELECT topic, "timestamp", is_controversy, CAST(rn <= ceil(n * 0.2::DOUBLE) AS INTEGER) AS is_test FROM (
          SELECT topic, "timestamp", is_controversy, row_number() OVER (PARTITION BY is_controversy ORDER BY {HASH_SQL}, topic, "timestamp") AS rn,
                 count(*) OVER (PARTITION BY is_controversy) AS n FROM labelled)""",
)
def _m9(t: Tables) -> DataFrame:
    return sp.stratified_split(t.labelled.select(*KEYS, "is_controversy"))


@query(
    "m10_stratified_folds",
    f"""SELECT topic, "timestamp", is_controversy, CAST(row_number() OVER (PARTITION BY is_controversy ORDER BY {FOLD_SQL}, topic, "timestamp") % 5 AS INTEGER) AS fold
        FROM labelled""",
)
def _m10(t: Tables) -> DataFrame:
    return sp.stratified_folds(t.labelled.select(*KEYS, "is_controversy"))


METRIC_DOUBLES = ["accuracy", "precision", "recall", "f1"]


@query("m11_binary_metrics", "SELECT model, tp, fp, fn, tn, accuracy, precision, recall, f1 FROM model_metrics", doubles=METRIC_DOUBLES)
def _m11(t: Tables) -> DataFrame:
    return met.binary_metrics(t.rules, ["model"])


@query(
    "m12_weighted_metrics",
    """SELECT model, CAST(sum(s) AS BIGINT) AS n, sum(p * s) / sum(s) AS weighted_precision, sum(r * s) / sum(s) AS weighted_recall,
              sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * s) / sum(s) AS weighted_f1 FROM (
         SELECT a.model, a.c, a.s, coalesce(CAST(a.h AS DOUBLE) / nullif(g.g, 0), 0) AS p, CAST(a.h AS DOUBLE) / a.s AS r FROM
           (SELECT model, label AS c, count(*) AS s, count(*) FILTER (WHERE label = prediction) AS h FROM predictions GROUP BY 1, 2) a
           LEFT JOIN (SELECT model, prediction AS c, count(*) AS g FROM predictions GROUP BY 1, 2) g ON g.model = a.model AND g.c = a.c)
       GROUP BY 1""",
    doubles=["weighted_precision", "weighted_recall", "weighted_f1"],
)
def _m12(t: Tables) -> DataFrame:
    return met.weighted_metrics(t.predictions, ["model"])


AUC_SQL = """SELECT {by}, sum(CASE WHEN label = 1 THEN rk - 0.5 ELSE 0 END) AS u, count(*) FILTER (WHERE label = 1) AS np, count(*) FILTER (WHERE label = 0) AS nn
      FROM (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY probability) + count(*) OVER (PARTITION BY {by}, probability) * 0.5 AS rk FROM rules) GROUP BY {by}"""


@query(
    "m13_roc_auc",
    f"""SELECT model, (u - np * (np + 1) * 0.5::DOUBLE) / nullif(CAST(np AS DOUBLE) * nn, 0) AS roc_auc
        FROM ({AUC_SQL.format(by='model')})""",
    doubles=["roc_auc"],
)
def _m13(t: Tables) -> DataFrame:
    return met.roc_auc(t.rules, ["model"])


@query(
    "m13_roc_auc_per_topic",
    f"""SELECT topic, model, (u - np * (np + 1) * 0.5::DOUBLE) / nullif(CAST(np AS DOUBLE) * nn, 0) AS roc_auc
        FROM ({AUC_SQL.format(by='topic, model')})""",
    doubles=["roc_auc"],
)
def _m13b(t: Tables) -> DataFrame:
    return met.roc_auc(t.rules, ["topic", "model"])


CURVE_SQL = """SELECT model, threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(np, 0), 0) AS recall FROM (
      SELECT model, probability AS threshold, np,
             sum(p) OVER (PARTITION BY model ORDER BY probability DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY probability DESC) AS fp
      FROM (SELECT model, probability, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n,
                   sum(count(*) FILTER (WHERE label = 1)) OVER (PARTITION BY model) AS np FROM rules GROUP BY 1, 2))"""
F1_SQL = f"SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ({CURVE_SQL})"


@query(
    "m14_threshold_curve",
    F1_SQL,
    doubles=["threshold", "precision", "recall", "f1"],
)
def _m14(t: Tables) -> DataFrame:
    return met.threshold_curve(t.rules, ["model"])


def _best_sql(recall: float) -> str:
    return f"""SELECT m.model, coalesce(b.threshold, 0.5) AS best_threshold, coalesce(b.f1, 0) AS best_f1
               FROM (SELECT DISTINCT model FROM rules) m LEFT JOIN (
                 SELECT model, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn
                   FROM ({F1_SQL}) WHERE f1 > 0 AND recall >= {recall}) WHERE rn = 1) b ON b.model = m.model"""


@query("m14_best_f1_threshold", _best_sql(0.0), doubles=["best_threshold", "best_f1"])
def _m14b(t: Tables) -> DataFrame:
    return met.best_threshold(t.rules, ["model"])


@query("m14_recall_bound_threshold", _best_sql(0.8), doubles=["best_threshold", "best_f1"])
def _m14c(t: Tables) -> DataFrame:
    return met.best_threshold(t.rules, ["model"], min_recall=0.8)


@query(
    "m15_hold_out_topic_rules",
    """SELECT topic, model, total - n AS n_train, n AS n_test, accuracy, precision, recall, f1
       FROM topic_metrics JOIN (SELECT model AS m, count(*) AS total FROM rules GROUP BY 1) ON m = model WHERE n >= 5""",
    doubles=METRIC_DOUBLES,
)
def _m15(t: Tables) -> DataFrame:
    per_topic = met.binary_metrics(t.rules, ["topic", "model"])
    sizes = per_topic.withColumn("n_test", C("tp") + C("fp") + C("fn") + C("tn"))
    totals = sizes.groupBy("model").agg(F.sum("n_test").alias("total"))
    out = sizes.join(totals, "model").filter("n_test >= 5")
    return out.select(
        "topic", "model", (C("total") - C("n_test")).alias("n_train"), "n_test", *METRIC_DOUBLES
    )


DELTAS_SQL = """SELECT b.model, b.topic, a.f1 AS "before", b.f1 AS "after" FROM topic_metrics a JOIN topic_metrics b
                ON b.model = a.model AND a.topic = 'click' AND b.topic <> 'click'"""


@query(
    "m20_run_deltas",
    f"""SELECT model, topic, "before", "after", ("after" - "before") * 100 AS points,
               ("after" - "before") / nullif("before", 0) * 100 AS percent FROM ({DELTAS_SQL})""",
    doubles=['"before"', '"after"', "points", "percent"],
)
def _m20(t: Tables) -> DataFrame:
    """Every other topic against the first."""
    return rep.run_deltas(met.binary_metrics(t.rules, ["topic", "model"]), "f1", "topic", "click")


@query(
    "m21_best_combination",
    """SELECT s.model, s.f1 AS standard_f1, c.f1 AS cross_f1, (s.f1 + c.f1) / 2 AS mean_f1 FROM model_metrics s
       JOIN (SELECT model, avg(f1) AS f1 FROM topic_metrics GROUP BY 1) c ON c.model = s.model
       ORDER BY mean_f1 DESC, s.model LIMIT 1""",
    doubles=["standard_f1", "cross_f1", "mean_f1"],
)
def _m21(t: Tables) -> DataFrame:
    cross = met.binary_metrics(t.rules, ["topic", "model"]).groupBy("model").agg(F.avg("f1").alias("f1"))
    return rep.best_combination(met.binary_metrics(t.rules, ["model"]), cross)


@query(
    "m21_improved_models",
    f"""SELECT topic, count(*) FILTER (WHERE "after" > "before") AS improved, count(*) AS models FROM ({DELTAS_SQL}) GROUP BY 1""",
)
def _m21b(t: Tables) -> DataFrame:
    deltas = rep.run_deltas(met.binary_metrics(t.rules, ["topic", "model"]), "f1", "topic", "click")
    return deltas.groupBy("topic").agg(
        F.count_if(C("after") > C("before")).alias("improved"), F.count(F.lit(1)).alias("models")
    )


@query(
    "m22_missed_positives",
    """SELECT model, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS missed,
              avg(volume) FILTER (WHERE label = 1 AND prediction = 0) AS mean_volume,
              avg(negative_rate) FILTER (WHERE label = 1 AND prediction = 0) AS mean_negative_rate,
              avg(flame_score) FILTER (WHERE label = 1 AND prediction = 0) AS mean_flame_score FROM predictions GROUP BY 1""",
    doubles=["mean_volume", "mean_negative_rate", "mean_flame_score"],
)
def _m22(t: Tables) -> DataFrame:
    return met.missed_positives(t.predictions, ["volume", "negative_rate", "flame_score"], by=["model"])


@query(
    "m23_topic_accuracy",
    f"""SELECT topic, model, count(*) AS n, avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS accuracy FROM (
          SELECT p.topic, p.model, p.label, p.prediction FROM predictions p JOIN (
            SELECT topic, "timestamp", row_number() OVER (PARTITION BY is_controversy ORDER BY {HASH_SQL}, topic, "timestamp") AS rn,
                   count(*) OVER (PARTITION BY is_controversy) AS n FROM labelled) s
          ON s.topic = p.topic AND s."timestamp" = p."timestamp" WHERE s.rn <= ceil(s.n * 0.2::DOUBLE)) GROUP BY 1, 2""",
    doubles=["accuracy"],
)
def _m23(t: Tables) -> DataFrame:
    """Every model on the same hold-out rows: each is split by the same hash within model and label."""
    marked = t.predictions.select(*KEYS, "model", "label", "prediction", F.concat_ws("|", "model", "label").alias("stratum"))
    split = sp.stratified_split(marked, label="stratum")
    return met.topic_accuracy(split.filter("is_test = 1"), by=["topic", "model"])


@query(
    "m24_added_feature_share",
    f"""SELECT sum(CASE WHEN feature IN {_list(ADDED_FEATURES)} THEN importance ELSE 0 END) AS added_importance,
               sum(importance) AS total_importance,
               sum(CASE WHEN feature IN {_list(ADDED_FEATURES)} THEN importance ELSE 0 END) / sum(importance) * 100 AS added_percent,
               count(*) FILTER (WHERE feature IN {_list(ADDED_FEATURES)} AND importance > 2.0) AS strong_added
        FROM (SELECT feature, avg(importance) * 100 AS importance FROM importance GROUP BY 1)""",
    doubles=["added_importance", "total_importance", "added_percent"],
)
def _m24(t: Tables) -> DataFrame:
    mean = rep.mean_importance(t.importance).withColumn("importance", C("importance") * 100)
    return rep.importance_gain(mean, ADDED_FEATURES)


@query(
    "m25_rule_scores",
    """SELECT topic, "timestamp", least(1.0, coalesce(volume, 0) / top * 0.5 + coalesce(negative_rate, 0) * 0.5) AS probability,
              CAST(trunc(least(1.0, coalesce(volume, 0) / top * 0.5 + coalesce(negative_rate, 0) * 0.5) * 100) AS INTEGER) AS score
       FROM (SELECT *, CAST(max(volume) OVER (PARTITION BY topic) AS DOUBLE) AS top FROM scoring_series)""",
    doubles=["probability"],
)
def _m25(t: Tables) -> DataFrame:
    from emberscope.functions.scores import percent_score

    top = F.max("volume").over(ser.Window.partitionBy("topic"))
    norm = finite_or_zero(C("volume")) / top
    p = F.least(F.lit(1.0), norm * 0.5 + finite_or_zero(C("negative_rate")) * 0.5)
    scored = ser.scoring_series(t.analysed).withColumn("probability", p)
    return scored.select(*KEYS, "probability", percent_score(C("probability")).alias("score"))
