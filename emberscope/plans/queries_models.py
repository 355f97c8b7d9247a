"""Queries: fitted models, comparisons and model scoring (checked by invariants)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.functions import composites as comp
from emberscope.functions.columns import finite_or_zero
from emberscope.operators import features as feat
from emberscope.operators import metrics as met
from emberscope.operators import modelling as mo
from emberscope.operators import scoring as sco
from emberscope.operators import series as ser
from emberscope.operators import stance as st
from emberscope.functions.scores import score_level
from emberscope.plans import jobs
from emberscope.plans.bindings import Tables
from emberscope.plans.constants import NEGATIVE_WORDS, POSITIVE_WORDS
from emberscope.plans.registry import query
from emberscope.schemas import (
    ENGAGEMENT_FEATURE_SETS,
    FEATURE_SETS,
    FEATURES_10,
    FEATURES_14,
    FEATURES_16,
    FEATURES_17,
    OPTIMIZED_FEATURES,
    SENTIMENT_FEATURE_SETS,
    STANCE_FEATURE_SETS,
)

C = F.col


def training_rows(t: Tables) -> DataFrame:
    """Labelled windows, materialised once per query."""
    return mo.materialise(t.labelled.withColumn("label", C("is_controversy")), "labelled")


def wide_rows(t: Tables) -> DataFrame:
    """Labelled windows with every feature of the ablations.

    Texts are scored once for both series, and the windows written before whole-table statistics and codes read them:
    each of these would otherwise go back to all posts and texts.
    """
    t.doc_polarity = mo.materialise(t.doc_polarity, "polarity")
    df = mo.materialise(feat.add_dictionary_rates(t.labelled, ser.dictionary_series(t.dict_posts)), "windows")
    df = comp.with_dictionary_composites(comp.with_high_flags(comp.with_logs(df), volume_min=5), volume_min=5)
    df = ser.with_first_difference(comp.with_spread_features(df), ["dict_negative_rate"])
    df = ser.with_encoded(ser.with_z_score(df))
    return mo.materialise(df.withColumn("label", C("is_controversy")), "wide")


ASSEMBLED_SQL = ", ".join(f"CASE WHEN isfinite({c}) THEN CAST({c} AS DOUBLE) ELSE 0 END" for c in FEATURES_16)


@query(
    "m1_assemble_features",
    f"""SELECT topic, "timestamp", {len(FEATURES_16)} AS n_features, greatest({ASSEMBLED_SQL}) AS largest FROM labelled""",
    doubles=["largest"],
)
def _m1(t: Tables) -> DataFrame:
    clean = t.labelled.select("topic", "timestamp", *[finite_or_zero(C(c)).alias(c) for c in FEATURES_16])
    out = VectorAssembler(inputCols=FEATURES_16, outputCol="v", handleInvalid="keep").transform(clean)
    arr = vector_to_array("v")
    return out.select(
        "topic", "timestamp", F.size(arr).alias("n_features"), F.array_max(arr).alias("largest")
    )


def _fit_query(t: Tables, name: str) -> DataFrame:
    rows = training_rows(t)
    return mo.predict(mo.fit(rows, FEATURES_16, mo.PRESETS[name]), rows, FEATURES_16)


@query("m3_boosted_trees")
def _m3(t: Tables) -> DataFrame:
    return _fit_query(t, "boosted_symmetric")


@query("m3_boosted_weighted")
def _m3b(t: Tables) -> DataFrame:
    rows = training_rows(t)
    return mo.predict(mo.fit(rows, FEATURES_16, mo.UNIFIED), rows, FEATURES_16)


@query("m4_random_forest")
def _m4(t: Tables) -> DataFrame:
    return _fit_query(t, "random_forest")


@query("m5_logistic")
def _m5(t: Tables) -> DataFrame:
    return _fit_query(t, "logistic")


@query("m6_rbf_svm")
def _m6(t: Tables) -> DataFrame:
    return _fit_query(t, "rbf_svm")


@query("m8_oversample_minority")
def _m8(t: Tables) -> DataFrame:
    return mo.oversample_minority(training_rows(t), FEATURES_10)


@query("m10_cross_validation")
def _m10(t: Tables) -> DataFrame:
    runs = {"unified": (FEATURES_16, mo.UNIFIED)}
    return mo.summarise(mo.cross_validate(training_rows(t), runs), ["model"])


@query("m15_hold_out_topic_model")
def _m15(t: Tables) -> DataFrame:
    return mo.cross_topic(training_rows(t), FEATURES_17, {"cross_topic": mo.CROSS_TOPIC}, encode_topic=True)


@query("m16_model_topic_grid")
def _m16(t: Tables) -> DataFrame:
    return mo.cross_topic(training_rows(t), FEATURES_16, mo.PRESETS)


@query("m17_importance")
def _m17(t: Tables) -> DataFrame:
    rows = training_rows(t)
    trained = mo.train_all(rows, FEATURES_16, mo.PRESETS)
    return mo.importance_table(trained, rows)


def _ablation(t: Tables, sets: dict[str, list[str]]) -> DataFrame:
    return mo.ablation(wide_rows(t), sets, mo.FEATURE_ABLATION)


@query("m18_feature_sets")
def _m18(t: Tables) -> DataFrame:
    return _ablation(t, FEATURE_SETS)


@query("m18_sentiment_sets")
def _m18b(t: Tables) -> DataFrame:
    return _ablation(t, SENTIMENT_FEATURE_SETS)


@query("m18_stance_sets")
def _m18c(t: Tables) -> DataFrame:
    return _ablation(t, STANCE_FEATURE_SETS)


SETS_14 = {"10": FEATURES_10, "14": FEATURES_14}


@query("m18_14_features")
def _m18e(t: Tables) -> DataFrame:
    """Ten features against the set published under 14: hold-out and folds."""
    return mo.hold_out_and_folds(wide_rows(t), SETS_14, mo.CROSS_TOPIC)


@query("m18_14_held_out_topics")
def _m18h(t: Tables) -> DataFrame:
    """The same sets on topics that the model has not seen."""
    rows = training_rows(t)
    parts = [mo.cross_topic(rows, fs, {n: mo.CROSS_TOPIC}) for n, fs in SETS_14.items()]
    return mo.summarise(parts[0].unionByName(parts[1]), ["model"], ("accuracy", "f1")).withColumnRenamed("model", "feature_set")


@query("m18_engagement_sets")
def _m18f(t: Tables) -> DataFrame:
    """Seven, ten and fifteen features, the last with virtual engagement."""
    key = F.concat_ws("|", "topic", C("timestamp").cast("string"))
    rows = t.labelled.withColumn("label", C("is_controversy"))
    virtual = mo.materialise(comp.with_virtual_engagement(rows, key), "virtual")
    return mo.hold_out_and_folds(virtual, ENGAGEMENT_FEATURE_SETS, mo.FEATURE_ABLATION)


@query("m3_single_topics")
def _m3c(t: Tables) -> DataFrame:
    """A model of its own for every topic that has both labels."""
    return jobs.train_single_topics(t.labelled, FEATURES_16)["metrics"]


@query(
    "m3_single_topic_sizes",
    """SELECT topic, model, CAST(sum(cut) AS BIGINT) AS n_test, CAST(sum(CASE WHEN label = 1 THEN cut ELSE 0 END) AS BIGINT) AS n_positive FROM (
         SELECT topic, is_controversy AS label, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS cut FROM labelled GROUP BY 1, 2)
       , (SELECT unnest(['stump', 'trees']) AS model)
       WHERE topic IN (SELECT topic FROM labelled GROUP BY 1 HAVING count(DISTINCT is_controversy) = 2) GROUP BY 1, 2""",
)
def _m3d(t: Tables) -> DataFrame:
    """The same job with small models: which topics it takes and what it holds out."""
    small = {"stump": mo.Preset("gbt", {"maxIter": 2, "maxDepth": 1}, weighted=True), "trees": mo.Preset("forest", {"numTrees": 3, "maxDepth": 2})}
    m = jobs.train_single_topics(t.labelled, FEATURES_16, small)["metrics"]
    positive = C("tp") + C("fn")
    return m.select("topic", "model", (positive + C("fp") + C("tn")).alias("n_test"), positive.alias("n_positive"))


QUICK = {"logistic": mo.Preset("logistic", {"C": 1.0, "maxIter": 20}, scaled=True), "trees": mo.Preset("forest", {"numTrees": 3, "maxDepth": 2})}


@query(
    "m16_grid_sizes",
    """SELECT topic, model, (SELECT count(*) FROM labelled) - n AS n_train, n AS n_test, positives FROM (
         SELECT topic, count(*) AS n, CAST(sum(is_controversy) AS BIGINT) AS positives FROM labelled GROUP BY 1),
       (SELECT unnest(['logistic', 'trees']) AS model) WHERE n >= 5""",
)
def _m16b(t: Tables) -> DataFrame:
    """The grid of models and held-out topics with small models: its rows, sizes and positives."""
    grid = mo.cross_topic(training_rows(t), FEATURES_16, QUICK)
    return grid.select("topic", "model", "n_train", "n_test", (C("tp") + C("fn")).alias("positives"))


@query(
    "m18_set_sizes",
    f"""SELECT feature_set, n_features, n_test, n_positive FROM (VALUES {', '.join(f"('{n}', {len(fs)})" for n, fs in ENGAGEMENT_FEATURE_SETS.items())}) v(feature_set, n_features),
        (SELECT CAST(sum(cut) AS BIGINT) AS n_test, CAST(max(cut) FILTER (WHERE label = 1) AS BIGINT) AS n_positive FROM (
           SELECT is_controversy AS label, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS cut FROM labelled GROUP BY 1))""",
)
def _m18g(t: Tables) -> DataFrame:
    """The ablation with a small model: its sets and what it holds out."""
    key = F.concat_ws("|", "topic", C("timestamp").cast("string"))
    rows = mo.materialise(comp.with_virtual_engagement(t.labelled.withColumn("label", C("is_controversy")), key), "virtual")
    out = mo.hold_out_and_folds(rows, ENGAGEMENT_FEATURE_SETS, QUICK["trees"], k=2)
    positive = C("tp") + C("fn")
    return out.select("feature_set", "n_features", (positive + C("fp") + C("tn")).alias("n_test"), positive.alias("n_positive"))


@query(
    "m8_oversample_counts",
    """SELECT is_controversy AS label, CASE WHEN n < top THEN top ELSE n END AS n, top - n AS synthetic FROM (
         SELECT is_controversy, count(*) AS n, max(count(*)) OVER () AS top FROM labelled GROUP BY 1)""",
)
def _m8b(t: Tables) -> DataFrame:
    out = mo.oversample_minority(training_rows(t), FEATURES_10)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("synthetic").cast("bigint").alias("synthetic"))


@query(
    "f25_virtual_engagement_bounds",
    """SELECT topic, "timestamp", flame_score, TRUE AS in_bounds, TRUE AS adds_up FROM labelled""",
    doubles=["flame_score"],
)
def _f25(t: Tables) -> DataFrame:
    """The factor lies in [0.5, 1.5) and the other columns follow from it."""
    key = F.concat_ws("|", "topic", C("timestamp").cast("string"))
    rows = comp.with_virtual_engagement(t.labelled, key)
    low, high = C("flame_score") * 0.5, C("flame_score") * 1.5
    total = C("avg_engagement") * C("volume")
    near = (F.abs(C("total_engagement") - total) < 1e-9) & (F.abs(C("engagement_rate") - total / (C("volume") + 1)) < 1e-9)
    return rows.select("topic", "timestamp", "flame_score", C("avg_engagement").between(low, high).alias("in_bounds"), near.alias("adds_up"))


@query("m18_10_16_17_features")
def _m18d(t: Tables) -> DataFrame:
    return _ablation(t, {"10": FEATURES_10, "16": FEATURES_16, "17": FEATURES_17})


@query("m19_model_leaderboard")
def _m19(t: Tables) -> DataFrame:
    trained = mo.train_all(training_rows(t), FEATURES_16, mo.PRESETS)
    return mo.compare(trained)


def scoring_model(t: Tables):
    """Model of the window scorer, fitted on labelled scoring windows."""
    from emberscope.operators.labels import apply_intervals

    labelled = apply_intervals(ser.scoring_series(t.analysed), t.intervals, out="label")
    rows = mo.materialise(labelled, "scoring")
    return mo.fit(rows, OPTIMIZED_FEATURES, mo.PRESETS["logistic"]), rows


@query("m25_score_windows")
def _m25(t: Tables) -> DataFrame:
    model, rows = scoring_model(t)
    return sco.score_windows(rows, model, OPTIMIZED_FEATURES)


@query("m26_score_topic_series")
def _m26(t: Tables) -> DataFrame:
    model, _ = scoring_model(t)
    return sco.score_series(t.analysed, model, OPTIMIZED_FEATURES)


@query(
    "m26_series_windows",
    """SELECT topic, "timestamp", volume, coalesce(negative_rate, 0) AS negative_rate, TRUE AS fits FROM scoring_series""",
    doubles=["negative_rate"],
)
def _m26b(t: Tables) -> DataFrame:
    """The windows that are scored, and whether score and level follow from the probability."""
    model, _ = scoring_model(t)
    out = sco.score_series(t.analysed, model, OPTIMIZED_FEATURES)
    fits = C("probability").between(0, 1) & (C("score") == F.floor(C("probability") * 100)) & (C("level") == score_level(C("score")))
    return out.select("topic", "timestamp", C("volume").cast("bigint").alias("volume"), "negative_rate", fits.alias("fits"))


@query(
    "m27_current_windows",
    """SELECT n.topic, w."timestamp", w.volume, w.topic IS NULL AS is_unknown FROM (
         SELECT topic FROM posts UNION SELECT lang FROM documents) n
       LEFT JOIN (SELECT topic, "timestamp", volume FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY "timestamp" DESC) AS rn
                  FROM scoring_series) WHERE rn = 1) w ON w.topic = n.topic""",
)
def _m27b(t: Tables) -> DataFrame:
    """Which window stands for each topic, and which topics have none."""
    volume = C("volume").cast("bigint").alias("volume")
    return _m27(t).select("topic", "timestamp", volume, (C("level") == "unknown").alias("is_unknown"))


@query("m27_current_score")
def _m27(t: Tables) -> DataFrame:
    model, rows = scoring_model(t)
    topics = t.posts.select("topic").union(t.documents.select(C("lang").alias("topic")))
    return sco.current_score(sco.score_windows(rows, model, OPTIMIZED_FEATURES), topics)


def stance_rows(t: Tables) -> DataFrame:
    """Documents with the stance that their labels stand for."""
    return t.with_stance(t.documents).select("doc_id", C("text").alias("content"), C("stance_label").alias("label"))


@query("m30_stance_training")
def _m30(t: Tables) -> DataFrame:
    """Metrics on the fifth of the documents, by hash of the id, that the fit does not see."""
    rows = stance_rows(t)
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = st.train_stance(rows.filter(~held_out))
    scored = st.predict_stance(model, rows.filter(held_out))
    return met.weighted_metrics(
        scored.select("label", "stance_label"), label="label", pred="stance_label"
    )


@query("m29_stance_scoring")
def _m29(t: Tables) -> DataFrame:
    rows = stance_rows(t)
    model = st.train_stance(rows)
    return st.predict_stance(model, rows.select("doc_id", "content")).drop("content")


def hit_scorer():
    """A stand-in batch scorer: softmax of word hits, as a model would return."""
    import numpy as np

    good, bad = set(POSITIVE_WORDS), set(NEGATIVE_WORDS)

    def score(texts: list[str]) -> dict[str, list[float]]:
        raw = np.array([[sum(w in good for w in x.split()), 0, sum(w in bad for w in x.split())] for x in texts], float)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return {c: p[:, i].tolist() for i, c in enumerate(("POSITIVE", "NEUTRAL", "NEGATIVE"))}

    return score


D4_SQL = """SELECT doc_id, CASE WHEN p >= greatest(u, n) THEN 'POSITIVE' WHEN u >= n THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS bert_label,
       p AS bert_positive, u AS bert_neutral, n AS bert_negative FROM (
         SELECT doc_id, exp(a - m) / z AS p, exp(-m) / z AS u, exp(b - m) / z AS n FROM (
           SELECT *, exp(a - m) + exp(-m) + exp(b - m) AS z FROM (
             SELECT doc_id, a, b, CAST(greatest(a, b, 0) AS DOUBLE) AS m FROM (
               SELECT doc_id, len(list_filter(words, lambda w: w IN {good})) AS a, len(list_filter(words, lambda w: w IN {bad})) AS b FROM (
                 SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x85]+') AS words FROM documents)))))"""


@query(
    "d4_batch_scorer",
    D4_SQL.format(good=f"({', '.join(repr(w) for w in POSITIVE_WORDS)})", bad=f"({', '.join(repr(w) for w in NEGATIVE_WORDS)})"),
    doubles=["bert_positive", "bert_neutral", "bert_negative"],
)
def _d4(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", C("text").alias("content"))
    scored = sco.score_posts(docs, hit_scorer, ["POSITIVE", "NEUTRAL", "NEGATIVE"], "bert")
    return scored.drop("content")
