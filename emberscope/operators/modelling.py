"""Training, comparison and explanation of flare-up classifiers.

The fits run as distributed Spark ML jobs; only the list of models, folds or
topics is walked on the driver, a few fits at a time.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.functions.columns import finite_or_zero
from emberscope.operators import metrics as met
from emberscope.operators.neighbours import nearest
from emberscope.operators.reports import leaderboard
from emberscope.operators.sizing import hash_order, hash_rank
from emberscope.operators.splits import stratified_folds, stratified_split
from emberscope.session import ensure_checkpoint_dir, shared_dir

SEED = 42
PARALLEL_FITS = 8


@dataclass(frozen=True)
class Preset:
    """One estimator with its fixed settings."""

    kind: str
    options: dict = field(default_factory=dict)
    scaled: bool = False
    weighted: bool = False
    oversampled: bool = False


# ---------------------------------------------------------------------------
# Settings of the compared models.
# ---------------------------------------------------------------------------
PRESETS: dict[str, Preset] = {
    "boosted_symmetric": Preset("gbt", {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}),
    "boosted_regularised": Preset(
        "gbt",
        {"maxIter": 100, "maxDepth": 3, "stepSize": 0.05, "minInstancesPerNode": 3,
         "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    ),
    "boosted_plain": Preset("gbt", {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "minInstancesPerNode": 20}),
    "random_forest": Preset("forest", {"numTrees": 100, "maxDepth": 10}),
    "rbf_svm": Preset("rbf_svm", {"C": 10.0, "components": 64}, scaled=True),
    "logistic": Preset("logistic", {"C": 1.0, "maxIter": 1000}, scaled=True),
}
UNIFIED = Preset(
    "gbt",
    {"maxIter": 100, "maxDepth": 3, "stepSize": 0.05, "minInstancesPerNode": 3,
     "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    weighted=True,
)
SINGLE_TOPIC = Preset("gbt", {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}, weighted=True)
FEATURE_ABLATION = Preset("gbt", {"maxIter": 100, "maxDepth": 4, "stepSize": 0.1}, weighted=True)
SINGLE_TOPIC_FOREST = Preset("forest", {"numTrees": 100, "maxDepth": 10}, weighted=True)
CROSS_TOPIC = Preset("gbt", {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1})


# Settings of this library: folds for calibration; boosted fits store their lineage every so many rounds.
CALIBRATION_FOLDS = 3
CHECKPOINT_ROUNDS = 50


def with_rounds(presets: dict[str, Preset], rounds: int) -> dict[str, Preset]:
    """The same presets with another number of boosting rounds."""
    return {
        n: replace(p, options={**p.options, "maxIter": rounds}) if p.kind == "gbt" else p
        for n, p in presets.items()
    }


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Repeated fits then start from the small table, and losing an executor
    costs no recomputation of the posts.  Rows are dealt into files of an even,
    worthwhile size: every round of a tree learner runs one task per file.
    """
    path = shared_dir(df.sparkSession, name)
    df.hint("rebalance").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_parallel(tasks: Sequence[Callable[[], object]], width: int = PARALLEL_FITS) -> list:
    """Run a few driver-side fits at a time; each one is its own set of Spark jobs.

    Every fit has a scheduler pool of its own.  Where the session schedules fairly, all of them advance together
    and the many short jobs of one fit fill the gaps that another leaves.
    """
    if not tasks:
        return []
    context = SparkSession.active().sparkContext

    def pooled(numbered: tuple[int, Callable[[], object]]) -> object:
        context.setLocalProperty("spark.scheduler.pool", f"fit-{numbered[0] % width}")
        return numbered[1]()

    run = inheritable_thread_target(SparkSession.active())(pooled)
    with ThreadPool(min(width, len(tasks))) as pool:
        return pool.map(run, list(enumerate(tasks)), chunksize=1)


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Positive rows weigh negatives over positives."""
    weight = met.class_weight(df, label=label).select("pos_weight").scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


@dataclass(frozen=True)
class Moments:
    """Rows, and mean and population deviation of each feature; a constant one counts as deviation 1."""

    rows: int
    mean: list[float]
    scale: list[float]


def moments(train: DataFrame, features: Sequence[str]) -> Moments:
    """All that scaled models need to know of the training rows, by one aggregate."""
    stats = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    d = range(len(features))
    return Moments(stats["n"], [stats[f"m{i}"] or 0.0 for i in d], [stats[f"s{i}"] or 1.0 for i in d])


def _scaling_stage(stats: Moments, features: Sequence[str]) -> SQLTransformer:
    """The features less their mean, over their population deviation, as columns of their own."""
    scaled = ", ".join(
        f"(`{c}` - {m!r}D) / {s!r}D AS _z{i}" for i, (c, m, s) in enumerate(zip(features, stats.mean, stats.scale))
    )
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def _fourier_stage(stats: Moments, features: Sequence[str], components: int) -> SQLTransformer:
    """Random Fourier features of the standardised columns, approximating an RBF kernel.

    The mean and deviation of each feature are folded into the random weights,
    so the stage is one expression over the raw columns.
    """
    d = len(features)
    gamma = 1.0 / d
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(components, d)) / np.array(stats.scale)
    b = rng.uniform(0.0, 2.0 * math.pi, size=components) - w @ np.array(stats.mean)
    norm = math.sqrt(2.0 / components)
    rows = ", ".join(
        f"named_struct('b', {float(b[j])!r}D, 'w', array({', '.join(f'{float(v)!r}D' for v in w[j])}))"
        for j in range(components)
    )
    dot = " + ".join(f"r.w[{i}] * `{c}`" for i, c in enumerate(features))
    wave = f"transform(array({rows}), r -> {norm!r}D * cos({dot} + r.b))"
    columns = ", ".join(f"_rff[{j}] AS _rff{j}" for j in range(components))
    return SQLTransformer(statement=f"SELECT *, {columns} FROM (SELECT *, {wave} AS _rff FROM __THIS__)")


def _estimator(preset: Preset, rows: int, inputs: str):
    common = {"featuresCol": inputs, "labelCol": "label"}
    if preset.weighted:
        common["weightCol"] = "weight"
    options = dict(preset.options)
    if preset.kind == "gbt":
        return GBTClassifier(seed=SEED, checkpointInterval=CHECKPOINT_ROUNDS, **common, **options)
    if preset.kind == "forest":
        return RandomForestClassifier(seed=SEED, **common, **options)
    reg = 1.0 / (options.pop("C") * max(rows, 1))
    if preset.kind == "logistic":
        return LogisticRegression(regParam=reg, standardization=False, **common, **options)
    return LinearSVC(regParam=reg, maxIter=100, tol=1e-4, standardization=False, **common)


def fit(train: DataFrame, features: Sequence[str], preset: Preset) -> PipelineModel:
    """Fit a preset on the feature columns; rows need ``label``, and an oversampled preset the row key.

    The margins of the RBF machine become probabilities by a sigmoid fitted to
    margins of rows that the machine behind them has not seen.
    """
    ensure_checkpoint_dir(train.sparkSession)
    if preset.oversampled:
        train = materialise(oversample_minority(train, features), "oversampled")
    clean = train.select(
        *[finite_or_zero(F.col(c)).alias(c) for c in features], F.col("label").cast("double").alias("label")
    )
    if preset.weighted:
        clean = with_class_weight(clean)
    stats = moments(clean, features) if preset.scaled else Moments(0, [], [])
    if preset.kind == "rbf_svm":
        return _fit_machine(clean, features, preset, stats)
    inputs, stages = list(features), []
    if preset.scaled:
        stages, inputs = [_scaling_stage(stats, features)], [f"_z{i}" for i in range(len(features))]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="inputs", handleInvalid="keep"))
    return Pipeline(stages=[*stages, _estimator(preset, stats.rows, "inputs")]).fit(clean)


def _fit_machine(clean: DataFrame, features: Sequence[str], preset: Preset, stats: Moments) -> PipelineModel:
    """The RBF machine with its calibration: out-of-fold margins against smoothed labels.

    A label stands for a probability a little off 0 and 1, namely (positives + 1) / (positives + 2) and
    1 / (negatives + 2); each row therefore enters the sigmoid's fit once for either class, by weight.
    """
    components = preset.options["components"]
    inputs = [f"_rff{j}" for j in range(components)]
    prepare = Pipeline(
        stages=[_fourier_stage(stats, features, components), VectorAssembler(inputCols=inputs, outputCol="inputs")]
    ).fit(clean)
    prepared = prepare.transform(clean)
    fold = F.pmod(F.xxhash64(*features), F.lit(CALIBRATION_FOLDS))
    slim = ["inputs", "label", *(["weight"] if preset.weighted else [])]
    folded = materialise(prepared.select(*slim, fold.alias("fold")), "machine-inputs")
    machine = _estimator(Preset("rbf_svm", {"C": preset.options["C"]}, True, preset.weighted), stats.rows, "inputs")
    margin = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])

    def held_out(k: int) -> DataFrame:
        part = machine.fit(folded.filter(F.col("fold") != k)).transform(folded.filter(F.col("fold") == k))
        return margin.transform(part).select("margin", "label")

    folds = [r["fold"] for r in folded.groupBy("fold").agg(F.count_distinct("label").alias("classes")).collect()]
    both = folded.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    final, *parts = in_parallel([lambda: machine.fit(folded), *[lambda k=k: held_out(k) for k in folds if len(folds) > 1]])
    if not parts or not both["p"] or not both["n"]:
        return PipelineModel(stages=[*prepare.stages, final])
    sure = F.when(F.col("label") == 1, (both["p"] + 1.0) / (both["p"] + 2.0)).otherwise(1.0 / (both["n"] + 2.0))
    classes = F.array(F.struct(F.lit(1.0).alias("label"), sure.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - sure).alias("weight")))
    soft = materialise(_union(parts).select("margin", F.inline(classes)), "margins")
    sigmoid = LogisticRegression(
        featuresCol="margin", weightCol="weight", standardization=False, maxIter=100,
        rawPredictionCol="calibrated", predictionCol="calibrated_prediction",
    ).fit(soft)
    return PipelineModel(stages=[*prepare.stages, final, margin, sigmoid])


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("topic", "timestamp", "label")) -> DataFrame:
    """Positive-class probability of each row; margins without calibration go through the logistic function."""
    clean = df.withColumns({c: finite_or_zero(F.col(c)) for c in features})
    out = model.transform(clean)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    kept = [k for k in keep if k in out.columns]
    return out.select(*kept, p.alias("probability"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cross_topic(
    df: DataFrame, features: Sequence[str], presets: dict[str, Preset], min_rows: int = 5, encode_topic: bool = False
) -> DataFrame:
    """Hold out one topic at a time and score it with models of the others.

    One row per held-out topic and model: training and test size and metrics.
    Topics with fewer than ``min_rows`` rows are skipped.
    """
    sizes = {r["topic"]: r["n"] for r in df.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())

    def task(topic: str, name: str, preset: Preset) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            train, test = df.filter(F.col("topic") != topic), df.filter(F.col("topic") == topic)
            if encode_topic:
                from emberscope.operators.series import encoder, encode_with

                codes = encoder(train)
                train = encode_with(train.drop("topic_encoded"), codes)
                test = test.withColumn("topic_encoded", F.lit(-1))
            scored = predict(fit(train, features, preset), test, features)
            return scored.withColumns(
                {"model": F.lit(name), "n_train": F.lit(total - sizes[topic]), "n_test": F.lit(sizes[topic])}
            )

        return run

    tasks = [
        task(topic, name, preset)
        for topic in sorted(sizes) if sizes[topic] >= min_rows
        for name, preset in presets.items()
    ]
    scored = _union(in_parallel(tasks))
    return met.binary_metrics(scored, ["topic", "model", "n_train", "n_test"])


def summarise(results: DataFrame, by: Sequence[str], names: Sequence[str] = ("accuracy", "f1", "roc_auc")) -> DataFrame:
    """Mean and population deviation of each metric."""
    aggs: list[Column] = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_sd")]
    return results.groupBy(*by).agg(*aggs)


def cross_validate(df: DataFrame, runs: dict[str, tuple[Sequence[str], Preset]], k: int = 5) -> DataFrame:
    """Metrics of every named run on each of the same stratified folds.

    All fold predictions are measured together by one aggregation.
    """
    folded = materialise(stratified_folds(df, k, "label"), "folds")

    def task(name: str, features: Sequence[str], preset: Preset, fold: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            model = fit(folded.filter(F.col("fold") != fold), features, preset)
            scored = predict(model, folded.filter(F.col("fold") == fold), features)
            return scored.withColumns({"model": F.lit(name), "fold": F.lit(fold)})

        return run

    tasks = [task(n, fs, p, i) for n, (fs, p) in runs.items() for i in range(k)]
    scored = materialise(_union(in_parallel(tasks)), "fold-scores")
    by = ["model", "fold"]
    return met.binary_metrics(scored, by).join(met.roc_auc(scored, by), by)


def hold_out_and_folds(df: DataFrame, feature_sets: dict[str, Sequence[str]], preset: Preset, k: int = 5) -> DataFrame:
    """Per feature set: metrics of one stratified hold-out, and F1 over stratified folds of all rows."""
    split = materialise(stratified_split(df, "label"), "split")
    train, test = split.filter("is_test = 0"), split.filter("is_test = 1")

    def task(name: str, features: Sequence[str]) -> Callable[[], DataFrame]:
        return lambda: predict(fit(train, features, preset), test, features).withColumn("feature_set", F.lit(name))

    scored = materialise(_union(in_parallel([task(n, fs) for n, fs in feature_sets.items()])), "hold-out")
    folds = ablation(df, feature_sets, preset, k).select(
        "feature_set", "n_features", F.col("f1_mean").alias("cv_f1_mean"), F.col("f1_sd").alias("cv_f1_sd")
    )
    return met.binary_metrics(scored, ["feature_set"]).join(folds, "feature_set")


def ablation(df: DataFrame, feature_sets: dict[str, Sequence[str]], preset: Preset, k: int = 5) -> DataFrame:
    """Cross-validated metrics per feature set, all on the same folds."""
    runs = {n: ([f for f in fs if f in df.columns], preset) for n, fs in feature_sets.items()}
    out = summarise(cross_validate(df, runs, k), ["model"]).withColumnRenamed("model", "feature_set")
    sizes = F.create_map(*[F.lit(x) for n, (fs, _) in runs.items() for x in (n, len(fs))])
    return out.withColumn("n_features", sizes[F.col("feature_set")].cast("int"))


@dataclass
class Trained:
    """A fitted model with its threshold and hold-out predictions."""

    name: str
    model: PipelineModel
    features: list[str]
    threshold: float
    train_seconds: float
    scored: DataFrame


def train_and_hold_out(df: DataFrame, name: str, features: Sequence[str], preset: Preset, min_recall: float = 0.0) -> Trained:
    """Fit on the training rows, tune the threshold on a validation fold, predict the hold-out.

    ``df`` carries ``is_test`` and ``fold``; fold 0 of the training rows is
    the validation part, so neither threshold nor scaler sees the hold-out.
    """
    train = df.filter("is_test = 0")
    tuner = fit(train.filter("fold <> 0"), features, preset)
    tuned = met.best_threshold(predict(tuner, train.filter("fold = 0"), features), min_recall=min_recall)
    threshold = float(tuned.first()["best_threshold"])
    started = time.monotonic()
    model = fit(train, features, preset)
    seconds = time.monotonic() - started
    scored = predict(model, df.filter("is_test = 1"), features)
    return Trained(name, model, list(features), threshold, seconds, scored)


def with_parts(df: DataFrame) -> DataFrame:
    """Add the hold-out mark and fold numbers and materialise the table."""
    split = stratified_split(df, "label")
    folds = stratified_folds(df, 5, "label").select("topic", "timestamp", "fold")
    return materialise(split.join(folds, ["topic", "timestamp"]), "parts")


def train_all(df: DataFrame, features: Sequence[str], presets: dict[str, Preset]) -> list[Trained]:
    parts = with_parts(df)
    return in_parallel(
        [lambda n=n, p=p: train_and_hold_out(parts, n, features, p) for n, p in presets.items()]
    )


def compare(trained: Sequence[Trained]) -> DataFrame:
    """Hold-out metrics, binary and weighted by class, area and training time of each model, ranked by F1."""
    parts = [
        t.scored.withColumns(
            {
                "model": F.lit(t.name),
                "threshold": F.lit(t.threshold),
                "train_time": F.lit(t.train_seconds),
                "prediction": (F.col("probability") >= t.threshold).cast("int"),
            }
        )
        for t in trained
    ]
    scored = materialise(_union(parts), "hold-out")
    by = ["model", "threshold", "train_time"]
    table = met.with_binary_metrics(met.confusion(scored, by)).join(met.roc_auc(scored, ["model"]), "model")
    return leaderboard(table.join(met.weighted_metrics(scored, ["model"]).drop("n"), "model"))


def importances(trained: Trained) -> list[tuple[str, float]] | None:
    """Tree importances or absolute coefficients by feature; None if the model has neither."""
    last = trained.model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix") and last.getFeaturesCol() == "inputs":
        values = np.abs(last.coefficients.toArray())
    else:
        return None
    return [(f, float(v)) for f, v in zip(trained.features, values)]


def permutation_importance(
    model: PipelineModel, test: DataFrame, features: Sequence[str], repeats: int = 10
) -> DataFrame:
    """Mean accuracy lost when a feature's values are shuffled among the rows.

    Every repeat ranks the rows twice by independent hashes and joins the two
    rankings, which hands each row the values of a random other row.  All
    shuffled copies are scored by one job.
    """
    rows = test.select("topic", "timestamp", "label", *[finite_or_zero(F.col(f)).alias(f) for f in features])
    spread = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    keys = ["topic", "timestamp"]
    taker = hash_rank(spread, [*keys, "repeat"], by=["repeat"], salt="taker")
    giver = hash_rank(spread, [*keys, "repeat"], by=["repeat"], salt="giver").select(
        "repeat", "rank", *[F.col(f).alias(f"_g_{f}") for f in features]
    )
    spark = test.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Scoring every shuffled copy is far more work than the row sizes suggest, so fix the task count.
    paired = taker.join(giver, ["repeat", "rank"]).repartition(tasks)
    named = paired.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    shuffled = named.withColumns(
        {f: F.when(F.col("feature") == f, F.col(f"_g_{f}")).otherwise(F.col(f)) for f in features}
    )
    hit = ((F.col("probability") >= 0.5).cast("int") == F.col("label")).cast("int")
    base = predict(model, rows, features).agg(F.avg(hit)).scalar()
    scored = predict(model, shuffled, features, keep=("feature", "repeat", "label"))
    per_repeat = scored.groupBy("feature", "repeat").agg(F.avg(hit).alias("accuracy"))
    return per_repeat.groupBy("feature").agg((base - F.avg("accuracy")).alias("importance"))


def importance_table(trained: Sequence[Trained], test: DataFrame) -> DataFrame:
    """``model, feature, importance`` for all models."""
    spark = test.sparkSession
    parts = []
    for t in trained:
        known = importances(t)
        if known is None:
            table = permutation_importance(t.model, test, t.features)
        else:
            table = spark.createDataFrame(known, "feature string, importance double")
        parts.append(table.withColumn("model", F.lit(t.name)))
    return _union(parts)


def oversample_minority(df: DataFrame, features: Sequence[str], label: str = "label", neighbours: int = 5) -> DataFrame:
    """Balance the classes with points between minority rows and their exact nearest neighbours.

    Distances are taken between features scaled by their deviation.  Each new point lies between a row and one of
    its ``neighbours`` nearest rows, drawn by a hash of the row's key (topic and timestamp), so it depends on no
    partitioning; a row's copies are neighbours at no distance.  The new rows exactly fill the gap between the
    classes.  With fewer than two minority rows nothing is added.
    """
    base = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias(label))
    original = base.withColumn("synthetic", F.lit(0))
    clean = df.select(*[finite_or_zero(F.col(f)).alias(f) for f in features], F.col(label).alias(label))
    stats = moments(clean, features)
    sizes = clean.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    minor = 1 if sizes["p"] <= sizes["n"] else 0
    have, need = min(sizes["p"], sizes["n"]), abs(sizes["p"] - sizes["n"])
    if have < 2 or need == 0:
        return original
    scaled = F.array(*[finite_or_zero(F.col(f)) / F.lit(s) for f, s in zip(features, stats.scale)])
    keyed = df.filter(F.col(label) == minor).select(
        hash_order(F.col("topic"), F.col("timestamp")).alias("_id"), scaled.alias("x")
    )
    ranked = materialise(hash_rank(keyed, ["_id"]), "minority")
    lists = nearest(ranked.select("x"), neighbours, len(features))
    copies = F.lit(need // have) + (F.col("rank") <= need % have).cast("int")
    jobs = ranked.withColumn("_copies", copies).filter("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))
    )
    # Own copies come first; the place drawn among all neighbours then names one of them.
    own = F.least(F.col("copies") - 1, F.lit(neighbours).cast("long"))
    others = F.aggregate("near", F.lit(0).cast("long"), lambda s, m: s + m["copies"])
    known = F.least(own + others, F.lit(neighbours).cast("long"))
    pick = F.pmod(F.xxhash64("_id", "_copy", F.lit("pick")), F.greatest(known, F.lit(1).cast("long")))
    found = F.aggregate(
        "near",
        F.struct((F.col("_pick") - F.col("_own")).alias("left"), F.col("x").alias("y")),
        lambda s, m: F.when(s["left"] < 0, s).otherwise(
            F.struct((s["left"] - m["copies"]).alias("left"), m["y"].alias("y"))
        ),
    )["y"]
    weight = F.pmod(F.xxhash64("_id", "_copy", F.lit("weight")), F.lit(1_000_000)) / 1_000_000.0
    drawn = jobs.join(lists, "x").withColumns({"_own": own, "_pick": pick}).select("x", found.alias("y"), weight.alias("w"))
    new = drawn.select(
        *[
            ((F.col("x")[i] + F.col("w") * (F.col("y")[i] - F.col("x")[i])) * F.lit(s)).alias(f)
            for i, (f, s) in enumerate(zip(features, stats.scale))
        ],
        F.lit(minor).cast("int").alias(label),
        F.lit(1).alias("synthetic"),
    )
    return original.unionByName(new)
