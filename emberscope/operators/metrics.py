"""Exact classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.functions.columns import ratio, ratio_or_zero
from emberscope.operators.sizing import running_totals, score_bucket


def _counts(label: Column, pred: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((label == 1) & (pred == 1)),
        "fp": F.count_if((label == 0) & (pred == 1)),
        "fn": F.count_if((label == 1) & (pred == 0)),
        "tn": F.count_if((label == 0) & (pred == 0)),
    }


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "prediction") -> DataFrame:
    """Confusion counts in one pass."""
    counts = _counts(F.col(label), F.col(pred))
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in counts.items()])


def with_binary_metrics(counted: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts; 0 where undefined."""
    c = F.col
    return counted.withColumns(
        {
            "accuracy": ratio_or_zero(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")),
            "precision": ratio_or_zero(c("tp"), c("tp") + c("fp")),
            "recall": ratio_or_zero(c("tp"), c("tp") + c("fn")),
            "f1": ratio_or_zero(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        }
    )


def binary_metrics(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, label: str = "label", score: str = "probability") -> DataFrame:
    """Metrics of ``score >= threshold``."""
    marked = df.withColumn("prediction", (F.col(score) >= threshold).cast("int"))
    return with_binary_metrics(confusion(marked, by, label))


def weighted_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall and F1 averaged over classes by support."""
    pairs = df.groupBy(*by, F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    hit = F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0)
    actual = pairs.groupBy(*by, F.col("_l").alias("_c")).agg(
        F.sum("_n").alias("support"), F.sum(hit).alias("hits")
    )
    guessed = pairs.groupBy(*by, F.col("_p").alias("_c")).agg(F.sum("_n").alias("guesses"))
    per_class = actual.join(guessed, [*by, "_c"], "left")
    p = ratio_or_zero(F.col("hits"), F.coalesce(F.col("guesses"), F.lit(0)))
    r = ratio_or_zero(F.col("hits"), F.col("support"))
    scored = per_class.withColumns({"p": p, "r": r}).withColumn(
        "f", ratio_or_zero(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    )
    total = F.sum("support")
    return scored.groupBy(*by).agg(
        total.alias("n"),
        *[
            ratio(F.sum(F.col(v) * F.col("support")), total).alias(name)
            for v, name in (("p", "weighted_precision"), ("r", "weighted_recall"), ("f", "weighted_f1"))
        ],
    )


def score_totals(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "probability") -> DataFrame:
    """Positives and negatives at each distinct score, with the totals below it.

    Rows collapse to distinct scores before anything is ordered.
    """
    distinct = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
    )
    return running_totals(distinct, by, "score", score_bucket(F.col("score")), ["pos", "neg"])


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "probability") -> DataFrame:
    """Exact ROC area with half credit for ties; null when only one class is present."""
    t = score_totals(df, by, label, score)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return t.groupBy(*by).agg(ratio(wins, pairs).alias("roc_auc"))


def threshold_curve(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "probability") -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold`` at every distinct score."""
    t = score_totals(df, by, label, score)
    tp = F.col("total_pos") - F.col("pos_below")
    fp = F.col("total_neg") - F.col("neg_below")
    out = t.select(
        *by,
        F.col("score").alias("threshold"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, F.col("total_pos")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)))


def best_threshold(
    df: DataFrame, by: Sequence[str] = (), min_recall: float = 0.0, label: str = "label", score: str = "probability"
) -> DataFrame:
    """Lowest threshold with the best F1 among those reaching ``min_recall``; 0.5 if none does."""
    curve = threshold_curve(df, by, label, score)
    usable = (F.col("f1") > 0) & (F.col("recall") >= min_recall)
    best = F.max_by(
        F.when(usable, F.col("threshold")),
        F.when(usable, F.struct(F.col("f1"), -F.col("threshold"))),
    )
    return curve.groupBy(*by).agg(
        F.coalesce(best, F.lit(0.5)).alias("best_threshold"),
        F.coalesce(F.max(F.when(usable, F.col("f1"))), F.lit(0.0)).alias("best_f1"),
    )


def class_weight(df: DataFrame, by: Sequence[str] = (), label: str = "is_controversy") -> DataFrame:
    """Negatives over positives; 1 without positives."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.groupBy(*by).agg(
        neg.alias("n_neg"), pos.alias("n_pos"), F.coalesce(ratio(neg, pos), F.lit(1.0)).alias("pos_weight")
    )


def missed_positives(
    df: DataFrame, features: Sequence[str], label: str = "label", pred: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Number of false negatives and their mean features, also for groups that miss none."""
    missed = (F.col(label) == 1) & (F.col(pred) == 0)
    means = [F.avg(F.when(missed, F.col(f))).alias(f"mean_{f}") for f in features]
    return df.groupBy(*by).agg(F.count_if(missed).alias("missed"), *means)


def topic_accuracy(df: DataFrame, label: str = "label", pred: str = "prediction", by: Sequence[str] = ("topic",)) -> DataFrame:
    hit = (F.col(label) == F.col(pred)).cast("int")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
