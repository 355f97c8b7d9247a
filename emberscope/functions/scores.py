"""Class probabilities, labels, score bands and polarity rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberscope.functions.columns import ratio
from emberscope.schemas import (
    ALERT_BANDS,
    LOWEST_ALERT,
    LOWEST_BAND,
    POLARITY_CUT,
    SCORE_BANDS,
    TOKEN_CLASS_CUT,
)


def softmax(scores: Mapping[str, Column]) -> dict[str, Column]:
    """Probabilities by class name, shifted by the maximum for stability."""
    top = F.greatest(*scores.values())
    exps = {name: F.exp(s.cast("double") - top) for name, s in scores.items()}
    total = sum(exps.values(), F.lit(0.0))
    return {name: e / total for name, e in exps.items()}


def argmax_label(probabilities: Sequence[tuple[str, Column]]) -> Column:
    """Label with the largest probability; the first class listed wins ties."""
    top = F.greatest(*[p for _, p in probabilities])
    label = F.lit(None).cast("string")
    for name, p in reversed(list(probabilities)):
        label = F.when(p == top, F.lit(name)).otherwise(label)
    return label


def threshold_label(
    negative: Column, positive: Column, negative_min: float = 0.4, positive_min: float = 0.4
) -> Column:
    """Negative is tested first, then positive, else neutral."""
    return (
        F.when(negative >= negative_min, F.lit("NEGATIVE"))
        .when(positive >= positive_min, F.lit("POSITIVE"))
        .otherwise(F.lit("NEUTRAL"))
    )


def discretise_polarity(score: Column, cut: float = POLARITY_CUT) -> Column:
    """Sign of a polarity beyond the cut, else 0."""
    return F.when(score > cut, 1).when(score < -cut, -1).otherwise(0)


def token_polarity(positive: Column, negative: Column) -> Column:
    """Balance of positive and negative weight in [-1, 1]; 0 without hits."""
    return F.coalesce(ratio(positive - negative, positive + negative), F.lit(0.0))


def token_class(polarity: Column, cut: float = TOKEN_CLASS_CUT) -> Column:
    return (
        F.when(polarity > cut, F.lit("positive"))
        .when(polarity < -cut, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def percent_score(probability: Column) -> Column:
    """0-100 score by truncation."""
    return (probability * 100).cast("int")


def _band(score: Column, bands: Sequence[tuple[int, str]], lowest: str) -> Column:
    out = F.lit(lowest)
    for floor, name in sorted(bands):
        out = F.when(score >= floor, F.lit(name)).otherwise(out)
    return out


def score_level(score: Column) -> Column:
    return _band(score, SCORE_BANDS, LOWEST_BAND)


def alert_class(score: Column) -> Column:
    return _band(score, ALERT_BANDS, LOWEST_ALERT)
