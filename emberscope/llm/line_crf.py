"""Document quality from a linear-chain conditional random field over lines.

The lines' labels are latent: a text's label only makes each of its lines more likely to be the same.  The fit
raises the likelihood of that evidence, so a bad text may keep good lines, and moves between good and bad lines
are learned from texts that hold both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.shared import pieces, texts

FIT_DOCUMENTS = 4000
FIT_LINES = 400
THRESHOLD = 0.3
EVIDENCE = 0.25
MOVE_DECAY = 0.1
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>",
    "pipe": b"|",
    "loud": b"!?",
    "stop": b".,;:",
    "other": bytes(range(128, 256)),
}
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
TABLE = np.zeros((len(CLASSES), 256), bool)
for _row, _set in zip(TABLE, CLASSES.values()):
    _row[list(_set)] = True


def line_features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, each line's length in bytes, and where each text's lines start.

    A text has one line more than newlines, so an empty text has one empty line.
    """
    if not values:
        return np.zeros((0, len(CLASSES) + 9)), np.zeros(0), np.zeros(1, np.int64)
    buffer = b"\n".join(values)
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts, stops = np.r_[0, breaks + 1], np.r_[breaks, len(data)]
    length = stops - starts
    bounds = np.r_[0, np.cumsum([v.count(b"\n") + 1 for v in values])]
    rows = len(starts)

    def per_line(flags: np.ndarray) -> np.ndarray:
        where = np.flatnonzero(flags)
        return np.bincount(np.searchsorted(breaks, where), minlength=rows)

    space = SPACE[data]
    word_at = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(data) else np.zeros(0, np.int64)
    words = buffer.split()
    line_of = np.searchsorted(breaks, word_at)
    n_words = np.bincount(line_of, minlength=rows)
    codes, _ = pd.factorize(np.array([*words, None], object)[:-1])
    same = (codes[1:] == codes[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of[1:][same], minlength=rows)
    first = ~pd.Series(line_of * (len(words) + 1) + codes).duplicated().to_numpy()
    distinct = np.bincount(line_of[first], minlength=rows)
    of_text = np.repeat(np.arange(len(values)), np.diff(bounds))
    line_codes, _ = pd.factorize(np.array([*buffer.split(b"\n"), None], object)[:-1])
    again = pd.Series(of_text * (rows + 1) + line_codes).duplicated().to_numpy() & (n_words > 0)
    visible = np.maximum(length - per_line(space & (data != 10)), 0)
    size, count = np.maximum(visible, 1), np.maximum(n_words, 1)
    columns = [per_line(mask[data]) / size for mask in TABLE]
    columns += [
        np.log1p(visible), np.log1p(n_words), visible / count / 10.0, repeats / count,
        1.0 - distinct / count, again.astype(float), (n_words == 0).astype(float),
        per_line(TABLE[3][data] | TABLE[5][data] | TABLE[4][data]) / count, (distinct / count < 0.3) * 1.0,
    ]
    return np.stack(columns, axis=1), length.astype(float), bounds


def with_neighbours(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in its text (zeros at the ends), and one."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[bounds[:-1]], after[bounds[1:] - 1] = 0.0, 0.0
    return np.concatenate([features, before, after, np.ones((len(features), 1))], axis=1)


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(good) of each line, and expected transitions (2 x 2).

    ``unary`` is the log-odds of good; texts are walked line by line side by side, longest first, so that
    the texts still running are always a prefix.
    """
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    starts, sizes = bounds[:-1][order], counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")
    score = np.stack([np.zeros_like(unary), unary], axis=1)
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    if longest:
        forward[starts] = score[starts]
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        past = forward[at - 1]
        forward[at, 0] = _log_sum(past[:, 0] + move[0, 0], past[:, 1] + move[1, 0]) + score[at, 0]
        forward[at, 1] = _log_sum(past[:, 0] + move[0, 1], past[:, 1] + move[1, 1]) + score[at, 1]
    for t in range(longest - 1, 0, -1):
        at = starts[: alive[t]] + t
        ahead = backward[at] + score[at]
        backward[at - 1, 0] = _log_sum(ahead[:, 0] + move[0, 0], ahead[:, 1] + move[0, 1])
        backward[at - 1, 1] = _log_sum(ahead[:, 0] + move[1, 0], ahead[:, 1] + move[1, 1])
    both = forward + backward
    good = 1.0 / (1.0 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    expected = np.zeros((2, 2))
    later = np.ones(len(unary), bool)
    later[bounds[:-1]] = False
    at = np.flatnonzero(later)
    if len(at):
        total = _log_sum(both[at, 0], both[at, 1])
        for a in range(2):
            for b in range(2):
                expected[a, b] = np.exp(forward[at - 1, a] + move[a, b] + score[at, b] + backward[at, b] - total).sum()
    return good, expected


@dataclass(frozen=True)
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray

    def lines(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's chance to be good and its length, and where each text's lines start."""
        features, length, bounds = line_features(values)
        x = with_neighbours((features - self.mean) / self.scale, bounds)
        return marginals(x @ self.weights, self.move, bounds)[0], length, bounds

    def score(self, values: list[bytes]) -> np.ndarray:
        """Quality of each text: the lines' chances to be good, weighted by line length."""
        good, length, bounds = self.lines(values)
        weight = length + 1.0
        return np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])


def fit(
    features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rounds: int = 150, decay: float = 1e-3, evidence: float = EVIDENCE,
    move_decay: float = MOVE_DECAY,
) -> LineModel:
    """Maximum likelihood of the texts' labels as evidence on latent line labels; Adam steps on the exact gradient.

    A text's label adds ``evidence`` to the log-odds of each of its lines.  The gradient is the difference of two
    expectations by forward-backward, with that evidence and without it, which is a step of
    expectation-maximisation that takes no full maximisation between.  The start is a model of single lines, for a
    chain that began with whole texts of one label would never learn a move.  For the same reason moves are held
    back by a decay of their own: what surrounds a line is among its features already.
    """
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = with_neighbours((features - mean) / scale, bounds)
    y = np.repeat(labels, np.diff(bounds)).astype(float)
    push = evidence * (2 * y - 1)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    penalty = np.r_[np.full(x.shape[1], decay), np.full(4, move_decay)]
    texts_ = max(1, len(labels))
    for step in range(1, rounds + 1):
        unary, move = x @ theta[:-4], theta[-4:].reshape(2, 2)
        if step <= rounds // 3:
            good, wanted, moved, expected = 1.0 / (1.0 + np.exp(-np.clip(unary, -700, 700))), y, np.zeros((2, 2)), np.zeros((2, 2))
        else:
            good, expected = marginals(unary, move, bounds)
            wanted, moved = marginals(unary + push, move, bounds)
        gradient = np.r_[x.T @ (wanted - good), (moved - expected).ravel()] / texts_ - penalty * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LineModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def _sampled_features(batches: Iterator[pa.RecordBatch], most_lines: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values = [v or b"" for v in batch.column("text").to_pylist()]
        rows = [i for i, v in enumerate(values) if v.count(b"\n") < most_lines]
        features, _, bounds = line_features([values[i] for i in rows])
        packed = [features[a:b].tobytes() for a, b in zip(bounds, bounds[1:])] if rows else []
        part = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "features"])


def train(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS, fit_lines: int = FIT_LINES) -> LineModel:
    """Fit on a bounded sample: at most ``fit_documents`` labelled rows, those with the smallest hash of their
    id, leaving out texts of ``fit_lines`` lines or more.  Rows with a null id or label are not used; an id
    labelled twice counts as 0 if any of its labels is 0.  Without rows of both labels the score is constant.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    chosen = texts(docs).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = chosen.mapInArrow(lambda b: _sampled_features(b, fit_lines), "doc_id long, features binary")
    one = rows.groupBy("doc_id").agg(F.min("features").alias("features"))
    got = one.join(sample, "doc_id").orderBy("doc_id").toPandas()
    width = len(CLASSES) + 9
    blocks = [np.frombuffer(f, float).reshape(-1, width) for f in got["features"]]
    y = got["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        chance = float(y.mean()) if len(y) else 0.5
        weights = np.zeros(3 * width + 1)
        weights[-1] = np.log((chance + 1e-3) / (1 - chance + 1e-3))
        return LineModel(np.zeros(width), np.ones(width), weights, np.zeros((2, 2)))
    return fit(np.concatenate(blocks), np.r_[0, np.cumsum([len(b) for b in blocks])], y)


def held_out(doc_id: str = "doc_id"):
    """Whether CRC-32 of the id as text leaves 0 modulo 5; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id and score of every row; null text counts as empty, repeated rows are each scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = model.score([v or b"" for v in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """Scores of all documents by a model that saw no held-out label."""
    model = train(docs, labels.where(~held_out()), **bounds)
    return score_quality(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
