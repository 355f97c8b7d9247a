"""Quality rules: word counts, symbols, repeated lines, and repetition by suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from emberscope.llm.shared import pieces, split_words, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_words long, longest_repeat long, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    ``min_repeat``: shortest repeat, in words, that counts as repetition; ``max_covered``: largest share
    of a text's words that such repeats may cover; ``max_repeat``: longest single repeat allowed, in words.
    """

    min_words: int = 50
    max_repeat_share: float = 0.5
    min_repeat: int = 8
    max_covered: float = 0.4
    max_repeat: int = 400


def longest_matches(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """At each position, the length of its longest substring that also starts elsewhere in the same text.

    ``codes`` must differ between texts.  A suffix array is built by prefix doubling that only sorts
    suffixes still tied; the ranks of every round are kept, and the longest common prefix of two
    neighbours is read from them, longest round first.  The larger of a suffix's two neighbours' values
    is the depth of the deepest common-prefix interval around it.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    order = np.argsort(codes, kind="stable")
    new = np.r_[True, np.diff(codes[order]) != 0]
    first = np.flatnonzero(new)
    rank = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = first[np.cumsum(new) - 1] + 1
    sizes = np.diff(np.r_[first, n])
    tied = order[np.repeat(sizes, sizes) > 1]
    levels, width = [rank.copy()], 1
    while len(tied):
        after = np.minimum(tied + width, end[tied])
        second = np.where(tied + width < end[tied], rank[after], 0)
        head = rank[tied]
        order = np.lexsort((second, head))
        tied, head, second = tied[order], head[order], second[order]
        opens = np.r_[True, np.diff(head) != 0]
        new = opens | np.r_[True, np.diff(second) != 0]
        group = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        first = np.flatnonzero(new)
        rank[tied] = head + first[np.cumsum(new) - 1] - group
        sizes = np.diff(np.r_[first, len(tied)])
        tied = tied[np.repeat(sizes, sizes) > 1]
        width *= 2
        levels.append(rank.copy())
    suffixes = np.empty(n, np.int64)
    suffixes[rank[:n] - 1] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        live = (x < end[a]) & (y < end[b])
        same = live & (levels[k][np.minimum(x, n)] == levels[k][np.minimum(y, n)])
        length += same << k
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, length)
    np.maximum.at(best, b, length)
    return best


def covered(match: np.ndarray, shortest: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``shortest`` words: the union of the repeats' spans."""
    starts = np.flatnonzero(match >= shortest)
    edge = np.zeros(len(match) + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + match[starts], 1)
    return np.cumsum(edge[:-1]) > 0


def _dup_lines(value: bytes) -> int:
    lines = [x for x in value.split(b"\n") if x.split()] if value.count(b"\n") else []
    return len(lines) - len(set(lines))


def measure(batch: pa.RecordBatch, rules: Rules) -> pa.RecordBatch:
    """The measures of one batch of ids and texts."""
    values = [v or b"" for v in batch.column("text").cast(pa.binary()).to_pylist()]
    words, bounds = split_words(values)
    n = np.diff(bounds)
    of_doc = np.repeat(np.arange(len(values)), n)
    codes, distinct = pd.factorize(np.array([*words, None], object)[:-1])
    match = longest_matches(of_doc * max(1, len(distinct)) + codes, bounds)

    def total(flags):
        return np.bincount(of_doc, weights=flags, minlength=len(values)).astype(np.int64)

    longest = np.zeros(len(values), np.int64)
    np.maximum.at(longest, of_doc, match)
    repeat, cover = total(covered(match, 3)), total(covered(match, rules.min_repeat))
    chars = [len(v.translate(None, SPACES).decode("utf-8", "replace")) for v in values]
    symbols = [len(v) - len(v.translate(None, SYMBOLS)) for v in values]
    failed = (n < rules.min_words) | (repeat > rules.max_repeat_share * n)
    kept = ~failed & (cover <= rules.max_covered * n) & (longest <= rules.max_repeat)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array(n), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()),
            pa.array([_dup_lines(v) for v in values], pa.int64()), pa.array(repeat), pa.array(failed),
            pa.array(cover), pa.array(longest), pa.array(kept),
        ],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row of measures and a verdict per document.

    A text is judged by its own words alone, so no row leaves its partition.  Null and empty texts have
    no words and fail ``min_words``; repeated rows are each judged; a null ``doc_id`` stays null; columns
    other than ``doc_id`` and ``text`` are ignored; no rows give no rows.
    """
    return texts(docs).mapInArrow(lambda batches: (measure(b, rules) for b in pieces(batches)), SCHEMA)


def passing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, with all their columns, filtered where they are read."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(measure(batch.select(["doc_id", "text"]), rules).column("kept"))

    return docs.mapInArrow(keep, docs.schema)
