"""Importance resampling towards a target corpus, with features hashed in length-bucketed CRC matrices.

Features are single words and pairs of neighbours.  A batch's distinct features are grouped by their length in
bytes; each group is a two-dimensional array of bytes, one row a feature, and the CRC-32 of all its rows is
updated column by column.  The buckets are then scattered back to every place where the feature stands.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberscope.llm.shared import pieces, ranges, stage

BUCKETS = 10_000
SEED = 7
SHARE = 25
LEAST_WORDS = 20
LONG_FEATURE = 256
SLICE_WORDS = 1 << 20
NOT_WORD = 0x20


def crc_table() -> np.ndarray:
    """CRC-32 of each byte value, by the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def letters() -> np.ndarray:
    """What each byte of a text counts as: A-Z as a-z; digits, a-z and all bytes from 0x80 as themselves; the rest as a gap."""
    kept = np.arange(256, dtype=np.uint8)
    kept[0x41:0x5B] += 0x20
    for a, b in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
        kept[a:b] = NOT_WORD
    return kept


TABLE, LETTERS = crc_table(), letters()


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row, all rows one column at a time."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc32_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start : start + size] of every span, grouped by size; spans over 256 bytes one by one."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, firsts = np.unique(sizes[order], return_index=True)
    for size, group in zip(lengths.tolist(), np.split(order, firsts[1:])):
        if size > LONG_FEATURE:
            out[group] = [zlib.crc32(data[a : a + size]) for a in starts[group].tolist()]
        else:
            out[group] = crc32_rows(data[starts[group][:, None] + np.arange(size)])
    return out


class Words:
    """The words of a batch: their bytes, each followed by one space, and where they and their texts start."""

    def __init__(self, texts: pa.Array):
        values = [t or b"" for t in texts.to_pylist()]
        gaps = b" ".join(values) + b" "
        kept = LETTERS[np.frombuffer(gaps, np.uint8)]
        word = kept != NOT_WORD
        edges = np.flatnonzero(np.diff(word, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        after = word.copy()
        after[ends] = True
        self.data = kept[after]
        self.sizes = ends - starts
        self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        heads = np.cumsum([0, *[len(t) + 1 for t in values]])
        self.bounds = np.searchsorted(starts, heads)


def distinct(starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span the number of its text among the distinct ones, and for each of those one span."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    values = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts, sizes)])]
    )
    codes = values.dictionary_encode().indices.to_numpy()
    return codes, first_places(codes)


def first_places(codes: np.ndarray) -> np.ndarray:
    """One position of every code; codes are numbered without gaps."""
    place = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    place[codes] = np.arange(len(codes))
    return place


def feature_buckets(words: Words, a: int, b: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words from ``a`` to ``b`` and of each with the word after it (also across texts)."""
    starts, sizes = words.starts[a : b + 1], words.sizes[a : b + 1]
    codes, firsts = distinct(starts, sizes, words.data)
    single = (crc32_spans(words.data, starts[firsts], sizes[firsts]) % buckets).astype(np.int64)[codes]
    pairs = pa.array(codes[:-1].astype(np.int64) * len(firsts) + codes[1:]).dictionary_encode().indices.to_numpy()
    at = first_places(pairs)
    double = crc32_spans(words.data, starts[at], sizes[at] + 1 + sizes[at + 1]) % buckets
    return single[: b - a], double.astype(np.int64)[pairs]


def slices(words: Words, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, end, buckets of words, buckets of pairs, which pairs lie within one text) for bounded runs of words."""
    n = len(words.sizes)
    for a in range(0, n, SLICE_WORDS):
        b = min(n, a + SLICE_WORDS)
        single, double = feature_buckets(words, a, b, buckets)
        inside = np.ones(len(double), bool)
        last = words.bounds[1:] - 1
        last = last[(last >= a) & (last < a + len(double))]
        inside[last - a] = False
        yield a, b, single, double, inside


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts by bucket; ``texts`` has the one column text."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            for _, _, single, double, inside in slices(Words(batch.column("text")), buckets):
                total += np.bincount(single, minlength=buckets) + np.bincount(double[inside], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """What one feature of each bucket adds to a text's weight: thousandths of the log-ratio of smoothed shares.

    Only two numbers per bucket reach the driver.
    """
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(
        target.select("bucket", F.lit(0).cast("long"), F.col("n"))
    )
    s, t = [0] * buckets, [0] * buckets
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    of, to = sum(s), sum(t)
    return [
        math.floor(1000 * math.log((float(b + 1) * float(of + buckets)) / (float(a + 1) * float(to + buckets))))
        for a, b in zip(s, t)
    ]


def chance(doc_id: int | None, seed: int) -> int:
    """A draw in thousandths from the Gumbel distribution that depends on the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: Sequence[int], seed: int = SEED) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight and score, with its ``row`` if ``docs`` has that column."""
    extra = [f for f in docs.schema.fields if f.name == "row"]
    kinds = "doc_id long, n_words long, n_features long, weight long, score long"
    schema = kinds + "".join(f", row {f.dataType.simpleString()}" for f in extra)
    names = ["doc_id", "n_words", "n_features", "weight", "score", *[f.name for f in extra]]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(gain, np.int64)
        for batch in pieces(batches):
            words = Words(batch.column("text"))
            n_words = np.diff(words.bounds)
            total = np.zeros(len(n_words), np.int64)
            for a, b, single, double, inside in slices(words, len(worth)):
                each = worth[single]
                each[: len(double)] += np.where(inside, worth[double], 0)
                sums = np.concatenate([[0], np.cumsum(each)])
                cut = np.clip(words.bounds, a, b) - a
                total += np.diff(sums[cut])
            n_features = np.maximum(2 * n_words - 1, 0)
            weight = np.floor_divide(total, np.maximum(n_features, 1))
            drawn = np.array([chance(d, seed) for d in batch.column("doc_id").to_pylist()], np.int64)
            columns = [batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight, weight + drawn))]
            yield pa.RecordBatch.from_arrays([*columns, *[batch.column(f.name) for f in extra]], names=names)

    return docs.mapInArrow(score, schema)


def ranked(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the best ``share`` percent of the rows of enough words, else null.

    Rows are dealt by ranges of (score, id, a number of the row), so equal scores and ids fill several tasks;
    rows per task are counted, the counts of the few tasks are added up, and each row adds its place.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at")]
    able = stage(scored.withColumn("at", F.monotonically_increasing_id()), "scored")
    rivals = able.where(F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    rivals = stage(rivals.withColumn("at", F.monotonically_increasing_id()), "rivals").withColumn("task", F.shiftright("at", 33))
    tasks = rivals.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all")
    )
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    placed = rivals.join(tasks, "task").withColumn("rank", F.when(place <= F.floor(F.col("all") * share / 100), place))
    columns = [c for c in able.columns if c != "at"]
    short = able.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*columns, "rank").union(short.select(*columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, carry: Sequence[str] = (), buckets: int = BUCKETS, seed: int = SEED,
    share: int = SHARE, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row; rows with a rank are the sample.

    ``carry`` names columns of ``docs`` to return in the struct ``row``, such as the text.  Texts of both tables
    count whole.  Null and empty texts have no features and weight 0.  A null id draws like an empty one and
    stands behind all ids in ties; repeated rows count, score and are drawn each for itself, so equal rows have
    equal scores and neighbouring ranks; an empty target leaves the corpus's own counts; no rows give no rows.
    Other columns are ignored, whatever their names.  A batch takes about 40 bytes of memory per byte of text.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"),
        *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []),
    )
    return ranked(scores(rows, gain, seed), share, least_words)
