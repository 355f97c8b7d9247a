"""Helpers shared by the operators: stage tables, bounded batches, word windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from threading import Lock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from emberscope.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_HELD = {"lock": Lock(), "writers": 0, "before": None}


@contextmanager
def released_shuffles(spark: SparkSession):
    """Drop the shuffle files of a query as soon as its result is stored.

    The setting belongs to the session, so the first of several writers sets it and the last one puts it back.
    """
    with _HELD["lock"]:
        if not _HELD["writers"]:
            _HELD["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _HELD["writers"] += 1
    try:
        yield
    finally:
        with _HELD["lock"]:
            _HELD["writers"] -= 1
            if not _HELD["writers"]:
                if _HELD["before"] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, _HELD["before"])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back.

    Cuts lineage, so later jobs survive lost executors without repeating earlier work.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with released_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """Id and UTF-8 bytes of every document; other columns play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def split_words(values: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in a row, and where each text's words start (one more entry than texts)."""
    words: list[bytes] = []
    bounds = np.zeros(len(values) + 1, np.int64)
    for i, value in enumerate(values):
        if value:
            words += value.split()
        bounds[i + 1] = len(words)
    return words, bounds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, count=len(words))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries, put together from runs of powers of two."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    power = mix(hashes + salt) if seed else hashes
    acc, length, width = None, 0, 1
    while True:
        if size & width:
            if acc is None:
                acc = power
            else:
                n = max(0, len(power) - length)
                acc = mix(acc[:n] * np.uint64(0xD6E8FEB86659FD93) + power[length : length + n] + salt)
            length += width
        if length == size:
            return acc
        n = max(0, len(power) - width)
        power = mix(power[:n] * np.uint64(0xD6E8FEB86659FD93) + power[width : width + n] + salt)
        width *= 2


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a window of ``size`` words fits into its own text."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    return ranges(bounds[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    total = int(counts.sum())
    firsts = np.cumsum(counts) - counts
    return np.repeat(starts - firsts, counts) + np.arange(total)
