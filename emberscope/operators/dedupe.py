"""Keep-first de-duplication by key digest and packed position.

A window or a sort over the key would order whole rows and put every copy of a hot key in one task.  Here a
key is a digest of 128 bits and a row's place in its files one number, so the least place of each key is found
by a hash aggregation of narrow rows that combines inside each input partition.  Rows then stay or go by their
place, which is theirs alone: copies of a hot key meet in no task, and no row is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.operators.sizing import broadcast_if_small

NUMBER, ROW = 10**19, 10**10


def digest(columns: Sequence[str], out: tuple[str, str] = ("_h1", "_h2")) -> list[Column]:
    """Two 64-bit hashes of the values and of which of them are null; equal for equal rows only, but for a chance of 2^-128 a pair."""
    parts = [*[F.col(c).isNull() for c in columns], *[F.col(c) for c in columns]]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in enumerate(out)]


def _whole(number: Column, factor: int = 1) -> Column:
    return (F.coalesce(number.cast("decimal(19,0)"), F.lit(0)) * F.lit(factor).cast("decimal(20,0)")).cast("decimal(38,0)")


def with_place(df: DataFrame, place: Sequence[str]) -> DataFrame:
    """Add ``_place``, one number in the order of the columns of ``place``: names first, then one or two numbers.

    Names, such as files, are replaced by their rank; a hundred thousand of them are broadcast, more are joined by
    hash, so rows are not sorted either way.  Of two numbers, such as a
    block's offset and a row's number in it, the second is below 10^10.  Numbers are not negative; nulls count as the least.
    """
    kinds = dict(df.dtypes)
    names = [c for c in place if kinds[c] == "string"]
    numbers = [c for c in place if kinds[c] != "string"]
    if len(names) + len(numbers) > 3 or len(names) > 1 or len(numbers) > 2:
        raise ValueError(f"place takes one name and two numbers at most, not {list(place)}")
    factors = [1] if len(numbers) < 2 else [ROW, 1]
    packed = sum((_whole(F.col(c), f) for c, f in zip(numbers, factors)), F.lit(0).cast("decimal(38,0)"))
    if not names:
        return df.withColumn("_place", packed.cast("decimal(38,0)"))
    found = df.select(F.col(names[0]).alias("_name")).distinct()
    ranks = found.withColumn("_rank", F.row_number().over(Window.orderBy("_name")))
    above = NUMBER * (ROW if len(numbers) > 1 else 1)
    step = F.lit(str(above)).cast("decimal(30,0)")
    ranked = df.join(broadcast_if_small(ranks.hint("shuffle_hash")), F.col(names[0]).eqNullSafe(F.col("_name")))
    whole = F.col("_rank").cast("decimal(8,0)") * step + packed
    return ranked.withColumn("_place", whole.cast("decimal(38,0)")).drop("_name", "_rank")


def keep_first(df: DataFrame, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    """The row of each key with the least ``place``, which no other row of the key has; null keys form one group."""
    placed = with_place(df, place)
    firsts = placed.select(*digest(keys), "_place").groupBy("_h1", "_h2").agg(F.min("_place").alias("_first"))
    rows = placed.withColumns({"_h1": digest(keys)[0], "_h2": digest(keys)[1]})
    firsts = firsts.withColumnsRenamed({"_h1": "_k1", "_h2": "_k2"})
    same = (F.col("_place") == F.col("_first")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    return rows.join(firsts.hint("shuffle_hash"), same, "left_semi").select(*df.columns)


def dedupe_posts(posts: DataFrame, key: str = "tweet_id", order: Sequence[str] = ("source_file", "row_pos")) -> DataFrame:
    """Keep the first post per id in file order."""
    return keep_first(posts, [key], order)


def dedupe_content(posts: DataFrame, order: Sequence[str] = ("source_file", "row_pos")) -> DataFrame:
    """Keep the first post per exact text in file order."""
    return keep_first(posts, ["content"], order)


def merge_hourly(series: DataFrame, keys: Sequence[str] = ("topic", "timestamp"), order: Sequence[str] = ("source_file",)) -> DataFrame:
    """One row per topic and hour from several result files, first file wins.

    Rows of one file for the same hour are told apart by a digest of all their columns.
    """
    hashed = F.xxhash64(*[F.col(c).isNull() for c in series.columns], *[F.col(c) for c in series.columns])
    numbered = series.withColumn("_row", F.shiftrightunsigned(hashed, 1))
    return keep_first(numbered, list(keys), [*order, "_row"]).drop("_row").distinct()


def removed_count(before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in, rows kept and rows removed by de-duplication on ``keys``."""
    per_key = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_removed"),
    )
