"""Size checks, and ranks, totals and quantiles that no single task has to order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; looks at no more than that many.

    Local relations answer without a job.
    """
    return len(df.select(F.lit(1)).limit(max_rows + 1).collect()) <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` as local rows to broadcast if it has at most ``max_rows`` narrow rows, else ``df`` as it is.

    The rows are computed once and looked at no further than the bound, so what is broadcast is of proven size
    and the other side of a join stays where it is.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a DataFrame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small_input(df: DataFrame, key: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Spread a small input over all cores before costly work on its rows.

    A small file is one row group and would be read, and worked on, by a
    single task.  Inputs above ``max_bytes`` already have many row groups and
    stay where they are read, so at most that much is ever moved.
    """
    if estimated_bytes(df) > max_bytes:
        return df
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(min(tasks, 256), key)


def hash_order(*keys: Column) -> Column:
    """Reproducible pseudo-random order: the MD5 of the row key."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))


def global_rank(
    df: DataFrame,
    bucket: Column,
    order: Sequence[Column],
    by: Sequence[str] = (),
    out: str = "rank",
) -> DataFrame:
    """Exact 1-based rank over the whole table (or per ``by``) without a one-task sort.

    ``bucket`` must rise with ``order`` and split the rows into bounded parts.
    Rows are counted per bucket, the counts are accumulated over the few
    buckets, and each bucket is numbered on its own and shifted by its offset.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = keyed.withColumn("_pos", F.row_number().over(within))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*by, "_bucket"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        numbered.alias("r")
        .join(offsets.alias("o"), cond)
        .select("r.*", (F.col("_pos") + F.col("_offset")).alias(out))
        .drop("_bucket", "_pos")
    )


def hash_rank(
    df: DataFrame, keys: Sequence[str], by: Sequence[str] = (), salt: str = "", out: str = "rank"
) -> DataFrame:
    """Exact rank in pseudo-random order; hashing keeps the 4,096 buckets even."""
    digest = hash_order(*[F.col(k) for k in keys], *([F.lit(salt)] if salt else []))
    ranked = global_rank(
        df.withColumn("_h", digest),
        F.substring("_h", 1, 3),
        [F.col("_h"), *[F.col(k) for k in keys]],
        by=by,
        out=out,
    )
    return ranked.drop("_h")


def score_bucket(score: Column) -> Column:
    """Bucket number that never falls as a probability rises.

    Spacing is logarithmic towards 0 and towards 1, so scores that crowd one
    end of the range still spread over many buckets.
    """
    low = F.floor(F.log2(score) * 64)
    high = -F.floor(F.log2(1 - score) * 64)
    return (
        F.when(score <= 0, F.lit(-1_000_000))
        .when(score >= 1, F.lit(1_000_000))
        .when(score < 0.5, low)
        .otherwise(high)
        .cast("long")
    )


def value_bucket(value: Column) -> Column:
    """Bucket number that never falls as any number rises, logarithmic in its size."""
    size = F.floor(F.log2(F.abs(value)) * 64) + 100_000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def running_totals(
    df: DataFrame, by: Sequence[str], order: str, bucket: Column, measures: Sequence[str]
) -> DataFrame:
    """Totals of the measures over all smaller ``order`` values, and over everything.

    Sums run inside each bucket and are shifted by the sums of the buckets
    below, so no task orders the whole table.  ``order`` is unique per ``by``.
    """
    keyed = df.withColumn("_b", bucket)
    below = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*by, "_b")
        .agg(*[F.sum(m).alias(f"_{m}") for m in measures])
        .select(
            *by,
            "_b",
            *[F.coalesce(F.sum(f"_{m}").over(below), F.lit(0)).alias(f"_o_{m}") for m in measures],
            *[F.sum(f"_{m}").over(everything).alias(f"total_{m}") for m in measures],
        )
    )
    running = keyed.withColumns(
        {f"_i_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}
    )
    return running.join(offsets, [*by, "_b"]).select(
        *df.columns,
        *[(F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"{m}_below") for m in measures],
        *[F.col(f"total_{m}") for m in measures],
    )


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, exact and without gathering a group's values."""
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    t = running_totals(distinct, by, "_v", value_bucket(F.col("_v")), ["n"])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n")), F.col("_v")))

    aggs = []
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("total_n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        aggs.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return t.groupBy(*by).agg(F.min("_v").alias("lowest"), *aggs, F.max("_v").alias("highest"))
