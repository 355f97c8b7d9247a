"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything is DataFrame functions.  Rows fall into blocks by a hash of their id, source, text and number among
equal rows, so a block is a random handful of its source even if rows share an id or have none.  A source gives whole passes over its blocks and, for the rest of its target, a prefix
of them; these draws are its exact quota of blocks.  A tree over the output shards splits the quotas in two,
and again, each time by a multivariate hypergeometric draw, and every leaf takes its quota as disjoint blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.llm.shared import WORD, stage
from emberscope.operators.sizing import is_small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SHARDS = 16
BLOCK_DOCUMENTS = 256
GROUP_BLOCKS = 512
SEED = 17
SPREAD = 1 << 53
COPIES = 4096
FEW_KEYS = 200_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key() -> Column:
    """What equal rows have in common."""
    return F.xxhash64(F.lit(SEED), "doc_id", "source", "text")


def place(nth: Column) -> Column:
    """A number below 2^53 that depends on the row's key and its number among equal rows alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), "key", nth), F.lit(SPREAD))


EQUAL = ["source", "size", "key"]


def counted(measured: DataFrame) -> DataFrame:
    """(source, size, key, n): rows are counted where they are read, so a hot row moves once per task."""
    return stage(measured.groupBy(*EQUAL).agg(F.count("*").alias("n")), "row-counts")


def places(counts: DataFrame) -> DataFrame:
    """(source, size, at) of every row.  Equal rows get their numbers in chunks, and many chunks are dealt out."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
    few, many = counts.where(F.col("n") <= COPIES).withColumn("chunk", F.lit(0).cast("long")), counts.where(F.col("n") > COPIES)
    chunks = few.unionByName(many.withColumn("chunk", chunk).repartition("key", "chunk"))
    first = F.col("chunk") * COPIES
    numbers = F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)
    return chunks.withColumn("nth", F.explode(numbers)).select("source", "size", place(F.col("nth")).alias("at"))


def numbered(measured: DataFrame, counts: DataFrame) -> DataFrame:
    """``measured`` with ``at``.  Only rows that have equals are moved to be numbered: within the task that wrote
    them, and from the counts of the tasks before it.
    """
    several = counts.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in EQUAL])
    if is_small(several, FEW_KEYS):  # no text then moves to find the rows that have no equals
        several = F.broadcast(several)
    same = measured["source"].eqNullSafe(several["_source"]) & (measured["size"] == several["_size"]) & (measured["key"] == several["_key"])
    alone = measured.join(several, same, "left_anti").withColumn("at", place(F.lit(0).cast("long")))
    equal = measured.join(several, same, "left_semi").withColumn("number", F.monotonically_increasing_id())
    equal = stage(equal, "equal-rows").withColumn("task", F.shiftright("number", 33))
    before = Window.partitionBy(*EQUAL).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = equal.groupBy(*EQUAL, "task").agg(F.count("*").alias("n"))
    tasks = tasks.select(*[F.col(c).alias(f"_{c}") for c in [*EQUAL, "task"]], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    equal = equal.withColumn("nth", F.row_number().over(Window.partitionBy(*EQUAL, "task").orderBy("number")).cast("long") - 1)
    joined = equal.join(
        tasks,
        equal["source"].eqNullSafe(tasks["_source"]) & (equal["size"] == tasks["_size"]) & (equal["key"] == tasks["_key"]) & (equal["task"] == tasks["_task"]),
    )
    return alone.unionByName(joined.withColumn("at", place(F.col("_before") + F.col("nth"))).select(*alone.columns))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: s (rank by code point, null last), source, documents, source_size, target.

    Sources share ``share`` times all words by weight, each at most ``most`` times its own size.  In order
    of cap over weight, those at their cap come first; the level is that of the first one below it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("s", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("s") % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spent, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - spent) / (F.sum("weight").over(whole) - used)
    levels = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(by_ratio))
    free = F.col("level") * F.col("weight") < F.col("cap")
    final = F.min_by("level", F.when(free, F.col("nth"))).over(whole)
    return levels.withColumn("final", final).select(
        "s", "source", "documents", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def hypergeometric(total: Column, good: Column, take: Column, chance: Column) -> Column:
    """How many of ``take`` drawn from ``total`` are among ``good``, by inverse distribution function.

    Weights run up from eight deviations below the mode by the ratio of neighbours, so no factorial is
    needed and sums stay within a double.
    """
    size = F.greatest(total, F.lit(1))
    mode = F.floor((take + 1) * (good + 1) / (total + 2))
    deviation = F.sqrt(take * good / size * (1 - good / size) * (total - take) / F.greatest(total - 1, F.lit(1)))
    low = F.greatest(F.lit(0), take + good - total, F.floor(mode - 8 * deviation - 2)).cast("long")
    high = F.least(good, take, F.ceil(mode + 8 * deviation + 2)).cast("long")
    steps = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc, k):
        ratio = (good - k).cast("double") * (take - k) / ((k + 1).cast("double") * (total - good - take + k + 1))
        weight = acc["weight"] * ratio
        return F.struct(weight.alias("weight"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + weight)).alias("sums"))

    start = F.struct(F.lit(1.0).alias("weight"), F.array(F.lit(1.0)).alias("sums"))
    sums = F.aggregate(steps, start, step)["sums"]
    return low + F.size(F.filter(sums, lambda c: c < chance * F.element_at(sums, -1)))


def split(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(s, cuts): where each shard's share of a source's draws starts, and the end.  ``quotas`` is (s, quota)."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("s", "quota"))).alias("pairs")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("count"),
        F.transform("pairs", lambda p: p["s"]).alias("names"), F.transform("pairs", lambda p: p["quota"]).alias("q"),
    )
    width = 1
    while width < shards:
        half = F.floor(F.col("count") / 2).cast("int")
        everything = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        to_left = F.when(F.col("count") > 1, F.floor(everything * half / F.col("count"))).otherwise(0).cast("long")

        def draw(acc, x):
            chance = F.pmod(F.xxhash64(F.lit(SEED + width), F.col("first"), F.size(acc["left"])), F.lit(SPREAD)) / SPREAD
            k = hypergeometric(acc["total"], x, acc["take"], chance)
            return F.struct((acc["total"] - x).alias("total"), (acc["take"] - k).alias("take"), F.concat(acc["left"], F.array(k)).alias("left"))

        start = F.struct(everything.alias("total"), to_left.alias("take"), F.array().cast("array<bigint>").alias("left"))
        nodes = nodes.withColumn("left", F.aggregate("q", start, draw)["left"])
        left = F.struct(F.col("first"), half.alias("count"), F.col("left").alias("q"))
        right = F.struct((F.col("first") + half).alias("first"), (F.col("count") - half).alias("count"), F.zip_with("q", "left", lambda q, x: q - x).alias("q"))
        nodes = nodes.select("names", F.explode(F.array(left, right)).alias("n")).where("n.count > 0").select("names", "n.first", "n.count", "n.q")
        width *= 2
    leaves = nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("names", "q")).alias("x")).select("shard", "x.names", "x.q")
    by_shard = F.sort_array(F.collect_list(F.struct("shard", "q")))
    sums = F.aggregate(
        by_shard, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["q"]))
    )
    return leaves.groupBy(F.col("names").alias("s")).agg(sums.alias("cuts"))


def block(documents: Column, at: Column) -> Column:
    """The block of a place among its source's blocks."""
    return F.floor(at / SPREAD * F.ceil(documents / BLOCK_DOCUMENTS)).cast("long")


def plan(sizes: DataFrame, shards: int = SHARDS, **shares) -> tuple[DataFrame, DataFrame]:
    """The sources' targets, and per source and block the shard of each whole pass, that of the partial pass
    (null if not drawn) and, where the target falls inside the block, the last (size, at) taken: its shortest
    documents go first, so the mix ends close to the target.  ``sizes`` has source, size and at.
    """
    sources = stage(targets(sizes, **shares), "sources")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    named = sources.select(F.col("source").alias("of"), "s", "documents", "passes", "rest")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block(F.col("documents"), F.col("at")))
    blocks = rows.groupBy("s", "block").agg(F.sum("size").alias("size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = stage(blocks.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS)), "blocks")
    groups = blocks.groupBy("s", "group").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("s", "group", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    inside = Window.partitionBy("s", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(groups, ["s", "group"]).withColumns(
        {
            "start": F.col("words") + F.coalesce(F.sum("size").over(inside), F.lit(0)),
            "rank": F.col("n") + F.coalesce(F.count("*").over(inside), F.lit(0)),
        }
    ).withColumn("drawn", F.col("start") < F.col("rest"))
    blocks = stage(blocks.drop("group", "words", "n"), "blocks")
    edge = blocks.where("drawn AND start + size > rest").select("s", "block", "start", "rest")
    inner = Window.partitionBy("s", "block").orderBy("size", "at").rowsBetween(Window.unboundedPreceding, -1)
    edge_rows = rows.select("s", "block", "at", "size").join(edge, ["s", "block"])
    middle = F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2
    edge_rows = edge_rows.withColumn("fits", middle <= F.col("rest"))
    limits = edge_rows.groupBy("s", "block").agg(
        F.coalesce(F.max(F.when(F.col("fits"), F.struct("size", "at"))), F.struct(F.lit(-1).cast("long").alias("size"), F.lit(-1).cast("long").alias("at"))).alias("last")
    )
    quotas = blocks.groupBy("s").agg(
        F.count("*").alias("blocks"), (F.first("passes") * F.count("*") + F.count(F.when(F.col("drawn"), 1))).alias("quota")
    )
    quotas = stage(quotas, "quotas")
    cuts = split(quotas.select("s", "quota"), shards)
    dealt = blocks.join(quotas.select("s", "blocks").join(cuts, "s"), "s").join(limits, ["s", "block"], "left")

    def shard(position: Column) -> Column:
        return F.size(F.filter("cuts", lambda c: c <= position)) - 1

    turn = F.pmod(F.xxhash64(F.lit(SEED), "s"), F.col("blocks"))
    whole = F.transform(
        F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")),
        lambda p: shard(p * F.col("blocks") + (F.col("rank") + p * turn) % F.col("blocks")),
    )
    partial = F.when(F.col("drawn"), shard(F.col("passes") * F.col("blocks") + F.col("rank")))
    dealt = dealt.select("s", "block", whole.alias("whole"), partial.alias("partial"), "last")
    return sources, stage(dealt, "dealt-blocks")


def mix(docs: DataFrame, shards: int = SHARDS, **shares) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with size, source_size, target and ``copies``: the shard of each
    time the mix takes it.

    Null and empty texts have size 0 and may be taken without effect; a null source is a source of its own;
    repeated rows count each and are placed each for itself, as are rows without an id; other columns
    travel inside ``row`` untouched; without words every target is 0; no rows give no rows.  The same
    input gives the same mix.
    """
    measured = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].cast("string").alias("source"),
        words("text").alias("size"), key().alias("key"),
    )
    counts = counted(measured)
    sources, dealt = plan(stage(places(counts), "sizes"), shards, **shares)
    named = sources.select(F.col("source").alias("of"), "s", "documents", "source_size", "target")
    placed = numbered(measured, counts)
    rows = placed.join(named, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block(F.col("documents"), F.col("at")))
    within = F.col("partial").isNotNull() & (F.col("last").isNull() | (F.struct("size", "at") <= F.col("last")))
    copies = F.concat("whole", F.when(within, F.array("partial")).otherwise(F.array().cast("array<int>")))
    return rows.join(dealt, ["s", "block"]).select("row", "size", "source_size", "target", copies.alias("copies"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The drawn rows themselves, shard after shard, each in an order random but repeatable.

    Partitions are ranges of (shard, order), so a large shard takes as many tasks as it needs.
    """
    drawn = mixed.select("row", F.posexplode("copies").alias("copy", "shard"))
    order = F.xxhash64(F.lit(SEED), "shard", "copy", F.col("row")["doc_id"], F.col("row")["text"])
    return drawn.withColumn("order", order).repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select("row.*")
