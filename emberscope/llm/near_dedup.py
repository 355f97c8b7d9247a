"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.shared import mix, pieces, split_words, stage, texts, windows, word_hashes

SHINGLE = 5
SIMILARITY = 85  # percent, unless the caller names another
COORDINATES = 128
ROWS = 4
UNIVERSE = 1 << 21
SEED = 20240607
GATHER = 8192
SIGNED = "doc_id long, text_key long, n_shingles long, key1 long, key2 long, bands array<long>"


@lru_cache(maxsize=1)
def shifted_permutation() -> np.ndarray:
    """The second permutation of the universe, continued past its end; window p holds its values at p, p+1, ..."""
    values = np.random.Generator(np.random.PCG64(SEED)).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.r_[values, values[: COORDINATES - 1]], COORDINATES)


def shingle_sets(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each starts."""
    words, bounds = split_words([v and v.lower() for v in values])
    hashes = word_hashes(words)
    runs = windows(hashes, SHINGLE)
    parts, sizes = [], []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            part = np.sort(runs[a : b - SHINGLE + 1])
            part = part[np.r_[True, part[1:] != part[:-1]]]
        else:
            part = windows(hashes[a:b], b - a, seed=b - a) if b > a else hashes[:0]
        parts.append(part)
        sizes.append(len(part))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least value of the second permutation, shifted by k, over the set.

    The first permutation, a bijection of hashes, places a shingle in the universe; since shifts of the
    second are neighbours in memory, all coordinates of a shingle are one contiguous read.
    """
    table = shifted_permutation()
    place = (mix(shingles ^ np.uint64(SEED)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    out = np.full((len(bounds) - 1, COORDINATES), np.iinfo(np.uint32).max, np.uint32)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a in range(0, len(place), GATHER):
        own = owner[a : a + GATHER]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        least = np.minimum.reduceat(table[place[a : a + GATHER]], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ``ROWS`` coordinates, different for equal values in different bands."""
    parts = signature.reshape(len(signature), -1, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        shingles, bounds = shingle_sets(batch.column("text").to_pylist())
        some = np.diff(bounds) > 0
        keys = band_keys(signatures(shingles, bounds)).view(np.int64)
        digests = []
        for seed in (1, 2):
            total = np.r_[np.uint64(0), np.cumsum(mix(shingles + np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)), dtype=np.uint64)]
            digests.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
        width = keys.shape[1]
        counts = np.where(some, width, 0)
        bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(keys[some].ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(bounds)), *map(pa.array, digests), bands],
            names=[f.split()[0] for f in SIGNED.split(", ")],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        shingles, bounds = shingle_sets(batch.column("text").to_pylist())
        sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(bounds)), sets], names=["node", "n", "shingles"])


def text_key(text: Column) -> Column:
    """What tells apart rows with the same id."""
    return F.xxhash64(text.cast("binary"))


def keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("text_key", text_key(F.col("text")))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of intersection and union of their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - shared
    return both.select("a", "b", shared.alias("shared"), union.alias("union"))


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Those that are links: at least ``percent`` of the union is shared."""
    return pairs.where(100 * F.col("shared") >= percent * F.col("union")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node with a link.

    Each round takes the smallest label among the neighbours and then the label of that label, so chains
    shorten by halves; every round is written to the shared folder, and only a count reaches the driver.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        least = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        least = stage(least, "least")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = stage(least.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"), "old"), "labels")
        changed = after.where("label <> old").limit(1).count()
        labels = after.drop("old")
        if not changed:
            return labels


def linked_nodes(docs: DataFrame, signed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all sets with a link to another one; ``nodes`` numbers the sets and names a row of each.

    A set is first compared with the smallest one it meets in any band.  Buckets whose members
    are then still in several components are compared pair by pair, in the first band a pair shares, and only
    pairs that can be links: given how many of their shingles occur in any other text still open (a copy with
    under ``percent`` % shingles that others have leaves its buckets, however large, at once), and given their distances from
    a common text they were compared with, as Jaccard distance obeys the triangle inequality.
    """
    named = nodes.select("node", "n_shingles", F.col("key1").alias("k1"), F.col("key2").alias("k2"), F.col("first_id").alias("of"))
    same = (signed["key1"] == named["k1"]) & (signed["key2"] == named["k2"]) & signed["doc_id"].eqNullSafe(named["of"])
    bands = signed.drop("n_shingles").join(named, same).select("node", "of", "text_key", "n_shingles", "bands")
    bands = stage(bands.dropDuplicates(["node"]), "representatives")
    flat = bands.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    members = stage(flat.join(stage(shared, "buckets"), "bucket"), "members")
    pairs = members.groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("b")).where("a <> b")
    active = members.select("node").distinct().join(bands.select("node", "of", F.col("text_key").alias("key")), "node")
    source = keyed(docs)
    own = source.join(active, source["doc_id"].eqNullSafe(active["of"]) & (source["text_key"] == active["key"]))
    own = own.select("node", "text").distinct()  # copies under one id, or without one, are dropped where they are read
    sets = stage(own.mapInArrow(_sets, "node long, n long, shingles array<long>").dropDuplicates(["node"]), "shingle-sets")
    judged = stage(compared(pairs, sets), "compared")
    links = similar(judged, percent)
    labels = components(links)

    open_ = members.drop("leader").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = stage(open_.select("bucket", "node", "n_shingles", "label"), "open-members")
    mixed = open_.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    open_ = stage(open_.join(stage(mixed, "mixed"), "bucket"), "open-members")
    some = open_.select("node").distinct()
    alone = (
        sets.join(some, "node").select("node", F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
        .groupBy("node").agg(F.count("*").alias("alone"))
    )
    open_ = open_.join(stage(alone, "alone"), "node", "left").withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
    open_ = stage(open_.where(100 * F.col("common") >= percent * F.col("n_shingles")).drop("alone"), "open-members")
    pivots = judged.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("shared") / F.col("union")).alias("far"))
    held = open_.select("node").distinct().join(bands.select("node", "bands"), "node").join(pivots, "node", "left")
    held = stage(held.select("node", "bands", F.coalesce("pivot", "node").alias("pivot"), F.coalesce("far", F.lit(0.0)).alias("far")), "pivots")
    open_ = stage(open_.join(held, "node"), "open-members")
    x, y = (
        open_.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in open_.columns if c != "bucket"]) for side in "ab"
    )
    most = F.least("common_a", "common_b")
    near = (F.col("pivot_a") != F.col("pivot_b")) | (F.abs(F.col("far_a") - F.col("far_b")) <= 1 - percent / 100 + 1e-9)
    both = F.filter(F.zip_with("bands_a", "bands_b", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())
    possible = (
        (F.col("label_a") < F.col("label_b")) & near & (F.get(both, 0) == x["bucket"])
        & (100 * most >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b") - most))
    )
    more = x.hint("merge").join(y, (x["bucket"] == y["bucket"]) & possible).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    more = stage(similar(compared(more, sets), percent), "links")
    if more.limit(1).count() == 0:
        return labels
    return components(links.unionByName(more))


def classes(docs: DataFrame, percent: int, with_null_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, sets, links): per row its set's keys; per set a number ``node`` and its smallest id ``first_id``;
    per set with a link the component's ``label``.

    Equal sets are one node, so copies cost one row each and never a pair.  Nodes are numbers of their own, so
    rows with the same id or without one are judged by their own texts.  They rise with the smallest id, null last:
    the text that a bucket's members are compared with first is the oldest, from which near copies differ least.
    """
    signed = stage(keyed(docs).mapInArrow(_sign, SIGNED), "signatures")
    some = signed.where("n_shingles > 0") if with_null_ids else signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = some.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("first_id"))
    order = [F.asc_nulls_last("first_id"), "key1", "key2"]
    nodes = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")
    return signed, nodes, linked_nodes(docs, signed, nodes, percent)


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept.

    Two texts are linked if their sets have a Jaccard similarity of ``percent`` % or more.  The bands miss a
    pair of 80 % with a chance of 5e-8 and a closer one less often.

    Null and empty texts have an empty set and are linked with nothing.  A null id links nothing:
    its component is null and it is kept.  Rows with the same id are judged by their own texts.  Other
    columns are ignored; no rows give no rows.
    """
    signed, nodes, labels = classes(docs, percent, False)
    linked = nodes.join(labels, "node")
    least = linked.groupBy("label").agg(F.min("first_id").alias("least"))
    linked = stage(linked.join(least, "label").select("node", "least"), "components")
    placed = nodes.join(linked, "node", "left").select("key1", "key2", F.coalesce("least", "first_id").alias("label"))
    rows = signed.select("doc_id", "n_shingles", "key1", "key2").join(placed, ["key1", "key2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_duplicates(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """One row of every group of near-duplicates, with all its columns: that of the smallest id (null last).

    Rows are judged, not ids: of equal texts under one id, or without an id, one row stays; an id with several
    texts keeps each that no other row stands for.  Rows without words are in no group and all stay.  Columns
    may have any names.
    """
    signed, nodes, labels = classes(docs, percent, True)
    grouped = nodes.join(labels, "node", "left").select("key1", "key2", F.coalesce("label", "node").alias("label"))
    rows = signed.where("n_shingles > 0").select("doc_id", "text_key", "key1", "key2").join(grouped, ["key1", "key2"])
    counted = rows.groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = counted.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("best"))
    wordless = signed.where("n_shingles = 0").select("doc_id", "text_key").distinct()
    winners = best.select("best.doc_id", "best.text_key", "best.n").unionByName(wordless.withColumn("n", F.lit(1).cast("long")))
    winners = stage(winners.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("n").alias("_n")), "winners")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    this = F.col("row")["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (text_key(F.col("row")["text"]) == F.col("_key"))
    found = whole.join(winners, this)
    once = found.where("_n > 1").dropDuplicates(["_id", "_key"])
    return found.where("_n = 1").unionByName(once).select("row.*")
