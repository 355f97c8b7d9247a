"""Exact nearest neighbours of many points by pivots.

Every point belongs to the cell of its nearest pivot.  Its neighbours inside the cell bound how far the true ones
can be, and the triangle inequality then names the few other cells that may hold a nearer one.  Cells and queries
meet in chunks of bounded size.  Equal points are one point with a count, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.session import shared_dir

MOST_PIVOTS = 1024
CHUNK = 4096
BLOCK = 256
NEAR = "array<struct<gap: double, y: array<double>, copies: long>>"
NEAR_TYPE = pa.list_(pa.struct([("gap", pa.float64()), ("y", pa.list_(pa.float64())), ("copies", pa.int64())]))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, width)


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``, added up one dimension after the other."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += (x[:, k : k + 1] - y[:, k][None, :]) ** 2
    return out


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _listed(rows: list[tuple[int, list[dict]]]) -> pa.Table:
    return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "near": pa.array([r[1] for r in rows], NEAR_TYPE)})


def _nearest_of(queries: pa.Table, points: pa.Table, width: int, k: int, itself: bool) -> pa.Table:
    """For each query the nearest points up to ``k`` copies in all; ``itself`` tells that the query is one of them."""
    rows: list[tuple[int, list[dict]]] = []
    if not queries.num_rows or not points.num_rows:
        return _listed(rows)
    x, y = _matrix(queries["x"], width), _matrix(points["x"], width)
    ids, own = queries["id"].to_numpy(), points["id"].to_numpy()
    copies = points["copies"].to_numpy()
    radius = queries["radius"].to_numpy() if "radius" in queries.column_names else np.full(len(ids), np.inf)
    for a in range(0, len(ids), BLOCK):
        gaps = _gaps(x[a : a + BLOCK], y)
        if itself:
            gaps[ids[a : a + BLOCK][:, None] == own[None, :]] = np.inf
        for row, id_, most in zip(gaps, ids[a : a + BLOCK].tolist(), radius[a : a + BLOCK].tolist()):
            if len(row) > k:
                most = min(most, np.partition(row, k - 1)[k - 1])
            found = np.flatnonzero((row <= most) & np.isfinite(row))
            near = sorted(({"gap": row[j], "y": y[j].tolist(), "copies": int(copies[j])} for j in found), key=lambda n: (n["gap"], n["y"]))
            rows.append((id_, near[:k]))
    return _listed(rows)


def _meet(queries: DataFrame, points: DataFrame, counts: dict[int, int], width: int, k: int, itself: bool) -> DataFrame:
    """Bring the queries of each cell, in chunks, together with the cell's points."""
    chunks = {cell: -(-n // CHUNK) for cell, n in counts.items() if n > CHUNK}
    if chunks:
        of = F.create_map(*[F.lit(v) for cell, n in chunks.items() for v in (cell, n)])
        n_chunks = F.coalesce(of[F.col("cell")], F.lit(1))
    else:
        n_chunks = F.lit(1)
    dealt = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), n_chunks).cast("int"))
    spread = points.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    keys = ["cell", "chunk"]

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest_of(left, right, width, k, itself)

    return dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(near, f"id long, near {NEAR}")


def nearest(points: DataFrame, k: int, width: int) -> DataFrame:
    """(x, copies, near): each distinct point of the column ``x``, how many rows it stands for, and its neighbours.

    ``near`` lists other points by distance (``gap`` is its square), then by coordinates, so many that their copies
    reach ``k``, or all.  A point's own copies are not listed.  The result is that of comparing all pairs, however
    the rows are partitioned.  Cells hold some thousand points each; the pivots, at most ``MOST_PIVOTS`` points, are known to all tasks.
    """
    distinct = points.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("id", F.monotonically_increasing_id())
    distinct = _stored(distinct, "points")
    n = distinct.count()
    wanted = max(1, min(MOST_PIVOTS, int(n**0.5)))
    chosen = distinct.orderBy(F.xxhash64("x"), "x").limit(wanted).select("x").collect()
    pivots = np.array([r["x"] for r in chosen], np.float64).reshape(-1, width)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            cell = np.concatenate([[], *[_gaps(x[a : a + CHUNK], pivots).argmin(1) for a in range(0, len(x), CHUNK)]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    placed = distinct.mapInArrow(assign, "x array<double>, copies long, id long, cell int")
    placed = _stored(placed, "cells")
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside = _stored(_meet(placed.select("id", "x", "cell"), placed, sizes, width, k, True), "near-inside")
    # The k-th neighbour in the cell bounds the distance; with fewer, any cell may help.
    known = F.aggregate("near", F.lit(0).cast("long"), lambda s, m: s + m["copies"])
    bound = F.when(F.size("near") >= k, F.element_at("near", -1)["gap"]).otherwise(F.lit(float("inf")))
    queries = placed.select("id", "x", "cell").join(inside.select("id", bound.alias("radius"), known.alias("known")), "id")

    def probes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.sqrt(_gaps(pivots, pivots))
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            home, radius = batch.column("cell").to_numpy(), batch.column("radius").to_numpy()
            for a in range(0, len(x), BLOCK):
                gaps, at = _gaps(x[a : a + BLOCK], pivots), home[a : a + BLOCK]
                own = gaps[np.arange(len(at)), at][:, None]
                # Every point of another cell lies beyond the plane half way between the two pivots.
                with np.errstate(divide="ignore", invalid="ignore"):
                    beyond = (gaps - own) / (2 * apart[at])
                slack = 1e-9 * (1 + np.sqrt(gaps))
                open_ = ~(beyond - slack > np.sqrt(radius[a : a + BLOCK])[:, None])
                open_[np.arange(len(at)), at] = False
                row, cell = np.nonzero(open_)
                taken = pa.array(row + a)
                parts = [batch.column(c).take(taken) for c in ("id", "x", "radius")]
                yield pa.RecordBatch.from_arrays([*parts, pa.array(cell.astype(np.int32))], names=["id", "x", "radius", "cell"])

    probed = _stored(queries.mapInArrow(probes, "id long, x array<double>, radius double, cell int"), "probes")
    visits = {r["cell"]: r["n"] for r in probed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    outside = _meet(probed, placed, visits, width, k, False)
    # A list has at most k entries and a point visits each cell once, so what is gathered per point is bounded.
    merged = inside.unionByName(outside).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("all"))
    enough = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("take")),
        lambda s, m: F.struct((s["n"] + m["copies"]).alias("n"), (s["take"] + F.when(s["n"] < k, 1).otherwise(0)).alias("take")),
    )["take"]
    return placed.join(merged, "id").select("x", "copies", F.slice("all", F.lit(1), enough).alias("near"))
