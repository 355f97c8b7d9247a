"""Best-fit packing of tokenised documents by residual rounds over a tree of shrinking groups.

Every partition packs its own pieces best-fit, longest first.  Full and nearly full bins are done.  The others
become items themselves and are dealt into fewer groups, which pack them again; this is repeated until one
group is left or a round no longer helps.  A bin travels with the list of its pieces, which its capacity bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.batch_encoder import batch_encoder, with_end
from emberscope.llm.shared import pieces, stage

CAPACITY = 2048
END_ID = 0
SLACK = 4
GROUP_ITEMS = 50_000
LEAST_GAIN = 0.002
PIECE = pa.struct([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])
BIN = pa.schema([("bin", pa.int64()), ("fill", pa.int64()), ("members", pa.list_(PIECE))])
MEMBERS = "array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, ids: binary>>"
PLACED_TYPE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PLACED = pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.int64()) for f in PLACED_TYPE.split(", ")])
BIN_TYPE = f"bin long, fill long, members {MEMBERS}"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: items from long to short, each into the fullest bin that still has room.

    Bit r of ``open_`` tells whether some bin has r free places, so the next fit is one shift away.
    """
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    open_ = 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        above = open_ >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            own = free[room].pop()
            if not free[room]:
                open_ &= ~(1 << room)
            bins[own].append(item)
        else:
            room, own = capacity, len(bins)
            bins.append([item])
        room -= size
        free.setdefault(room, []).append(own)
        if room:
            open_ |= 1 << room
    return bins


def pack_items(rows: list[tuple[int, list[dict]]], capacity: int, first: int) -> pa.RecordBatch:
    """The bins of items given as (length, pieces), numbered from ``first``."""
    out = []
    for number, own in enumerate(best_fit([length for length, _ in rows], capacity)):
        members = [m for i in own for m in rows[i][1]]
        out.append({"bin": first + number, "fill": sum(rows[i][0] for i in own), "members": members})
    return pa.RecordBatch.from_pylist(out, BIN)


def grouped(items: Iterator[tuple[int, int, list[dict]]], capacity: int, round_: int, group_items: int) -> Iterator[pa.RecordBatch]:
    """Pack a task's items, given as (order, length, pieces), in groups of bounded size; bins get numbers no other task or round gives."""
    number = (round_ << 56) | (TaskContext.get().partitionId() << 32)
    group: list[tuple[int, int, list[dict]]] = []

    def pack() -> pa.RecordBatch:
        nonlocal number, group
        group.sort(key=lambda x: x[0])
        packed = pack_items([(length, members) for _, length, members in group], capacity, number)
        number, group = number + packed.num_rows, []
        return packed

    for item in items:
        group.append(item)
        if len(group) >= group_items:
            yield pack()
    if group:
        yield pack()


def token_pieces(batches: Iterable[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[tuple[int, int, list[dict]]]:
    """The pieces of each document as items."""
    code, order = batch_encoder(tokenizer), 0
    for batch in pieces(batches):
        ids, counts = with_end(*code.encode(batch.column("text")), end_id)
        wide = ids.astype("<u4")
        begin = 0
        for doc_id, count in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
            for k, start in enumerate(range(0, count, capacity)):
                own = wide[begin + start : begin + min(count, start + capacity)].tobytes()
                piece = {"doc_id": doc_id, "piece": k, "start": start, "length": len(own) // 4, "ids_crc32": zlib.crc32(own), "ids": own if with_ids else None}
                yield order, len(own) // 4, [piece]
                order += 1
            begin += count


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, with_ids: bool = False,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """One row per sequence: bin, fill (its tokens) and members, its pieces in order with doc_id, piece, start, length, ids_crc32 and,
    if asked for, ids (little-endian unsigned 32-bit numbers).

    A document is the ids of its whole text and ``end_id``; only one longer than ``capacity`` is cut, into pieces
    of that length and a rest.  Null and empty texts are the end id alone; null and repeated ids are documents
    like others; other columns are ignored; no rows give no rows.  Bins with at most ``slack`` free places are
    done after the round that made them.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(token_pieces(batches, tokenizer, capacity, end_id, with_ids), capacity, 0, group_items)

    def again(round_: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = ((r["bin"], r["fill"], r["members"]) for batch in batches for r in batch.to_pylist())
            return grouped(items, capacity, round_, group_items)

        return run

    made, done, groups, before = stage(rows.mapInArrow(first, BIN_TYPE), "packed-0"), [], 4 * tasks, None
    for round_ in range(1, 100):
        left = made.where(F.col("fill") < capacity - slack)
        done.append(made.where(F.col("fill") >= capacity - slack))
        n = left.count()
        if n < 2 or groups == 1 or (before is not None and before - n < LEAST_GAIN * before):
            break
        before, groups = n, max(1, -(-n // group_items), groups // 4) if n > group_items else 1
        dealt = left.repartition(groups, F.xxhash64("bin", F.lit(round_)))
        made = stage(dealt.mapInArrow(again(round_), BIN_TYPE), f"packed-{round_}")
    for part in done:
        left = left.union(part)
    return left


def placements(packed: DataFrame) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and its offset in the sequence."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            counts, flat = members.value_lengths().to_numpy(), members.flatten()
            length = flat.field("length").to_numpy()
            ends = np.cumsum(length)
            heads = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
            fields = [flat.field(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            sequence = np.repeat(batch.column("bin").to_numpy(), counts)
            offset = ends - length - np.repeat(heads, counts)
            yield pa.RecordBatch.from_arrays([*fields, pa.array(sequence), pa.array(offset)], names=PLACED.names)

    slim = F.transform("members", lambda m: F.struct(*[m[n].alias(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]))
    return packed.select("bin", slim.alias("members")).mapInArrow(place, PLACED_TYPE)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the packed ids of sequences made with ``with_ids``."""
    ids = F.aggregate("members", F.lit(b"").cast("binary"), lambda all_, m: F.concat(all_, m["ids"]))
    return packed.select(F.col("bin").alias("sequence_id"), F.col("fill").alias("n_tokens"), ids.alias("ids"))
