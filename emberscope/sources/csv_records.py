"""Records of CSV files whose quoted text may span lines, read by many tasks a file.

Spark splits a text file into blocks of lines, but only all lines before a block tell whether it begins inside a
quoted field.  A first pass sums up each block: in which state it ends, for either state it may begin in.  The
summaries of a file's blocks, one row each, are then chained.  A second pass joins the lines of each record where
they are read; only records that cross a block's border, two pieces a block at most, are put together in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberscope.session import shared_dir

OUT, IN = 0, 1
BOM = "\ufeff"
#: A field: quoted (a doubled quote stands for one; text after the closing quote belongs to it) or plain.
QUOTED = r'"(?:[^"]|"")*'
FIELD = rf'(?:{QUOTED}"(?:[^",][^,]*)?|[^",][^,]*|)'
#: Lines that end inside a quoted field: begun outside of one, or inside.
OPENS = rf"(?s)^(?:{FIELD},)*{QUOTED}$"
STAYS = rf'(?s)^(?:[^"]|"")*$|^(?:[^"]|"")*"(?:[^",][^,]*)?,(?:{FIELD},)*{QUOTED}$'


def line_steps(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The state after each line, if it begins outside and if it begins inside a quoted field."""
    quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    after_out, after_in = np.full(len(lines), OUT, np.int8), np.full(len(lines), IN, np.int8)
    at = np.flatnonzero(quoted)
    if len(at):
        some = lines.take(pa.array(at))
        opens = pc.match_substring_regex(some, OPENS).to_numpy(zero_copy_only=False)
        comment = pc.starts_with(some, "#").to_numpy(zero_copy_only=False)
        after_out[at] = opens & ~comment
        after_in[at] = pc.match_substring_regex(some, STAYS).to_numpy(zero_copy_only=False)
    return after_out, after_in


def states(after_out: np.ndarray, after_in: np.ndarray, start: int) -> np.ndarray:
    """The state after each of the lines in turn: that of the last line that fixes it, turned by the lines since that turn it."""
    fixed, turns = after_out == after_in, np.cumsum((after_out == IN) & (after_in == OUT))
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    known = last >= 0
    base = np.where(known, after_out[last], start)
    return (base ^ ((turns - np.where(known, turns[last], 0)) & 1)).astype(np.int8)


def _lines(spark: SparkSession, roots: Sequence[str], recursive: bool, glob: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).option("lineSep", "\n")
    return raw.text(list(roots)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.Array]]:
    """(path, block, whether it is the first run of its block, lines): runs of lines of one block within a batch."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        code = batch.column("path").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = (batch.column("path")[a].as_py(), int(block[a]))
            yield (*key, key != before, batch.column("line").slice(a, b - a))
            before = key


SUMMARY = "path string, block long, end_out int, end_in int, leaves boolean, header string, header_line long"


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: dict | None = None
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("end_out", pa.int32()), ("end_in", pa.int32()), ("leaves", pa.bool_()), ("header", pa.string()), ("header_line", pa.int64())])
    number = 0
    for path, block, first, lines in _runs(batches):
        if first:
            if now:
                yield pa.RecordBatch.from_pylist([now], schema)
            now = {"path": path, "block": block, "end_out": OUT, "end_in": IN, "leaves": False, "header": None, "header_line": None}
            number = 0
        steps = line_steps(lines)
        from_in = states(*steps, now["end_in"])
        now["leaves"] = now["leaves"] or bool((from_in == OUT).any())
        now["end_out"], now["end_in"] = int(states(*steps, now["end_out"])[-1]), int(from_in[-1])
        if block == 0 and now["header"] is None:
            for k, line in enumerate(lines):
                text = line.as_py().removeprefix(BOM)
                if text.strip() and not text.startswith("#"):
                    now["header"], now["header_line"] = text, number + k
                    break
        number += len(lines)
    if now:
        yield pa.RecordBatch.from_pylist([now], schema)


def block_table(spark: SparkSession, roots: Sequence[str], recursive: bool, glob: str) -> DataFrame:
    """One row per block: path, block, whether it starts inside a quoted field, ``origin``, the block in which the record
    begins that its first lines belong to, and in a file's first block the header and its line.

    A block maps either state to an end state; the running state of a file is the end of its last block that ends
    the same way from both, turned by the blocks since that swap them.
    """
    found = _lines(spark, roots, recursive, glob).mapInArrow(_summaries, SUMMARY)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("end_out") == F.col("end_in"), F.struct("block", "end_out", "swaps"))
    swap = ((F.col("end_out") == IN) & (F.col("end_in") == OUT)).cast("int")
    counted = found.withColumn("swaps", F.sum(swap).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = counted.withColumn("last", F.last(fixed, ignorenulls=True).over(before)).withColumn(
        "turned", F.coalesce(F.lag("swaps").over(Window.partitionBy("path").orderBy("block")), F.lit(0)) - F.coalesce("last.swaps", F.lit(0))
    )
    start = F.pmod(F.coalesce("last.end_out", F.lit(OUT)) + F.col("turned"), F.lit(2)).cast("int")
    started = last.withColumn("start", start)
    ends = F.when(F.col("start") == OUT, F.col("end_out")).otherwise(F.col("end_in"))
    # A record begins in the block and goes on beyond it.
    begins = (ends == IN) & ((F.col("start") == OUT) | F.col("leaves"))
    origin = F.last(F.when(begins, F.col("block")), ignorenulls=True).over(before)
    table = started.select("path", "block", "start", origin.alias("origin"), "header", "header_line")
    folder = shared_dir(spark, "csv-blocks")
    table.write.parquet(folder)
    return spark.read.schema(table.schema).parquet(folder)


RECORDS = "path string, block long, line long, piece int, record string"


def _records(batches: Iterable[pa.RecordBatch], inside: frozenset) -> Iterator[pa.RecordBatch]:
    """Whole records (piece 0) and the pieces at a block's borders: its first lines (1) and its last (2)."""
    state = number = 0
    open_: list[str] = []
    opened, head = 0, False
    key: tuple = ()

    def rest() -> pa.RecordBatch:
        return made([opened], [1 if head else 2], pa.array(["\n".join(open_)]))

    def made(lines: Sequence[int], pieces: Sequence[int], records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        columns = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(lines, pa.int64()), pa.array(pieces, pa.int32()), records]
        return pa.RecordBatch.from_arrays(columns, names=["path", "block", "line", "piece", "record"])

    for path, block, first, lines in _runs(batches):
        if first:
            if open_:
                yield rest()
            key, number, open_ = (path, block), 0, []
            state = IN if key in inside else OUT
            head = state == IN
        after = states(*line_steps(lines), state)
        ends = np.flatnonzero(after == OUT)
        begin = 0
        if open_ or head:
            if not len(ends):
                open_ += lines.to_pylist()
                state, number = IN, number + len(lines)
                continue
            open_ += lines.slice(0, int(ends[0]) + 1).to_pylist()
            yield made([opened], [1 if head else 0], pa.array(["\n".join(open_)]))
            begin, open_, head, ends = int(ends[0]) + 1, [], False, ends[1:]
        if len(ends):
            starts = np.concatenate([[begin], ends[:-1] + 1])
            span = lines.slice(begin, int(ends[-1]) + 1 - begin)
            if len(ends) == len(span):
                whole = span
            else:
                offsets = np.concatenate([starts, [ends[-1] + 1]]) - begin
                whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), span), "\n")
            yield made((starts + number).tolist(), [0] * len(whole), whole)
            begin = int(ends[-1]) + 1
        if begin < len(lines):
            open_, opened = lines.slice(begin).to_pylist(), number + begin
        state, number = int(after[-1]), number + len(lines)
    if open_:
        yield rest()


def read_records(spark: SparkSession, roots: Sequence[str], recursive: bool, glob: str) -> tuple[DataFrame, DataFrame]:
    """(records, blocks): path, block and line where each record begins, and its text; and the block table.

    Lines inside a record are joined by a line feed; comments, empty lines and the header are still there.  The
    list of blocks that begin inside a quoted field goes to all tasks: an entry for a block of 128 MB, so some
    hundred thousand for 100 TB.  A record whose closing quote is missing reaches to the end of its file.
    """
    blocks = block_table(spark, roots, recursive, glob)
    inside = frozenset((r["path"], r["block"]) for r in blocks.where(F.col("start") == IN).select("path", "block").collect())
    shared = spark.sparkContext.broadcast(inside)
    records = _lines(spark, roots, recursive, glob).mapInArrow(lambda b: _records(b, shared.value), RECORDS)
    whole = records.where("piece = 0").select("path", "block", "line", "record")
    if not inside:
        return records.select("path", "block", "line", "record"), blocks
    pieces = records.where("piece > 0").join(blocks.select("path", "block", "origin"), ["path", "block"])
    begun = F.when(F.col("piece") == 1, F.col("origin")).otherwise(F.col("block"))
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "record")))
    joined = pieces.groupBy("path", begun.alias("begun")).agg(parts.alias("parts")).select(
        "path", F.col("begun").alias("block"), F.col("parts")[0]["line"].alias("line"),
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
    )
    return whole.unionByName(joined), blocks
