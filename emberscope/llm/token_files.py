"""Token ids in Arrow files of equal-length sequences with masks.

A data set is a folder of shards in ascending ``doc_id`` order.  ``part-N.arrow`` is an Arrow IPC file whose
record batches hold two fixed-size-list columns: ``ids`` (unsigned 16 or 32 bit) and ``mask`` (true where an
id is real).  The ids of a shard's documents follow one another and are cut into sequences; only the shard's
last sequence is padded.  ``part-N.index.arrow`` holds ``doc_id``, ``start`` (within the shard) and
``n_tokens`` of each document.  Files are uncompressed, so a memory map gives any sequence without a copy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberscope.llm.batch_encoder import batch_encoder, with_end
from emberscope.llm.shared import pieces, released_shuffles, shared_dir, stage, texts

END_ID = 2
SEQUENCE = 1024
BATCH_SEQUENCES = 64
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes one shard under a private name and renames it when complete, so a repeated task does no harm."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int):
        self.fs, base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = f"{base}/part-{shard:06d}"
        self.own = f"{base}/.part-{shard:06d}-{uuid.uuid4().hex}"
        self.schema, self.dtype, self.length = file_schema(dtype, length), dtype, length
        self.sinks = [self.fs.open_output_stream(self.own + kind) for kind in (".arrow", ".index.arrow")]
        self.writer, self.index = (ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (self.schema, INDEX)))
        self.parts: list[np.ndarray] = []
        self.waiting = 0
        self.total = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """The documents of a batch: their ids one after the other, and how many each has."""
        starts = self.total + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(counts)], schema=INDEX))
        self.total += len(ids)
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.length * BATCH_SEQUENCES:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        block = self.length * BATCH_SEQUENCES
        while len(ids) >= block or (last and len(ids)):
            now, ids = ids[:block], ids[block:]
            rows = -(-len(now) // self.length)
            full = np.zeros(rows * self.length, self.dtype)
            full[: len(now)] = now
            mask = np.arange(rows * self.length) < len(now)
            self.writer.write_batch(
                pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeListArray.from_arrays(pa.array(full), self.length),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
                    ],
                    schema=self.schema,
                )
            )
        self.parts, self.waiting = [ids], len(ids)

    def close(self) -> str:
        self._flush(True)
        for part in (self.writer, self.index, *self.sinks):
            part.close()
        for kind in (".index.arrow", ".arrow"):
            if self.fs.get_file_info(self.final + kind).type == fs.FileType.NotFound:
                self.fs.move(self.own + kind, self.final + kind)
            else:
                self.fs.delete_file(self.own + kind)
        return self.final.rsplit("/", 1)[1]


class TokenFile:
    """Random access to the sequences of one shard; local files are memory-mapped, others are read ahead."""

    def __init__(self, folder: str, name: str):
        system, base = fs.FileSystem.from_uri(folder)
        local = isinstance(system, fs.LocalFileSystem)
        open_ = (lambda p: pa.memory_map(p)) if local else system.open_input_file
        self.reader = ipc.open_file(open_(f"{base}/{name}.arrow"))
        self.index = ipc.open_file(open_(f"{base}/{name}.index.arrow"))
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.rows + self.reader.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``k``: views of the file, not copies."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        batch = self.reader.get_batch(k // self.rows)
        at = (k % self.rows) * self.length
        ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[at : at + self.length]
        return ids, batch.column("mask").values.slice(at, self.length)

    def documents_ids(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, put together from the sequences it spans."""
        batches = ((b.column("ids").values.to_numpy(zero_copy_only=True), b.column("mask").values.true_count)
                   for b in map(self.reader.get_batch, range(self.reader.num_record_batches)))
        rest = np.zeros(0, np.uint16)
        documents = (row for k in range(self.index.num_record_batches) for row in zip(*(c.to_pylist() for c in self.index.get_batch(k).columns)))
        for doc_id, start, n in documents:
            got = [rest]
            have = len(rest)
            while have < n:
                values, real = next(batches)
                got.append(values[:real])
                have += real
            rest = got[0] if len(got) == 1 else np.concatenate(got)
            yield doc_id, start, rest[:n]
            rest = rest[n:]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Encode every text, append ``end_id`` and write the shards; returns one row per shard (shard, name, n_tokens).

    Null and empty texts give the end id alone; rows with the same id stay next to each other in the order
    of a hash of their texts; null ids come first; an empty table writes no shard; other columns are ignored.
    Shards are ranges of (id, hash, a number of the row), so rows that share an id, or have none, fill several.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = batch_encoder(tokenizer)
        shard, writer = TaskContext.get().partitionId(), None
        for batch in pieces(batches):
            writer = writer or ShardWriter(folder, shard, code.dtype, length)
            writer.add(batch.column("doc_id"), *with_end(*code.encode(batch.column("text")), end_id))
        if writer is not None:
            name = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_tokens": [writer.total]})

    if length % 8:
        raise ValueError("length must be a multiple of 8")
    rows = texts(docs).withColumns({"key": F.xxhash64("text"), "number": F.monotonically_increasing_id()})
    order = ["doc_id", "key", "number"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stage(ordered.mapInArrow(write, "shard long, name string, n_tokens long"), "token-shards")


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the checksum is CRC-32 of the ids as little-endian
    unsigned 32-bit numbers.  Shards are few and small rows, so their running total is one short window.
    """
    spark = shards.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [
                    (doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, start, ids in TokenFile(folder, row["name"]).documents_ids()
                ]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(width, F.xxhash64("shard")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the documents' ids and return what the files say about each document."""
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    with released_shuffles(docs.sparkSession):
        shards = write_tokens(docs, folder, tokenizer, **options)
    return read_tokens(shards, folder)
