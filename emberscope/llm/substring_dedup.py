"""Exact substring removal across documents by fixed-block anchors.

Every text is cut into blocks of 25 words that do not overlap, and the blocks are indexed by fingerprint.
A window of 50 words always covers a whole block, so if a text repeats 50 words of another one, some rolling
window of 25 of its words is a block of the other.  All rolling windows probe the index; the hits are
extended to both sides to all windows of 50 words around them, which are compared by 128-bit hash, and the
runs of windows that were seen in an earlier document are the maximal repeats that go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.shared import pieces, split_words, stage, texts, window_starts, windows, word_hashes

WINDOW = 50
BLOCK = 25
FINGERPRINT_BYTES = 6
CHUNK_DOCUMENTS = 256
PACKED = "bucket int, doc_ids binary, texts binary, blocks binary, prints binary, hit_ids array<long>, hit_prints array<long>"
HITS = "doc_id long, prints array<long>"


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Prints of all windows of a block's length."""
    return windows(hashes, BLOCK) >> np.uint64(64 - 8 * FINGERPRINT_BYTES)


def _pack(values: np.ndarray) -> bytes:
    """The low bytes of each number, all lowest bytes first, so that equal high bytes compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :FINGERPRINT_BYTES].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(FINGERPRINT_BYTES, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :FINGERPRINT_BYTES] = planes.T
    return out.view("<u8").ravel()


def _lists(keys: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Sorted distinct keys, and the values of each as a list."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    opens = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[opens, len(keys)], pa.int32())
    return pa.array(keys[opens], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int64)))


def _probe(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Prints of all rolling windows, packed by bucket; each print once per chunk of documents.

    A print met in several documents of the chunk is a hit already and goes along as such, so a passage that
    many documents share costs one entry per chunk, not one per document.
    """
    for batch in pieces(batches):
        for at in range(0, batch.num_rows, CHUNK_DOCUMENTS):
            part = batch.slice(at, CHUNK_DOCUMENTS)
            ids = part.column("doc_id").to_numpy()
            words, bounds = split_words(part.column("text").to_pylist())
            where = window_starts(bounds, BLOCK)
            if not len(where):
                continue
            prints = fingerprints(word_hashes(words))[where]
            text = (np.searchsorted(bounds, where, side="right") - 1).astype(np.int64)
            block = (where - bounds[text]) % BLOCK == 0
            order = np.argsort(prints, kind="stable")
            prints, text, block = prints[order], text[order], block[order]
            first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
            sizes = np.diff(np.r_[first, len(prints)])
            many = np.repeat(np.minimum.reduceat(ids[text], first) != np.maximum.reduceat(ids[text], first), sizes)
            pairs = np.unique(np.stack([ids[text[many]], prints[many].astype(np.int64)]), axis=1)
            hit_ids, hit_prints = _lists(pairs[0], pairs[1])
            is_block = np.logical_or.reduceat(block, first)
            prints, text = prints[first], text[first]
            bucket = (prints % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = {c: [] for c in ("bucket", "doc_ids", "texts", "blocks", "prints")}
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[b] : cuts[b + 1]]
                some, inverse = np.unique(text[own], return_inverse=True)
                rows["bucket"].append(b)
                rows["doc_ids"].append(ids[some].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())
                rows["texts"].append(inverse.astype(np.uint8).tobytes())
                rows["blocks"].append(np.packbits(is_block[own]).tobytes())
                rows["prints"].append(_pack(prints[own]))
            n = len(rows["bucket"])
            own_hits = [[]] * n
            hits = [pa.array(own_hits, pa.list_(pa.int64()))] * 2
            if len(hit_ids):  # spread over the rows: the j-th document's hits go with row j modulo n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.arange(len(hit_ids)) + rows["bucket"][0]) % buckets, pa.int32()),
                        *[pa.nulls(len(hit_ids), pa.binary())] * 4,
                        pa.ListArray.from_arrays(pa.array(np.arange(len(hit_ids) + 1), pa.int32()), hit_ids), hit_prints,
                    ],
                    names=[*rows, "hit_ids", "hit_prints"],
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["bucket"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in list(rows)[1:]], *hits],
                names=[*rows, "hit_ids", "hit_prints"],
            )


def _hits(group: pa.Table) -> pa.Table:
    """Prints of one bucket that are a block somewhere and occur in more than one chunk, by document."""
    ids, prints, blocks, local = [], [], [], []
    for row in group.select(["doc_ids", "texts", "blocks", "prints", "hit_ids", "hit_prints"]).to_batches():
        for doc_ids, texts_, flags, packed, hit_ids, hit_prints in zip(*(c.to_pylist() if k < 4 else c for k, c in enumerate(row.columns))):
            if doc_ids is None:
                local.append((hit_ids.values[0].as_py(), hit_prints.values.to_numpy()))
                continue
            own = np.frombuffer(doc_ids, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
            which = np.frombuffer(texts_, np.uint8)
            ids.append(own[which])
            prints.append(_unpack(packed))
            blocks.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(which)).astype(bool))
    out_ids = [np.full(len(p), i, np.int64) for i, p in local]
    out_prints = [p for _, p in local]
    if ids:
        ids, prints, blocks = np.concatenate(ids), np.concatenate(prints), np.concatenate(blocks)
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        sizes = np.diff(np.r_[first, len(prints)])
        hit = np.repeat((sizes > 1) & np.logical_or.reduceat(blocks[order], first), sizes)
        out_ids.append(ids[order[hit]])
        out_prints.append(prints[hit].astype(np.int64))
    keys, lists = _lists(np.concatenate(out_ids), np.concatenate(out_prints)) if out_ids else _lists(np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.table({"doc_id": keys, "prints": lists})


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of 50 words that cover a hit, with their 128-bit hashes."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32())])
    for batch in pieces(batches):
        words, bounds = split_words(batch.column("text").to_pylist())
        starts = window_starts(bounds, WINDOW)
        if not len(starts):
            continue
        hashes = word_hashes(words)
        probes, hits = fingerprints(hashes), batch.column("prints")
        found = np.zeros(len(words) + WINDOW + 1, np.int64)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b - a >= BLOCK:
                found[a : b - BLOCK + 1] = np.isin(probes[a : b - BLOCK + 1], hits[i].values.to_numpy().view(np.uint64))
        total = np.r_[0, np.cumsum(found)]
        starts = starts[total[starts + WINDOW - BLOCK + 1] > total[starts]]
        text = np.searchsorted(bounds, starts, side="right") - 1
        for at in range(0, len(starts), 1 << 17):
            own, of = starts[at : at + (1 << 17)], text[at : at + (1 << 17)]
            if at == 0:
                first, second = windows(hashes, WINDOW).view(np.int64), windows(hashes, WINDOW, seed=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first[own]), pa.array(second[own]), pa.array(batch.column("doc_id").to_numpy()[of]),
                    pa.array(batch.column("text_key").to_numpy()[of]), pa.array((own - bounds[of]).astype(np.int32)),
                ],
                schema=schema,
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and the spans of words that went."""
    for batch in pieces(batches):
        rows = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "spans": []}
        for i, value in enumerate(batch.column("text").to_pylist()):
            words = (value or b"").split()
            gone, spans = 0, []
            if batch.column("starts")[i].is_valid:
                edge = np.zeros(len(words) + 1, np.int64)
                starts = batch.column("starts")[i].values.to_numpy()
                np.add.at(edge, starts, 1)
                np.subtract.at(edge, starts + WINDOW, 1)
                removed = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
                turns = np.flatnonzero(removed[1:] != removed[:-1]).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2])]
                gone = int(removed.sum())
                words = [w for w, r in zip(words, removed[1:-1].tolist()) if not r]
            kept = b" ".join(words)
            rows["n_words"].append(len(words) + gone)
            rows["n_removed"].append(gone)
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["kept"].append(kept.decode("utf-8", "replace"))
            rows["spans"].append(spans)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [rows["doc_id"], pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["kept"], pa.string()), pa.array(rows["spans"], spans)],
            names=list(rows),
        )


def repeated_windows(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Windows of 50 words that also start in a document with a smaller id: doc_id, text_key, starts.

    ``text_key`` tells rows with the same id apart.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = texts(docs).where("doc_id IS NOT NULL AND length(text) > 0")
    packed = base.mapInArrow(lambda b: _probe(b, buckets), PACKED)
    hits = stage(packed.groupBy("bucket").applyInArrow(_hits, HITS), "block-hits")
    by_doc = hits.groupBy("doc_id").agg(F.flatten(F.collect_list("prints")).alias("prints"))
    near = base.join(by_doc, "doc_id").select("doc_id", "text", "prints", F.xxhash64("text").alias("text_key"))
    around = stage(near.mapInArrow(_extend, "h1 long, h2 long, doc_id long, text_key long, at int"), "block-windows")
    first = around.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = stage(first.where("first < last").drop("last"), "first-windows")
    return around.join(first, ["h1", "h2"]).where("first < doc_id").groupBy("doc_id", "text_key").agg(F.collect_list("at").alias("starts"))


def remove_repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every row with what is left of it: doc_id, n_words, n_removed, kept_sha256, kept (words joined by a
    space) and spans (word positions removed, end exclusive).

    Null and empty texts have no words; texts under 50 words lose nothing; rows with the same id do not count
    as earlier than each other; a null id is neither earlier nor later than another, so nothing is taken from
    or because of it; other columns are ignored; no rows give no rows.
    """
    gone = stage(repeated_windows(docs, buckets), "repeats").withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    base = texts(docs)
    joined = base.join(gone, (base["doc_id"] == gone["gone_id"]) & (F.xxhash64(base["text"]) == gone["gone_key"]), "left")
    return joined.select("doc_id", "text", "starts").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"
    )
