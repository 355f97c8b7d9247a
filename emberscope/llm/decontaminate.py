"""Benchmark decontamination: every passage queries a BM25 index of test items with block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.shared import pieces, ranges, stage, texts

K1, B = 1.2, 0.75
SHINGLE = 5
OVERLAP = 0.8
ANSWER_WORDS = 10
POSTING_BLOCK = 32
INDEX_BYTES = 8 << 20
EDGES = b".,;:!?\"'()[]{}"
SENTENCE = re.compile(rb"[.?!]\s+|\n+")
SLACK = 1e-9
FOUND = "doc_id long, text_key long, item_id long, overlap double, score double"


def item_words(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z) without punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence or line, with those before it until it has ten words, as a word run
    together with its surroundings should not decide alone; the question is the rest.  If nothing would be
    left for the question, the answer is the last quarter of the words, or ten of them if half are as many.
    """
    parts = [w for w in map(item_words, SENTENCE.split(text)) if w]
    words = [w for p in parts for w in p]
    size, k = 0, len(parts)
    while k > 0 and size < ANSWER_WORDS:
        k -= 1
        size += len(parts[k])
    if k == 0:
        size = max(len(words) // 4, min(ANSWER_WORDS, len(words) // 2))
    cut = len(words) - size
    return words[:cut], words[cut:]


def shingles(words: list) -> set[tuple]:
    """Distinct runs of five; fewer words are one run."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


class Index:
    """BM25 postings of the items, in blocks with their largest impact.

    Impacts are divided by the least score that a passage passing the overlap check can have, so that
    one threshold, 1, holds for every item: a passage that holds the needed share of an item's shingles
    lacks at most as many of its words as there may be shingles missing, at worst the heaviest ones.
    """

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids, self.parts, self.shingles = [], [], []
        bags = []
        for item_id, text in items:
            question, answer = question_and_answer(text)
            if question or answer:
                self.ids.append(item_id)
                self.parts.append((Counter(question), Counter(answer)))
                self.shingles.append(shingles(question + answer))
                bags.append(Counter(question + answer))
        n = len(bags)
        lengths = [sum(b.values()) for b in bags]
        self.longest = max(lengths, default=1)
        mean = sum(lengths) / n if n else 1.0
        frequency = Counter(w for b in bags for w in b)
        self.terms = {w: i for i, w in enumerate(sorted(frequency))}
        postings: dict[int, list[tuple[int, float]]] = {}
        heavy: list[tuple[int, int, float]] = []
        self.rest = np.zeros(n)
        for item, bag in enumerate(bags):
            scores = {}
            for w, tf in bag.items():
                idf = math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5))
                scores[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
            ordered = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
            spare = len(self.shingles[item]) - math.ceil(OVERLAP * len(self.shingles[item]) - SLACK)
            least = sum(s for _, s in ordered[spare:])
            for rank, (w, s) in enumerate(ordered):
                postings.setdefault(self.terms[w], []).append((item, s / least))
                if rank <= spare or rank < len(ordered) // 2:
                    heavy.append((self.terms[w], item, s / least))
                else:
                    self.rest[item] += s / least
        self.postings = {
            t: (
                [i for i, _ in p], [s for _, s in p],
                [(p[min(k + POSTING_BLOCK, len(p)) - 1][0], max(s for _, s in p[k : k + POSTING_BLOCK])) for k in range(0, len(p), POSTING_BLOCK)],
                max(s for _, s in p),
            )
            for t, p in postings.items()
        }
        heavy.sort()
        self.heavy_start = np.searchsorted([t for t, _, _ in heavy], np.arange(len(self.terms) + 1))
        self.heavy_item = np.array([i for _, i, _ in heavy], np.int64)
        self.heavy_weight = np.array([s for _, _, s in heavy], float)

    def search(self, terms: set[int]) -> list[tuple[int, float]]:
        """All items of score 1 or more, by block-max WAND over the passage's terms."""
        lists = [[self.postings[t], 0, 0] for t in terms]
        found = []
        while lists:
            lists.sort(key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, -1
            for k, (posting, _, _) in enumerate(lists):
                bound += posting[3]
                if bound >= 1 - SLACK:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][0][lists[pivot + 1][1]] == item:
                pivot += 1
            block_bound, block_end = 0.0, None
            for cursor in lists[: pivot + 1]:
                blocks = cursor[0][2]
                while cursor[2] < len(blocks) and blocks[cursor[2]][0] < item:
                    cursor[2] += 1
                if cursor[2] < len(blocks):
                    last, most = blocks[cursor[2]]
                    block_bound += most
                    block_end = last if block_end is None else min(block_end, last)
            if block_bound >= 1 - SLACK:
                if lists[0][0][0][lists[0][1]] == item:
                    score = sum(c[0][1][c[1]] for c in lists[: pivot + 1])
                    if score >= 1 - SLACK:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                target = (item if block_end is None else max(item, block_end)) + 1
                if pivot + 1 < len(lists):
                    target = max(item + 1, min(target, lists[pivot + 1][0][0][lists[pivot + 1][1]]))
            for cursor in lists[: pivot + 1]:
                ids, blocks = cursor[0][0], cursor[0][2]
                while cursor[2] < len(blocks) and blocks[cursor[2]][0] < target:
                    cursor[2] += 1
                cursor[1] = max(cursor[1], cursor[2] * POSTING_BLOCK)
                while cursor[1] < len(ids) and ids[cursor[1]] < target:
                    cursor[1] += 1
            lists = [c for c in lists if c[1] < len(c[0][0])]
        return found

    def candidates(self, term: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Passages worth a search, as (text, tile) rows.

        Texts are cut into tiles as long as the longest item; a passage is three tiles, starting at each.
        A passage's score for an item is at most the impacts of the item's heavy terms in its tiles plus
        those of all the item's light terms; where that stays below 1 for every item, WAND would find no pivot.
        """
        width = self.longest
        sizes = np.diff(bounds)
        tiles = -(-sizes // width)
        first_tile = np.cumsum(tiles) - tiles
        heavy = np.zeros(len(self.terms) + 1, bool)
        heavy[:-1] = np.diff(self.heavy_start) > 0
        at = np.flatnonzero(heavy[term])
        if not len(at):
            return np.zeros((0, 2), np.int64)
        text = np.searchsorted(bounds, at, side="right") - 1
        tile = first_tile[text] + (at - bounds[text]) // width
        pairs = np.unique(tile * len(self.terms) + term[at])
        tile, t = pairs // len(self.terms), pairs % len(self.terms)
        counts = self.heavy_start[t + 1] - self.heavy_start[t]
        where = ranges(self.heavy_start[t], counts)
        key = np.repeat(tile, counts) * len(self.ids) + self.heavy_item[where]
        keys, inverse = np.unique(key, return_inverse=True)
        sums = np.bincount(inverse, weights=self.heavy_weight[where])
        tile, item = keys // len(self.ids), keys % len(self.ids)
        owner = np.searchsorted(first_tile, tile, side="right") - 1
        passage = np.concatenate([tile, tile - 1, tile - 2])
        inside = passage >= np.tile(first_tile[owner], 3)
        key = passage[inside] * len(self.ids) + np.tile(item, 3)[inside]
        keys, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=np.tile(sums, 3)[inside]) + self.rest[keys % len(self.ids)]
        passage = np.unique(keys[total >= 1 - SLACK] // len(self.ids))
        owner = np.searchsorted(first_tile, passage, side="right") - 1
        return np.stack([owner, passage - first_tile[owner]], axis=1)

    def verify(self, item: int, words: list[bytes]) -> float:
        """Share of the item's shingles in the passage, or 0 unless question and answer are both there."""
        share = len(self.shingles[item] & shingles(words)) / len(self.shingles[item])
        if share < OVERLAP - SLACK:
            return 0.0
        have = Counter(words)
        for part in self.parts[item]:
            size = sum(part.values())
            if size and sum(min(n, have[w]) for w, n in part.items()) < OVERLAP * size - SLACK:
                return 0.0
        return share


def _matches(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
        words, bounds = [], np.zeros(len(ids) + 1, np.int64)
        for i, value in enumerate(batch.column("text").to_pylist()):
            words += (value or b"").lower().split()
            bounds[i + 1] = len(words)
        array = np.array([*words, None], object)[:-1]
        codes, distinct = pd.factorize(array)
        bare = [w.strip(EDGES) for w in distinct]
        full = np.array([bool(w) for w in bare], bool)
        if len(full) and not full.all():  # words of punctuation only count for nothing
            solid = full[codes]
            array, codes = array[solid], codes[solid]
            bounds = np.r_[0, np.cumsum(solid)][bounds]
        lookup = np.array([index.terms.get(w, -1) for w in bare] + [-1], np.int64)
        term = lookup[codes]
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for text, tile in index.candidates(term, bounds).tolist():
            start = int(bounds[text]) + tile * index.longest
            stop = min(int(bounds[text + 1]), start + 3 * index.longest)
            hits = index.search(set(term[start:stop].tolist()) - {-1})
            if hits:
                passage = [bare[c] for c in codes[start:stop]]
                for item, score in hits:
                    share = index.verify(item, passage)
                    if share:
                        known = best.get((text, item), (0.0, 0.0))
                        best[text, item] = (max(known[0], share), max(known[1], score))
        rows = [(ids[t], keys[t], index.ids[i], share, score) for (t, i), (share, score) in best.items()]
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in FOUND.split(", ")])


def text_key() -> Column:
    """What tells apart the rows that have no id."""
    return F.xxhash64(F.col("text").cast("binary"))


def found(docs: DataFrame, benchmark: DataFrame, index_bytes: int) -> DataFrame:
    """One row per row of ``docs`` and test item it leaks, with the key of the text that leaks it.

    Items are indexed in shares of about ``index_bytes`` of text; each share's index, of that bounded size, is
    broadcast and all documents are read against it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = max(1, -(-size // index_bytes))
    keyed = texts(docs).withColumn("text_key", text_key())
    parts = []
    for share in range(shares):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)) == share).distinct().collect()
        index = spark.sparkContext.broadcast(Index(sorted(((r[0], bytes(r[1])) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))
        parts.append(keyed.mapInArrow(lambda b, index=index: _matches(b, index.value), FOUND))
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and test item it leaks: doc_id, item_id, overlap, score (best passage of each).

    Items without words match nothing; null and empty texts hold nothing; repeated rows give one row; null
    ids are kept as they are; other columns are ignored.
    """
    rows = found(docs, benchmark, index_bytes)
    return rows.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.round(F.max("score"), 6).alias("score"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that leak no test item, with all their columns, whatever their names.

    Each row is judged by its own text: rows that share an id, or have none, stay or leave one by one.
    """
    leaks = found(docs, benchmark, INDEX_BYTES).select(F.col("doc_id").alias("_leak"), F.col("text_key").alias("_leak_key"))
    leaks = stage(leaks.distinct(), "leaks")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row")["text"].cast("binary")
    same = F.col("row")["doc_id"].cast("long").eqNullSafe(F.col("_leak")) & (F.xxhash64(text) == F.col("_leak_key"))
    return rows.join(leaks, same, "left_anti").select("row.*")
