"""Token counts of a unigram model by dynamic programming over a trie of words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from emberscope.llm.shared import pieces, texts

MARK = "▁"
UNITS = 1_000_000
BYTE_RANKS = 50
MOST_NODES = 700_000
LONG_WORD = 4096


class WordTrie:
    """Distinct words as a trie; each node holds the best score of its prefix and its number of pieces.

    A prefix is scored once, from the scores on its own path, however many words share it.  Scores are whole
    millionths of the natural logarithm of a piece's chance, which falls with its rank r as 1 / (r + 2)
    (Zipf), so they add up exactly; of equal scores the one with fewer pieces counts.  A character without a
    piece of its own costs one byte piece per UTF-8 byte.  Past ``most_nodes`` nodes the trie is emptied
    before the next word; this bounds memory and changes no count.
    """

    def __init__(self, vocabulary: list[str], most_nodes: int = MOST_NODES):
        self.score = {p: -round(UNITS * math.log(r + 2)) for r, p in enumerate(vocabulary)}
        self.byte = -round(UNITS * math.log(len(vocabulary) * BYTE_RANKS + 2))
        self.longest = max(map(len, vocabulary), default=1)
        self.ends = {}
        for piece in self.score:
            self.ends.setdefault(piece[-1], set()).add(len(piece))
        self.ends = {c: sorted(n) for c, n in self.ends.items()}
        self.most_nodes = most_nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0], [0]
        self.terminal: dict[bytes, int] = {}

    def _step(self, word: str, d: int, best: list[int], count: list[int], path) -> tuple[int, int]:
        """Best score and pieces of the prefix of length d; ``path`` maps earlier lengths to entries of best and count."""
        top = None
        for n in self.ends.get(word[d - 1], ()):
            if n > d:
                break
            score = self.score.get(word[d - n : d])
            if score is not None:
                at = path[d - n]
                option = (best[at] + score, -count[at] - 1)
                if top is None or option > top:
                    top = option
        if top is None or word[d - 1] not in self.score:
            size, at = len(word[d - 1].encode("utf-8", "surrogatepass")), path[d - 1]
            option = (best[at] + size * self.byte, -count[at] - size)
            if top is None or option > top:
                top = option
        return top[0], -top[1]

    def insert(self, word: str) -> int:
        """Number of pieces of a word."""
        if len(word) > LONG_WORD:
            best, count, path = [0], [0], range(len(word) + 1)
            for d in range(1, len(word) + 1):
                b, c = self._step(word, d, best, count, path)
                best.append(b)
                count.append(c)
            return count[-1]
        if len(self.best) > self.most_nodes:
            self.clear()
        node, path, child = 0, [0], self.child
        for d, letter in enumerate(word, 1):
            key = node * 0x110000 + ord(letter)
            after = child.get(key)
            if after is None:
                b, c = self._step(word, d, self.best, self.count, path)
                after = child[key] = len(self.best)
                self.best.append(b)
                self.count.append(c)
            path.append(after)
            node = after
        return self.count[node]

    def pieces(self, word: bytes) -> int:
        """Number of pieces of a word as it stands in a text, kept at its end in the trie."""
        known = self.terminal.get(word)
        if known is None:
            known = self.insert(MARK + word.decode("utf-8", "replace"))
            self.terminal[word] = known
        return known


@lru_cache(maxsize=1)
def word_trie(path: str) -> WordTrie:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return WordTrie([model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every row; words are runs without ASCII white space, each with a mark before it.

    Every task keeps a trie of its words, so no row moves.  Null and empty texts count 0; repeated rows are
    each counted; ids may be null; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = word_trie(vocabulary)
        for batch in pieces(batches):
            n_words, n_tokens = [], []
            for value in batch.column("text").to_pylist():
                words = (value or b"").split()
                counts = list(map(trie.terminal.get, words))
                if None in counts:
                    counts = [trie.pieces(words[i]) if n is None else n for i, n in enumerate(counts)]
                n_words.append(len(words))
                n_tokens.append(sum(counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
