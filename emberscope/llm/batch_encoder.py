"""Token ids of whole batches of texts: each distinct unit is encoded once and its ids are gathered by offsets.

A unit is a stretch of text over whose borders the tokenizer never merges.  Two kinds of tokenizers have such
borders at white space:

* byte-level BPE without normalizer, whose pre-tokens take one space in front: a text is cut before each space
  and around each line break.  Texts with two white-space characters in a row go to the library whole.
* BPE with word ends whose pre-tokenizer drops white space: a text is cut at white space, which is dropped.

Any other tokenizer gets its texts whole.  Known units are kept in a store of bounded size; a batch that finds
it full starts a new one.
"""

from __future__ import annotations

import json
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from emberscope.llm.shared import ranges

STORED_IDS = 4_000_000
CUT = "\x00"
SPACES = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"


def byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write byte b as this letter: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + i) for i, b in enumerate(rest)}}


def unit_kind(spec: dict) -> str:
    """Where a tokenizers file lets texts be cut: ``space`` before spaces, ``word`` at white space, else ``text``."""
    pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"]["type"] != "BPE":
        return "text"
    if not normalizer and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "space"
    parts = [normalizer] if normalizer and "normalizers" not in normalizer else (normalizer or {}).get("normalizers", [])
    steps = pre.get("pretokenizers") or []
    harmless = all(n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in parts)
    dropped = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    classes = dropped and steps[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    level = dropped and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
    return "word" if harmless and classes and level else "text"


class BatchEncoder:
    def __init__(self, path: str, stored_ids: int = STORED_IDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        self.kind = unit_kind(spec)
        self.lower = self.kind == "word" and any(n["type"] == "Lowercase" for n in spec["normalizer"].get("normalizers", []))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = str.maketrans(byte_letters())
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.stored_ids = stored_ids
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tails: dict[str, list[int]] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(1 << 18, self.dtype)
        self.used = 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, units: list[str]) -> None:
        """Encode new units and store them; a plain word in front of full stops and commas needs the BPE model alone."""
        model, letters, known, spaced = self.tokenizer.model, self.letters, self.known, self.kind == "space"
        ids: list[int] = []
        sizes: list[int] = []
        for unit in units:
            word = unit.rstrip(".,")
            bare = word[1:] if spaced and word[:1] == " " else word
            if self.lower:
                bare = word = bare.lower()
            if bare.isalpha() and (bare.isascii() or max(bare) < "ɐ" and is_normalized("NFC", bare)):
                own = [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(letters))]
                if len(word) != len(unit):
                    tail = unit[len(word) :]
                    if tail not in self.tails:
                        self.tails[tail] = self.whole(tail)
                    own += self.tails[tail]
            else:
                own = self.whole(unit)
            known[unit] = len(known)
            ids += own
            sizes.append(len(own))
        starts = self.used + np.cumsum([0, *sizes[:-1]])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, sizes])
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(which texts are cut, where each of them starts among the units, the units)."""
        n = len(texts)
        if self.kind == "word":
            units = pc.ascii_split_whitespace(texts)
            return np.ones(n, bool), units.offsets.to_numpy(), units.flatten()
        fine = np.zeros(n, bool)
        if self.kind == "space":
            odd = pc.or_(pc.match_substring_regex(texts, SPACES), pc.match_substring(texts, CUT))
            for token in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, token))
            fine = ~odd.to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(texts.filter(pa.array(fine)), " ", CUT + " ")
        units = pc.split_pattern(pc.replace_substring(cut, "\n", f"{CUT}\n{CUT}"), CUT)
        return fine, units.offsets.to_numpy(), units.flatten()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has; nulls are empty."""
        if pa.types.is_binary(texts.type):
            texts = utf8(texts)
        texts = pc.fill_null(texts, "")
        if self.used > self.stored_ids:
            self._forget()
        fine, bounds, units = self._cut(texts)
        encoded = units.dictionary_encode()
        distinct = encoded.dictionary.to_numpy(zero_copy_only=False)
        new = [u for u in distinct if u not in self.known]
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[encoded.indices.to_numpy()]
        lengths = self.lengths[slots]
        ids = self.store[ranges(self.starts[slots], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.zeros(len(texts), np.int64)
        counts[fine] = np.diff(sums[bounds])
        if fine.all():
            return ids, counts
        others = {i: self.whole(texts[i].as_py()) for i in np.flatnonzero(~fine).tolist()}
        for i, own in others.items():
            counts[i] = len(own)
        out = np.empty(int(counts.sum()), self.dtype)
        starts = np.cumsum(counts) - counts
        out[ranges(starts[fine], counts[fine])] = ids
        for i, own in others.items():
            out[starts[i] : starts[i] + len(own)] = own
        return out, counts


def utf8(texts: pa.Array) -> pa.Array:
    """Bytes as text; bytes that are not UTF-8 become replacement characters."""
    try:
        return pc.cast(texts, pa.string() if pa.types.is_binary(texts.type) else pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` after each text's own."""
    out = np.full(len(ids) + len(counts), end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


@lru_cache(maxsize=2)
def batch_encoder(path: str) -> BatchEncoder:
    return BatchEncoder(path)
