"""Token ids of whole texts with a public tokenizer file.

Most words of a corpus repeat, so a worker encodes each distinct word once and keeps its ids under a 64-bit hash of the
word. Cutting at words is exact only where the tokenizer never joins characters across white space; other tokenizers
get whole texts.
"""

from __future__ import annotations

import json
import os
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from cadenza.llm.arrow_text import Texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Distinct words a worker remembers (about 25 bytes each); further words are encoded each time they come.
CACHE_WORDS = 2_000_000
# Longer pieces are not worth remembering.
CACHE_BYTES = 64

# Split patterns under which no token spans the start of a run of white space.
WORD_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}

_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _by_words(config: dict) -> bool:
    norm, pre = config.get("normalizer"), config.get("pre_tokenizer") or {}
    kinds = [norm] if norm and norm["type"] != "Sequence" else (norm or {}).get("normalizers", [])
    if not {k["type"] for k in kinds} <= {"NFC", "Replace", "Lowercase"}:
        return False
    if pre.get("type") == "ByteLevel":
        return bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space", True) and not kinds
    if pre.get("type") == "Sequence":
        first, *rest = pre["pretokenizers"]
        return (first.get("type") == "Split" and first["pattern"].get("Regex") in WORD_PATTERNS
                and all(r["type"] == "ByteLevel" and not r["use_regex"] and not r["add_prefix_space"] for r in rest))
    return False


class Encoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.by_words = _by_words(json.loads(self.tokenizer.to_str()))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache_words = cache_words
        # Remembered words: sorted hashes, and where the ids of each lie in ``pool``.
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, self.dtype)

    def _cuts(self, texts: Texts) -> np.ndarray:
        """Piece borders: every text border, and every start of white space after a character that is surely none."""
        d = texts.data
        if not self.by_words or len(d) == 0:
            return np.unique(texts.ends)
        cut = np.zeros(len(d) + 1, bool)
        # A continuation byte after C3..DF ends a two-byte letter or mark from U+00C0 on, where no white space lies.
        two = np.zeros(len(d), bool)
        two[1:] = (d[1:] >= 0x80) & (d[1:] < 0xC0) & (d[:-1] >= 0xC3) & (d[:-1] <= 0xDF)
        cut[1:len(d)] = _SPACE[d[1:]] & (_GRAPHIC[d[:-1]] | two[:-1])
        cut[texts.ends] = True
        return np.flatnonzero(cut)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); null counts as empty."""
        texts = Texts.of(col)
        cuts = self._cuts(texts)
        if len(cuts) < 2:
            return np.empty(0, self.dtype), np.zeros(len(texts), np.int64)
        start, end = cuts[:-1], cuts[1:]
        words, example, which = np.unique(texts.hasher()(start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, words)
        known = np.zeros(len(words), bool)
        inside = np.flatnonzero(place < len(self.keys))
        known[inside] = self.keys[place[inside]] == words[inside]
        new = np.flatnonzero(~known)
        start, end = start[example[new]], end[example[new]]
        # Short words first, as only those are remembered.
        order = np.argsort(end - start > CACHE_BYTES, kind="stable")
        new, start, end = new[order], start[order], end[order]
        raw, found = texts.data, []
        for lo in range(0, len(new), 4096):
            some = [raw[i:j].tobytes().decode() for i, j in zip(start[lo:lo + 4096], end[lo:lo + 4096])]
            found += [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        offset, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        offset[known], sizes[known] = self.at[place[known]], self.size[place[known]]
        sizes[new] = [len(x) for x in found]
        offset[new] = len(self.pool) + np.cumsum(sizes[new]) - sizes[new]
        flat = np.concatenate([self.pool, *found])
        short = new[:int((end - start <= CACHE_BYTES).sum())]
        if len(short) and len(self.keys) + len(short) <= self.cache_words:
            self.pool = flat[:len(self.pool) + int(sizes[short].sum())].copy()
            self.keys = np.concatenate([self.keys, words[short]])
            order = np.argsort(self.keys, kind="stable")
            self.keys = self.keys[order]
            self.at = np.concatenate([self.at, offset[short]])[order]
            self.size = np.concatenate([self.size, sizes[short]])[order]
        n = sizes[which]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(offset[which] - before, n) + np.arange(int(n.sum()))]
        total = np.concatenate([before, [int(n.sum())]])
        return ids, np.diff(total[np.searchsorted(cuts, texts.ends)])


def encoder(path: str) -> Encoder:
    """One encoder per worker process; it outlives the task, so its words are encoded once."""
    held = sys.modules.setdefault("cadenza_worker_state", types.ModuleType("cadenza_worker_state"))
    if getattr(held, "path", None) != path:
        held.path, held.encoder = path, Encoder(path)
    return held.encoder


def encode_with_end(col: pa.Array, path: str, end_id: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of each text followed by ``end_id``."""
    e = encoder(path)
    ids, n = e.encode(col)
    stop = np.cumsum(n)
    all_ids = np.insert(ids, stop, e.dtype.type(end_id))
    stop = stop + np.arange(1, len(n) + 1)
    return np.split(all_ids, stop[:-1]) if len(n) else [], n + 1
