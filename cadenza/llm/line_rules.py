"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much is rejected.

* punctuation: a line fails if it carries more than MAX_SYMBOLS symbols per word, or shouts (mostly capitals, with an
  exclamation mark for every other word), or is shorter than MIN_WORDS words and ends without a closing mark;
* navigation: a line fails with at least MIN_BARS separators of menus, one for every fourth word or more;
* boilerplate: a line fails if it holds one of the PHRASES and has at most MAX_BOILERPLATE words.

The verdict compares the characters of removed lines with those of all lines. Beside it stand fixed counts of the whole
text: words, symbols, repeated lines and words inside repeated windows of eight words.

A null or empty text has no words. All work is on the bytes of a batch slice, so a long text costs memory in proportion.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrow_text import CODE_POINT_STARTS, Texts, mix, slices, window_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 8
MAX_SYMBOLS = 0.5
MIN_WORDS = 4
MIN_BARS = 3
MAX_BOILERPLATE = 40
MAX_LOSS = 0.5
# Phrases of page furniture and licence lines.
PHRASES = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies",
           "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter", "subscribe to our newsletter",
           "licensed under the", "is licensed under", "released under the")
CLOSING = frozenset(b".!?;:\"')]}>")
CLOSING_WIDE = ("\u2026", "\u201d", "\u2019", "\u00bb", "\u3002", "\uff01", "\uff1f", "\u061f", "\u0964")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SYMBOLS = _table(b"#*$%&|<>")
BARS = _table(b"|>")
SHOUTS = _table(b"!")
UPPER = _table(bytes(range(65, 91)))
LOWER = _table(bytes(range(97, 123)))
# Ends of UTF-8 forms of CLOSING_WIDE, compared as three or two bytes.
_WIDE = {c.encode() for c in CLOSING_WIDE}


def judge(col: pa.Array) -> dict[str, np.ndarray]:
    """Fixed counts and line verdicts of each text; ``lines`` lists (text, start, end, fails) by bytes."""
    texts = Texts.of(col)
    n, d = len(texts), texts.data
    owner, start, end = texts.words()
    points = texts.count(CODE_POINT_STARTS)
    n_words = np.bincount(owner, minlength=n)
    word_chars = np.bincount(owner, weights=(points[end] - points[start]).astype(float), minlength=n).astype(np.int64)
    symbols = texts.count(SYMBOLS)
    hashes = texts.hasher()

    # Windows of eight words that occur again in their text.
    first, h = window_hashes(hashes(start, end), owner, WINDOW)
    h = h ^ mix(owner[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    same[:-1] |= same[1:]
    again = np.zeros(len(owner) + 1, np.int64)
    np.add.at(again, first[order[same]], 1)
    np.add.at(again, first[order[same]] + WINDOW, -1)
    n_repeat = np.bincount(owner[np.cumsum(again[:-1]) > 0], minlength=n)

    # Lines with a word.
    l_owner, l_start, l_end = texts.lines()
    w_lo, w_hi = np.searchsorted(start, l_start), np.searchsorted(start, l_end)
    keep = w_hi > w_lo
    l_owner, l_start, l_end, w_lo, w_hi = (x[keep] for x in (l_owner, l_start, l_end, w_lo, w_hi))
    lh = hashes(l_start, l_end) ^ mix(l_owner.astype(np.uint64) + np.uint64(1))
    distinct_owner = l_owner[np.unique(lh, return_index=True)[1]]
    n_dup = np.bincount(l_owner, minlength=n) - np.bincount(distinct_owner, minlength=n)

    inside = lambda table: (lambda c: c[l_end] - c[l_start])(texts.count(table))
    words = w_hi - w_lo
    sym, bars, bangs, upper, lower = symbols[l_end] - symbols[l_start], inside(BARS), inside(SHOUTS), inside(UPPER), inside(LOWER)
    last = d[end[w_hi - 1] - 1] if len(w_hi) else np.empty(0, np.uint8)
    closes = np.isin(last, list(CLOSING))
    for i in np.flatnonzero((last >= 0x80) & ~closes):
        e = end[w_hi[i] - 1]
        closes[i] = d[e - 3:e].tobytes() in _WIDE or d[e - 2:e].tobytes() in _WIDE
    fails = (sym > MAX_SYMBOLS * words) | ((upper > lower) & (bangs * 2 >= words) & (words > 1)) | (~closes & (words < MIN_WORDS))
    fails |= (bars >= MIN_BARS) & (bars * 4 >= words)
    suspects = np.flatnonzero(words <= MAX_BOILERPLATE)
    if len(suspects) and len(d):
        low = np.where(UPPER[d], d + 32, d).astype(np.uint8).tobytes()
        holder = pc.match_substring_regex(pa.array([low], pa.binary()), "|".join(PHRASES))
        if holder[0].as_py():
            for phrase in PHRASES:
                p, at = phrase.encode(), low.find(phrase.encode())
                while at >= 0:
                    i = np.searchsorted(l_start, at, "right") - 1
                    if i >= 0 and at + len(p) <= l_end[i] and words[i] <= MAX_BOILERPLATE:
                        fails[i] = True
                    at = low.find(p, at + 1)
    chars = (points[l_end] - points[l_start]).astype(float)
    total = np.bincount(l_owner, weights=chars, minlength=n)
    lost = np.bincount(l_owner, weights=chars * fails, minlength=n)
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[texts.ends[1:]] - symbols[texts.ends[:-1]],
            "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed,
            "n_lines": np.bincount(l_owner, minlength=n), "n_failed_lines": np.bincount(l_owner[fails], minlength=n),
            "kept": ~base_failed & (lost <= MAX_LOSS * total), "lines": (texts, l_owner, l_start, l_end, fails)}


def without_failed(found: dict) -> list[str]:
    """Texts without their failing lines; other bytes stay as they are."""
    texts, owner, start, end, fails = found["lines"]
    gone_owner, gone_start, gone_end = owner[fails], start[fails], end[fails]
    raw, out = texts.data.tobytes(), []
    lo = np.searchsorted(gone_owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        at, stop, parts = texts.ends[i], texts.ends[i + 1], []
        for k in range(lo[i], lo[i + 1]):
            parts.append(raw[at:gone_start[k]])
            at = min(stop, gone_end[k] + 1)     # with its line end
        parts.append(raw[at:stop])
        out.append(b"".join(parts).decode("utf-8", "replace"))
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines")


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Counts, base_failed, kept and the cleaned text of every document."""

    def run(batches):
        for b in slices(batches, 1):
            q = judge(b.column(1))
            cols = [b.column(0), *(pa.array(q[c], pa.int64()) for c in COUNTS), pa.array(q["base_failed"]), pa.array(q["kept"])]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(without_failed(q), pa.string())] if with_text else []), names)

    names = ["doc_id", *COUNTS, "base_failed", "kept"] + (["clean_text"] if with_text else [])
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean" + (", clean_text string" if with_text else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Rows whose text is kept, with the failing lines taken out of it; other columns are carried along.

    ``length_col``, where it exists, is set to the new length in code points."""
    at, names = docs.columns.index(text_col), docs.columns
    size = names.index(length_col) if length_col in names else None

    def run(batches):
        for b in slices(batches, at):
            q = judge(b.column(at))
            text = pa.array(without_failed(q), pa.string())
            cols = list(b.columns)
            cols[at] = text
            if size is not None:
                cols[size] = pc.utf8_length(text).cast(b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(q["kept"]))

    return docs.mapInArrow(run, docs.schema)
