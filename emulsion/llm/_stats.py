"""Counts over whole documents, vectorised over a slice: the base of the quality rules and of the tree features."""

from __future__ import annotations

import numpy as np

from . import _text as X

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
PUNCT = np.zeros(256, bool)
PUNCT[list(b".,;:!?'\"()-")] = True
WINDOW = 8


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags each document has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found before in the document, found elsewhere in the document) for each hash."""
    order = np.lexsort((h, doc)) if len(h) else np.zeros(0, np.int64)
    d, x = doc[order], h[order]
    same = np.zeros(len(h), bool)
    same[1:] = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    again, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order] = same  # the sort is stable: the first one in the text comes first
    either = same.copy()
    either[:-1] |= same[1:]
    twice[order] = either
    return again, twice


def dup_lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, lines with a word that equal an earlier line) of each document; lines are split at \\n."""
    begins = np.zeros(len(buf) + 1, bool)
    begins[1:] = buf == 10
    begins[off[:-1]] = True
    start = np.flatnonzero(begins[: len(buf)])
    end = np.append(start[1:], len(buf))[: len(start)]
    doc = np.searchsorted(off, start, "right") - 1
    # a line ends before its \n, the last line of a document before its own or with the document
    end = end - (buf[end - 1] == 10)
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~X.SPACE[buf], out=sums[1:])
    worded = sums[end] > sums[start]
    h = X.span_hashes(buf, start[worded], end[worded])
    again, _ = repeated(doc[worded], h)
    n = len(off) - 1
    return np.bincount(doc, minlength=n), np.bincount(doc[worded][again], minlength=n)


def repeat_words(words: X.Words, n_docs: int, k: int = WINDOW) -> np.ndarray:
    """Words of each document that lie in a k-word window found twice or more in it."""
    h, at = X.windows(words.hash, words.first, k)
    _, twice = repeated(words.doc[at], h)
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def base_counts(buf: np.ndarray, off: np.ndarray, words: X.Words) -> dict[str, np.ndarray]:
    n = len(off) - 1
    text = ~X.SPACE[buf] & ((buf & 0xC0) != 0x80)
    return {
        "n_words": np.diff(words.first),
        "word_chars": per_doc(text, off),
        "n_symbols": per_doc(SYMBOLS[buf], off),
        "n_dup_lines": dup_lines(buf, off)[1],
        "n_repeat_words": repeat_words(words, n),
    }


FEATURES = (
    "log_bytes log_words mean_word symbols upper digits punct marks non_ascii newlines words_a_line dup_lines "
    "repeat_words distinct_words short_words long_words upper_words longest_word"
).split()


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document, from its text alone; an empty text gives zeros."""
    n = len(off) - 1
    w = X.Words(buf, off)
    size = np.diff(off)
    nb, nw = np.maximum(size, 1), np.maximum(np.diff(w.first), 1)
    length = w.end - w.start
    lines, dups = dup_lines(buf, off)
    again, _ = repeated(w.doc, w.hash)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, length)
    count = lambda flags: np.bincount(w.doc[flags], minlength=n)
    cols = [
        np.log1p(size), np.log1p(np.diff(w.first)), np.bincount(w.doc, length, n) / nw,
        per_doc(SYMBOLS[buf], off) / nb, per_doc(UPPER[buf], off) / nb, per_doc(DIGIT[buf], off) / nb,
        per_doc(PUNCT[buf], off) / nb, per_doc(buf == 0x21, off) / nb, per_doc(buf >= 0x80, off) / nb,
        per_doc(buf == 10, off) / nb, np.diff(w.first) / np.maximum(lines, 1), dups / np.maximum(lines, 1),
        repeat_words(w, n) / nw, 1 - count(again) / nw, count(length <= 3) / nw, count(length >= 12) / nw,
        count(UPPER[buf[w.start]]) / nw if len(w.start) else np.zeros(n), np.log1p(longest),
    ]
    return np.where(size[:, None] > 0, np.stack(cols, 1), 0.0).astype(np.float32)
