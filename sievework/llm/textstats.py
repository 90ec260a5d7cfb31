"""Statistics of whole documents, computed from UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from sievework.llm.common import ragged, word_hashes, word_spans

#: Classes of bytes, by which the share of each is a feature.
CLASSES = ("upper", "lower", "digit", "stop", "mark", "space", "line", "high")
FEATURES = (
    "log_words", "word_bytes", *(f"share_{c}" for c in CLASSES), "distinct_words", "top_word", "distinct_pairs", "distinct_fives",
    "repeat_next", "words_per_line", "distinct_lines", "short_words", "capitals", "marked_words",
)


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("mark"), np.uint8)
    t[0x80:] = CLASSES.index("high")
    t[65:91], t[97:123], t[48:58] = 0, 1, 2
    t[list(b".,;:?'")] = CLASSES.index("stop")
    t[list(b" \t\x0b\x0c\r")] = CLASSES.index("space")
    t[10] = CLASSES.index("line")
    return t


_CLASS = _class_table()


def _distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct values, and of the commonest one, of each span."""
    distinct, top = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b > a:
            v = np.sort(values[a:b])
            heads = np.flatnonzero(v[1:] != v[:-1]) + 1
            distinct[i] = len(heads) + 1
            top[i] = max(np.diff(heads).max() if len(heads) > 1 else 0, heads[0] if len(heads) else b - a, (b - a) - heads[-1] if len(heads) else 0)
    return distinct, top


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document; an empty one has zeros only."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    col = {f: i for i, f in enumerate(FEATURES)}
    size = np.diff(offsets).astype(float)
    code = _CLASS[data]
    for c, name in enumerate(CLASSES):
        out[:, col[f"share_{name}"]] = _count(code == c, offsets) / np.maximum(size, 1)
    starts, ends, at = word_spans(data, offsets)
    hashes, words = word_hashes(data, starts, ends), np.diff(at).astype(float)
    many = np.maximum(words, 1)
    lengths = ends - starts
    out[:, col["log_words"]] = np.log1p(words)
    out[:, col["word_bytes"]] = _sum(lengths, at) / many
    out[:, col["short_words"]] = _sum(lengths <= 3, at) / many
    if len(starts):
        out[:, col["capitals"]] = _sum(code[starts] == 0, at) / many
        out[:, col["marked_words"]] = _sum(code[ends - 1] == CLASSES.index("mark"), at) / many
    distinct, top = _distinct(hashes, at)
    out[:, col["distinct_words"]], out[:, col["top_word"]] = distinct / many, top / many
    for name, k in (("distinct_pairs", 2), ("distinct_fives", 5)):
        count = np.maximum(np.diff(at) - k + 1, 0)
        ends_k = np.concatenate(([0], np.cumsum(count)))
        where = ragged(at[:-1], count)
        grams = sum((hashes[where + j] * np.uint64(2 * j + 0x9E3779B97F4A7C15) for j in range(k)), np.zeros(len(where), np.uint64))
        out[:, col[name]] = np.where(count > 0, _distinct(grams, ends_k)[0] / np.maximum(count, 1), 1.0) * (words > 0)
    if len(hashes) > 1:
        same = np.concatenate((hashes[1:] == hashes[:-1], [False]))
        inner = np.ones(len(hashes), bool)
        inner[at[1:][words > 0] - 1] = False
        out[:, col["repeat_next"]] = _sum(same & inner, at) / many
    breaks = data == 10
    out[:, col["words_per_line"]] = np.log1p(words / (_count(breaks, offsets) + 1))
    line_at = np.flatnonzero(breaks)
    first = np.unique(np.concatenate((offsets[:-1][size > 0], line_at[line_at + 1 < len(data)] + 1)))
    stop = np.concatenate((first[1:], [len(data)]))
    stop = stop - (data[stop - 1] == 10)
    whole = word_hashes(data, first, stop)
    line_of = np.searchsorted(first, offsets)
    distinct, _ = _distinct(whole, line_of)
    out[:, col["distinct_lines"]] = distinct / np.maximum(np.diff(line_of), 1)
    return out


def _count(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return (total[at[1:]] - total[at[:-1]]).astype(float)
