"""Statistics of a text that quality rules and quality classifiers look at."""

from __future__ import annotations

from collections import Counter

import numpy as np

from linkloom.llm._common import utf8, window_hashes

#: The statistics in the order of ``features``.
NAMES = (
    "log_words", "mean_word", "symbols", "dup_lines", "repeat_words", "upper", "marks", "distinct", "top_word",
    "digits", "line_words", "bars",
)
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?:;=\"'()[]{}_~^`\\/@+-"


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def repeated(words: list[bytes], n: int = 8) -> int:
    """Words inside windows of n words that the text has twice or more, the first one included."""
    if len(words) <= n:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)  # for this text alone, checked below
    h = np.sort(window_hashes(h, n))
    if not (h[1:] == h[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], "<u4").tobytes()
    keys = [ids[4 * k : 4 * (k + n)] for k in range(len(words) - n + 1)]
    counts = Counter(keys)
    twice = np.flatnonzero([counts[k] > 1 for k in keys])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    return int((np.cumsum(cover) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return _measure(text)[0]


def _measure(text: str | None):
    raw = utf8(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = (0 if text is None else len(text)) - _count(raw, _SPACE)
    return (len(words), chars, _count(raw, _SYMBOLS), len(lines) - len(set(lines)), repeated(words)), raw, words, lines


def measured(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The five counts and the statistics of each text; an empty text has zeros."""
    base, stats = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(NAMES)))
    for k, text in enumerate(texts):
        base[k], raw, words, lines = _measure(text)
        if n := len(words):
            tally = Counter(words)
            _, chars, symbols, dup, again = base[k]
            stats[k] = (
                np.log1p(n), chars / n, symbols / n, dup / len(lines), again / n, _count(raw, _UPPER) / len(raw),
                _count(raw, _MARKS) / n, len(tally) / n, max(tally.values()) / n, _count(raw, _DIGITS) / len(raw),
                np.log1p(n / len(lines)), raw.count(b"|") / n,
            )
    return base, stats
