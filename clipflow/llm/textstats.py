"""Counts over a whole text, made in one pass per document and shared by the rule votes and the quality classifier."""

from __future__ import annotations

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
WINDOW = 5

#: The order of the values that ``doc_stats`` returns.
STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_distinct",
    "n_upper", "n_letters", "n_digits", "n_exclaim", "n_stops", "n_short", "n_symbol_words", "len_sq", "longest_word",
)


def window_codes(ids: np.ndarray, distinct: int, size: int = WINDOW) -> np.ndarray:
    """One integer per window of ``size`` word numbers; equal exactly when the windows are equal."""
    if distinct ** size < 2**63:
        codes = ids[: len(ids) - size + 1].copy()
        for k in range(1, size):
            codes = codes * distinct + ids[k : len(ids) - size + 1 + k]
        return codes
    codes = ids
    for k in range(1, size):
        _, rank = np.unique(codes[: len(ids) - k], return_inverse=True)
        codes = rank * distinct + ids[k:]
    return codes


def repeated_words(words: list[bytes], index: dict[bytes, int]) -> int:
    """Words that lie in a window found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    codes = window_codes(ids, len(index))
    order = np.argsort(codes)
    same = np.diff(codes[order]) == 0
    if not same.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def doc_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS. A null text counts as empty."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode()
    words = raw.split()
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(BLANKS):
            seen.add(line)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    symbols = SYMBOLS.encode()
    n_symbols = count(symbols)
    bare = [w.translate(None, symbols) for w in words] if n_symbols else []
    return (
        n, len(text) - count(BLANKS.encode()), n_symbols, dup, repeated_words(words, index), len(lines), len(text), len(index),
        count(UPPER), count(LETTERS), count(DIGITS), raw.count(b"!"), raw.count(b"."), int((lengths <= 3).sum()) - sum(1 for w, b in zip(words, bare, strict=False) if not b and len(w) <= 3),
        sum(1 for w, b in zip(words, bare, strict=False) if b != w), int((lengths * lengths).sum()), int(lengths.max(initial=0)),
    )
