"""Statistics of one whole text, as numbers that rules and classifiers read."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
STOPS = b".!?\"'"
WINDOW = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "log_words",
    "mean_word",
    "long_words",
    "short_words",
    "symbols_a_word",
    "bars_a_word",
    "bangs_a_word",
    "stops_a_word",
    "commas_a_word",
    "upper_share",
    "digit_share",
    "punct_share",
    "wide_share",
    "control_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "top_word_share",
    "echo_share",
    "lines_a_word",
    "stop_line_share",
    "word_entropy",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WHITE = np.isin(np.arange(256), list(WHITE))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_CONTROL = (np.arange(256) < 32) & ~_WHITE
_PUNCT = (np.arange(256) > 32) & (np.arange(256) < 127) & ~(_UPPER | _LOWER | _DIGIT)
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_WIDE = np.arange(256) >= 0xC0


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice.

    Windows get exact numbers by doubling: equal numbers of two halves make equal
    windows. ``window`` is a power of two.
    """
    n = len(ids)
    if n < window + 1:
        return 0
    size, numbers = 1, ids.astype(np.int64)
    while size < window:
        base = int(numbers.max()) + 1
        pairs = numbers[:-size] * base + numbers[size:]
        distinct, numbers = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        size *= 2
    twice = np.bincount(numbers)[numbers] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(twice)] += twice
    edge[window : window + len(twice)] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The values of ``BASE`` and of ``RATIOS``; all zero for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(BASE), [0.0] * len(RATIOS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    word_chars = int(counts[_FIRST & ~_WHITE].sum())
    symbols = int(counts[_SYMBOL].sum())
    full = [line for line in data.split(b"\n") if line and not line.isspace()]
    lines = len(full)
    repeats = lines - len(set(full))
    stopped = sum(line.rstrip(WHITE)[-1] in STOPS for line in full)
    numbers: dict[bytes, int] = {}
    ids = np.array(list(map(numbers.setdefault, words, range(n))))  # place of the first equal word
    often = np.bincount(ids)
    often = often[often > 0]
    inside = repeated_words(ids)
    share = often / n
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = max(1, word_chars)
    letters = max(1, int(counts[_UPPER | _LOWER].sum()))
    ratios = [
        float(np.log1p(n)),
        word_chars / n,
        float((lengths > 15).mean()),
        float((lengths < 3).mean()),
        symbols / n,
        float(counts[ord("|")]) / n,
        float(counts[ord("!")]) / n,
        float(counts[ord(".")]) / n,
        float(counts[ord(",")]) / n,
        float(counts[_UPPER].sum()) / letters,
        float(counts[_DIGIT].sum()) / chars,
        float(counts[_PUNCT].sum()) / chars,
        float(counts[_WIDE].sum()) / chars,
        float(counts[_CONTROL].sum()) / chars,
        repeats / lines,
        inside / n,
        len(numbers) / n,
        float(share.max()),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        lines / n,
        stopped / lines,
        float(-(share * np.log(share)).sum() / np.log(n + 1)),
    ]
    return (n, word_chars, symbols, repeats, inside), ratios
