"""Features of the lines of a text, for linear-chain models over lines."""

from __future__ import annotations

import numpy as np

from .common import SPACES

#: Characters that mark up rather than write.
SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
#: Names of a line's own features.
OWN = ("one", "log_words", "short", "symbols", "pipes", "shouts", "upper", "digits", "latin", "word_len", "distinct", "in_a_row", "stop", "opens_upper", "seen", "links")


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple:
    """Numbers from 0 to about 1 that describe one line with at least one word."""
    n, size = len(words), len(line)
    letters = size - len(line.translate(None, _LETTERS))
    upper = size - len(line.translate(None, _UPPER))
    in_a_row = sum(map(bytes.__eq__, words, words[1:]))
    return (
        1.0,
        min(1.0, n.bit_length() / 10),
        1.0 if n < 4 else 0.0,
        min(1.0, (size - len(line.translate(None, SYMBOLS))) / n),
        min(1.0, 2 * line.count(b"|") / n),
        min(1.0, line.count(b"!") / n),
        upper / max(1, letters),
        min(1.0, 4 * (size - len(line.translate(None, _DIGITS))) / size),
        letters / size,
        min(1.0, size / n / 20),
        len(set(words)) / n,
        in_a_row / n,
        1.0 if words[-1][-1:] in b".?!:;" and words[-1] else 0.0,
        1.0 if line.lstrip(SPACES)[:1].isupper() else 0.0,
        1.0 if seen else 0.0,
        min(1.0, 2 * (line.count(b"://") + line.count(b"@")) / n),
    )


def lines_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, words in each line) of the lines that hold a word, split at line feeds."""
    rows, sizes, before = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words, line in before))
            sizes.append(len(words))
            before.add(line)
    return np.array(rows, np.float32).reshape(-1, len(OWN)), np.array(sizes, np.int64)


def with_neighbours(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it in its text; the ends see zeros."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(lengths[lengths > 0])
    before[ends[:-1]] = 0
    if len(x):
        before[0] = 0
        after[ends - 1] = 0
    return np.concatenate([x, before, after], 1)
