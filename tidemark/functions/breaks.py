"""Where a text may be broken: indexes over one text, built once and asked by bisection or by range maximum."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


class RangeMaximum:
    """Sparse table over boundary strengths: the strongest position of a range, the rightmost among equals."""

    def __init__(self, strength: np.ndarray, longest: int) -> None:
        keys = strength.astype(np.int64) * (len(strength) + 1) + np.arange(len(strength))
        self.width, self.levels, reach = len(strength) + 1, [keys], 1
        while 2 * reach <= min(longest, len(strength)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-reach], last[reach:]))
            reach *= 2

    def strongest(self, low: int, high: int) -> int:
        """The best position of low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[low], row[high + 1 - (1 << k)]) % self.width)


class Lines:
    """The lines of a text by their places."""

    def __init__(self, text: str) -> None:
        self.size = len(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def around(self, start: int, end: int) -> tuple[int, int]:
        """From the start of the line of ``start`` to the end of that of ``end``."""
        after = bisect_right(self.starts, end)
        return self.starts[bisect_right(self.starts, start) - 1], self.starts[after] - 1 if after < len(self.starts) else self.size


class Breaks:
    """Ends of paragraphs, lines and sentences. A break lies behind the white space that makes it."""

    def __init__(self, text: str) -> None:
        self.lines = [m.end() for m in re.finditer("\n", text)]
        # A line break ends a paragraph if nothing but white space parts it from the line break before.
        self.paragraphs = [(z, a - 1) for a, z in zip(self.lines, self.lines[1:], strict=False) if not text[a:z].strip()]
        self.sentences = [m.span() for m in _SENTENCE.finditer(text)]

    def last(self, low: int, high: int) -> int | None:
        """The last end of a paragraph in a range, else of a line, else of a sentence; all that makes it lies in the range."""
        k = bisect_right(self.paragraphs, (high, high)) - 1
        if k >= 0 and self.paragraphs[k][1] >= low:
            return self.paragraphs[k][0]
        k = bisect_right(self.lines, high) - 1
        if k >= 0 and self.lines[k] > low:
            return self.lines[k]
        k = bisect_left(self.sentences, (high, high)) - 1
        # White space may go on behind the range; the mark before it must lie within.
        return min(self.sentences[k][1], high) if k >= 0 and self.sentences[k][0] > low else None
