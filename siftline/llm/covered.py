"""Stretches of a text that spans cover."""

from __future__ import annotations

from bisect import bisect_right


class Covered:
    """The union of some ``(kind, start, end)`` spans; asking whether a stretch meets it takes logarithmic time."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end
