"""Spans (kind, start, end) in code points, end exclusive, and their digests."""

from __future__ import annotations

import hashlib

import numpy as np

Span = tuple[str, int, int]


def joined(spans: list[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(spans: list[Span], order: dict[str, int]) -> str:
    return hashlib.sha256(joined(spans, order).encode()).hexdigest()


class Taken:
    """Which places some spans take."""

    def __init__(self, spans: list[Span]):
        bounds = sorted((a, b) for _, a, b in spans)
        self.starts = np.array([a for a, _ in bounds], np.int64)
        self.ends = np.maximum.accumulate(np.array([b for _, b in bounds], np.int64)) if bounds else np.zeros(0, np.int64)

    def overlaps(self, start: int, end: int) -> bool:
        k = int(np.searchsorted(self.starts, end, "left"))
        return k > 0 and bool(self.ends[k - 1] > start)
