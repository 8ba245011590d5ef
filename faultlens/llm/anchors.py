"""Runs of windows that share an anchor: how equal windows of a corpus meet without a row for each of them.

The anchor of a window is the smallest hash among its grams (short windows inside it). Equal windows have equal
anchors, and neighbouring windows mostly share theirs, so a document falls into few runs. A window whose run has an
anchor of its own occurs nowhere else; runs of equal anchor and equal content are the same windows; only runs of
equal anchor and different content must be compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

# An odd multiplier has an inverse modulo 2**64, so one prefix sum gives the hash of every window.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Longest stretch hashed at once; longer texts are cut into stretches that overlap by a window.
STRETCH = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 12, 2 * len(known[0]) if known else 0)
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = base, pow(base, -1, 1 << 64)
        known = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return known[0][:n], known[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Rabin-Karp hashes of any windows of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        up, self.down = _power(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.down[first])

    def every(self, width: int) -> np.ndarray:
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def stacked(names: list[str], parts: list[tuple]) -> pd.DataFrame:
    """One frame of many short parts; a part holds arrays of one length and single values that stand for all of it."""
    if not parts:
        return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
    arrays = [i for i, x in enumerate(parts[0]) if isinstance(x, np.ndarray)]
    sizes = [len(p[arrays[0]]) for p in parts]
    return pd.DataFrame(
        {
            name: np.concatenate([p[i] for p in parts]) if i in arrays else np.repeat(np.array([p[i] for p in parts], np.int64), sizes)
            for i, name in enumerate(names)
        }
    )


def _slide(f, h: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) of every `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = f(h[:-step], h[step:])
        done += step
    return h


def runs(values: np.ndarray, window: int, gram: int, places: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, content, first, count, again) of all runs of a sequence of hashes, stretch by stretch.

    `first` is the run's first window, `count` its number of windows, `content` the hash of everything they cover.
    With `places`, `again` says that the anchor stands at several places of the run: only then can a run repeat one
    of its own windows.
    """
    for begin in range(0, max(len(values) - window + 1, 0), STRETCH):
        rolling = Rolling(values[begin : begin + STRETCH + window - 1])
        grams = rolling.every(gram)
        anchors = _slide(np.minimum, grams, window - gram + 1)
        edge = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        count = np.diff(np.r_[edge, len(anchors)])
        content = rolling.of(edge, edge + count + (window - 1))
        again = np.zeros(len(edge), bool)
        if places:
            pad = np.zeros(window - gram, np.uint64)
            # A gram is the smallest of a window if no window with it has a larger anchor.
            chosen = np.flatnonzero(_slide(np.maximum, np.r_[pad, anchors, pad], window - gram + 1) == grams)
            again = _stand_twice(grams[chosen], chosen, anchors[edge], edge, edge + count + (window - gram))
        yield anchors[edge].view(np.int64), content.view(np.int64), edge + begin, count, again


def _stand_twice(h: np.ndarray, at: np.ndarray, anchor: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each anchor stands at more than one of the places first ... end - 1."""
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    lo, hi = np.searchsorted(h, anchor, side="left"), np.searchsorted(h, anchor, side="right")
    out = np.zeros(len(anchor), bool)
    for i in np.flatnonzero(hi - lo > 1):
        own = at[lo[i] : hi[i]]
        out[i] = np.searchsorted(own, end[i]) - np.searchsorted(own, first[i]) > 1
    return out
