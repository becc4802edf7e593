"""Edit similarity of two word sequences by banded bit-parallel alignment."""

from __future__ import annotations

import numpy as np


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Least insertions, deletions and replacements, or ``most`` + 1 if there are more.

    Only a band of ``most`` diagonals on either side of the main one is aligned, one row
    of the band as the bits of one number.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return min(most + 1, len(a) + len(b))
    if len(a) > len(b):
        a, b = b, a
    return min(most + 1, _banded(a, b, most))


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Rows follow ``b``, the longer; the band holds the cells of ``a`` within ``most`` of the diagonal.

    Bit t of the vectors stands for cell j - most + t. ``rise``/``fall`` say where a cell is
    one more or one less than the cell above; the score is that of the lowest cell of ``a``
    in the band.
    """
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    width = 2 * most + 1
    full = (1 << width) - 1
    low = 1 << (width - 1)
    # Before the first row the cells below the corner rise by one each.
    rise, fall = full & ~((1 << most) - 1), 0
    n = len(a)
    score = min(most, n)
    for j, word in enumerate(b.tolist()):
        mask = places.get(word, 0)
        shift = j - most
        match = (mask >> shift if shift >= 0 else mask << -shift) & full
        diagonal = ((((match & rise) + rise) ^ rise) | match | fall) & full
        right = (fall | ~(diagonal | rise)) & full
        left = diagonal & rise
        if j + most < n:
            score += not diagonal & low
        else:
            bit = 1 << (n - 1 - shift)
            score += bool(right & bit) - bool(left & bit)
        down = diagonal >> 1
        rise = (left | ~(down | right)) & full
        fall = down & right
    return score


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """1 - distance / longer length, or 0 if that is below ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most or _common(a, b) < longer - most:
        return 0.0
    distance = edit_distance(a, b, most)
    return 1 - distance / longer if distance <= most else 0.0


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset that two sequences share: no alignment matches more."""
    if len(a) > len(b):
        a, b = b, a
    a, b = np.sort(a), np.sort(b)
    nth_a = np.arange(len(a)) - np.searchsorted(a, a)
    return int((np.searchsorted(b, a, side="right") - np.searchsorted(b, a) > nth_a).sum())
