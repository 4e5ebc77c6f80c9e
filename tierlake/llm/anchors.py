"""Anchored windows: a complete, sparse index of all windows of a fixed length.

Every window of `length` symbols is represented by one anchor, the least of its
k-grams by hash (the leftmost of equals). Neighbouring windows mostly share
theirs, so a document has far fewer anchors than windows. Equal windows have
equal anchors at equal distances: windows whose anchor occurs once in the
corpus are unique, and only the others need any comparison. For each anchor the
segment is the text of all windows that it stands for; occurrences with equal
segments have equal windows throughout.
"""

from __future__ import annotations

import numpy as np

from .common import U64, row_of, sliding_min

#: Bits of a place in a slice, below the hash in the sort key of the sliding minimum.
_PLACE = U64((1 << 31) - 1)


def anchored(grams: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, lo, n, shift, anchor) per anchor, from the hashes of all k-grams: the windows from lo on, n of them, have theirs at lo + shift. lo counts from the slice's first symbol."""
    size = int(offs[-1])
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none, none.astype(U64)
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=U64), length - k + 1)
    row = row_of(offs)
    at = np.flatnonzero(row[: size - length + 1] == row[length - 1 :])
    if not len(at):
        return none, none, none, none, none.astype(U64)
    place = (least[at] & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    lo, place = at[first], place[first]
    return row[lo], lo, n, place - lo, grams[place]


def covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` symbols lie in one of the spans."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0
