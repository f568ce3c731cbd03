"""Banded bit-parallel edit distance.

The automaton of Wu and Manber ("Fast text searching allowing errors", 1992)
has a bit vector for each number of errors d: bit i is set if the first i code
points of a become what has been read of b by d edits or fewer. After j code
points of b only the i from j - k to j + k can still come to an end within k
edits, so each vector is a band of 2 k + 1 bits around that diagonal: bit p
stands for i = j - k + p, and moves along with j.
"""

from __future__ import annotations

#: Code points of a whose places are looked up together.
BLOCK = 1024


def _places(a: str, first: int, last: int) -> dict[str, int]:
    """For each code point of a[first:last] the bits of its places, counted from ``first``, which may be below zero."""
    out: dict[str, int] = {}
    for i in range(max(first, 0), min(last, len(a))):
        out[a[i]] = out.get(a[i], 0) | 1 << (i - first)
    return out


def within(a: str, b: str, k: int) -> bool:
    """Whether ``k`` insertions, deletions and substitutions of code points or fewer turn a into b."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    band = (1 << 2 * k + 1) - 1
    # Before anything is read, d edits drop up to d code points of a.
    errors = [((1 << d + 1) - 1) << k for d in range(k + 1)]
    for start in range(0, len(b), BLOCK):
        places = _places(a, start - k, start + BLOCK + k)
        for j, c in enumerate(b[start : start + BLOCK]):
            same = places.get(c, 0) >> j & band
            fewer, moved = 0, 0  # the vector of one error less, before and after c
            for d in range(k + 1):
                old = errors[d]
                new = old & same  # c is the next of a
                new |= fewer  # c stands for the next of a
                new |= fewer >> 1  # c is inserted, i stays and so its bit goes down
                new |= moved << 1 & band  # the next of a is dropped after c
                errors[d] = moved = new
                fewer = old
            if not moved:
                return False
    return bool(errors[k] >> (len(a) - len(b) + k) & 1)
