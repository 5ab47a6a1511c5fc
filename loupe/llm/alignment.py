"""Banded alignment of two word sequences: their edit distance, within a band."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int | None:
    """The least number of insertions, deletions and substitutions that turn
    ``a`` into ``b``; None if it is above ``most``.

    Bit-parallel: one integer holds the column's differences for the diagonals
    within ``most`` of the main one, and moves down one row with each column.
    """
    start = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        start += 1
    end = 0
    for x, y in zip(reversed(a[start:]), reversed(b[start:]), strict=False):
        if x != y:
            break
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return None
    if not m:
        return n
    k = min(most, n)
    width = 2 * k + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    at: dict[Hashable, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    # bit i of the band is row column + 1 - k + i - 1; the top bit is the lowest diagonal
    vp, vn, dist, side = mask & ~((1 << (width - 1 - k)) - 1), 0, k, top >> 1
    shift = k + 1 - width
    for column, w in enumerate(b):
        eq = at.get(w, 0)
        s = shift + column
        eq = (eq >> s if s >= 0 else eq << -s) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        if column < n - k:
            dist += not d0 & top
        else:
            dist += bool(hp & side) - bool(hn & side)
            side >>= 1
        vp = hn | (mask & ~((d0 >> 1) | hp))
        vn = (d0 >> 1) & hp
    return dist if dist <= most else None


def similar(a: Sequence[Hashable], b: Sequence[Hashable], least: float) -> bool:
    """1 - distance / longer length is at least ``least``."""
    most = allowed(max(len(a), len(b)), least)
    return edit_distance(a, b, most) is not None


def allowed(length: int, least: float) -> int:
    """Edits that a pair of that longer length may have."""
    return int(length * (1 - least) + 1e-9)
