"""Word splitting and edit distance shared by the Python-side operators."""

from __future__ import annotations

import re

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD = re.compile(r"[^\w\x00-\x7f]")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8: runs of letters and digits of any script; null has none."""
    if not text:
        return []
    t = text.lower()
    if not t.isascii() and _ODD.search(t):
        t = _ODD.sub(" ", t)
    return t.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def search(pattern: list, text: list) -> tuple[int, int, int]:
    """Myers' bit-parallel search: least edit distance of ``pattern`` to any stretch of ``text``, with the
    stretch's first place and end (the shortest one at the first best end)."""
    m = len(pattern)
    best, end = _sweep(pattern, text, anchored=False)
    if m == 0 or end == 0:
        return best, 0, 0
    _, back = _sweep(pattern[::-1], text[:end][::-1], anchored=True)
    return best, end - back, end


def _sweep(pattern: list, text: list, anchored: bool) -> tuple[int, int]:
    m = len(pattern)
    if not m:
        return 0, 0
    eq: dict = {}
    for i, x in enumerate(pattern):
        eq[x] = eq.get(x, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score = mask, 0, m
    best, at = m, 0
    for j, x in enumerate(text, 1):
        e = eq.get(x, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (mask & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | anchored) & mask
        mh = mh << 1 & mask
        pv = mh | (mask & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


def banded_distance(a, b, limit: int) -> int:
    """Edit distance of two sequences if it is at most ``limit``, else ``limit + 1``.

    Only cells within ``limit`` of the diagonal are kept, as bits of one integer that slides along with the
    row of the longer sequence (a banded bit-parallel alignment)."""
    if len(a) < len(b):
        a, b = b, a
    lo, n, m = 0, len(a), len(b)
    if n - m > limit:
        return limit + 1
    while lo < m and a[lo] == b[lo]:
        lo += 1
    while m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if not m or not limit:
        return n if n <= limit else limit + 1
    # Column j of the matrix (symbol j of a) keeps rows j-limit..j+limit: bit i is row j - limit + i.
    width = 2 * limit + 1
    mask = (1 << width) - 1
    eq: dict = {}
    for i, x in enumerate(b):
        eq[x] = eq.get(x, 0) | 1 << i + limit  # shifted: rows above the first have no match
    vp, vn = mask >> limit << limit, 0
    score = min(limit, m)  # the value at the band's lowest row, later at the last row
    diagonal = 1 << width - 1
    for j in range(n):
        e = (eq.get(a[j], 0) >> j) & mask
        d0 = (((e & vp) + vp) ^ vp) | e | vn
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        if j + limit < m:
            score += not d0 & diagonal
        else:
            last = 1 << (m - 1 - j + limit)
            if hp & last:
                score += 1
            elif hn & last:
                score -= 1
        vp = hn | (mask & ~((d0 & mask) >> 1 | hp))
        vn = (d0 & mask) >> 1 & hp
        if j + limit < m and score > 2 * limit + n - m:  # a diagonal never falls, neighbours differ by one
            return limit + 1
    return score if score <= limit else limit + 1
