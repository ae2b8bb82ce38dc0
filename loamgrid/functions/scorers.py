"""Similarity of two strings, 0 to 100, by the public definitions of the usual scorers."""

from __future__ import annotations

from difflib import SequenceMatcher


def _lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence; what both begin or end with is part of one."""
    k, most, end = 0, min(len(a), len(b)), 0
    while k < most and a[k] == b[k]:
        k += 1
    while end < most - k and a[-1 - end] == b[-1 - end]:
        end += 1
    return k + end + _lcs_bits(a[k : len(a) - end], b[k : len(b) - end]) if k + end < most else most


def _lcs_bits(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    return 100.0 if a == b else 200 * _lcs(a, b) / (len(a) + len(b))


def _ends(a: str, b: str, most: int, best: float) -> float:
    """The best ratio of a with a prefix of b of at most `most` letters, or `best`: one pass has the subsequences of all of them."""
    n = len(a)
    from_ = int(n * best / (200 - best))  # a shorter prefix could not be better, were it all in a
    if from_ >= most:
        return best
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    s = full = (1 << n) - 1
    find = where.get
    for ch in b[:from_]:
        u = s & find(ch, 0)
        s = (s + u | s - u) & full
    for w in range(from_, most):
        u = s & find(b[w], 0)
        s = (s + u | s - u) & full
        best = max(best, 200 * (n - s.bit_count()) / (n + w + 1))
    return best


def _windows(short: str, long: str) -> float:
    """The best ratio of the shorter string with a window of its own length: all windows as lanes of one integer."""
    n, lanes = len(short), len(long) - len(short) + 1
    where: dict[str, int] = {}
    for i, ch in enumerate(short):
        where[ch] = where.get(ch, 0) | 1 << i
    masks = 0
    for ch in reversed(long):
        masks = masks << n + 1 | where.get(ch, 0)  # a lane has a bit to spare for the carry
    one = 0
    for _ in range(lanes):
        one = one << n + 1 | 1
    s = full = one * ((1 << n) - 1)
    for _ in range(n):
        u = s & masks
        s = (s + u | s - u) & full
        masks >>= n + 1
    lane, least = (1 << n) - 1, n
    for _ in range(lanes):
        least = min(least, (s & lane).bit_count())
        s >>= n + 1
    return 200 * (n - least) / (n + n)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer; windows may stick out at both ends."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    if short in long:
        return 100.0
    n = len(short)
    best = _windows(short, long)
    for x, y in ((short, long), (long, short)) if len(a) == len(b) else ((short, long),):
        best = _ends(x[::-1], y[::-1], n - 1, _ends(x, y, n - 1, best))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not p or not q):
        return 100.0
    n, m, k = len(both), len(p), len(q)
    if not both:
        return ratio(p, q)
    # The shared tokens begin both texts; with a blank, they are n + 1 letters of each.
    return max(200 * (n + 1 + _lcs(p, q)) / (2 * n + 2 + m + k), 200 * n / (2 * n + 1 + m), 200 * n / (2 * n + 1 + k))


def hybrid(a: str, b: str, least: float = 0.0) -> float:
    """The weighted blend of the four scorers on trimmed, lower-cased text; one empty side gives 0.

    A score that cannot reach `least` may come out lower than it is: the dear scorers are left out once the cheap ones
    have decided.
    """
    a, b = a.strip().lower(), b.strip().lower()
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    so_far = 0.35 * token_set_ratio(a, b)
    if so_far + 65 < least:
        return so_far
    so_far += 0.30 * token_sort_ratio(a, b)
    if so_far + 35 < least:
        return so_far
    so_far += 0.15 * ratio(a, b)
    return so_far + 0.20 * partial_ratio(a, b) if so_far + 20 >= least else so_far


def difflib_ratio(a: str, b: str) -> float:
    """The matching-block ratio, 0 to 1; not symmetric."""
    return SequenceMatcher(None, a, b).ratio()


#: Scorers by name; the last argument is the score below which the exact value does not matter.
SCORERS = {"hybrid": hybrid, "token_set": lambda a, b, least=0.0: token_set_ratio(a.strip().lower(), b.strip().lower()), "ratio": lambda a, b, least=0.0: ratio(a, b)}
