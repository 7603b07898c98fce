"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the last, a sentinel, counts as smaller."""
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]  # of equal neighbours the next difference decides
    return np.append(np.append(step, 1)[following] > 0, True)


def _induce(s: list[int], larger: list[bool], smaller: list[bool], heads: list[int], tails: list[int], lms: list[int], n: int) -> list[int]:
    """Sort all suffixes given their leftmost-smaller ones in order: larger suffixes follow from left to right, smaller ones from right to left.

    larger and smaller tell of each place, n for an empty slot included, whether the suffix before it is of that type."""
    sa = [n] * n
    ends = tails.copy()
    for i in reversed(lms):
        c = s[i]
        ends[c] -= 1
        sa[ends[c]] = i
    starts = heads.copy()
    for i in sa:  # entries are filled in ahead of the scan
        if larger[i]:
            c = s[i - 1]
            r = starts[c]
            sa[r] = i - 1
            starts[c] = r + 1
    ends = tails.copy()
    for r in range(n - 1, -1, -1):
        i = sa[r]
        if smaller[i]:
            c = s[i - 1]
            ends[c] = q = ends[c] - 1
            sa[q] = i - 1
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of non-negative numbers whose last is 0 and occurs nowhere else, in time linear in its length."""
    n = len(s)
    if n < 3:
        return np.arange(n - 1, -1, -1)
    small = _classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s)
    tails = np.cumsum(counts)
    seq = s.tolist()
    args = (seq, [False, *(~small[:-1]).tolist(), False], [False, *small[:-1].tolist(), False], (tails - counts).tolist(), tails.tolist())
    # sort the leftmost-smaller substrings by inducing from them in any order, and name them by rank
    first = np.array(_induce(*args, lms.tolist(), n))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    ends = np.full(n, n)
    ends[lms] = np.append(lms[1:], n - 1)
    names, name = np.full(n, -1), 0
    names[order[0]] = 0
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        la, lb = int(ends[a]) - a, int(ends[b]) - b
        if la != lb or seq[a : a + la + 1] != seq[b : b + lb + 1]:
            name += 1
        names[b] = name
    if name + 1 < len(lms):
        lms = lms[suffix_array(names[lms])]
    else:
        lms = order
    return np.array(_induce(*args, lms.tolist(), n))


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position how many symbols its suffix shares with the one before it in sa.

    Where the symbols before both are equal the value is one less than at the position before; only the others are compared, all of them side by side."""
    n, step = len(s), 16
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    own = np.flatnonzero((before > 0) & (at > 0) & (s[np.maximum(at - 1, 0)] != s[np.maximum(before - 1, 0)]) | (before == 0) | (at == 0) & (before >= 0))
    padded = np.append(s, np.zeros(step, s.dtype))
    lcp, live = np.zeros(n, np.int64), own
    while len(live):
        i, j = (live + lcp[live])[:, None] + np.arange(step), (before[live] + lcp[live])[:, None] + np.arange(step)
        differ = padded[i] != padded[j]
        stop = differ.any(1)
        lcp[live] += np.where(stop, differ.argmax(1), step)
        live = live[~stop]
    reach = np.zeros(n, np.int64)
    reach[own] = lcp[own] + own
    return np.maximum(np.maximum.accumulate(reach) - at, 0)


def repeated(pieces: list[bytes], length: int, cores: list[tuple[tuple[int, int], int]] | None = None) -> list[np.ndarray]:
    """For each piece the positions at which a string of `length` bytes starts that also starts elsewhere in one of the pieces.

    cores: for each piece ((start, end), group), a stretch that all its strings of `length` bytes hold. Pieces of a group hold the same stretch and others
    match none of theirs; equal strings have it at the same place. One symbol a group then stands for the whole stretch."""
    parts, groups = [], {}
    for k, piece in enumerate(pieces):
        symbols = np.frombuffer(piece, np.uint8) + np.int64(2)
        if cores is not None:
            (x, y), group = cores[k]
            symbols = np.concatenate([symbols[:x], np.array([258 + groups.setdefault(group, len(groups))]), symbols[y:]])
        parts += [symbols, np.ones(1, np.int64)]  # 1 is no byte, so strings that hold it are no matches
    s = np.concatenate([*parts, np.zeros(1, np.int64)])
    sizes = np.array([len(p) for p in parts[::2]], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    least = np.full(len(s), length, np.int64)  # symbols of a string that starts at each place
    if cores is not None:
        least = np.repeat([*(length - (y - x) + 1 for (x, y), _ in cores), length], np.r_[sizes + 1, 1])
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa)
    hit = np.zeros(len(s), bool)
    long = lcp[sa] >= least[sa]
    hit[sa[long]] = True
    hit[sa[np.flatnonzero(long) - 1]] = True
    return [np.flatnonzero(hit[a : a + max(0, len(p) - length + 1)]) for a, p in zip(starts.tolist(), pieces, strict=True)]
