"""Suffix arrays by induced sorting, in whole-array steps, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the end counts as smallest."""
    n = len(t)
    step = np.append(np.sign(np.diff(t.astype(np.int64))), -1)
    where = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(where[::-1])[::-1]] > 0


def _deal(scan: np.ndarray, t: np.ndarray, keep, into: list[list[np.ndarray]]) -> None:
    """Predecessors of the scanned suffixes go to the bucket of their symbol, in the order of the scan."""
    before = scan[scan > 0] - 1
    symbols = t[before]
    chosen = keep(symbols)
    before, symbols = before[chosen], symbols[chosen]
    if not len(before):
        return
    order = np.argsort(symbols, kind="stable")
    before, symbols = before[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part, first in zip(np.split(before, cuts), symbols[np.append(0, cuts)].tolist(), strict=True):
        into[first].append(part)


def _induce(t: np.ndarray, lms: list[np.ndarray], single: int, sigma: int) -> np.ndarray:
    """All suffixes from the given order of the leftmost-smaller ones (a list for each symbol).

    L-type suffixes are induced from the left, S-type ones from the right, one
    bucket at a time; a bucket's own predecessors come in waves, as many as its
    longest run of one symbol. Symbols below `single` occur once and need no loop.
    """
    empty = np.zeros(0, np.int64)
    into: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    into[int(t[-1])].append(np.array([len(t) - 1]))
    large: list[np.ndarray] = [empty] * sigma

    def waves(parts: list[np.ndarray], c: int) -> np.ndarray:
        own = list(parts)
        wave = np.concatenate(own) if own else empty
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[t[wave] == c]
            if len(wave):
                own.append(wave)
        return np.concatenate(own) if own else empty

    if single:
        for c in range(single):
            large[c] = np.concatenate(into[c]) if into[c] else empty
        scan = [x for c in range(single) for x in (large[c], lms[c]) if len(x)]
        if scan:
            _deal(np.concatenate(scan), t, lambda s: s >= single, into)
    for c in range(single, sigma):
        large[c] = waves(into[c], c)
        scan = np.concatenate((large[c], lms[c]))
        if len(scan):
            _deal(scan, t, lambda s, c=c: s > c, into)
    into = [[] for _ in range(sigma)]
    small: list[np.ndarray] = [empty] * sigma
    for c in range(sigma - 1, single - 1, -1):
        small[c] = waves(into[c], c)
        scan = np.concatenate((small[c], large[c][::-1]))
        if len(scan):
            _deal(scan, t, lambda s, c=c: s < c, into)
    for c in range(single):
        small[c] = np.concatenate(into[c]) if into[c] else empty
    return np.concatenate([x for c in range(sigma) for x in (large[c], small[c][::-1])])


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, ranks doubling their reach until all differ."""
    rank, reach, n = names.astype(np.int64), 1, len(names)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - reach] = rank[reach:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order][1:] != key[order][:-1])
        rank, reach = new, reach * 2
        if rank[order[-1]] == n - 1 or reach >= n:
            return order


def suffix_array(t: np.ndarray, single: int = 0, depth: int = 0) -> np.ndarray:
    """Suffix array of a string of small integers by induced sorting.

    Suffixes are classified, the leftmost-smaller substrings sorted by one
    induction and named; the string of names is sorted recursively (a string with
    many names by doubling, where a loop over symbols would be slow), and a second
    induction gives the whole array. Symbols below `single` occur once at most and
    never beside each other.
    """
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    t = t.astype(np.int64)
    sigma = int(t.max()) + 1
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    def by_symbol(order: np.ndarray) -> list[np.ndarray]:
        symbols = t[order]
        at = np.searchsorted(symbols, np.arange(sigma + 1))
        return [order[a:b] for a, b in zip(at, at[1:], strict=False)]

    if not len(lms):
        return _induce(t, [np.zeros(0, np.int64)] * sigma, single, sigma)
    first = _induce(t, by_symbol(lms[np.argsort(t[lms], kind="stable")]), single, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    # Name the substrings: equal to the one before in length and in every symbol?
    place = np.zeros(n, np.int64)
    place[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), n - lms[-1])
    a, b = order[:-1], order[1:]
    same = (length[place[a]] == length[place[b]]) & (a != lms[-1]) & (b != lms[-1])
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        left = left[length[place[a[left]]] >= k]
        equal = t[a[left] + k] == t[b[left] + k]
        same[left[~equal]] = False
        left, k = left[equal], k + 1
    name = np.zeros(n, np.int64)
    name[order] = np.append(0, np.cumsum(~same))
    names = name[lms]
    if names.max() + 1 == len(names):
        inner = np.argsort(names)
    elif names.max() < 4096 and len(names) > 4096 and depth < 8:
        inner = suffix_array(names, 0, depth + 1)
    else:
        inner = _doubled(names)
    return _induce(t, by_symbol(lms[inner]), single, sigma)


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PLCP and phi: for each position the common prefix with the suffix before it in `order`, and that suffix.

    Only irreducible positions (the symbols before the two suffixes differ) are
    compared, eight bytes at a time up to `ends`; at the others the prefix is one
    shorter than at the position before. `symbols` are those `order` sorts;
    `data` are their bytes, with 8 more at the end.
    """
    n = len(order)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (phi > 0)
    reducible[reducible] = symbols[at[reducible] - 1] == symbols[phi[reducible] - 1]
    start = np.flatnonzero(~reducible)
    prefix = np.zeros(n, np.int64)
    words = np.ndarray((n,), "<u8", data, strides=(1,)).copy()
    i = start[phi[start] >= 0]
    j = phi[i]
    room = np.minimum(ends[i] - i, ends[j] - j)
    done = np.zeros(len(i), np.int64)
    live = np.flatnonzero(room > 0)
    while len(live):
        differ = words[i[live] + done[live]] ^ words[j[live] + done[live]]
        equal = differ == 0
        odd = differ[~equal]
        done[live[~equal]] += np.log2((odd & (~odd + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8
        done[live[equal]] += 8
        live = live[equal]
        live = live[done[live] < room[live]]
    prefix[i] = np.minimum(done, room)
    base = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.maximum(prefix[base] - (at - base), 0), phi
