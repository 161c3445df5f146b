"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest Lyndon prefix and the groups put in order,
then the order inside the groups follows in one pass:

1. Groups start as the first symbols. They are processed from the highest down.
   For each member the previous-smaller pointer leads to the nearest earlier
   suffix of a lower group; a suffix that m members point at has their Lyndon
   word m times behind its own prefix, so it moves, with its equals, to a new
   group just above its old one, the largest m topmost.
2. Ranks are walked upwards. When a suffix is placed, those whose next smaller
   suffix it is stand on the chain of previous-smaller pointers just before it;
   each takes the first free place of its group.

No symbol is renamed and no shorter string is solved.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int] | np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``symbols`` (integers above 0) in lexicographic order."""
    s = np.append(np.asarray(symbols, np.int64), 0)
    n = len(s)
    sa = np.argsort(s, kind="stable").tolist()
    at = np.empty(n, np.int64)
    at[sa] = np.arange(n)
    at = at.tolist()
    ordered = s[sa]
    opens = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    head = np.repeat(opens, np.diff(np.append(opens, n)))
    group = np.empty(n, np.int64)
    group[sa] = head
    group = group.tolist()  # the first rank of a suffix's group names the group
    size = np.zeros(n, np.int64)
    size[opens] = np.diff(np.append(opens, n))
    size = size.tolist()
    before = [-1] * n

    top = n - 1
    while top > 0:
        low = group[sa[top]]
        members = sorted(sa[low : top + 1]) if top > low else sa[low : top + 1]
        votes: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                votes[p] = votes.get(p, 0) + 1
        if len(votes) == 1:
            order = list(votes)
            cuts = [(0, 1)]
        else:
            order = sorted(votes, key=votes.__getitem__, reverse=True)
            cuts = []
            a = 0
            for b in range(1, len(order) + 1):
                if b == len(order) or votes[order[b]] != votes[order[a]]:
                    cuts.append((a, b))
                    a = b
        for a, b in cuts:
            moved: dict[int, int] = {}
            for p in order[a:b]:
                g = group[p]
                k = moved.get(g, 0) + 1
                moved[g] = k
                slot = g + size[g] - k
                other, own = sa[slot], at[p]
                sa[own], sa[slot] = other, p
                at[other], at[p] = own, slot
            for g, k in moved.items():
                size[g] -= k
                if size[g]:
                    new = g + size[g]
                    for slot in range(new, new + k):
                        group[sa[slot]] = new
                    size[new] = k
                else:
                    size[g] = k
        top = low - 1

    free = list(range(n))
    placed = [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        p = out[r] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = before[p]
    return np.array(out[1:], np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[r]: how many symbols the suffixes of rank r - 1 and r share (0 for rank 0)."""
    s, sa = list(symbols), order.tolist()
    n = len(s)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    lcp, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = sa[rank[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            lcp[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return np.array(lcp, np.int64)


def joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' symbols (shifted above every end mark), each row closed by a mark of its own; and where each row starts."""
    sizes = np.array([len(r) for r in rows], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    out = np.empty(int(sizes.sum()) + len(rows), np.int64)
    for k, (a, r) in enumerate(zip(starts, rows, strict=True)):
        out[a : a + len(r)] = np.asarray(r, np.int64) + len(rows) + 1
        out[a + len(r)] = k + 1
    return out, starts


def longest_repeats(rows: list[np.ndarray], sizes: list[np.ndarray]) -> list[np.ndarray]:
    """For each position of each row, the size of the longest string from there that starts at another position of the rows too.

    ``sizes`` has the size of each symbol (equal symbols have equal sizes). In
    suffix order the longest common prefix is that with a neighbour.
    """
    if not rows:
        return []
    _, ranks = np.unique(np.concatenate(rows), return_inverse=True)
    cuts = np.cumsum([len(r) for r in rows])[:-1]
    text, starts = joined(np.split(ranks, cuts))
    order = suffix_array(text)
    shared = np.append(common_prefixes(text, order), 0)
    most = np.empty(len(text), np.int64)
    most[order] = np.maximum(shared[:-1], shared[1:])
    at = np.concatenate([a + np.arange(len(r)) for a, r in zip(starts, rows, strict=True)])
    size = np.zeros(len(text), np.int64)
    size[at] = np.concatenate(sizes)
    reach = np.append(0, np.cumsum(size))
    return np.split(reach[at + most[at]] - reach[at], cuts)
