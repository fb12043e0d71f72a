"""Suffix arrays of integer strings by induced sorting, on whole arrays.

The steps are those of induced sorting: classify suffixes as L (larger than the
next one) or S, sort the substrings between leftmost S suffixes (LMS), name
them, recurse on the names where they repeat, and induce the order of the L
suffixes and then the S suffixes from that of the LMS ones. Runs of L or S
suffixes are induced together: a suffix's place follows from its symbol and the
place of the next suffix, so doubling along the run settles a run of r
suffixes in log r vectorised rounds.
"""

from __future__ import annotations

import numpy as np


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 without gaps; equal keys have equal ranks."""
    if not len(keys):
        return keys
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    step = np.zeros(len(k), dtype=np.int64)
    step[1:] = np.cumsum(k[1:] != k[:-1])
    out = np.empty(len(k), dtype=np.int64)
    out[order] = step
    return out


def _induce(symbol: np.ndarray, seed_rank: np.ndarray, is_seed: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Ranks over seeds and members together, of runs of members that each end in a seed.

    symbol orders positions by their first symbol (L before S); seed_rank ranks
    the seeds, consistently with symbol. Positions in neither get rank -1.
    """
    n = len(symbol)
    at = np.flatnonzero(is_seed | member)
    span = int(seed_rank.max(initial=0)) + 2
    rank = np.full(n, -1, dtype=np.int64)
    rank[at], tied = _starts(symbol[at] * span + np.where(is_seed[at], seed_rank[at] + 1, 0))
    done = is_seed.copy()
    done[at[~tied]] = True
    todo = at[~done[at]]
    to = np.minimum(np.arange(n) + 1, n - 1)
    to[is_seed] = np.flatnonzero(is_seed)
    while len(todo):
        used = to[todo]
        inner, tied = _starts(rank[todo] * n + rank[used])
        outer, _ = _starts(rank[todo])
        rank[todo] += inner - outer
        over = done[used] | ~tied
        to[todo] = to[used]
        done[todo] = over
        todo = todo[~over]
    return rank


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the number of lesser keys, and whether another key equals it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    start = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
    single = head & np.append(head[1:], True)
    out, tied = np.empty(len(k), dtype=np.int64), np.empty(len(k), dtype=bool)
    out[order] = start
    tied[order] = ~single
    return out, tied


def _types(t: np.ndarray) -> np.ndarray:
    """True for S. The last suffix, of the single least symbol, is S."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    s[-1] = True
    differ = np.flatnonzero(t[:-1] != t[1:])
    nxt = np.searchsorted(differ, np.arange(n - 1))
    at = differ[np.minimum(nxt, len(differ) - 1)]
    s[:-1] = t[at] < t[at + 1]
    return s


def _ranks(t: np.ndarray) -> np.ndarray:
    n = len(t)
    if n <= 2 or len(np.unique(t)) == n:
        return dense(t)
    s = _types(t)
    lms = np.zeros(n, dtype=bool)
    lms[1:] = s[1:] & ~s[:-1]
    at = np.flatnonzero(lms)
    symbol = 2 * t + s
    names = _induce_both(symbol, s, lms, np.zeros(n, dtype=np.int64), unsorted=True)[at]
    # A substring runs to the next LMS position and includes it: its name is that of its run.
    names = dense(names)
    if names.max(initial=-1) + 1 < len(at):
        names = _ranks(names)
    seeds = np.zeros(n, dtype=np.int64)
    seeds[at] = names
    return _induce_both(symbol, s, lms, seeds, unsorted=False)


def _induce_both(symbol: np.ndarray, s: np.ndarray, lms: np.ndarray, seeds: np.ndarray, unsorted: bool) -> np.ndarray:
    """Order of L runs from the LMS positions they end in, then of S runs from the L positions they end in."""
    n = len(symbol)
    low = _induce(symbol, dense_at(symbol, lms) if unsorted else seeds, lms, ~s)
    # S runs end in an L position; the last position, an S of its own, is the least of all.
    is_l = ~s
    stop = is_l.copy()
    stop[n - 1] = True
    rank = low.copy()
    rank[n - 1] = -1
    rank += 1
    member = s.copy()
    member[n - 1] = False
    return _induce(symbol, rank, stop, member)


def dense_at(symbol: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbol), dtype=np.int64)
    out[where] = dense(symbol[where])
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of t, whose last symbol is less than all others and occurs once."""
    rank = _ranks(np.asarray(t, dtype=np.int64))
    sa = np.empty(len(rank), dtype=np.int64)
    sa[rank] = np.arange(len(rank))
    return sa


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """PLCP[i]: symbols that suffix i shares with the one before it in sa (0 for the first).

    PLCP[i] = PLCP[i-1] - 1 wherever t[i-1] equals the symbol before the
    neighbour of i; only at the other, irreducible positions are symbols
    compared, and those add up to O(n log n).
    """
    n = len(t)
    prev = np.full(n, -1, dtype=np.int64)
    prev[sa[1:]] = sa[:-1]
    i = np.arange(n)
    irreducible = (prev <= 0) | (i == 0)
    ok = ~irreducible
    irreducible[ok] = t[i[ok] - 1] != t[prev[ok] - 1]
    at = np.flatnonzero(irreducible & (prev >= 0))
    lcp = np.zeros(n, dtype=np.int64)
    alive, depth, step = at, np.zeros(len(at), dtype=np.int64), 1
    pad = np.concatenate([t, np.arange(-1, -257, -1)])
    other = np.concatenate([t, np.arange(-1000, -1256, -1)])
    while len(alive):
        k = np.arange(step)
        a = alive + depth
        b = prev[alive] + depth
        same = pad[a[:, None] + k] == other[b[:, None] + k]
        run = np.where(same.all(1), step, same.argmin(1))
        depth = depth + run
        lcp[alive] = depth
        more = run == step
        alive, depth = alive[more], depth[more]
        step = min(step * 2, 256) if len(alive) * step < 2_000_000 else step
    last = np.maximum.accumulate(np.where(irreducible, i, 0))
    return np.maximum(lcp[last] - (i - last), 0)
