"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

The suffixes are classified as smaller (S) or larger (L) than their successor; the leftmost S of each run (LMS) is
sorted by its substring, the substrings' names by recursion, and all others are induced from them: one pass upwards
through the buckets places the L suffixes, one downwards the S suffixes. A pass takes a large bucket, or some small ones
together, at a time and is a few array operations for each, so it costs its suffixes and not an interpreter step for
each; also over the many names of a recursion.
"""

from __future__ import annotations

import numpy as np

from .common import eights

CHUNKS, LEAST = 64, 8192  # chunks of about equal sizes into which a pass's buckets go, and suffixes of a chunk at least
FEW = 16  # suffixes that are placed one by one
ONE, ONE_BIT = np.ones(1, bool), np.uint64(1)
DEEP = 12  # steps of induction within a chunk beyond which it is parted


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the empty suffix is smaller than all."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    step[n - 1] = -1
    where = np.where(step != 0, np.arange(n, dtype=np.int32), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    return step[nearest] > 0


def _induced(s: np.ndarray, placed: np.ndarray, fixed: np.ndarray, first: int | None, sigma: int) -> np.ndarray:
    """The suffixes of one kind (`placed`) in order, from those of the other kind (`fixed`, in order). A suffix goes to the
    end of its symbol's bucket when the suffix after it is passed; no symbol of this kind is below the one after it.
    A bucket's own fixed suffixes are passed after those placed there."""
    counts = np.bincount(s[placed], minlength=sigma)
    at = np.cumsum(counts) - counts  # of each bucket's first free place
    begin = at.copy()
    out = np.zeros(int(counts.sum()), np.int32)
    fixed = fixed[np.argsort(s[fixed], kind="stable")]
    size = np.bincount(s[fixed], minlength=sigma)
    bound = np.append(0, np.cumsum(size))
    if first is not None:
        out[at[s[first]]] = first
        at[s[first]] += 1

    def before(found: np.ndarray) -> np.ndarray:
        p = found[found > 0] - 1
        return p[placed[p]]

    def push(p: np.ndarray) -> None:
        if len(p) <= FEW:
            for q in p.tolist():
                c = s[q]
                out[at[c]] = q
                at[c] += 1
        else:
            symbols = s[p]
            order = np.argsort(symbols, kind="stable")
            symbols = symbols[order]
            heads = np.flatnonzero(np.concatenate([ONE, symbols[1:] != symbols[:-1]]))
            more = np.concatenate([heads[1:], [len(p)]]) - heads
            out[np.repeat(at[symbols[heads]] - heads, more) + np.arange(len(p))] = p[order]
            at[symbols[heads]] += more

    def alone(c: int) -> None:
        done = begin[c]
        while done < at[c]:
            part, done = out[done : at[c]], at[c]
            push(before(part))
        push(before(fixed[bound[c] : bound[c + 1]]))

    def together(lo: int, hi: int) -> None:
        held = at[lo:hi] - begin[lo:hi]
        total = int(held.sum())
        here = out[np.repeat(begin[lo:hi] - (np.cumsum(held) - held), held) + np.arange(total)]
        given = fixed[bound[lo] : bound[hi]]
        # what is placed within the chunk from within it, step by step, and from which (an index into all)
        every, parents, front, where = [here, given], [], np.concatenate([here, given]), np.arange(total + len(given))
        while len(front):
            go = front > 0
            p, where = front[go] - 1, where[go]
            inside = placed[p] & (s[p] < hi)
            p, where = p[inside], where[inside]
            if len(p):
                if len(parents) == DEEP:
                    for a, b in ((lo, c := int(s[p[0]])), (c, c + 1), (c + 1, hi)):  # the bucket of a long run, alone
                        if a < b:
                            chunk(a, b)
                    return
                parents.append(where)
                where = np.arange(len(p)) + sum(map(len, every))
                every.append(p)
            front = p
        # buckets in order; in each, what came from before the chunk, then from within, then the fixed
        inner = np.concatenate(every[2:]) if parents else here[:0]
        mine = s[inner].astype(np.int64) - lo
        sizes = np.stack([held, np.bincount(mine, minlength=hi - lo), size[lo:hi]], 1).ravel()
        starts = (np.cumsum(sizes) - sizes).reshape(-1, 3)
        rank = np.empty(total + len(given) + len(inner), np.int64)
        for k, n, at_ in ((0, total, 0), (2, len(given), total)):
            n_ = sizes.reshape(-1, 3)[:, k]
            rank[at_ : at_ + n] = np.repeat(starts[:, k] - (np.cumsum(n_) - n_), n_) + np.arange(n)
        if parents:
            parent, fresh = np.concatenate(parents), np.arange(total + len(given), len(rank))
            n_ = sizes.reshape(-1, 3)[:, 1]
            spots = np.repeat(starts[:, 1] - (np.cumsum(n_) - n_), n_) + np.arange(len(inner))
            rank[fresh] = 0
            for _ in parents:  # an order settles one step of induction after that of its parents
                order = np.lexsort((rank[parent], mine))
                rank[fresh[order]] = spots
            push(inner[order])
        passed = np.empty(len(rank), np.int32)
        passed[rank] = np.concatenate([here, given, inner])
        p = before(passed)
        push(p[s[p] >= hi])

    def chunk(lo: int, hi: int) -> None:
        if hi - lo == 1:
            alone(lo)
        else:
            together(lo, hi)

    weight = np.cumsum(counts + size)
    target = max(LEAST, int(weight[-1]) // CHUNKS)
    lo = 0
    while lo < sigma:
        hi = max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + target, "right")))
        if weight[hi - 1] > (weight[lo - 1] if lo else 0):
            chunk(lo, hi)
        lo = hi
    return out


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in the order given."""
    s = s.astype(np.uint8 if sigma <= 1 << 8 else np.uint16 if sigma <= 1 << 16 else np.int32)  # small ones sort by digits
    large = _induced(s, ~small, lms, len(s) - 1, sigma)
    # downwards is upwards with the symbols in reverse
    rest = _induced(sigma - 1 - s, small, large[::-1], None, sigma)[::-1]
    both = np.concatenate([large, rest])
    return both[np.argsort(s[both], kind="stable")]


def _names(s: np.ndarray, small: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in their order: equal substrings share one. `length` is indexed by position."""
    same = np.zeros(len(ordered), bool)
    left, right = ordered[:-1], ordered[1:]
    todo = np.flatnonzero(length[left] == length[right])
    size = length[left]
    k = 0
    equal = todo[:0]
    while len(todo):
        a, b = left[todo] + k, right[todo] + k
        todo = todo[(s[a] == s[b]) & (small[a] == small[b])]
        k += 1
        over = size[todo] <= k
        equal = np.concatenate([equal, todo[over]])
        todo = todo[~over]
    same[equal + 1] = True
    return np.cumsum(~same) - 1


def _recursion(names: np.ndarray, most: int) -> np.ndarray:
    """The suffix array of names. A name that stands once ends every comparison that comes to it, so of those only the
    ones behind repeated names go into the recursion."""
    once = np.bincount(names, minlength=most)[names] == 1
    keep = ~once
    keep[1:] |= ~once[:-1]
    if keep.all():
        return suffix_array(names, most)
    some = names[keep]
    label = np.zeros(most, np.int32)
    label[some] = 1
    label = np.cumsum(label, dtype=np.int32) - 1
    rank = np.zeros(len(names), np.int64)
    rank[np.flatnonzero(keep)[suffix_array(label[some], int(label[-1]) + 1)]] = np.arange(len(some))
    return np.argsort(names * np.int64(len(names)) + rank)


def suffix_array(s: np.ndarray, sigma: int = 256) -> np.ndarray:
    """The suffix array of symbols below sigma; the end is smaller than every symbol."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = classify(s)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        sa = induce(s, small, lms, sigma)
        ordered = sa[is_lms[sa]]
        length = np.zeros(n, np.int32)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = n + 1 - lms[-1]
        last = lms[-1]
        names = np.empty(n, np.int32)
        # the last substring ends with the text and equals no other
        length[last] = -1
        names[ordered] = _names(s, small, ordered, length)
        reduced = names[lms]
        most = int(reduced.max()) + 1
        lms = lms[np.argsort(reduced) if most == len(lms) else _recursion(reduced, most)]
    return induce(s, small, lms, sigma)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position of bytes, the common prefix of its suffix and the one before it in the array, cut at
    end[position].

    Common prefixes are compared only at irreducible positions, where the symbols before both suffixes differ or a
    piece begins; from there each next position's is one less."""
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    whole = before >= 0
    first = np.ones(n, bool)
    both = whole[1:] & (before[1:] > 0)
    first[1:] = ~(both & (s[:-1] == s[np.maximum(before[1:] - 1, 0)]))
    first[1:] |= end[1:] != end[:-1]
    # the suffix before position i + 1 is that of i moved by one only if i's is reducible from it; the bound holds anyway
    todo = np.flatnonzero(first & whole)
    value = np.zeros(n, np.int32)
    limit = np.minimum(end[todo] - todo, n - np.maximum(todo, before[todo]))
    words, k = eights(s), 0
    while len(todo):
        differ = words[todo + k] ^ words[before[todo] + k]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + ONE_BIT)) - ONE_BIT) >> 3).astype(np.int32)  # low zero bytes
        done = (differ != 0) | (limit <= k + 8)
        value[todo[done]] = np.minimum(limit[done], k + same[done])
        todo, limit, k = todo[~done], limit[~done], k + 8
    # reducible positions: one less than the position before
    anchor = np.maximum.accumulate(np.where(first, at, 0))
    return np.maximum(value[anchor] - (at - anchor), 0)
