"""Suffix arrays by induced sorting, vectorised, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successors; leftmost-S substrings are sorted (by packed symbols) and
named; where names repeat, the string of names is sorted in its turn, in the same way; the sorted leftmost-S suffixes then induce the
rest, L from below, S from above.

Over bytes the induction goes bucket by bucket: a bucket's suffixes, and with them its whole runs of equal bytes, are placed in one
step. Over names, whose buckets hold a few suffixes each, all buckets are induced at once: a suffix's place follows from its own symbols
and the place of the known suffix (leftmost S for L, L for S) it runs into, and the way there is gone in doubling steps.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last suffix is larger (an end below all symbols follows)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1]).astype(np.int8)
    step[-1] = -1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def _place(order: np.ndarray, head: np.ndarray, found: np.ndarray, chars: np.ndarray, up: bool) -> None:
    """Put ``found`` (in scan order) at the heads (or, from above, the tails) of their buckets."""
    if not len(found):
        return
    by = np.argsort(chars, kind="stable")
    sizes = np.bincount(chars, minlength=len(head))
    # within its bucket each has the place of its order of arrival
    shift = head - (np.cumsum(sizes) - sizes) if up else head - 1 + (np.cumsum(sizes) - sizes)
    place = shift[chars[by]]
    place += np.arange(len(by)) if up else -np.arange(len(by))
    order[place] = found[by]
    if up:
        head += sizes
    else:
        head -= sizes


def _with_runs(seeds: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``seeds``, then those one equal symbol before them, then two, and so on, each in the order of the seeds."""
    reach = before[seeds]
    if not reach.any():
        return seeds
    which = np.repeat(np.arange(len(seeds)), reach)
    steps = np.arange(1, len(which) + 1) - np.repeat(np.cumsum(reach) - reach, reach)
    by = np.argsort(steps.astype(np.uint16) if steps.max() < 1 << 16 else steps, kind="stable")
    return np.concatenate((seeds, seeds[which[by]] - steps[by].astype(seeds.dtype)))


def induce(text: np.ndarray, small: np.ndarray, lms_sorted: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix order that the given order of leftmost-S suffixes induces."""
    n = len(text)
    place = np.int32 if n < 1 << 31 else np.int64
    counts = np.bincount(text, minlength=sigma)
    ends = np.cumsum(counts)
    begins = ends - counts
    at = np.arange(n, dtype=place)
    fresh = np.ones(n, bool)
    fresh[1:] = text[1:] != text[:-1]
    before = at - np.maximum.accumulate(np.where(fresh, at, 0))
    # the symbol in front, where its suffix is of the kind in question and in another bucket; else sigma
    up, down = np.full(n, sigma, np.uint16), np.full(n, sigma, np.uint16)
    rising, falling = np.flatnonzero(small[:-1] & fresh[1:]), np.flatnonzero(~small[:-1] & fresh[1:])
    up[falling + 1], down[rising + 1] = text[falling], text[rising]
    order = np.full(n, -1, place)
    lms_sorted = lms_sorted.astype(place)
    lms_stop = np.cumsum(np.bincount(text[lms_sorted], minlength=sigma))
    # L suffixes, from below. The end of the text comes first of all and induces the last suffix.
    head = begins.copy()
    order[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    used = np.flatnonzero(counts).tolist()
    for c in used:
        known = lms_sorted[lms_stop[c - 1] if c else 0 : lms_stop[c]]
        if head[c] > begins[c]:
            own = _with_runs(order[begins[c] : head[c]], before)
            head[c] = begins[c] + len(own)
            order[begins[c] : head[c]] = own
            known = np.concatenate((own, known))
        chars = up[known]
        use = chars < sigma
        _place(order, head, known[use] - 1, chars[use], True)
    large = head.copy()
    # S suffixes, from above
    tail = ends.copy()
    for c in used[::-1]:
        known = order[begins[c] : large[c]][::-1]
        if tail[c] < ends[c]:
            own = _with_runs(order[tail[c] : ends[c]][::-1], before)
            tail[c] = ends[c] - len(own)
            order[tail[c] : ends[c]] = own[::-1]
            known = np.concatenate((own, known))
        chars = down[known]
        use = chars < sigma
        _place(order, tail, known[use] - 1, chars[use], False)
    return order


#: Rounds of packed symbols that naming takes; longer substrings that still tie are parted in doubling steps.
ROUNDS = 8


def _names(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of leftmost-S substrings, in text order, and how many differ; names sort as the substrings do.

    A symbol counts with its kind (L before S), so no substring begins another but the last one, which comes first: the text's end
    follows it. So substrings sort by their packed symbols.
    """
    n = len(text)
    kind = 2 * text.astype(np.int64) + small + 1
    bits = int(kind.max()).bit_length()
    per = 63 // bits
    packed = np.zeros(n, np.int64)
    for k in range(per):
        packed <<= bits
        packed[: max(0, n - k)] += kind[k:]
    length = np.zeros(n, np.int64)
    length[lms] = np.append(lms[1:] + 1, n) - lms
    rank = np.zeros(n, np.int64)
    tied, offset, base = lms, 0, np.zeros(len(lms), np.int64)
    for _ in range(ROUNDS):
        left = length[tied] - offset
        key = packed[tied + offset]
        short = np.flatnonzero(left < per)
        key[short] &= ~((np.int64(1) << ((per - left[short]) * bits)) - 1)
        by = np.lexsort((key, base)) if offset else np.argsort(key)
        tied, key, left, base = tied[by], key[by], left[by], base[by]
        at, group = np.arange(len(by)), np.ones(len(by), bool)
        group[1:] = base[1:] != base[:-1]
        new = group.copy()
        new[1:] |= key[1:] != key[:-1]
        base = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank[tied] = base
        alone = new.copy()
        alone[:-1] &= new[1:]
        going = ~alone & (left > per)
        tied, base = tied[going], base[going]
        offset += per
        if not len(tied):
            break
    else:
        rank = _places(text.astype(np.int64), small, lms, None)
    below, again = np.unique(rank[lms], return_inverse=True)
    return again, len(below)


def _ranked(keys: np.ndarray, of: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Give each of the suffixes ``of`` the place of the first one with its key; those that share theirs come back."""
    by = np.argsort(keys)
    keys = keys[by]
    new = np.ones(len(by), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    rank[of[by]] = first
    tied = ~new
    tied[:-1] |= ~new[1:]
    return of[by[tied]]


def _part(rank: np.ndarray, tied: np.ndarray, stop: np.ndarray) -> None:
    """Part suffixes of one place by the known suffixes they run into at ``stop``, in doubling steps."""
    n, step = len(rank) + 1, 1
    while len(tied):
        ahead = np.minimum(tied + step, stop[tied])
        key = rank[tied] * n + rank[ahead] + 1
        by = np.argsort(key)
        tied, key, arrived = tied[by], key[by], (ahead == stop[tied])[by]
        at, base = np.arange(len(tied)), rank[tied]
        group, new = np.ones(len(tied), bool), np.ones(len(tied), bool)
        group[1:] = base[1:] != base[:-1]
        new[1:] = key[1:] != key[:-1]
        rank[tied] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = tied[~alone & ~arrived]
        step *= 2


def _places(text: np.ndarray, small: np.ndarray, lms: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Each suffix's place (of equals, that of the first): exact given the order of leftmost-S suffixes, else by their substrings."""
    n = len(text)
    at = np.arange(n)
    kind = 2 * text + small
    rank = np.full(n + 1, -1, np.int64)
    given = np.zeros(n, np.int64)
    if known is not None:
        given[known] = np.arange(1, len(known) + 1)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    first_pass = np.flatnonzero(~small | is_lms)
    tied = _ranked(kind[first_pass] * (n + 1) + given[first_pass], first_pass, rank)
    next_small = np.minimum.accumulate(np.where(small, at, n)[::-1])[::-1]
    _part(rank, tied[~small[tied]], next_small)
    tied = _ranked(kind * (n + 1) + np.where(small, 0, rank[:-1] + 1), at, rank)
    next_large = np.minimum.accumulate(np.where(small, n, at)[::-1])[::-1]
    _part(rank, tied[small[tied]], next_large)
    return rank[:-1]


def _of_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string over any alphabet of numbers from 0."""
    n = len(names)
    if n < 2:
        return np.arange(n)
    small = classify(names)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ordered = lms
    if len(lms) > 1:
        again, distinct = _names(names, small, lms)
        ordered = lms[np.argsort(again) if distinct == len(lms) else _of_names(again)]
    order = np.empty(n, np.int64)
    order[_places(names, small, lms, ordered)] = np.arange(n)
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes, or of numbers from 0; a suffix that ends first comes first."""
    n = len(text)
    if text.dtype != np.uint8:
        return _of_names(text.astype(np.int64))
    if n < 2:
        return np.arange(n)
    sigma = 256
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return induce(text, small, lms, sigma)
    names, distinct = _names(text, small, lms)
    ordered = np.argsort(names) if distinct == len(lms) else _of_names(names)
    return induce(text, small, lms[ordered], sigma)


def byte_words(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each position on, as one little-endian number; ``pad`` zero bytes follow the text."""
    padded = np.concatenate((text, np.zeros(pad + 8, np.uint8)))
    return np.ndarray((len(text) + pad,), "<u8", padded.tobytes(), strides=(1,))


def permuted_lcp(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each listed suffix, in list order: common prefix with the one before it, up to ``cap`` symbols of one byte; the first has 0.

    Computed through phi in text order (so that reads of one side run forward).
    """
    if not len(order):
        return np.zeros(0, np.int64)
    words = byte_words(text, cap)
    place = np.full(len(text), -1, order.dtype)
    place[order] = np.arange(len(order))
    back = place[place > 0].astype(np.int64)
    here, phi = order[back].astype(np.int64), order[back - 1].astype(np.int64)
    common = np.zeros(len(back), np.int64)
    open_ = np.arange(len(back))
    for offset in range(0, cap, 8):
        unequal = words[here[open_] + offset] ^ words[phi[open_] + offset]
        same = unequal == 0
        stopped = open_[~same]
        low = unequal[~same]
        low &= ~low + np.uint64(1)
        common[stopped] = offset + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        open_ = open_[same]
    common[open_] = cap
    out = np.zeros(len(order), np.int64)
    out[back] = np.minimum(common, cap)
    return out
