"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

#: Bytes that are packed into one sort key: 9 bits each, so that the end of a string sorts before every byte.
PACKED = 7
#: So many packed keys are compared for all pairs at once; the few pairs that are alike for longer go one by one.
STEPS_TOGETHER = 128


class Strings:
    """Strings, one after another, each with an end of its own that is unlike all others."""

    def __init__(self, parts: list[bytes]):
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        n = len(self.text)
        if n >= 1 << 30:
            raise ValueError("places and their sums are 32-bit numbers: make the shards smaller")
        sizes = np.array([len(p) for p in parts], np.int32)
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        self.end = np.repeat(begins + sizes, sizes)
        self.begins = np.zeros(n, bool)
        self.begins[begins[sizes > 0]] = True
        left = self.end - np.arange(n, dtype=np.int32)
        padded = np.zeros(n + PACKED, np.int64)
        padded[:n] = self.text
        padded[:n] += 1
        self.packed = np.zeros(n, np.int64)
        for k in range(PACKED):
            self.packed <<= 9
            self.packed |= padded[k : k + n]
        # nothing of the next string: only the last places of a string see it
        last = np.flatnonzero(left < PACKED)
        beyond = 9 * (PACKED - left[last].astype(np.int64))
        self.packed[last] = self.packed[last] >> beyond << beyond


def suffix_array(s: Strings) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the rank of each.

    Suffixes sorted by their first h bytes are in groups; a group's rank is the
    place where it begins. Sorting the groups by the rank of the suffix h bytes
    further on doubles h. Groups of one are done and not touched again.
    """
    place = np.int32
    sa = np.argsort(s.packed).astype(place)
    n = len(sa)
    first = np.ones(n, bool)
    sorted_ = s.packed[sa]
    first[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n, place)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=place), place(0)))
    open_ = np.flatnonzero(~(first & np.append(first[1:], True))).astype(place)
    h = PACKED
    while len(open_):
        p = sa[open_]
        after = p + place(h)
        # group and rank in one number; a string that has ended comes first, each end for itself
        then = np.where(after < s.end[p], rank[np.minimum(after, n - 1)] + place(n), p)
        key = rank[p].astype(np.int64) * (2 * n) + then
        order = np.argsort(key)
        p, key = p[order], key[order]
        sa[open_] = p
        new = np.ones(len(p), bool)
        new[1:] = key[1:] != key[:-1]
        rank[p] = np.maximum.accumulate(np.where(new, open_, place(0)))
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, rank


def common_prefixes(s: Strings, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``out[r]``: length of the common prefix of the suffixes of rank ``r - 1`` and ``r``; 0 at either end.

    Kasai's observation, for all places at once: where the bytes before two
    neighbouring suffixes are equal, those longer suffixes are neighbours too,
    and the common prefix is one shorter than theirs. So bytes are compared only
    where they differ, and the lengths in between count down from there.
    """
    n = len(sa)
    out = np.zeros(n + 1, np.int32)
    here = np.arange(n, dtype=np.int32)
    other = sa[rank - 1]  # the suffix of rank 0 has none; its length stays 0
    compared = (rank == 0) | s.begins | s.begins[other] | (s.text[here - 1] != s.text[other - 1])
    a = np.flatnonzero(compared).astype(np.int32)
    b = other[a]
    most = np.minimum(s.end[a] - a, s.end[b] - b)
    most[rank[a] == 0] = 0
    length = np.zeros(len(a), np.int32)
    go = np.flatnonzero(length < most)
    for _ in range(STEPS_TOGETHER):
        differ = s.packed[a[go] + length[go]] ^ s.packed[b[go] + length[go]]
        same = sum((differ >> 9 * (PACKED - k) == 0).astype(np.int32) for k in range(1, PACKED + 1))
        length[go] = np.minimum(length[go] + same, most[go])
        go = go[(same == PACKED) & (length[go] < most[go])]
    for k in go.tolist():
        length[k] += _equal_bytes(s.text, int(a[k] + length[k]), int(b[k] + length[k]), int(most[k] - length[k]))
    at = np.cumsum(compared) - 1
    out[rank] = length[at] - (here - a[at])
    return out


def _equal_bytes(text: np.ndarray, a: int, b: int, most: int) -> int:
    """Length of the common prefix from two places on, in pieces that double."""
    done, piece = 0, 1 << 12
    while done < most:
        n = min(piece, most - done)
        differ = text[a + done : a + done + n] != text[b + done : b + done + n]
        if differ.any():
            return done + int(differ.argmax())
        done, piece = done + n, piece * 2
    return most


def repeated_starts(parts: list[bytes], size: int) -> np.ndarray:
    """For every byte of the joined parts, whether the ``size`` bytes from there on also start elsewhere in the parts."""
    s = Strings(parts)
    if not len(s.text):
        return np.zeros(0, bool)
    sa, rank = suffix_array(s)
    lcp = common_prefixes(s, sa, rank)
    return np.maximum(lcp[rank], lcp[rank + 1]) >= size
