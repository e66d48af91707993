"""External induced sorting of suffixes, in numpy batches.

A batch queue takes tuples (symbol, rank of the suffix that follows) and gives them back in order. Beyond a number of tuples it writes sorted runs to files of the task's own that have no name, so they go when the task ends, however it ends; nobody else reads them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Numbers that an array or a queue holds in memory; larger ones are on disk.
HELD = 1 << 22


def numbers(n: int, held: int = HELD, kind=np.int64) -> np.ndarray:
    """An array of n numbers, on disk if they are more than held."""
    if n <= held:
        return np.empty(n, kind)
    file = tempfile.TemporaryFile()
    file.truncate(n * np.dtype(kind).itemsize)
    return np.memmap(file, kind, "r+", shape=(n,))


class Queue:
    """A priority queue for batches of (key, position): push any, then drain in order of key."""

    def __init__(self, held: int = HELD):
        self.held, self.batches, self.size, self.runs = held, [], 0, []

    def push(self, keys: np.ndarray, at: np.ndarray) -> None:
        self.batches.append((keys, at))
        self.size += len(keys)
        if self.size > self.held:
            self._spill()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = (np.concatenate(x) for x in zip(*self.batches, strict=True)) if len(self.batches) > 1 else self.batches[0]
        order = np.argsort(keys, kind="stable")
        self.batches, self.size = [], 0
        return keys[order], at[order]

    def _spill(self) -> None:
        run = []
        for values in self._sorted():
            kept = numbers(len(values), 0, values.dtype)
            kept[:] = values
            run.append(kept)
        self.runs.append(run)

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted batches; equal keys may be split over batches."""
        if not self.runs:
            if self.batches:
                yield self._sorted()
            return
        if self.batches:
            self._spill()
        step = max(1, self.held // len(self.runs))
        at = [0] * len(self.runs)
        while any(a < len(keys) for a, (keys, _) in zip(at, self.runs, strict=True)):
            # All that is at most the least of the runs' last keys within a step.
            bound = min(keys[min(a + step, len(keys)) - 1] for a, (keys, _) in zip(at, self.runs, strict=True) if a < len(keys))
            parts = []
            for i, (keys, places) in enumerate(self.runs):
                to = at[i] + int(np.searchsorted(keys[at[i] : at[i] + step], bound, "right"))
                parts.append((np.array(keys[at[i] : to]), np.array(places[at[i] : to])))
                at[i] = to
            keys, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            yield keys[order], places[order]


def _ordered(keys: np.ndarray, held: int) -> np.ndarray:
    """The places of keys in their order."""
    if len(keys) <= held:
        return np.argsort(keys)
    out, n, queue = numbers(len(keys), held), 0, Queue(held)
    for a in range(0, len(keys), held):
        queue.push(np.asarray(keys[a : a + held]), np.arange(a, min(a + held, len(keys))))
    for _, at in queue.drain():
        out[n : n + len(at)] = at
        n += len(at)
    return out


def _refine(rank: np.ndarray, active: np.ndarray, second: np.ndarray, held: int) -> np.ndarray:
    """Splits groups of equal rank by second, in place, for all members of such groups, active; returns those still in a group of two or more. A rank is the number of smaller ones."""
    if not len(active):
        return active
    own = rank[active]
    bits = int(second.max()).bit_length()
    places = (len(active) - 1).bit_length()
    if len(active) <= held and int(own.max()).bit_length() + bits + places <= 63:
        # Key and place in one number: plain sorting is much faster than sorting places.
        packed = np.sort((own << np.int64(bits + places)) | (second << np.int64(places)) | np.arange(len(active)))
        order, key = packed & np.int64((1 << places) - 1), packed >> np.int64(places)
        own = key >> np.int64(bits)
    else:
        key = own * np.int64(int(second.max()) + 1) + second
        order = _ordered(key, held)
        key, own = key[order], own[order]
    place = np.arange(len(order))
    new, group = np.ones(len(order) + 1, bool), np.ones(len(order), bool)
    new[1:-1] = key[1:] != key[:-1]
    group[1:] = own[1:] != own[:-1]
    moved = active[order]
    rank[moved] = own + np.maximum.accumulate(np.where(new[:-1], place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
    return moved[~(new[:-1] & new[1:])]


def _induced(first: np.ndarray, follow: np.ndarray, held: int) -> np.ndarray:
    """Ranks of suffixes by (own key, rank of the one that follows); follow gives the place of the next one, its own where first decides.

    The queue takes tuples (rank, rank of what follows) of those not yet told apart. Each round pairs what is ranked by 2 ** k symbols with what follows them, so there are as many rounds as the longest run has binary digits.
    """
    rank = numbers(len(first), held)
    rank[:] = 0
    active = _refine(rank, np.arange(len(first)), first, held)
    while len(active):
        active = _refine(rank, active, rank[follow[active]], held)
        follow = follow[follow]
    return rank


def suffix_ranks(t: np.ndarray, held: int = HELD) -> np.ndarray:
    """The rank of each suffix of t, whole numbers from 0 up, the last of which is the only 0.

    Suffixes are of type S (smaller than the next one) or L. The leftmost of each run of type S are sorted first, by the names of the substrings between them: a smaller problem of the same kind, solved by recursion if names repeat. They induce the order of the suffixes of type L before them, and these that of all of type S.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(t))
    known = np.flatnonzero(step)
    small = np.ones(n, bool)
    small[:-1] = step[known[np.searchsorted(known, np.arange(n - 1))]] > 0  # the last step is down to 0
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    symbol = 2 * t.astype(np.int64) + small
    length = np.diff(np.append(leftmost, n - 1)) + 1
    # Names, refined symbol by symbol. Types tell a substring that ends from one that goes on, so those of one name end together.
    order = numbers(len(leftmost), held)
    order[:] = 0
    active, k = _refine(order, np.arange(len(leftmost)), symbol[leftmost], held), 1
    repeat = False
    while len(active):
        going = length[active] > k
        repeat |= not going.all()
        active = active[going]
        active = _refine(order, active, symbol[leftmost[active] + k], held)
        k += 1
    if repeat:
        order = suffix_ranks(np.where(np.arange(len(leftmost)) == len(leftmost) - 1, 0, order + 1), held)
    # Type L from the leftmost S.
    large = np.flatnonzero(~small)
    nodes = np.sort(np.concatenate([large, leftmost]))
    where = numbers(n, held)
    where[nodes] = np.arange(len(nodes))
    star = np.zeros(n, bool)
    star[leftmost] = True
    key = symbol[nodes] * np.int64(len(leftmost) + 1)
    key[where[leftmost]] += order + 1
    by_large = _induced(key, where[np.minimum(nodes + ~star[nodes], n - 1)], held)
    # All of type S from type L; the last one stands by itself.
    key = symbol * np.int64(len(nodes) + 1)
    key[large] += by_large[where[large]] + 1
    follow = np.arange(n) + small
    follow[n - 1] = n - 1
    return _induced(key, follow, held)


def _eights(t: np.ndarray, held: int) -> np.ndarray:
    """Eight symbols (less than 512 each) from each place on, hashed without loss of what differs in bytes: separators stay out of what is compared."""
    out = numbers(len(t), held, np.uint64)
    out[:] = 0
    for k in range(min(8, len(t))):
        out[: len(t) - k] |= (t[k:] & 0xFF).astype(np.uint64) << np.uint64(8 * k)
    return out


def repeated(texts: list[bytes], length: int, held: int = HELD) -> list[np.ndarray]:
    """For each text, whether the string of length bytes that starts at each byte (and ends within the text) starts anywhere else, in this text or another."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = numbers(int(starts[-1]), held)
    for x, a in zip(texts, starts, strict=False):
        t[a : a + len(x)] = np.frombuffer(x, np.uint8)
        t[a : a + len(x)] += 2
        t[a + len(x)] = 1
    if len(t):
        t[-1] = 0
    valid = np.zeros(len(t), bool)
    for x, a in zip(texts, starts, strict=False):
        valid[a : a + max(0, len(x) - length + 1)] = True
    places = np.flatnonzero(valid)
    found = np.zeros(len(t), bool)
    if len(places):
        # Suffixes that share length bytes are neighbours, with only such between them: strings that can't be full never lie between.
        rank = suffix_ranks(t, held)
        order = places[np.argsort(rank[places])]
        same = np.zeros(len(order) + 1, bool)
        pair = np.arange(1, len(order))
        eight = _eights(t, held)
        for k in [*range(0, length - 7, 8), *([length - 8] if length > 8 else [])]:
            pair = pair[eight[order[pair] + k] == eight[order[pair - 1] + k]]
        for k in range(length if length < 8 else 0):
            pair = pair[t[order[pair] + k] == t[order[pair - 1] + k]]
        same[pair] = True
        found[order[same[:-1] | same[1:]]] = True
    return [found[a : a + max(0, len(x) - length + 1)] for x, a in zip(texts, starts, strict=False)]
