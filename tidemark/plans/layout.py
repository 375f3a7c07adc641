"""Window layouts: how a stream of N elements is cut into time-decayed windows.

A decay is a sequence of non-decreasing target lengths, the first for the newest
elements.  The element with count c has age N - c (the newest 1).  Neighbouring
windows merge as soon as both lie within one target window, so a layout depends
on counts alone, whatever the data, and can go on from the windows of before.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count
from math import ceil


class Decay:
    """Target windows of a sequence of lengths, extended as far as they are asked for."""

    def __init__(self, lengths: Callable[[], Iterator[int]], largest: int | None = None):
        self._source, self.largest = lengths(), largest
        self.lengths, self.starts, self._next = [], [], 1

    def _extend(self) -> None:
        n = next(self._source)
        self.lengths.append(n)
        self.starts.append(self._next)
        self._next += n

    def first_window(self) -> int:
        if not self.lengths:
            self._extend()
        return self.lengths[0]

    def covering(self, total: int) -> list[int]:
        """The longest run of first lengths whose sum is at most total."""
        while self._next - 1 <= total:
            self._extend()
        k = bisect_right(self.starts, total + 1) - 1
        return self.lengths[:k]

    def first_containing(self, left: int, right: int, now: int) -> int:
        """The first count, now or later, at which elements left..right lie in one target window; -1: never."""
        size, age = right - left + 1, now - right
        if self.largest is not None and size > self.largest:
            return -1
        while self._next <= age or self.lengths[-1] < size:
            self._extend()
        k = bisect_right(self.starts, age) - 1
        if now - left < self.starts[k] + self.lengths[k]:
            return now
        while len(self.lengths) <= k + 1:
            self._extend()
        return self.starts[max(k + 1, bisect_left(self.lengths, size))] + right


def exponential(base: float) -> Decay:
    return Decay(lambda: (ceil(base**k) for k in count()))


def rational_power(p: int, q: int, r: int = 1, s: int = 1) -> Decay:
    """R k^(p-1) windows of S k^q elements, for k = 1, 2, ..."""
    return Decay(lambda: (s * k**q for k in count(1) for _ in range(r * k ** (p - 1))), s if q == 0 else None)


#: Decays by names of the user's own: a function without arguments that gives the lengths, oldest last, without end.
CUSTOM: dict[str, Callable[[], Iterator[int]]] = {}


def register_decay(name: str, lengths: Callable[[], Iterator[int]]) -> None:
    """Makes a decay known by a name, in this process and in the jobs that it starts from now on."""
    CUSTOM[name] = lengths


def parse_decay(spec: str, custom: dict | None = None) -> Decay:
    """exponentialB, rationalPowerP,Q[,R,S] or a registered name"""
    if spec in (known := CUSTOM if custom is None else custom):
        return Decay(known[spec])
    if m := re.fullmatch(r"exponential([\d.]+)", spec):
        return exponential(float(m[1]))
    if m := re.fullmatch(r"rationalPower(\d+),(\d+)(?:,(\d+),(\d+))?", spec):
        return rational_power(*(int(x) for x in m.groups() if x))
    raise ValueError(f"unknown decay: {spec}")


class Merger:
    """Windows in order, merged as the stream grows."""

    def __init__(self, decay: Decay):
        self.decay, self.n = decay, 0
        self.ends: dict[int, int] = {}  # first count -> last count
        self.after: dict[int, int] = {}
        self.before: dict[int, int] = {}
        self.heap: list[tuple[int, int, int, int]] = []
        self.last: int | None = None

    @classmethod
    def resume(cls, decay: Decay, n: int, windows: list[tuple[int, int]]) -> Merger:
        """The merger after n elements that gave these windows."""
        m = cls(decay)
        m.n = n
        ordered = sorted(windows)
        m.ends = dict(ordered)
        for (a, _), (b, _) in zip(ordered, ordered[1:]):
            m.after[a], m.before[b] = b, a
        m.last = ordered[-1][0] if ordered else None
        for a, _ in ordered[:-1]:
            m._plan(a)
        return m

    def _plan(self, a: int) -> None:
        b = self.after.get(a)
        if b is not None and (at := self.decay.first_containing(a, self.ends[b], self.n)) >= 0:
            heapq.heappush(self.heap, (at, a, b, self.ends[b]))

    def append(self, size: int = 1) -> None:
        cs = self.n
        self.n += size
        self.ends[cs] = self.n - 1
        if self.last is not None:
            self.after[self.last], self.before[cs] = cs, self.last
        before, self.last = self.last, cs
        if before is not None:
            self._plan(before)
        while self.heap and self.heap[0][0] <= self.n:
            _, a, b, end = heapq.heappop(self.heap)
            if self.after.get(a) != b or self.ends.get(b) != end:
                continue  # one of the two has merged meanwhile
            self.ends[a] = self.ends.pop(b)
            nxt = self.after.pop(b, None)
            self.before.pop(b, None)
            if nxt is None:
                self.after.pop(a, None)
                self.last = a
            else:
                self.after[a], self.before[nxt] = nxt, a
            if (prev := self.before.get(a)) is not None:
                self._plan(prev)
            self._plan(a)

    def windows(self) -> list[tuple[int, int]]:
        return sorted(self.ends.items())


def settled(decay: Decay, n: int) -> list[tuple[int, int]] | None:
    """What Merger makes of n single elements, without a step for each of them; None where lengths of the decay decrease.

    Merges within one target window come before those of the same windows in an older
    one, so target windows are taken in order, the newest first: each joins, from the
    oldest element on, what lies at its age or beyond and fits its length.  Windows are
    kept as runs of equal sizes; what is too new for one target window is too new for
    all older ones and is done.
    """
    head, done, total, level, before = [[1, n]] if n else [], [], n, 0, 0
    while head:
        while level >= len(decay.lengths):
            decay._extend()
        length, reach = decay.lengths[level], n - decay.starts[level] + 1  # elements old enough
        if length < before:
            return None
        while head and total > reach:
            size, k = head[-1]
            out = min(k, -(-(total - reach) // size))
            done.append((size, out))
            total -= out * size
            head[-1][1] -= out
            if not head[-1][1]:
                head.pop()
        if length > before and (len(head) > 1 or (head and 2 * head[0][0] <= length)):
            head = _packed(head, length)
        if length == decay.largest:
            break
        before, level = length, level + 1
    at, out = 0, []
    for size, k in (*head, *reversed(done)):
        for _ in range(k):
            out.append((at, at + size - 1))
            at += size
    return out


def _packed(runs: list[list[int]], length: int) -> list[list[int]]:
    """Runs [size, number] of neighbouring windows, joined from the first on as long as they fit."""
    out, cur = [], 0  # cur: the size of the window that the next ones may join

    def put(size: int, k: int) -> None:
        if k and out and out[-1][0] == size:
            out[-1][1] += k
        elif k:
            out.append([size, k])

    for size, k in runs:
        if cur and cur + size <= length:
            more = min(k, (length - cur) // size)
            cur, k = cur + more * size, k - more
        if not k:
            continue
        put(cur, 1 if cur else 0)
        group = max(length // size, 1)
        rest = k % group or group
        put(group * size, (k - rest) // group)
        cur = rest * size
    put(cur, 1 if cur else 0)
    return out


def pieces(decay: Decay, total: int, buffer: int = 0) -> Iterator[int]:
    """Sizes in which windows reach the merger: single elements, or full buffers cut at the target lengths, oldest the longest."""
    full = decay.covering(buffer)[::-1] if buffer else []
    while full and total >= sum(full):
        yield from full
        total -= sum(full)
    if full:
        rest = decay.covering(total)[::-1]
        yield from rest
        total -= sum(rest)
    yield from (1 for _ in range(total))


def buffer_size(decay: Decay, total: int, buffers: int = 2) -> int:
    """One of several buffers that share a total, rounded down to whole target windows."""
    return sum(decay.covering(total // buffers))


@lru_cache(maxsize=256)
def layout(spec: str, n: int, buffer: int = 0) -> tuple[tuple[int, int], ...]:
    """(cs, ce) of each window of a stream of n elements."""
    decay = parse_decay(spec)
    merger = Merger(decay)
    for size in pieces(decay, n, buffer):
        merger.append(size)
    return tuple(merger.windows())
