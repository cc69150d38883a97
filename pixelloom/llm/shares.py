"""Deficit round-robin over any number of queues, in closed form.

Queues give tokens to one line in proportion to their weights. A queue that runs dry
leaves its share to the others, in proportion again; queues without a weight come
last, in proportion to what they hold. The queues are leaves of a binary tree. At a
node, the left side has given among the node's first v tokens what the proportions ask
for, rounded. That grows by nought or one with v, so it can be inverted, and a queue's
place in the line, or its part of any stretch, is a walk along its path. What rounding
leaves over or short at one token is made up at a later one: nothing is passed on from
stretch to stretch, and no stretch needs the one before.

A queue is short or over by half a token for each split above it, less what the splits
between divide: each takes a half of its node's weight, as near as the queues allow,
so the sum stays under two tokens, however many queues there are.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate, groupby


class Split:
    """Two sides on one line. A segment (end, A, B, a, b) ends at a place where a queue runs dry:
    up to there, dry queues have given A tokens, a of them on the left, and the others give
    in proportion to their weights, B in all, b on the left."""

    __slots__ = ("ends", "segments", "upto")

    def __init__(self, segments: list[tuple[int, int, int, int, int]]):
        self.ends = [s[0] for s in segments]
        self.segments = [s[1:] for s in segments]
        left = [self.left(e) for e in self.ends]
        self.upto = (left, [e - x for e, x in zip(self.ends, left, strict=True)])

    def left(self, v: int) -> int:
        """Tokens of the left side among the first v."""
        dry, weight, dry_left, weight_left = self.segments[bisect_left(self.ends, v)]
        return dry_left + (2 * weight_left * (v - dry) + weight) // (2 * weight)

    def counter(self) -> Callable[[int], int]:
        """``left``, without the search where nothing runs dry before the end."""
        if len(self.ends) > 1:
            return self.left
        _, weight, _, weight_left = self.segments[0]
        return lambda v: (2 * weight_left * v + weight) // (2 * weight)

    def position(self, side: int, y: int) -> int:
        """Where the y-th token of a side stands on the line (0: left, 1: right)."""
        k = bisect_left(self.upto[side], y + 1)
        dry, weight, dry_left, weight_left = self.segments[k]
        first = self.ends[k - 1] + 1 if k else 1
        if side and weight > weight_left:
            first = max(first, dry + weight * (2 * (y + 1 - dry + dry_left) - 1) // (2 * (weight - weight_left)) + 1)
        elif not side and weight_left:
            first = max(first, dry - (weight - 2 * weight * (y + 1 - dry_left)) // (2 * weight_left))
        return first - 1  # a side without weight here has its last token where the segment begins


Path = tuple[tuple[Split, int], ...]


@lru_cache(4096)
def even(left: int, right: int) -> Split:
    """Two sides of that many tokens, which run dry together."""
    return Split([(left + right, 0, left + right, 0, left)])


def _tree(leaves: list[tuple[int, int, int]]) -> dict[int, Path]:
    """The path of each of ``leaves`` (queue, tokens, weight), all positive."""
    leaves = sorted(leaves, key=lambda x: -x[2])
    upto = [0, *accumulate(w for _, _, w in leaves)]
    dry = [Fraction(n, w) for _, n, w in leaves]
    paths, todo = {}, [(0, len(leaves), sorted(range(len(leaves)), key=dry.__getitem__), ())]
    while todo:
        lo, hi, members, path = todo.pop()
        if hi - lo == 1:
            paths[leaves[lo][0]] = path
            continue
        half = (upto[lo] + upto[hi]) / 2
        mid = min(max(bisect_left(upto, half), lo + 1), hi - 1)
        if mid > lo + 1 and half - upto[mid - 1] < upto[mid] - half:
            mid -= 1
        segments, gone, weight, gone_left, weight_left = [], 0, upto[hi] - upto[lo], 0, upto[mid] - upto[lo]
        for time, group in groupby(members, key=dry.__getitem__):
            segments.append((gone + weight * time.numerator // time.denominator, gone, weight, gone_left, weight_left))
            for q in group:
                _, n, w = leaves[q]
                gone, weight = gone + n, weight - w
                if q < mid:
                    gone_left, weight_left = gone_left + n, weight_left - w
        split = Split(segments)
        todo.append((lo, mid, [q for q in members if q < mid], (*path, (split, 0))))
        todo.append((mid, hi, [q for q in members if q >= mid], (*path, (split, 1))))
    return paths


def schedule(totals: list[int], weights: list[float]) -> list[Path | None]:
    """The path of every queue; one that is empty has none. A weight that is no finite
    number over nought is none."""
    wanted = [w if math.isfinite(w) and w > 0 and n else 0.0 for n, w in zip(totals, weights, strict=True)]
    most = max(wanted, default=0.0)
    first = [(q, n, max(1, round(w / most * (1 << 53)))) for q, (n, w) in enumerate(zip(totals, wanted, strict=True)) if w]
    last = [(q, n, n) for q, (n, w) in enumerate(zip(totals, wanted, strict=True)) if n and not w]
    paths = _tree(first) if first else {}
    late = _tree(last) if last else {}
    if first and last:
        before, total = sum(x[1] for x in first), sum(totals)
        turn = Split([(before, 0, 1, 0, 1), (total, before, 1, before, 0)])
        paths, late = {q: ((turn, 0), *p) for q, p in paths.items()}, {q: ((turn, 1), *p) for q, p in late.items()}
    paths |= late
    return [paths.get(q) for q in range(len(totals))]


def own_shares(totals: list[int]) -> list[Path | None]:
    """As ``schedule``, every queue weighing what it holds."""
    paths = _tree([(q, n, n) for q, n in enumerate(totals) if n]) if any(totals) else {}
    return [paths.get(q) for q in range(len(totals))]


class Queue:
    """One queue's part of a line of ``total`` tokens in windows. Within a window, tokens
    stand queue by queue."""

    def __init__(self, path: Path, total: int, window: int):
        self.path, self.total, self.window = path, total, window
        self.lefts = [(split.counter(), side) for split, side in path]
        self.start = self.first = self.end = 0  # of the window looked at last
        self.upto, self.marks = 0, [0] * len(path)  # its end, and what the left sides have given by then

    def _next(self) -> None:
        """Goes on by a window."""
        start, marks, before = self.upto, self.marks, 0
        self.upto = hi = min(start + self.window, self.total)
        for k, (left, side) in enumerate(self.lefts):
            given = left(hi)
            if side:
                before += given - marks[k]
                hi -= given
            else:
                hi = given
            marks[k] = given
        self.start, self.first, self.end = start + before, self.end, hi

    def _look(self, x: int) -> None:
        """Goes to the window that holds the queue's token x: the next one, or where its place says."""
        if x == self.end and self.upto < self.total:
            self._next()
            if x < self.end:
                return
        v = x
        for split, side in reversed(self.path):
            v = split.position(side, v)
        self.upto = at = v - v % self.window
        for k, (left, side) in enumerate(self.lefts):
            self.marks[k] = given = left(at)
            at = at - given if side else given
        self.end = at
        self._next()

    def pieces(self, x: int, n: int) -> Iterator[tuple[int, int]]:
        """(position, length) of the queue's tokens x .. x+n, cut at windows."""
        while n:
            if not self.first <= x < self.end:
                self._look(x)
            take = min(n, self.end - x)
            yield self.start + x - self.first, take
            x, n = x + take, n - take
