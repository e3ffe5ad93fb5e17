"""Adaptive windowing (Bifet and Gavalda, 2007): change detection on one numeric stream.

Kept small on purpose: it is the per-entity state of the batch and streaming drift jobs.
"""

from __future__ import annotations

import math


class Adwin:
    """Exponential histogram of the recent values; ``update`` returns True when the mean changed.

    ``levels[i]`` holds [sum, squared deviation] buckets of 2**i values each, oldest first.
    """

    MAX_BUCKETS, CHECK_EVERY, MIN_SIDE, GRACE = 5, 32, 5, 10

    def __init__(self, delta: float = 0.002):
        self.delta = delta
        self.levels: list[list[tuple[float, float]]] = [[]]
        self.n, self.total, self.spread, self.ticks = 0, 0.0, 0.0, 0

    def update(self, x: float) -> bool:
        self.ticks += 1
        if self.n:
            self.spread += self.n * (x - self.total / self.n) ** 2 / (self.n + 1)
        self.n += 1
        self.total += x
        self.levels[0].append((x, 0.0))
        self._compress()
        if self.ticks % self.CHECK_EVERY or self.n <= self.GRACE:
            return False
        changed = False
        while self._cut_somewhere():
            changed = True
            self._drop_oldest()
        return changed

    def _compress(self) -> None:
        i = 0
        while len(self.levels[i]) > self.MAX_BUCKETS:
            (s1, v1), (s2, v2) = self.levels[i][:2]
            del self.levels[i][:2]
            size = 2 ** i
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append((s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 * size)))
            i += 1

    def _cut_somewhere(self) -> bool:
        if self.n <= self.GRACE:
            return False
        n0, s0 = 0, 0.0
        log_term = math.log(2 * math.log(self.n) / self.delta)
        variance = self.spread / self.n
        for i in range(len(self.levels) - 1, -1, -1):
            for s, _ in self.levels[i]:
                n0 += 2 ** i
                s0 += s
                n1 = self.n - n0
                if n1 < self.MIN_SIDE:
                    return False
                if n0 < self.MIN_SIDE:
                    continue
                m = 1 / (n0 - self.MIN_SIDE + 1) + 1 / (n1 - self.MIN_SIDE + 1)
                bound = math.sqrt(2 * m * variance * log_term) + 2 / 3 * log_term * m
                if abs(s0 / n0 - (self.total - s0) / n1) > bound:
                    return True
        return False

    def _drop_oldest(self) -> None:
        top = len(self.levels) - 1
        s, v = self.levels[top].pop(0)
        size = 2 ** top
        self.n -= size
        self.total -= s
        if self.n:
            gap = s / size - self.total / self.n
            self.spread = max(0.0, self.spread - v - size * self.n * gap * gap / (size + self.n))
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()
