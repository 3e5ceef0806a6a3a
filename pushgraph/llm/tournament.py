"""A tournament tree that merges sorted runs, a page at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Key = tuple[int, int, int]
LAST: tuple = (float("inf"),)


class Page:
    """Sorted rows of a run: three key columns, least first; at is the next row."""

    def __init__(self, keys: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.keys, self.at = keys, 0

    def head(self) -> Key:
        return tuple(int(k[self.at]) for k in self.keys)

    def upto(self, bound: tuple) -> int:
        """The row after the last one below bound, found by doubling steps and halving."""
        n = len(self.keys[0])
        below = lambda i: tuple(int(k[i]) for k in self.keys) < bound
        low, step = self.at, 1
        while low + step < n and below(low + step):
            low, step = low + step, step * 2
        high = min(low + step, n)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if below(mid) else (low, mid)
        return high


class Tournament:
    """Pages compete by their heads; each inner node keeps its winner, so that a new head replays one path of the tree."""

    def __init__(self) -> None:
        self.pages: list[Page | None] = []
        self.heads: list[tuple] = []
        self.tree: list[int] = []
        self.size = 0
        self.free: list[int] = []

    def add(self, page: Page) -> None:
        if not self.free:
            grown = max(2, 2 * self.size)
            self.free = list(range(grown - 1, self.size - 1, -1))
            self.pages += [None] * (grown - self.size)
            self.heads += [LAST] * (grown - self.size)
            self.size = grown
            self.tree = [0] * grown
            for node in range(grown - 1, 0, -1):
                self._play(node)
        slot = self.free.pop()
        self.pages[slot] = page
        self._replay(slot, page.head())

    def _entrant(self, node: int) -> int:
        return node - self.size if node >= self.size else self.tree[node]

    def _play(self, node: int) -> None:
        a, b = self._entrant(2 * node), self._entrant(2 * node + 1)
        self.tree[node] = a if self.heads[a] <= self.heads[b] else b

    def _replay(self, slot: int, head: tuple) -> None:
        self.heads[slot] = head
        node = (slot + self.size) // 2
        while node:
            self._play(node)
            node //= 2

    def winner(self) -> tuple:
        """The least head of all; LAST where no page is left."""
        return self.heads[self.tree[1]] if self.size else LAST

    def _second(self, slot: int) -> tuple:
        """The least head but the winner's: it lost to the winner somewhere on its path."""
        node, least = slot + self.size, LAST
        while node > 1:
            least = min(least, self.heads[self._entrant(node ^ 1)])
            node //= 2
        return least

    def below(self, bound: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows below bound in order, in slices: of the winner, all that lies below the runner-up."""
        while self.winner() < bound:
            slot = self.tree[1]
            page = self.pages[slot]
            end = page.upto(min(bound, self._second(slot)))
            yield tuple(k[page.at : end] for k in page.keys)
            page.at = end
            if end < len(page.keys[0]):
                self._replay(slot, page.head())
            else:
                self.pages[slot] = None
                self._replay(slot, LAST)
                self.free.append(slot)
