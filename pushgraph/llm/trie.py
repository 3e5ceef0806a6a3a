"""A path-compressed trie of ordered token sets, and the Jaccard links it finds."""

from __future__ import annotations

import numpy as np


class Node:
    __slots__ = ("edge", "ends", "kids", "labels", "long", "most", "refresh", "short")

    def __init__(self, edge: np.ndarray) -> None:
        self.edge = edge  # token ranks on the way into this node
        self.kids: dict[int, Node] = {}
        self.ends: list[int] = []  # sets that end here
        self.long = self.short = 0  # largest and smallest set below
        self.most = 0  # most tokens below this node's edge
        self.labels: set[int] = set()  # components below, as they were
        self.refresh = 8


class SetTrie:
    """Sets whose tokens are ranked by one order, most frequent first, so that near copies share paths.

    A probe walks the trie with the overlap that all sets below a node share. A subtree is left when
    what remains of the probe or of the subtree can't bring the overlap to the least that any
    set below needs, when no size below is near enough, or when everything below is already in the
    probe's component.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, width: int) -> None:
        self.sets, self.sizes = sets, sizes
        self.root = Node(np.zeros(0, np.int64))
        self.parent = list(range(len(sets)))
        self.mark = np.zeros(width, bool)
        self.visits = 0

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def insert(self, i: int) -> None:
        tokens, size, label = self.sets[i], int(self.sizes[i]), self.find(i)
        node, at = self.root, 0
        while True:
            node.labels.add(label)
            if len(node.labels) > node.refresh:
                node.labels = {self.find(x) for x in node.labels}
                node.refresh = 2 * len(node.labels) + 8
            node.long = max(node.long, size)
            node.short = min(node.short or size, size)
            node.most = max(node.most, len(tokens) - at)
            if at == len(tokens):
                node.ends.append(i)
                return
            kid = node.kids.get(int(tokens[at]))
            if kid is None:
                kid = Node(tokens[at:])
                kid.long = kid.short = size
                kid.labels.add(label)
                kid.ends.append(i)
                node.kids[int(tokens[at])] = kid
                return
            n = min(len(kid.edge), len(tokens) - at)
            same = kid.edge[:n] == tokens[at : at + n]
            shared = n if same.all() else int(np.argmin(same))
            if shared < len(kid.edge):
                upper = Node(kid.edge[:shared])
                upper.long, upper.short, upper.labels = kid.long, kid.short, set(kid.labels)
                upper.most = kid.most + len(kid.edge) - shared
                kid.edge = kid.edge[shared:]
                upper.kids[int(kid.edge[0])] = kid
                node.kids[int(tokens[at])] = upper
                kid = upper
            node, at = kid, at + shared

    def links(self, i: int) -> list[tuple[int, int]]:
        """Joins set i with every component that one of its sets links to; the links used."""
        tokens, size, out = self.sets[i], int(self.sizes[i]), []
        self.mark[tokens] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            self.visits += 1
            if len(node.labels) <= 8:
                node.labels = {self.find(x) for x in node.labels}
                if node.labels == {self.find(i)}:
                    continue
            if 5 * node.long < 4 * size or 4 * node.short > 5 * size:
                continue
            edge = node.edge
            at = 0
            if len(edge):
                overlap += int(np.count_nonzero(self.mark[edge]))
                at = int(np.searchsorted(tokens, edge[-1], "right"))
            # 100 * overlap >= 80 * (size + other - overlap)
            if 9 * (overlap + min(len(tokens) - at, node.most)) < 4 * (size + max(node.short, -(-4 * size // 5))):
                continue
            for j in node.ends:
                if 9 * overlap >= 4 * (size + int(self.sizes[j])) and self.join(i, j):
                    out.append((i, j))
            if node.kids:
                nearest = node.kids.get(int(tokens[at])) if at < len(tokens) else None
                stack.extend((k, overlap) for k in node.kids.values() if k is not nearest)
                if nearest is not None:
                    stack.append((nearest, overlap))
        self.mark[tokens] = False
        return out


def spanning_links(ids: list[int], tokens: list[np.ndarray], labels: list[int] | None = None, probes: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (Jaccard of 0.8 or more) that span the components of the sorted sets, as pairs of ids.

    labels: sets with equal labels are known to be in one component. probes: only pairs with such
    a set are looked for; by default all. Tokens held by one set alone count in its size only.
    """
    sizes = np.array([len(t) for t in tokens], np.int64)
    if len(ids) < 2 or not sizes.sum():
        return []
    together = np.concatenate(tokens)
    together.sort()
    again = together[1:][together[1:] == together[:-1]]
    shared = again[np.flatnonzero(np.concatenate(([True], again[1:] != again[:-1])))] if len(again) else again
    counts = np.searchsorted(together, shared, "right") - np.searchsorted(together, shared, "left")
    del together, again
    width = len(shared)
    rank = np.empty(width, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(width)
    sets = []
    for t in tokens:
        at = np.searchsorted(shared, t)
        at = at[at < width] if width else at[:0]
        held = shared[at] == t[: len(at)]  # t is sorted, so places past the end are at its end
        sets.append(np.sort(rank[at[held]]))
    trie = SetTrie(sets, sizes, max(width, 1))
    if labels is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            trie.join(i, first.setdefault(x, i))
    todo = sorted(range(len(ids)), key=lambda i: (probes is not None and probes[i], int(sizes[i]), ids[i]))
    found = []
    for i in todo:
        if probes is None or probes[i]:
            found += trie.links(i)
        trie.insert(i)
    return [(ids[a], ids[b]) for a, b in found]
