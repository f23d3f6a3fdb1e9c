"""Signature trees over token sets, and the dual traversal that joins two of them."""

from __future__ import annotations

import numpy as np

LEAF = 8


class Linked:
    """Union-find over the sets of one task; the root is the smallest index."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


class Sets:
    """Sorted token arrays with true sizes.

    ``sizes`` may exceed the stored length: tokens known to be in no other set
    need not be stored.
    """

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray) -> None:
        self.tokens, self.sizes = tokens, np.asarray(sizes, np.int64)
        widest = max((len(x) for x in tokens), default=1)
        bits = 256
        while bits < 4 * widest and bits < 1 << 14:
            bits *= 2
        self.maps = np.zeros((len(tokens), bits // 64), np.uint64)
        for row, x in zip(self.maps, tokens, strict=True):
            spot = (x >> np.uint64(7)) % np.uint64(bits)
            np.bitwise_or.at(row, (spot >> np.uint64(6)).astype(np.intp), np.uint64(1) << (spot & np.uint64(63)))
        #: Tokens of a set beyond one per bit of its bitmap.
        self.excess = np.array([len(x) for x in tokens], np.int64) - np.bitwise_count(self.maps).sum(1, dtype=np.int64)


class Node:
    """Member indices, OR of their bitmaps, range of sizes, largest excess, and the one class they are known to share."""

    __slots__ = ("excess", "kids", "least", "map", "members", "most", "one")

    def __init__(self, sets: Sets, members: np.ndarray, kids: list[Node]) -> None:
        self.members, self.kids = members, kids
        self.map = np.bitwise_or.reduce([k.map for k in kids] if kids else sets.maps[members], axis=0)
        sizes = sets.sizes[members]
        self.least, self.most, self.excess = int(sizes.min()), int(sizes.max()), int(sets.excess[members].max())
        self.one = False


def build(sets: Sets, members: np.ndarray) -> Node:
    """Sets alike in smallest tokens and size come to lie in one leaf; each level above joins LEAF nodes."""
    first = np.array([[int(x[0]) if len(x) else 0, int(x[len(x) // 2]) if len(x) else 0] for x in (sets.tokens[i] for i in members)], np.uint64)
    members = members[np.lexsort((members, sets.sizes[members], first[:, 1], first[:, 0]))]
    level = [Node(sets, members[i : i + LEAF], []) for i in range(0, len(members), LEAF)]
    while len(level) > 1:
        level = [Node(sets, np.concatenate([k.members for k in level[i : i + LEAF]]), level[i : i + LEAF]) for i in range(0, len(level), LEAF)]
    return level[0]


class Join:
    """Links of sets with ``den * |x & y| >= num * |x | y|``.

    Only links that merge two classes are checked and kept: two sets that are
    already in one class by earlier links are not compared, so a group of n
    near copies costs about n checks and not n squared.
    """

    def __init__(self, sets: Sets, linked: Linked, num: int, den: int) -> None:
        self.sets, self.linked, self.num, self.den = sets, linked, num, den
        self.found: list[tuple[int, int]] = []

    def needed(self, a, b):
        """The least overlap of sets of sizes a and b that links them."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def _may_link(self, a: Node, b: Node) -> bool:
        if self.den * min(a.most, b.most) < self.num * max(a.least, b.least):
            return False
        most = min(a.most, b.most, int(np.bitwise_count(a.map & b.map).sum()) + min(a.excess, b.excess))
        return most >= self.needed(a.least, b.least)

    def _settled(self, a: Node, b: Node) -> bool:
        return a.one and b.one and self.linked.root(int(a.members[0])) == self.linked.root(int(b.members[0]))

    def _leaves(self, a: Node, b: Node) -> None:
        s = self.sets
        common = np.bitwise_count(s.maps[a.members][:, None, :] & s.maps[b.members][None, :, :]).sum(2, dtype=np.int64)
        most = common + np.minimum.outer(s.excess[a.members], s.excess[b.members])
        likely = most >= self.needed(s.sizes[a.members][:, None], s.sizes[b.members][None, :])
        for i, j in np.argwhere(likely):
            x, y = int(a.members[i]), int(b.members[j])
            if (a is b and i >= j) or self.linked.root(x) == self.linked.root(y):
                continue
            both = np.intersect1d(s.tokens[x], s.tokens[y], assume_unique=True).size
            if both >= self.needed(int(s.sizes[x]), int(s.sizes[y])):
                self.linked.join(x, y)
                self.found.append((x, y))

    def _mark(self, a: Node) -> None:
        roots = {self.linked.root(int(x)) for x in a.members} if not a.kids else {self.linked.root(int(k.members[0])) if k.one else -i - 1 for i, k in enumerate(a.kids)}
        a.one = len(roots) == 1 and min(roots) >= 0

    def within(self, a: Node) -> None:
        if a.kids:
            for k in a.kids:
                self.within(k)
            for i, k in enumerate(a.kids):
                for other in a.kids[i + 1 :]:
                    self.between(k, other)
        else:
            self._leaves(a, a)
        self._mark(a)

    def between(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if self._settled(x, y) or not self._may_link(x, y):
                continue
            if not x.kids and not y.kids:
                self._leaves(x, y)
            elif x.kids and (not y.kids or len(x.members) >= len(y.members)):
                todo += [(k, y) for k in x.kids]
            else:
                todo += [(x, k) for k in y.kids]
