"""A HAT-trie over word numbers: hash containers below a shallow trie, spilled as sorted runs.

A path is up to four word numbers, packed in two integers: the head (first and second word) and
the tail (third and fourth). Numbers begin at 1; 0 says that a path has ended. A container counts
the paths of a range of heads in one open-addressing table. One that grows beyond `burst` paths is
split: between two first words if it holds several, else between second words of its only first
word. So the trie above the containers, kept as the sorted first heads of its leaves, is
two words deep at the most and deep only below frequent words.
"""

from __future__ import annotations

import numpy as np

_SHIFT = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


class Container:
    """Counts of paths by (head, tail), unsorted."""

    def __init__(self, slots: int = 1 << 10):
        self.head = np.zeros(slots, np.uint64)
        self.tail = np.zeros(slots, np.uint64)
        self.count = np.zeros(slots, np.int32)
        self.size = 0

    def add(self, head: np.ndarray, tail: np.ndarray, count: np.ndarray) -> None:
        """Add counts over 0; paths may repeat."""
        if 3 * (self.size + len(head)) > 2 * len(self.count):
            held = self.paths()
            self.__init__(1 << int(np.ceil(np.log2(2 * (self.size + len(head)) + 1))))
            self._place(*held)
        self._place(head, tail, count)
        self.size = int(np.count_nonzero(self.count))

    def _place(self, head: np.ndarray, tail: np.ndarray, count: np.ndarray) -> None:
        last = np.uint64(len(self.count) - 1)
        at = (joined(head, tail) & last).astype(np.int64)
        while len(head):
            free = self.count[at] == 0
            # Of several paths that claim a free slot the last one gets it; the others look on.
            self.head[at[free]] = head[free]
            self.tail[at[free]] = tail[free]
            own = (self.head[at] == head) & (self.tail[at] == tail)
            np.add.at(self.count, at[own], count[own])
            other = ~own
            head, tail, count, at = head[other], tail[other], count[other], (at[other] + 1) & int(last)

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = np.flatnonzero(self.count)
        return self.head[held], self.tail[held], self.count[held]


class HatTrie:
    """Counts of paths; `size` of them are held."""

    def __init__(self, burst: int = 1 << 17):
        self.burst = burst
        self.clear()

    def clear(self) -> None:
        self.first = np.zeros(1, np.uint64)
        self.leaves = [Container()]

    @property
    def size(self) -> int:
        return sum(leaf.size for leaf in self.leaves)

    def add(self, head: np.ndarray, tail: np.ndarray) -> None:
        """Count each path once more."""
        leaf = (np.searchsorted(self.first, head, "right") - 1).astype(np.uint32)
        order = np.argsort(leaf, kind="stable")
        ends = np.searchsorted(leaf[order], np.arange(len(self.leaves) + 1))
        ones = np.ones(len(head), np.int32)
        for k, (start, stop) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if start < stop:
                mine = order[start:stop]
                self.leaves[k].add(head[mine], tail[mine], ones[: stop - start])
        k = 0
        while k < len(self.leaves):
            if not (self.leaves[k].size > self.burst and self._burst(k)):
                k += 1

    def _burst(self, k: int) -> bool:
        """Split leaf k; False where all its paths have one head."""
        head, tail, count = self.leaves[k].paths()
        least, middle = head.min(), np.partition(head, len(head) // 2)[len(head) // 2]
        word = (middle >> _SHIFT) << _SHIFT
        if word > least:
            cut = word  # between first words
        elif (head.max() >> _SHIFT) > (middle >> _SHIFT):
            cut = word + (np.uint64(1) << _SHIFT)
        elif middle > least:
            cut = middle  # between second words of one first word
        elif head.max() > middle:
            cut = middle + np.uint64(1)
        else:
            return False
        halves = []
        for half in (head < cut, head >= cut):
            leaf = Container()
            leaf.add(head[half], tail[half], count[half])
            halves.append(leaf)
        self.leaves[k : k + 1] = halves
        self.first = np.insert(self.first, k + 1, cut)
        return True

    def spill(self, share: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out the paths of the largest subtrees that hold about that share of them."""
        sizes = np.array([leaf.size for leaf in self.leaves])
        by_size = np.argsort(-sizes, kind="stable")
        most = int(np.searchsorted(np.cumsum(sizes[by_size]), share * sizes.sum())) + 1
        taken = by_size[:most].tolist()
        parts = [self.leaves[k].paths() for k in taken]
        for k in taken:
            self.leaves[k] = Container()
        return tuple(np.concatenate(column) for column in zip(*parts))
