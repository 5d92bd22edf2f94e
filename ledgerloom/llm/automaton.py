"""A trie searched with a Levenshtein automaton, on request with swaps of neighbours as one edit.

The automaton of a query is simulated bit-parallel: row j is the set of query positions reached with j edits, one integer, and one
trie edge moves all rows; a half swap waits in a row of its own for the letter that completes it. A branch of the trie is left as soon as no row has a position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Node:
    __slots__ = ("children", "ends", "cut", "low", "high")

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.ends: set | None = None  # entries whose path ends here
        self.cut: set | None = None  # entries whose path may be broken off here
        self.low, self.high = 1 << 30, 0  # the lengths of the paths through here that may end, from the shortest to the longest


class Trie:
    def __init__(self) -> None:
        self.root = Node()
        self.size = 0

    def add(self, path: str, entry, cut_from: int | None = None) -> None:
        """A path of an entry; from cut_from characters on, its rest may be missing."""
        node, n = self.root, len(path)
        shortest = n if cut_from is None else min(cut_from, n)
        for i, c in enumerate(path, 1):
            nxt = node.children.get(c)
            if nxt is None:
                nxt = node.children[c] = Node()
                self.size += 1
            node = nxt
            if max(i, shortest) < node.low:
                node.low = max(i, shortest)
            if n > node.high:
                node.high = n
            if cut_from is not None and cut_from <= i < len(path):
                if node.cut is None:
                    node.cut = set()
                node.cut.add(entry)
        if node.ends is None:
            node.ends = set()
        node.ends.add(entry)

    def search(self, query: str, most: int, swaps: bool = False) -> dict:
        """{entry: fewest edits} of all entries with a path within most edits; breaking off costs half an edit.

        swaps: two neighbours in turned order are one edit instead of two, if nothing else is edited between them.
        """
        m = len(query)
        full = (1 << (m + 1)) - 1
        goal = 1 << m
        where: dict[str, int] = {}
        for i, c in enumerate(query):
            where[c] = where.get(c, 0) | 1 << i
        found: dict = {}

        def note(entries: set, cost: float) -> None:
            for e in entries:
                if cost < found.get(e, 1e9):
                    found[e] = cost

        low, high = m - most, m + most
        start = tuple((1 << (j + 1)) - 1 & full for j in range(most + 1))
        none = (0,) * (most + 1)
        stack = [(self.root, start, none)]
        pop, push = stack.pop, stack.append
        while stack:
            node, rows, half = pop()
            for c, child in node.children.items():
                if child.high < low or child.low > high:
                    continue
                b = where.get(c, 0)
                before = rows[0]
                row = (before & b) << 1
                new = [row]
                if swaps:
                    for old, waits in zip(rows[1:], half[1:]):
                        row = ((old & b) << 1 | (waits & b) << 2 | before | before << 1 | row << 1) & full
                        new.append(row)
                        before = old
                else:
                    for old in rows[1:]:
                        row = ((old & b) << 1 | before | before << 1 | row << 1) & full
                        new.append(row)
                        before = old
                if not row:  # the last row holds all others
                    continue
                if row & goal and (child.ends or child.cut):
                    cost = next(j for j, r in enumerate(new) if r & goal)
                    if child.ends:
                        note(child.ends, cost)
                    if child.cut:
                        note(child.cut, cost + 0.5)
                if child.children:
                    push((child, tuple(new), (0, *(r & b >> 1 for r in rows[:-1])) if swaps else none))
        return found

    def nearest(self, query: str, most: int) -> dict:
        """The entries of search within the fewest edits that give any, at most most."""
        for k in range(most + 1):
            if found := self.search(query, k):
                return found
        return {}

    def paths(self) -> Iterator[str]:
        stack = [(self.root, "")]
        while stack:
            node, path = stack.pop()
            if node.ends:
                yield path
            stack += [(n, path + c) for c, n in node.children.items()]


class Levels:
    """A trie laid out in levels of arrays, searched for many queries at once by the same automaton."""

    CELLS = 1 << 21  # queries times nodes of a level that are worked on at once

    def __init__(self, trie: Trie) -> None:
        self.trie, self.code = trie, {}
        self.levels: list[tuple[np.ndarray, np.ndarray, list[tuple[int, Node]]]] = []
        nodes = [trie.root]
        while True:
            chars, parents, below = [], [], []
            for at, node in enumerate(nodes):
                for c, child in node.children.items():
                    chars.append(self.code.setdefault(c, len(self.code)))
                    parents.append(at)
                    below.append(child)
            if not below:
                break
            self.levels.append((np.array(chars), np.array(parents), [(i, n) for i, n in enumerate(below) if n.ends or n.cut]))
            nodes = below
        self.widest = max((len(c) for c, _, _ in self.levels), default=1)

    def search(self, queries: list[str], most: int, swaps: bool = False) -> list[dict]:
        """The result of Trie.search of each query. Queries of more than 60 characters are searched one by one."""
        out: list[dict] = [{}] * len(queries)
        short = [i for i, q in enumerate(queries) if len(q) <= 60]
        for i in set(range(len(queries))) - set(short):
            out[i] = self.trie.search(queries[i], most, swaps)
        step = max(1, self.CELLS // self.widest)
        for a in range(0, len(short), step):
            part = short[a : a + step]
            for i, found in zip(part, self._search([queries[i] for i in part], most, swaps)):
                out[i] = found
        return out

    def _search(self, queries: list[str], most: int, swaps: bool) -> list[dict]:
        found: list[dict] = [{} for _ in queries]
        where = np.zeros((len(queries), len(self.code) + 1), np.int64)
        for i, q in enumerate(queries):
            for j, c in enumerate(q):
                where[i, self.code.get(c, -1)] |= 1 << j
        where[:, -1] = 0  # letters that the trie lacks
        goal = np.array([1 << len(q) for q in queries])[:, None]
        full = goal * 2 - 1
        rows = [np.full((len(queries), 1), (1 << (j + 1)) - 1) & full for j in range(most + 1)]
        half = [np.zeros_like(r) for r in rows]
        place = np.zeros(1, np.int64)  # where a node of the level before stands among those still alive, -1 if it is not
        for chars, parents, ends in self.levels:
            at = place[parents]
            alive = np.flatnonzero(at >= 0)
            if not len(alive):
                break
            up, b = at[alive], where[:, chars[alive]]
            old = [r[:, up] for r in rows]
            new = [(old[0] & b) << 1]
            for j in range(1, most + 1):
                row = ((old[j] & b) << 1) | old[j - 1] | (old[j - 1] << 1) | (new[j - 1] << 1)
                if swaps:
                    row |= (half[j][:, up] & b) << 2
                new.append(row & full)
            if swaps:
                half = [np.zeros_like(b)] + [old[j - 1] & (b >> 1) for j in range(1, most + 1)]
            stands = np.full(len(chars), -1)
            stands[alive] = np.arange(len(alive))
            last = [(stands[i], node) for i, node in ends if stands[i] >= 0]
            if last:
                columns = np.array([i for i, _ in last])
                hits = [(r[:, columns] & goal) != 0 for r in new]
                for q, e in zip(*np.nonzero(hits[-1])):
                    cost, node = next(j for j in range(most + 1) if hits[j][q, e]), last[e][1]
                    for entries, price in ((node.ends, cost), (node.cut, cost + 0.5)):
                        for entry in entries or ():
                            if price < found[q].get(entry, 1e9):
                                found[q][entry] = price
            keep = np.flatnonzero((new[-1] != 0).any(axis=0))
            rows, half = [r[:, keep] for r in new], [h[:, keep] for h in half] if swaps else half
            place = np.full(len(chars), -1)
            place[alive[keep]] = np.arange(len(keep))
        return found
