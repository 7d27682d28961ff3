"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries for what is still equal."""

from __future__ import annotations

import numpy as np

SHALLOW = 16  # words of 8 bytes


def matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `width` bytes, padded with zeros, and the lengths."""
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width), np.array([len(s) for s in strings], np.int64)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie: inner nodes hold a depth and children by the byte there (-1: the end), leaves hold equal strings.

    An insert walks down by single bytes without comparing what lies between, compares once with the
    leaf it meets, and then knows where its own branch goes.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while isinstance(node, tuple):
            depth, children = node
            path.append(node)
            byte = s[depth] if depth < len(s) else -1
            node = children[byte] if byte in children else next(iter(children.values()))
        other = self.strings[node[0]]
        depth = _common(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            return
        above, below = None, self.root
        for step in path:
            if step[0] >= depth:
                break
            above, below = step, step[1][s[step[0]] if step[0] < len(s) else -1]
        own = s[depth] if depth < len(s) else -1
        if isinstance(below, tuple) and below[0] == depth:
            below[1][own] = [i]
            return
        fresh = (depth, {other[depth] if depth < len(other) else -1: below, own: [i]})
        if above is None:
            self.root = fresh
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = fresh

    def in_order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def _shallow(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins of groups): rows sorted by their words, a multikey sort that goes on to the next word only within groups still equal."""
    order, group = np.arange(len(words)), np.zeros(len(words), np.int64)
    open_ = np.arange(len(words))  # places in order that hold groups of more than one row
    for depth in range(words.shape[1]):
        if not len(open_):
            break
        w = words[order[open_], depth]
        by = np.lexsort((w, group[open_]))
        order[open_] = order[open_][by]
        w, g = w[by], group[open_]
        edge = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
        group[open_] = open_[np.maximum.accumulate(np.where(edge, np.arange(len(open_)), 0))]
        g = group[open_]
        twin = np.concatenate([[False], g[1:] == g[:-1]])
        open_ = open_[twin | np.append(twin[1:], False)]
    return order, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def deep_shallow_sort(strings: list[bytes], table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the sorted order of strings, and the common prefix of each with the next one in it (0 for the last).

    table and lengths are matrix(strings). Equal strings enter the sort once.
    """
    first: dict[bytes, int] = {}
    of = np.array([first.setdefault(s, i) for i, s in enumerate(strings)], np.int64)
    once = np.flatnonzero(of == np.arange(len(of)))
    wide = np.pad(table[once, : 8 * SHALLOW], ((0, 0), (0, max(0, 8 * SHALLOW - table.shape[1]))))
    order, begins = _shallow(np.ascontiguousarray(wide).view(">u8").astype(np.uint64))
    order = once[order]
    edges = [*begins.tolist(), len(order)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            trie = BlindTrie(strings)
            for i in order[a:b].tolist():
                trie.insert(i)
            order[a:b] = trie.in_order()
    rank = np.empty(len(of), np.int64)
    rank[order] = np.arange(len(order))
    order = np.argsort(rank[of], kind="stable") if len(of) else order
    lcp = np.zeros(len(order), np.int64)
    for at in range(0, len(order) - 1, 4096):
        a, b = order[at : at + 4097][:-1], order[at + 1 : at + 4097]
        differ = table[a] != table[b]
        found = np.where(differ.any(1), differ.argmax(1), table.shape[1])
        lcp[at : at + len(a)] = np.minimum(found, np.minimum(lengths[a], lengths[b]))
    return order, lcp
