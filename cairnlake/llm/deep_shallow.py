"""Sorting of suffixes by deep-shallow sorting, a whole batch of suffix groups at a time.

Shallow: multikey quicksort with eight bytes as one character.  Every step sorts all groups that are not yet
told apart by their next character and splits them.  Deep: suffixes that still agree after the shallow depth
have a long common prefix; each such group, if it isn't too large, gets a blind trie, a tree that stores only branching places.  A
suffix goes down the trie by the characters at those places alone, is compared once with the leaf it reaches,
and is put in where the two part.  The tries of all groups grow side by side, one suffix of each at a time.
"""

from __future__ import annotations

import numpy as np

from . import textscan as ts

CHARACTER = ts.BLOCK
SHALLOW = 4
#: Suffixes in a trie, at most.
TRIE = 16


class _Tries:
    """One blind trie for each group.  Nodes of all tries lie in the same arrays."""

    def __init__(self, chars: np.ndarray, pos: np.ndarray, depth: int, first: np.ndarray) -> None:
        n = 2 * len(pos)
        self.chars, self.pos, self.full = chars, pos, depth
        self.depth, self.leaf = np.full(n, depth, np.int64), np.zeros(n, np.int64)
        self.key, self.child, self.next = np.zeros(n, np.uint64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.root = np.arange(len(first))
        self.leaf[: len(first)] = first
        self.used = len(first)

    def at(self, suffix: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        return self.chars[self.pos[suffix] + depth * CHARACTER].astype(np.uint64)

    def _down(self, suffix: np.ndarray, node: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Follow the branching characters to a node of that depth or more, or to where no branch fits."""
        node = node.copy()
        live = np.flatnonzero(self.depth[node] < until)
        while len(live):
            key = self.at(suffix[live], self.depth[node[live]])
            branch = self.child[node[live]]
            seek = np.flatnonzero(self.key[branch] != key)
            while len(seek):
                branch[seek] = self.next[branch[seek]]
                seek = seek[branch[seek] >= 0]
                seek = seek[self.key[branch[seek]] != key[seek]]
            on = branch >= 0
            live, branch = live[on], branch[on]
            node[live] = branch
            live = live[self.depth[branch] < until[live]]
        return node

    def insert(self, trie: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put a suffix in each of these tries.  Returns the leaf suffixes that were met and whether they are equal."""
        root = self.root[trie]
        met = self.leaf[self._down(suffix, root, np.full(len(suffix), self.full))]
        common = np.zeros(len(suffix), np.int64)
        live = np.arange(len(suffix))
        for d in range(self.full):
            live = live[self.at(suffix[live], d) == self.at(met[live], d)]
            if not len(live):
                break
            common[live] = d + 1
        equal = common == self.full
        new = np.flatnonzero(~equal)
        if len(new):
            x, d = suffix[new], common[new]
            node = self._down(x, root[new], d)
            leaf = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            self.leaf[leaf], self.depth[leaf], self.key[leaf] = x, self.full, self.at(x, d)
            split = self.depth[node] > d
            at = node[split]
            moved = np.arange(self.used, self.used + len(at))
            self.used += len(at)
            # The node becomes the new branching place, and what it was moves to a node below it.
            self.depth[moved], self.leaf[moved], self.child[moved] = self.depth[at], self.leaf[at], self.child[at]
            self.key[moved] = self.at(self.leaf[at], d[split])
            self.depth[at], self.child[at] = d[split], moved
            self.next[leaf] = self.child[node]
            self.child[node] = leaf
        return met, equal


def classes(buf: np.ndarray, pos: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """A number for each suffix, the same for suffixes of one group that agree in their first width bytes.

    Groups that the shallow sort leaves go to tries if they have up to ``TRIE`` suffixes; larger ones are split
    by further characters first.
    """
    depth = width // CHARACTER
    chars = ts.eights(buf)
    out = np.arange(len(pos))
    live = np.arange(len(pos))
    key, part = group.view(np.uint64) if group.dtype == np.int64 else group, np.zeros(len(pos), np.int64)
    deep, deep_part, made = [], [], 0
    for level in range(-1, depth):
        if not len(live):
            break
        if level >= 0:
            key = chars[pos[live] + level * CHARACTER].astype(np.uint64)
        order = np.lexsort((key, part)) if level >= 0 else np.argsort(key, kind="stable")
        live, key, part = live[order], key[order], part[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        begins = np.flatnonzero(new)
        size = np.diff(np.r_[begins, len(live)])
        per = np.repeat(size, size)
        part = np.cumsum(new)
        more = per > 1
        if level >= SHALLOW - 1:
            ready = more & (per <= TRIE)
            deep.append(live[ready]), deep_part.append(part[ready] + made)
            made += len(begins) + 1
            more &= per > TRIE
        live, part = live[more], part[more]
    if len(live):  # large groups that agree to the full width
        begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[live] = np.repeat(live[begins], np.diff(np.r_[begins, len(live)]))
    live, part = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (deep, deep_part))
    if not len(live):
        return out
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    size = np.diff(np.r_[begins, len(live)])
    by_size = np.argsort(-size, kind="stable")
    begins, size = begins[by_size], size[by_size]
    tries = _Tries(chars, pos[live] + SHALLOW * CHARACTER, max(0, depth - SHALLOW), begins)
    same = np.arange(len(live))
    for turn in range(1, int(size[0])):
        many = int(np.searchsorted(-size, -turn, "left"))  # tries with a suffix left
        suffix = begins[:many] + turn
        met, equal = tries.insert(np.arange(many), suffix)
        same[suffix[equal]] = met[equal]
    out[live] = live[same]
    return out
