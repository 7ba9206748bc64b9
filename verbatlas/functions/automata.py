"""Automata over word lists, for workers: whole words of a list in a text, and words of a list within some edits of a word."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np


def _joins(ch: str) -> bool:
    """Whether a character is part of a word: letters, marks, digits, connectors and joiners."""
    return ch.isalnum() or ch == "_" or (ch > "\x7f" and (unicodedata.category(ch) in ("Mn", "Me", "Mc", "Pc") or ch in "‌‍"))


def _at_edge(text: str, at: int) -> bool:
    """Whether a word begins or ends between the characters at - 1 and at."""
    before = at > 0 and _joins(text[at - 1])
    after = at < len(text) and _joins(text[at])
    return before != after


class WholeWords:
    """All words of a list that a text holds as whole words, in one pass over the text."""

    def __init__(self, words: Iterable[str]):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for w in words:
            if w:
                self._automaton.add_word(w, w)
        self._any = len(self._automaton) > 0
        if self._any:
            self._automaton.make_automaton()

    def __call__(self, text: str) -> set[str]:
        found: set[str] = set()
        if self._any:
            for end, word in self._automaton.iter(text):
                if word not in found and _at_edge(text, end + 1) and _at_edge(text, end + 1 - len(word)):
                    found.add(word)
        return found


class NearWords:
    """Words of a list within some edits (insertions, deletions, substitutions) of given words.

    The list is a trie of sorted words, level by level: a node's children lie together. All given words walk it at
    once, a level a step, each with the states of its Levenshtein automaton as bits: bit i of state d is set if its first i
    letters meet the path with d edits. Branches whose states are empty are left.
    """

    #: Letters that fit into the bits of a state.
    LONGEST = 62

    def __init__(self, words: list[str]):
        """words: sorted, without repeats."""
        self.words = words
        letters = sorted(set().union(*words)) if words else []
        self._code = {c: i for i, c in enumerate(letters)}
        longest = max(map(len, words), default=0)
        sizes = np.array([len(w) for w in words], np.int32)
        grid = np.full((len(words), longest), -1, np.int32)
        for i, w in enumerate(words):
            grid[i, : len(w)] = [self._code[c] for c in w]
        new = np.zeros(len(words), bool)
        new[:1] = True
        #: For each level: the letter of each node, the word that ends at it or -1, and where the children of the nodes above begin.
        self._levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        node = np.zeros(len(words), np.int64)  # of each word at the level above; all share the root
        nodes = 1
        for depth in range(longest):
            there = np.flatnonzero(sizes > depth)
            letter = grid[there, depth]
            fresh = np.ones(len(there), bool)
            fresh[1:] = (node[there][1:] != node[there][:-1]) | (letter[1:] != letter[:-1])
            own = np.cumsum(fresh) - 1
            heads = there[fresh]
            ends = np.full(len(heads), -1, np.int64)
            done = sizes[there] == depth + 1
            ends[own[done]] = there[done]
            begins = np.searchsorted(node[heads], np.arange(nodes + 1))
            self._levels.append((letter[fresh], ends, begins))
            node = node.copy()
            node[there] = own
            nodes = len(heads)

    def pairs(self, given: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in given, places in words, and edits of all pairs of at most `most` edits. No given word is longer than LONGEST."""
        n = np.array([len(w) for w in given], np.uint64)
        if len(n) and int(n.max()) > self.LONGEST:
            raise ValueError(f"a word has more than {self.LONGEST} letters")
        one = np.uint64(1)
        masks = np.zeros((len(given), len(self._code) + 1), np.uint64)  # bit i + 1: letter i is this one
        for q, w in enumerate(given):
            for i, c in enumerate(w):
                if c in self._code:
                    masks[q, self._code[c]] |= one << np.uint64(i + 1)
        within = (one << (n + one)) - one
        last = one << n
        q = np.arange(len(given))
        at = np.zeros(len(given), np.int64)
        states = [np.full(len(given), (1 << (d + 1)) - 1, np.uint64) & within for d in range(most + 1)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.words and not self.words[0]:  # the empty word ends at the root
            short = np.flatnonzero(n <= most)
            found.append((short, np.zeros(len(short), np.int64), n[short].astype(np.int64)))
        for letters, ends, begins in self._levels:
            count = begins[at + 1] - begins[at]
            total = int(count.sum())
            if not total:
                break
            up = np.repeat(np.arange(len(q)), count)
            at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + begins[at][up]
            q = q[up]
            same, inside = masks[q, letters[at]], within[q]
            before = [s[up] for s in states]
            states = []
            for d in range(most + 1):
                s = (before[d] << one) & same
                if d:
                    s |= before[d - 1] | (before[d - 1] << one) | (states[d - 1] << one)
                states.append(s & inside)
            alive = states[most] != 0
            q, at, states = q[alive], at[alive], [s[alive] for s in states]
            hit = np.flatnonzero((ends[at] >= 0) & (states[most] & last[q] != 0))
            if len(hit):
                edits = np.full(len(hit), most)
                for d in range(most - 1, -1, -1):
                    edits[states[d][hit] & last[q[hit]] != 0] = d
                found.append((q[hit], ends[at[hit]], edits))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def nearest(self, given: list[str], most: int, n: int, freq: np.ndarray, batch: int = 256) -> Iterator[list[str]]:
        """For each given word the first n words near it, itself left out: fewest edits first, then commonest, then smallest."""
        for at in range(0, len(given), batch):
            q, w, edits = self.pairs(given[at : at + batch], most)
            order = np.lexsort((w, -freq[w], edits, q))
            q, w, edits = q[order], w[order], edits[order]
            own = edits > 0
            q, w = q[own], w[own]
            starts = np.searchsorted(q, np.arange(len(given[at : at + batch]) + 1))
            for a, b in zip(starts, starts[1:], strict=False):
                yield [self.words[i] for i in w[a : min(b, a + n)]]
