"""Generalised suffix automaton over sequences of small integers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Every substring of the added sequences is a path from state 0.

    ``length[v]`` is the longest substring of state ``v``, ``link[v]`` the state of
    its longest suffix with other occurrences, ``count[v]`` (after :meth:`finish`)
    the weighted number of positions where the substrings of ``v`` end.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.count: list[int] = [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """Give the substrings of ``q`` that end the path over ``p`` a state of their own."""
        nexts, link = self.next, self.link
        clone = self._state(self.length[p] + 1, dict(nexts[q]), link[q])
        while p >= 0 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, sequence: Iterable[int], weight: int = 1) -> int:
        """Add a sequence; each of its positions counts ``weight`` times. Returns its state."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for symbol in sequence:
            q = nexts[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, symbol)
            else:
                made = self._state(length[last] + 1, {}, 0)
                p = last
                while p >= 0 and symbol not in nexts[p]:
                    nexts[p][symbol] = made
                    p = link[p]
                if p >= 0:
                    q = nexts[p][symbol]
                    link[made] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
                last = made
            count[last] += weight
        return last

    def finish(self) -> None:
        """Sum the counts up the suffix links."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def walk(self, sequence: Iterable[int]) -> tuple[list[int], list[int]]:
        """Matching statistics: after each symbol, the state and length of the longest match ending there."""
        nexts, link, length = self.next, self.link, self.length
        v = matched = 0
        states, lengths = [], []
        for symbol in sequence:
            to = nexts[v].get(symbol)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = nexts[v].get(symbol)
            if to is None:
                matched = 0
            else:
                v = to
                matched += 1
            states.append(v)
            lengths.append(matched)
        return states, lengths

    def of_length(self, v: int, n: int) -> int:
        """The state that holds the suffix of length ``n`` of the substrings of ``v``."""
        link, length = self.link, self.length
        while length[link[v]] >= n:
            v = link[v]
        return v

    def owners(self, sequences: Sequence[Sequence[int]], least: int) -> dict[int, list[int]]:
        """For each state with substrings of ``least`` symbols or more: the sequences that contain them."""
        link, length, nexts = self.link, self.length, self.next
        held: dict[int, list[int]] = {}
        for k, sequence in enumerate(sequences):
            v = 0
            for symbol in sequence:
                v = nexts[v][symbol]
                u = v
                while u > 0 and length[u] >= least:
                    own = held.setdefault(u, [])
                    if own and own[-1] == k:
                        break
                    own.append(k)
                    u = link[u]
        return held
