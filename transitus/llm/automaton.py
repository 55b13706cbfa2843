"""Generalised suffix automaton over sequences of small integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Every run of symbols of any added sequence is a path from state 0.

    `length` is the longest run of a state, `link` the state of its longest suffix that occurs more widely.
    """

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A copy of `target` for the runs that are only one symbol longer than those of `state`."""
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, symbol, target)
        return new

    def add(self, symbols: Iterable[int]) -> None:
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)

    def states_of(self, symbols: Iterable[int]) -> Iterator[int]:
        """The state of each prefix of an added sequence."""
        state = 0
        for symbol in symbols:
            state = self.next[state][symbol]
            yield state

    def by_length(self) -> list[int]:
        """States from the longest to the shortest, so that a link comes after what points to it."""
        return sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)

    def matches(self, symbols: Sequence[int], cap: int) -> Iterator[tuple[int, int]]:
        """For each position the state and the length of the longest run of the added sequences that ends there.

        Runs above `cap` are cut to the shortest state that holds their last `cap` symbols.
        """
        following, link, length = self.next, self.link, self.length
        state = run = 0
        for symbol in symbols:
            target = following[state].get(symbol)
            if target is None:
                while state and target is None:
                    state = link[state]
                    target = following[state].get(symbol)
                run = length[state]
            if target is not None:
                state = target
                run += 1
                while length[link[state]] >= cap:
                    state = link[state]
                    run = length[state]
            yield state, run
