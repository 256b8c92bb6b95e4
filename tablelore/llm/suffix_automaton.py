"""A suffix automaton of several sequences."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """Knows every run of symbols in the sequences added to it.

    ``step[state][symbol]`` is the next state; ``length`` is that of a state's longest run,
    and ``link`` leads to the state of its longest suffix that is another state's.
    """

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.length, self.link = [0], [-1]

    def add(self, sequence: Iterable[Hashable]) -> list[int]:
        """The states of the sequence's prefixes; later additions leave them valid."""
        step, length, link = self.step, self.length, self.link
        last, path = 0, []
        for symbol in sequence:
            there = step[last].get(symbol)
            if there is None:
                fresh = len(length)
                length.append(length[last] + 1)
                step.append({})
                while last >= 0 and symbol not in step[last]:
                    step[last][symbol] = fresh
                    last = link[last]
                if last < 0:
                    link.append(0)
                else:
                    link.append(-1)  # until it is known
                    link[fresh] = self._only(last, symbol)
                last = fresh
            else:
                last = self._only(last, symbol)
            path.append(last)
        return path

    def _only(self, state: int, symbol: Hashable) -> int:
        """The state of just the longest run of ``state`` with ``symbol`` after it; split off if longer ones share it."""
        step, length, link = self.step, self.length, self.link
        there = step[state][symbol]
        if length[there] == length[state] + 1:
            return there
        twin = len(length)
        length.append(length[state] + 1)
        link.append(link[there])
        step.append(step[there].copy())
        while state >= 0 and step[state].get(symbol) == there:
            step[state][symbol] = twin
            state = link[state]
        link[there] = twin
        return twin
