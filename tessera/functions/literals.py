"""Literals that a pattern can't match without: a cheap test before the pattern itself."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _constants as C
from re import _parser as P

#: Shorter literals tell too little.
SHORTEST = 3


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """Of two sets of which one literal must occur, the one whose shortest literal is longer."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _of(parsed: Iterable) -> frozenset | None:
    best, run = None, ""
    for op, arg in parsed:
        if op is C.LITERAL:
            run += chr(arg).lower()
            continue
        best, run = _better(best, frozenset([run]) if run else None), ""
        inner = None
        if op is C.SUBPATTERN:
            inner = _of(arg[-1])
        elif op is C.BRANCH:
            each = [_of(b) for b in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _of(arg[2])
        best = _better(best, inner)
    return _better(best, frozenset([run]) if run else None)


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match holds at least one; None where there are none long enough."""
    found = _of(P.parse(pattern))
    return found if found and min(map(len, found)) >= SHORTEST else None


class Finder:
    """Which of many words stand in a text, in one pass."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = sorted(set(words))
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for w in self.words:
                self.automaton.add_word(w, w)
            self.automaton.make_automaton()
        except ImportError:  # a plain alternation tells the same, only slower
            self.automaton = None

    def starts(self, low: str) -> Iterator[tuple[int, str]]:
        """(start, word) of every occurrence in a lower-case text."""
        if self.automaton is not None:
            yield from ((end - len(w) + 1, w) for end, w in self.automaton.iter(low))
        else:
            yield from ((m.start(), w) for w in self.words for m in re.finditer(re.escape(w), low))

    def present(self, low: str) -> set[str]:
        return {w for _, w in self.starts(low)}


def lower(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
