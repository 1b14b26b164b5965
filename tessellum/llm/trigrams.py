"""Boolean trigram queries from regular expressions.

A query is a list of clauses that all hold for a text with a match; a clause is a list of branches of which
one holds; a branch is a set of trigrams that all occur in the lower-cased text. An empty list says nothing.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: More alternative strings than this, or a larger character class, count as unknown.
MOST_STRINGS, MOST_CLASS = 64, 8


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


class _Reader:
    def __init__(self):
        self.clauses: list[list[frozenset[str]]] = []
        self.strings = {""}

    def flush(self) -> None:
        """The text holds one of the strings known so far, whole; what comes next is unknown."""
        branches = {trigrams(s.lower()) for s in self.strings}
        if all(branches):
            least = [b for b in branches if not any(other < b for other in branches)]
            self.clauses.append(sorted(least, key=sorted))
        self.strings = {""}

    def extend(self, more: set[str] | None) -> None:
        if more is None or len(more) * len(self.strings) > MOST_STRINGS:
            self.flush()
            if more is None or len(more) > MOST_STRINGS:
                return
        self.strings = {a + b for a in self.strings for b in more}

    def read(self, parsed) -> None:
        for kind, value in parsed:
            got = exact([(kind, value)])
            if got is None and kind is op.SUBPATTERN:
                self.read(value[3])
            elif got is None and kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                if (unit := exact(value[2])) is not None:
                    self.extend(unit)
                else:
                    self.flush()
                    self.read(value[2])
                self.flush()
            else:
                self.extend(got)


def exact(parsed) -> set[str] | None:
    """All strings that the parsed expression matches, if they are few."""
    strings = {""}
    for kind, value in parsed:
        if kind is op.LITERAL:
            more = {chr(value)}
        elif kind is op.IN:
            more = set()
            for k, v in value:
                if k is op.LITERAL:
                    more.add(chr(v))
                elif k is op.RANGE and v[1] - v[0] < MOST_CLASS:
                    more |= {chr(c) for c in range(v[0], v[1] + 1)}
                else:
                    return None
            if len(more) > MOST_CLASS:
                return None
        elif kind is op.BRANCH:
            each = [exact(x) for x in value[1]]
            if any(x is None for x in each):
                return None
            more = set().union(*each)
        elif kind is op.SUBPATTERN:
            more = exact(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] is not op.MAXREPEAT and value[1] <= 4:
            unit = exact(value[2])
            if unit is None:
                return None
            more, now = set(), {""}
            for i in range(value[1] + 1):
                if i >= value[0]:
                    more |= now
                now = {a + b for a in now for b in unit}
                if len(now) > MOST_STRINGS:
                    return None
        elif kind is op.AT:
            more = {""}
        else:
            return None
        if more is None:
            return None
        strings = {a + b for a in strings for b in more}
        if len(strings) > MOST_STRINGS:
            return None
    return strings


def query(pattern: str) -> list[list[frozenset[str]]]:
    reader = _Reader()
    reader.read(parser.parse(pattern))
    reader.flush()
    return reader.clauses
