"""What both byte-pair operators share: an exact merge loop for one token and the test whether two tokens may stand side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

NEVER = float("inf")


class PairTest:
    """Whether two tokens stand next to each other in some encoding.

    A token sequence is the encoding of its own concatenation exactly if every adjacent pair is, since
    a merge across a boundary depends on the parts at that boundary alone. The parts of a token at its
    right (left) end live from their own merge to the merge that swallows them. Two parts that live at
    the same time and have a merge of an earlier rank would have been merged across the boundary.
    So the last token of a prefix is the one that may stand after the last token of a shorter prefix.
    """

    def __init__(self, units: Callable[[object], Sequence], rank_of: Callable[[object, object], int | None], keep: int = 300_000):
        self.units, self.rank_of, self.keep = units, rank_of, keep
        self.known: dict = {}
        self.ends: dict = {}

    def _halves(self, token) -> tuple | None:
        """The last merge that makes the token from its units; () for a unit, None if merging doesn't give it."""
        parts, pair = list(self.units(token)), ()
        while len(parts) > 1:
            rank, at = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank_of(parts[i], parts[i + 1])) is not None), default=(0, -1))
            if at < 0:
                return None
            pair = (parts[at], parts[at + 1], rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return pair

    def _of(self, token) -> tuple | None:
        """(parts at the right end, parts at the left end), each with the rank that swallows it; None if the token isn't its own encoding."""
        got = self.ends.get(token, self)
        if got is self:
            pair = self._halves(token)
            if pair is None:
                got = None
            elif not pair:
                got = (((token, NEVER),), ((token, NEVER),))
            else:
                (right, _), (_, left) = self._of(pair[1]), self._of(pair[0])
                got = tuple(((token, NEVER), (inner[0][0], pair[2]), *inner[1:]) for inner in (right, left))
            self.ends[token] = got
        return got

    def __call__(self, left, right) -> bool:
        """``left`` None: whether ``right`` alone is its own encoding."""
        got = self.known.get((left, right))
        if got is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            got = self.known[left, right] = self._test(left, right)
        return got

    def _test(self, left, right) -> bool:
        after = self._of(right)
        if after is None or left is None:
            return after is not None
        rank_of = self.rank_of
        for x, x_ends in self._of(left)[0]:
            for y, y_ends in after[1]:
                r = rank_of(x, y)
                # on equal ranks the merge further left comes first
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True
