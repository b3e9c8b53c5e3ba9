"""Front-coded runs of sorted suffixes and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first known bytes are not looked at."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_code(strings: Sequence[bytes]) -> tuple[list[int], bytes]:
    """Sorted strings as the lengths that each shares with the one before, and all the rests."""
    shared, rest, before = [], [], b""
    for s in strings:
        k = common_prefix(before, s)
        shared.append(k)
        rest.append(s[k:])
        before = s
    return shared, b"".join(rest)


class Run:
    """A reader of one front-coded run: its current string, and what that shares with the string read before."""

    __slots__ = ("shared", "sizes", "rest", "at", "place", "string", "lcp", "tags")

    def __init__(self, shared: Sequence[int], sizes: Sequence[int], rest: bytes, tags: Sequence):
        self.shared, self.sizes, self.rest, self.tags = shared, sizes, rest, tags
        self.at, self.place, self.string, self.lcp = -1, 0, b"", 0

    def next(self) -> bool:
        self.at += 1
        if self.at >= len(self.shared):
            return False
        k = self.shared[self.at]
        more = self.sizes[self.at] - k
        self.string = self.string[:k] + self.rest[self.place : self.place + more]
        self.place += more
        self.lcp = k
        return True


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, object]]:
    """All strings in order, each with the length it shares with the one before and its tag.

    Each inner node keeps a loser with the prefix it shares with the winner that passed. Of two strings the one that
    shares more with the last output is the smaller; only where both share as much are bytes compared, from there on.
    """
    live = [r for r in runs if r.next()]
    n = len(live)
    if not n:
        return
    size = 1
    while size < n:
        size *= 2
    leaf: list[Run | None] = live + [None] * (size - n)
    losers: list[Run | None] = [None] * size
    for r in live:
        r.lcp = 0

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """Winner and loser; the loser's lcp becomes the one with the winner."""
        if a is None:
            return b, a
        if b is None or a.lcp > b.lcp:
            return a, b
        if a.lcp < b.lcp:
            return b, a
        x, y = a.string, b.string
        k = common_prefix(x, y, a.lcp)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            b.lcp = k
            return a, b
        a.lcp = k
        return b, a

    where = {id(r): i for i, r in enumerate(live)}
    level = leaf
    at = size
    while at > 1:
        at //= 2
        won = []
        for i in range(at):
            w, losers[at + i] = play(level[2 * i], level[2 * i + 1])
            won.append(w)
        level = won
    winner = level[0]
    while winner is not None:
        yield winner.string, winner.lcp, winner.tags[winner.at]
        node = (where[id(winner)] + size) // 2
        contender: Run | None = winner if winner.next() else None
        while node >= 1:
            loser = losers[node]
            if loser is not None:
                contender, losers[node] = play(contender, loser)
            node //= 2
        winner = contender
