"""Loser trees over sorted runs, plain and aware of common prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class LoserTree:
    """Merges sorted iterables of comparable items with one comparison a level."""

    def __init__(self, streams: Iterable[Iterable]):
        self.its = [iter(s) for s in streams]
        self.k = max(1, len(self.its))
        self.heads = [next(it, None) for it in self.its] or [None]
        self.done = [h is None for h in self.heads]
        self.tree = [-1] * self.k

    def _less(self, a: int, b: int) -> bool:
        if self.done[a] or self.done[b]:
            return not self.done[a]
        return (self.heads[a], a) < (self.heads[b], b)

    def __iter__(self) -> Iterator:
        k, tree, less = self.k, self.tree, self._less
        win = [0] * k + list(range(k))
        for n in range(k - 1, 0, -1):
            a, b = win[2 * n], win[2 * n + 1]
            win[n], tree[n] = (a, b) if less(a, b) else (b, a)
        w = win[1] if k > 1 else 0
        while not self.done[w]:
            yield self.heads[w]
            x = next(self.its[w], None)
            self.heads[w], self.done[w] = x, x is None
            n = (w + k) // 2
            while n:
                if less(tree[n], w):
                    tree[n], w = w, tree[n]
                n //= 2


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(items: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefix with the item before, and the rest, of sorted items."""
    lcps, rests, last = [], [], b""
    for x in items:
        n = common(last, x)
        lcps.append(n)
        rests.append(x[n:])
        last = x
    return lcps, rests


def lcp_merge(streams: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge front-coded sorted streams of (common prefix with the stream's item before, rest,
    payload) into (common prefix with the output before, item, payload).

    Each tree node keeps a loser and the prefix it shares with the winner that beat it. Of
    two contenders the one that shares more with the last output comes first, without
    looking at a byte; only equal shares are compared, from the first unknown byte on.
    """
    k = max(1, len(streams))
    items: list[bytes | None] = [None] * k
    loads: list[object] = [None] * k
    h = [0] * k
    for s, it in enumerate(streams):
        x = next(it, None)
        if x is not None:
            items[s], loads[s] = x[1], x[2]
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); both know their share with the last output."""
        if items[a] is None:
            return b, a
        if items[b] is None:
            return a, b
        if h[a] != h[b]:
            return (a, b) if h[a] > h[b] else (b, a)
        x, y, n = items[a], items[b], h[a]
        m = common(x, y, n)
        if m == len(x) or (m < len(y) and x[m] < y[m]):
            if m == len(x) == len(y) and b < a:
                a, b = b, a
            h[b] = m
            return a, b
        h[a] = m
        return b, a

    win = [0] * k + list(range(k))
    for n in range(k - 1, 0, -1):
        win[n], tree[n] = play(win[2 * n], win[2 * n + 1])
    w = win[1] if k > 1 else 0
    while items[w] is not None:
        last = items[w]
        yield h[w], last, loads[w]
        x = next(streams[w], None)
        if x is None:
            items[w] = None
        else:
            items[w], loads[w], h[w] = last[: x[0]] + x[1], x[2], x[0]
        n = (w + k) // 2
        while n:
            w, tree[n] = play(w, tree[n])
            n //= 2
