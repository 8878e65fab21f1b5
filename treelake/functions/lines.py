"""Lines of a text, and matching of two texts' lines by a greedy shortest edit script; where that needs more than GREEDY edits, by a
longest common subsequence in linear space (of several equally long ones the two ways may choose different ones)."""

from __future__ import annotations

from collections.abc import Sequence


def lines(text: str | bytes) -> list:
    """Split at line feeds; a last one opens no further line, and an empty text has none."""
    nl = "\n" if isinstance(text, str) else b"\n"
    parts = text.split(nl)
    return parts if parts[-1] else parts[:-1]


GREEDY = 1000  # the script's history is at most about half the square of this


def _row(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Length of the longest common subsequence of a with each beginning of b, by bits of one integer."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if u := v & where.get(x, 0):
            v = (v + u | v - u) & full
    out, n = [0], 0
    for bit in reversed(format(v, f"0{max(len(b), 1)}b")[-len(b) :] if b else ""):
        n += bit == "0"
        out.append(n)
    return out


def linear_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by halving a; lines that only one side has are left out first."""
    both = {*a} & {*b}
    number = {x: k for k, x in enumerate(both)}
    left, right = [i for i, x in enumerate(a) if x in both], [j for j, y in enumerate(b) if y in both]
    x, y = [number[a[i]] for i in left], [number[b[j]] for j in right]
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and x[i] == y[j]:
            out.append((left[i], right[j]))
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1] == y[m - 1]:
            n, m = n - 1, m - 1
            out.append((left[n], right[m]))
        if i >= n or j >= m:
            continue
        if n - i == 1:
            if x[i] in y[j:m]:
                out.append((left[i], right[y.index(x[i], j, m)]))
            continue
        half = (i + n) // 2
        head, tail = _row(x[i:half], y[j:m]), _row(x[half:n][::-1], y[j:m][::-1])[::-1]
        cut = max(range(len(head)), key=lambda k: head[k] + tail[k])
        todo += [(i, half, j, j + cut), (half, n, j + cut, m)]
    return sorted(out)


def matched_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of equal lines on a shortest edit path. Of two ways to a diagonal the one further along a is taken, on a tie the deletion."""
    n, m = len(a), len(b)
    if n == m and list(a) == list(b):
        return [(k, k) for k in range(n)]
    if not n or not m:
        return []
    reach: dict[int, int] = {1: 0}
    history: list[dict[int, int]] = []
    for d in range(n + m + 1):
        if d > GREEDY:
            return linear_pairs(a, b)
        now, done = {}, False  # diagonals of this parity; the others are in the step before
        for k in range(-d, d + 1, 2):
            x = _enter(reach, k, d)
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            now[k] = x
            done = done or (x >= n and x - k >= m)
        history.append(now)
        reach = now
        if done:
            break
    out, x, y = [], n, m
    for d in range(len(history) - 1, 0, -1):
        k, before = x - y, history[d - 1]
        entered = _enter(before, k, d)
        out += [(i, i - k) for i in range(x - 1, entered - 1, -1)]
        down = k == -d or (k != d and before.get(k - 1, 0) < before.get(k + 1, 0))
        x = before.get(k + 1, 0) if down else before.get(k - 1, 0)
        y = x - k - 1 if down else x - k + 1
    out += [(i, i) for i in range(x - 1, -1, -1)]
    out.reverse()
    return out


def _enter(reach: dict[int, int], k: int, d: int) -> int:
    """Where diagonal k is entered by the d-th edit."""
    if k == -d or (k != d and reach.get(k - 1, 0) < reach.get(k + 1, 0)):
        return reach.get(k + 1, 0)
    return reach.get(k - 1, 0) + 1


def additions(pairs: list[tuple[int, int]], b_size: int) -> list[int]:
    kept = {j for _, j in pairs}
    return [j for j in range(b_size) if j not in kept]


def carryovers(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Place in b of each line that was there before, to its place in a."""
    return {j: i for i, j in pairs}
