"""The most similar of many names with one first word, without a comparison with each of them.

Names of one length make a compressed trie, so that a beginning they share is compared once; a branch is left as soon
as the longest common subsequence it can still reach is too short for the best score found so far.
"""

from __future__ import annotations

from bisect import bisect_left
from math import ceil

from .. import values as V
from .candidates import similarity

_W = V.SIMILARITY
_SLACK = 1e-9


def _trie(names: list[str]) -> tuple:
    """Nodes ``(letters, children, name)`` of sorted, different names of one length; a leaf has a name, others children."""
    top: list[tuple] = []
    todo = [(0, len(names), 0, top)]
    while todo:
        low, high, depth, into = todo.pop()
        first, last, end = names[low], names[high - 1], depth
        if high - low == 1:
            into.append((first[depth:], None, first))
            continue
        while first[end] == last[end]:
            end += 1
        children: list[tuple] = []
        into.append((first[depth:end], children, None))
        while low < high:
            at, low = low, low + 1
            while low < high and names[low][end] == names[at][end]:
                low += 1
            todo.append((at, low, end, children))
    return top[0]


def _places(text: str, word: str) -> list[int]:
    out, at = [], text.find(word)
    while at >= 0:
        out.append(at)
        at = text.find(word, at + 1)
    return out


class Names:
    """Different names with the same first word."""

    def __init__(self, names: list[str]):
        self.all = set(names)
        by_length: dict[int, list[str]] = {}
        for name in sorted(self.all):
            by_length.setdefault(len(name), []).append(name)
        self.tries = {n: _trie(same) for n, same in by_length.items()}
        self.word = names[0].split(" ")[0] if names else ""
        # where a name may begin within another one: at the first word of both
        self.tails = sorted((name[at:], name) for name in self.all for at in _places(name, self.word))

    def nearest(self, name: str, least: float) -> list[tuple[str, float]]:
        """All names of the highest score, if it is at least ``least`` or hardly below."""
        best, found, size = least, {}, len(name)

        def offer(other: str) -> None:
            nonlocal best
            if (score := similarity(name, other, best)) >= best - _SLACK:
                found[other] = score
                best = max(best, score)

        def alike(length: int) -> float:
            """What both ratios are at most, by the lengths."""
            return 2.0 * min(size, length) / (size + length)

        def may_contain(length: int) -> bool:
            return (_W["ratio"] + _W["token_sort"]) * alike(length) + _W["token_set"] + _W["contains"] + _W["same_first"] >= best - _SLACK

        for at in _places(name, self.word):
            for length in self.tries:
                if at + length <= size and name[at : at + length] in self.all and may_contain(length):
                    offer(name[at : at + length])
        k = bisect_left(self.tails, (name,))
        while k < len(self.tails) and self.tails[k][0].startswith(name):
            if may_contain(len(self.tails[k][1])):
                offer(self.tails[k][1])
            k += 1

        def need(length: int) -> int:
            """The shortest common subsequence that may do for a name that neither contains the other."""
            rest = _W["token_sort"] * alike(length) + _W["token_set"] + _W["same_first"]
            return ceil((best - _SLACK - rest) / _W["ratio"] * (size + length) / 2 - 1e-6)

        marks: dict[str, int] = {}
        for i, x in enumerate(name):
            marks[x] = marks.get(x, 0) | 1 << i
        full = (1 << size) - 1
        for length in sorted(self.tries, key=lambda n: abs(n - size)):
            least_common = need(length)
            if least_common > min(size, length):
                continue
            todo = [(self.tries[length], full, 0)]
            while todo:
                # as in ``ratio``, a cleared bit of ``rows`` for each letter of the common subsequence so far
                (letters, children, other), rows, depth = todo.pop()
                for y in letters:
                    met = rows & marks.get(y, 0)
                    rows = (rows + met | rows - met) & full
                depth += len(letters)
                # the letters to come meet at most as many of the last ones of the name
                to_come = min(size, length - depth)
                before = size - to_come
                if before - (rows & ((1 << before) - 1)).bit_count() + to_come < least_common:
                    continue
                if children is None:
                    offer(other)
                    least_common = need(length)
                else:
                    following = name[depth : depth + 1]
                    todo += [(c, rows, depth) for c in children if c[0][:1] != following]
                    todo += [(c, rows, depth) for c in children if c[0][:1] == following]
        return [(other, score) for other, score in found.items() if score == best]
