"""Equal stretches of two texts as difflib finds them with autojunk off, by bits in place of a table's steps."""

from __future__ import annotations

from difflib import Match, SequenceMatcher

#: Fixed value: pairs of characters up to which equal ones stand as bits (2 MB); larger pairs of texts are split by an automaton first.
CELLS = 1 << 24


class Automaton:
    """Suffix automaton of a text: the longest block that another text shares with it, in one pass over that text."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [0]
        last = 0
        for place, c in enumerate(text, 1):
            state = self._add({}, self.size[last] + 1, place)
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = state
                at = self.link[at]
            if at < 0:
                self.link[state] = 0
            elif self.size[to := self.next[at][c]] == self.size[at] + 1:
                self.link[state] = to
            else:
                twin = self._add(dict(self.next[to]), self.size[at] + 1, self.end[to])
                self.link[twin] = self.link[to]
                while at >= 0 and self.next[at].get(c) == to:
                    self.next[at][c] = twin
                    at = self.link[at]
                self.link[to] = self.link[state] = twin
            last = state

    def _add(self, moves: dict[str, int], size: int, end: int) -> int:
        self.next.append(moves)
        self.link.append(-1)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, x: str) -> tuple[int, int, int]:
        """(size, start in x, start in the text) of the longest common block; the first in x, then the first in the text."""
        state = length = 0
        best = 0, 0, 0
        for place, c in enumerate(x, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            if length > best[0]:
                best = length, place - length, self.end[state] - length
        return best


def _small(a: str, b: str, i0: int, j0: int, out: list[tuple[int, int, int]]) -> None:
    """Blocks of two texts, with i0 and j0 added. Row i of runs[p] has a bit for each j where p characters from a's i and b's j on are equal; runs[p + 1] are twice as long. The lowest bit of the longest run in a part of both texts is difflib's choice."""
    n, m = len(a), len(b)
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    wide = (m >> 3) + 1
    row = 8 * wide
    rows = {c: x.to_bytes(wide, "little") for c, x in at.items()}
    none = bytes(wide)
    runs = [b"".join([rows.get(c, none) for c in a])]
    bits = int.from_bytes(runs[0], "little")
    if not bits:
        return
    while True:
        step = 1 << len(runs) - 1
        bits &= bits >> step * (row + 1)
        if not bits:
            break
        runs.append(bits.to_bytes(n * wide, "little"))
    parts = [(0, n, 0, m, (2 << len(runs) - 1) - 1)]
    while parts:
        i, i_end, j, j_end, most = parts.pop()
        most = min(most, i_end - i, j_end - j)
        if most == 1:
            # One character against several, or single ones left: the first that is there.
            if i_end - i == 1:
                k = b.find(a[i], j, j_end)
                if k >= 0:
                    out.append((i0 + i, j0 + k, 1))
                continue
            if j_end - j == 1:
                k = a.find(b[j], i, i_end)
                if k >= 0:
                    out.append((i0 + k, j0 + j, 1))
                continue
        p = most.bit_length() - 1
        while p >= 0:
            size = 1 << p
            count = i_end - size + 1 - i
            within = ((1 << j_end - size + 1) - (1 << j)).to_bytes(wide, "little") * count
            found = int.from_bytes(runs[p][i * wide : (i + count) * wide], "little") & int.from_bytes(within, "little")
            if found:
                break
            p -= 1
        else:
            continue
        low, high = size, min(most, 2 * size - 1)
        while low < high:
            middle = (low + high + 1) // 2
            longer = found & found >> (middle - size) * (row + 1)
            if longer:
                low, best = middle, longer
            else:
                high = middle - 1
        if low > size:
            found = best
        x, y = divmod((found & -found).bit_length() - 1, row)
        x += i
        out.append((i0 + x, j0 + y, low))
        if x > i and y > j:
            parts.append((i, x, j, y, low))
        if x + low < i_end and y + low < j_end:
            parts.append((x + low, i_end, y + low, j_end, low))


def blocks(a: str, b: str) -> list[Match]:
    """get_matching_blocks() of difflib's SequenceMatcher(None, a, b, autojunk=False)."""
    found: list[tuple[int, int, int]] = []
    parts = [(0, len(a), 0, len(b))] if a != b else []
    if a and a == b:
        found.append((0, 0, len(a)))
    while parts:
        i, i_end, j, j_end = parts.pop()
        if i == i_end or j == j_end:
            continue
        if (i_end - i) * (j_end - j) <= CELLS:
            _small(a[i:i_end], b[j:j_end], i, j, found)
            continue
        size, x, y = Automaton(b[j:j_end]).longest(a[i:i_end])
        if size:
            x, y = x + i, y + j
            found.append((x, y, size))
            parts += [(i, x, j, y), (x + size, i_end, y + size, j_end)]
    out, last = [], (0, 0, 0)
    for x, y, size in sorted(found):
        if last[0] + last[2] == x and last[1] + last[2] == y:
            last = last[0], last[1], last[2] + size
        else:
            if last[2]:
                out.append(Match(*last))
            last = x, y, size
    if last[2]:
        out.append(Match(*last))
    return [*out, Match(len(a), len(b), 0)]


def matcher(a: str, b: str) -> SequenceMatcher:
    """SequenceMatcher(None, a, b, autojunk=False) of two texts, whose blocks are found already."""
    out = SequenceMatcher(None, "", "", autojunk=False)
    out.a, out.b, out.matching_blocks = a, b, blocks(a, b)
    return out
