"""Hash-compared suffix sort of many short contexts, and the anchors that pick them.

Two suffixes are compared by the length of their common extension, found by binary search over
prefix polynomial hashes, and by the byte behind it: a logarithmic comparison. The sort is a merge
sort whose merges look up every element's place in the sibling run, for all groups at once. Common
extensions that are used afterwards are verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from sward.llm.common import Text, mix, prefix_hashes, row_prefix_hashes, span_hashes

# Fixed value: the length of the strings that count as repeated.
LENGTH = 200
# Anchors are the least hashed grams of every LENGTH bytes.
GRAM = 64
SIDE = LENGTH - GRAM
_PLACE = np.uint64((1 << 28) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima inside blocks of ``width``."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, context hash, row, place in the row) of the anchors of all texts.

    Every string of LENGTH bytes holds an anchor, chosen by the string alone. The context is all that
    strings around the anchor can reach, cut at the text's ends.
    """
    data, offsets = text.data, text.offsets
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < LENGTH:
        return none
    prefix = prefix_hashes(data)
    begin = np.arange(n - GRAM + 1)
    gram = span_hashes(prefix, begin, begin + GRAM)
    least = sliding_least((gram & ~_PLACE) | begin.astype(np.uint64), SIDE + 1) & _PLACE
    end = np.repeat(offsets[1:], np.diff(offsets))[: n - LENGTH + 1]
    place = least[end - begin[: n - LENGTH + 1] >= LENGTH].astype(np.int64)
    if not len(place):
        return none
    place = place[np.concatenate(([True], place[1:] != place[:-1]))]
    row = np.searchsorted(offsets, place, "right") - 1
    low = np.maximum(offsets[row], place - SIDE)
    high = np.minimum(offsets[row + 1], place + LENGTH)
    return gram[place], mix(span_hashes(prefix, low, high) + (place - low).astype(np.uint64)), row, place - offsets[row]


class Contexts:
    """Contexts as rows of one byte matrix, anchors in column SIDE; ``left`` and ``right`` bytes are real."""

    def __init__(self, group: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray):
        self.group, self.left, self.right, self.rows = group, left, right, rows
        # spans of one column range are compared, so their hashes need no shift to a common place
        self.prefix = row_prefix_hashes(rows)

    def same(self, a, b, size) -> np.ndarray:
        """Whether ``size`` bytes from the anchors on have equal hashes."""
        p, stop = self.prefix, SIDE + size
        return p[a, stop] - p[a, SIDE] == p[b, stop] - p[b, SIDE]

    def strings(self, rows: np.ndarray, back: int) -> np.ndarray:
        """Hashes of the strings that start ``back`` bytes left of the anchors; equal ones share gram and ``back``."""
        inner = self.prefix[rows, SIDE - back + LENGTH] - self.prefix[rows, SIDE - back]
        return mix(mix(inner) + np.uint64(back))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension to the right of the anchors, by binary search."""
        high = np.minimum(self.right[a], self.right[b])
        low = np.zeros(len(a), np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.same(a, b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a sorts before, with or behind suffix b; a text's end sorts first."""
        size = self.extension(a, b)
        x = np.where(size < self.right[a], self.rows[a, np.minimum(SIDE + size, self.rows.shape[1] - 1)].astype(np.int64), -1)
        y = np.where(size < self.right[b], self.rows[b, np.minimum(SIDE + size, self.rows.shape[1] - 1)].astype(np.int64), -1)
        return np.sign(x - y)

    def sort(self) -> np.ndarray:
        """Row numbers by group and suffix: merge sort inside all groups at once."""
        order = np.argsort(self.group, kind="stable")
        named = self.group[order]
        new = np.concatenate(([True], named[1:] != named[:-1])) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while len(size) and width < size.max():
            at = np.flatnonzero(count > width)
            local = at - begin[at]
            run = local // width
            sibling = (run ^ 1) * width
            length = np.clip(count[at] - sibling, 0, width)
            low, high = np.zeros(len(at), np.int64), length.copy()
            mine = order[at]
            strict = run % 2 == 0  # elements of the first run go before equal ones of the second
            while True:
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                middle = (low[todo] + high[todo]) // 2
                other = order[begin[at[todo]] + sibling[todo] + middle]
                sign = self.before(other, mine[todo])
                ahead = np.where(strict[todo], sign < 0, sign <= 0)
                low[todo] = np.where(ahead, middle + 1, low[todo])
                high[todo] = np.where(ahead, high[todo], middle)
            target = begin[at] + np.minimum(run, run ^ 1) * width + (local - run * width) + low
            order = order.copy()
            order[target] = mine
            width *= 2
        return order

    def shared(self) -> np.ndarray:
        """(rows, SIDE + 1) truth: the string that starts that many bytes left of the anchor stands in another row too."""
        n = len(self.group)
        found = np.zeros((n, SIDE + 1), bool)
        if n < 2:
            return found
        order = self.sort()
        a, b = order[:-1], order[1:]
        common = self.extension(a, b)
        # verification: the bytes themselves bound every common extension
        differ = self.rows[a][:, SIDE:] != self.rows[b][:, SIDE:]
        exact = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        common = np.minimum(common, exact)
        common[self.group[a] != self.group[b]] = -1
        left, right = self.left[order], self.right[order]
        for back in range(SIDE + 1):
            cluster = np.concatenate(([0], np.cumsum(common < LENGTH - back)))
            use = np.flatnonzero((left >= back) & (right >= LENGTH - back))
            if len(use) < 2:
                continue
            rows = order[use]
            key = mix(self.prefix[rows, SIDE] - self.prefix[rows, SIDE - back] + mix(cluster[use].astype(np.uint64)))
            by = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
            x, y = by[same], by[same + 1]
            sound = (self.rows[rows[x], SIDE - back : SIDE] == self.rows[rows[y], SIDE - back : SIDE]).all(axis=1) & (cluster[use[x]] == cluster[use[y]])
            if sound.all():
                found[rows[x], back] = found[rows[y], back] = True
            else:  # a hash collision: compare the bytes themselves
                seen: dict[tuple, int] = {}
                for i in range(len(use)):
                    whole = (int(cluster[use[i]]), self.rows[rows[i], SIDE - back : SIDE].tobytes())
                    if whole in seen:
                        found[rows[i], back] = found[seen[whole], back] = True
                    else:
                        seen[whole] = rows[i]
        return found
