"""Boxes that meet, found by cells of a grid over each image, for Arrow batches of many images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs within cells that are held at once.
PAIRS = 1 << 21


class Grid:
    """A grid over each image's boxes, whose cells are about as large as its boxes and at most as many a side as the root of their number."""

    def __init__(self, image: np.ndarray, x1, y1, x2, y2):
        self.image, self.box = image, (x1, y1, x2, y2)
        n = int(image.max(initial=-1)) + 1
        self.low, high = np.full((2, n), np.inf), np.full((2, n), -np.inf)
        sides = [(np.minimum(a, b), np.maximum(a, b)) for a, b in ((x1, x2), (y1, y2))]
        for i, (lo, hi) in enumerate(sides):
            np.minimum.at(self.low[i], image, lo)
            np.maximum.at(high[i], image, hi)
        count = np.maximum(np.bincount(image, minlength=n), 1)
        mean = np.bincount(image, np.maximum(sides[0][1] - sides[0][0], sides[1][1] - sides[1][0]), minlength=n) / count
        self.side = np.maximum(np.maximum(mean, np.where(np.isfinite(high), high - self.low, 0.0).max(0) / np.sqrt(count)), 1e-9)
        self.first, self.last = ([self._cell(i, s[k]) for i, s in enumerate(sides)] for k in (0, 1))

    def _cell(self, axis: int, value: np.ndarray, image: np.ndarray | None = None) -> np.ndarray:
        image = self.image if image is None else image
        return np.floor((value - self.low[axis][image]) / self.side[image]).astype(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Box and cell of each cell that a box touches."""
        wide, high = (self.last[i] - self.first[i] + 1 for i in (0, 1))
        many = wide * high
        box = np.repeat(np.arange(len(many)), many)
        k = np.arange(len(box)) - np.repeat(np.cumsum(many) - many, many)
        return box, self.first[0][box] + k // high[box], self.first[1][box] + k % high[box]

    def meeting(self) -> tuple[np.ndarray, np.ndarray]:
        """Each two boxes of an image that share some area, once: the earlier and the later one."""
        box, cx, cy = self.entries()
        order = np.lexsort((box, cy, cx, self.image[box]))
        box, cx, cy = box[order], cx[order], cy[order]
        new = np.r_[True, (np.diff(cx) != 0) | (np.diff(cy) != 0) | (np.diff(self.image[box]) != 0)] if len(box) else np.zeros(0, bool)
        end = np.append(np.flatnonzero(new), len(box))[np.cumsum(new)] if len(box) else np.zeros(0, np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part, later in _stretches(end - np.arange(len(box)) - 1):
            a = np.repeat(part, later)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
            # A pair counts in the first cell that both touch.
            i, j = box[a], box[b]
            once = (cx[a] == np.maximum(self.first[0][i], self.first[0][j])) & (cy[a] == np.maximum(self.first[1][i], self.first[1][j]))
            i, j = i[once], j[once]
            x1, y1, x2, y2 = self.box
            real = (x1[i] < x2[j]) & (x1[j] < x2[i]) & (y1[i] < y2[j]) & (y1[j] < y2[i])
            found.append((i[real], j[real]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def holding(self) -> tuple[np.ndarray, np.ndarray]:
        """Each box with each other one of its image whose centre lies in it or on its border."""
        x1, y1, x2, y2 = self.box
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        box, cx, cy = self.entries()
        px, py = self._cell(0, mx), self._cell(1, my)
        order = np.lexsort((py, px, self.image))
        keys = np.empty(len(box) + len(order), [("i", np.int64), ("x", np.int64), ("y", np.int64)])
        keys["i"], keys["x"], keys["y"] = np.r_[self.image[box], self.image[order]], np.r_[cx, px[order]], np.r_[cy, py[order]]
        code = np.unique(keys, return_inverse=True)[1]
        cell, points = code[: len(box)], code[len(box) :]
        begin, stop = np.searchsorted(points, cell, side="left"), np.searchsorted(points, cell, side="right")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part, many in _stretches(stop - begin):
            a = np.repeat(part, many)
            b = order[np.repeat(begin[part], many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)]
            i = box[a]
            inside = (i != b) & (mx[b] >= x1[i]) & (mx[b] <= x2[i]) & (my[b] >= y1[i]) & (my[b] <= y2[i])
            found.append((i[inside], b[inside]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stretches(many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and how many partners each has, about PAIRS pairs at a time."""
    ends, start = np.cumsum(many), 0
    while start < len(many):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        yield np.arange(start, stop), many[start:stop]
        start = stop


def area(x1, y1, x2, y2) -> np.ndarray:
    return np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)


def shared(box: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Area that two boxes share."""
    x1, y1, x2, y2 = box
    return area(np.maximum(x1[i], x1[j]), np.maximum(y1[i], y1[j]), np.minimum(x2[i], x2[j]), np.minimum(y2[i], y2[j]))
