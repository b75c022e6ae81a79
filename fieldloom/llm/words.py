"""Words of text columns as flat byte buffers: where they stand, their bytes, distinct ones and their counts.

A word is a run of bytes of a class that holds every byte of a multi-byte
character or none, so words begin and end at characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Rows that a task gathers before it hands them on.
HELD_ROWS = 400_000


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that tells which bytes lie in one of the ranges, ends included."""
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs where inside holds, none of which goes beyond its row's offsets."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def as_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array over contiguous bytes, without a copy."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def ends_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of data[start:end] one after another, and their offsets."""
    offsets = ends_of(ends - starts)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return data[at], offsets


def values(array: pa.Array) -> list[bytes]:
    """The values of a large binary array; faster than its own way to a list."""
    if not len(array):
        return []
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1].tolist()
    data = memoryview(array.buffers()[2])[offsets[0] : offsets[-1]].tobytes()
    base = offsets[0]
    return [data[a - base : b - base] for a, b in zip(offsets, offsets[1:], strict=False)]


class Sums:
    """Counts by key columns that a task sums up before it hands them on.

    Parts are merged when they hold so many rows; what is then still more than
    half of that is handed on, so memory stays bounded whatever the keys are.
    """

    def __init__(self, keys: list[str], counts: list[str], schema: pa.Schema, held: int = HELD_ROWS):
        self.keys, self.counts, self.schema, self.held = keys, counts, schema, held
        self.parts: list[pa.Table] = []
        self.rows = 0

    def _merged(self) -> pa.Table:
        out = pa.concat_tables(self.parts).group_by(self.keys).aggregate([(c, "sum") for c in self.counts])
        return pa.table([out[k] for k in self.keys] + [out[f"{c}_sum"] for c in self.counts], schema=self.schema)

    def add(self, columns: list) -> list[pa.RecordBatch]:
        part = pa.table(columns, schema=self.schema)
        self.parts.append(part)
        self.rows += len(part)
        if self.rows < self.held:
            return []
        whole = self._merged()
        if len(whole) > self.held // 2:
            self.parts, self.rows = [], 0
            return whole.to_batches(max_chunksize=50_000)
        self.parts, self.rows = [whole], len(whole)
        return []

    def rest(self) -> list[pa.RecordBatch]:
        out = self._merged().to_batches(max_chunksize=50_000) if self.rows else []
        self.parts, self.rows = [], 0
        return out
