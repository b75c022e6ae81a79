"""Which tokens do rows of several documents share: entries packed by range of a token's hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, trim

U64 = np.uint64
PACKED = "r int, live boolean, tokens binary, docs binary, sizes binary"
#: Entries that one reducer should get, and that a task holds before it hands them on.
RANGE_ENTRIES, FLUSH_ENTRIES = 600_000, 250_000
#: Groups over which what is settled already is dealt within each range, so that a token of very many documents lands in no one task.
SALTS = 8


def range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Mixed once more first: tokens that were chosen as least hashes would crowd the lowest ranges."""
    return ((mix64(tokens) >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int32)


def rows_by_range(r: np.ndarray, columns: list[np.ndarray]):
    """(range, bytes of each column) for entries that come sorted by range."""
    at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]).tolist() if len(r) else []
    for lo, hi in zip(at, [*at[1:], len(r)], strict=False):
        yield int(r[lo]), [c[lo:hi].tobytes() for c in columns]


def pack(ranges: int, tokens: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """A task's entries, packed by range.

    Of a token that several of the task's documents share, all entries are
    known to be live and only one is sent to meet other tasks' entries, so no
    token sends more entries than there are tasks.
    """
    o = np.lexsort((docs, tokens))
    t, d, s = tokens[o], docs[o], sizes[o]
    new = np.r_[True, t[1:] != t[:-1]][: len(t)]
    keep = new | np.r_[True, d[1:] != d[:-1]]
    t, d, s, new = t[keep], d[keep], s[keep], new[keep]
    first = np.flatnonzero(new)
    many = np.diff(np.r_[first, len(t)])
    several = np.repeat(many > 1, many)
    rows = []
    # The sign of the size tells that this entry has been handed on as live already.
    for live, at, size in ((True, np.flatnonzero(several), s), (False, first, np.where(several, -s, s))):
        r = range_of(t[at], ranges)
        o = np.lexsort((d[at], r))  # equal documents together, which the shuffle's compression likes
        at = at[o]
        rows += [(k, live, *c) for k, c in rows_by_range(r[o], [t[at], d[at], size[at].astype(np.int32)])]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["r", "live", "tokens", "docs", "sizes"])


def packed_stream(ranges: int, entries):
    """Batches of packed entries from (tokens, doc, size) of one document after another."""
    tokens, docs, sizes, held = [], [], [], 0
    for t, doc, size in entries:
        tokens.append(t)
        docs.append(np.full(len(t), doc, np.int64))
        sizes.append(np.full(len(t), size, np.int32))
        held += len(t)
        if held >= FLUSH_ENTRIES:
            yield pack(ranges, np.concatenate(tokens), np.concatenate(docs), np.concatenate(sizes))
            tokens, docs, sizes, held = [], [], [], 0
    if held:
        yield pack(ranges, np.concatenate(tokens), np.concatenate(docs), np.concatenate(sizes))


def met(packed: DataFrame, settled: str, ranges: int, most: int, reduce, schema: str) -> DataFrame:
    """reduce() over each range of packed rows; rows whose flag settled is set need no company and are dealt apart.

    Of a token, only entries that aren't settled meet in one task, and those are
    at most one of each hand-over of a task.
    """
    salt = F.when(F.col(settled), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    return packed.withColumn("salt", salt).repartition(min(ranges, most), "r", "salt").groupBy("r", "salt").applyInArrow(reduce, schema)


def unpack(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist())])


def live(table: pa.Table) -> pa.Table:
    """The entries of one range whose token more than one document has."""
    sent, known = table.filter(pc.invert(table.column("live"))), table.filter(table.column("live"))
    t, d, s = unpack(sent, "tokens", U64), unpack(sent, "docs", np.int64), unpack(sent, "sizes", np.int32)
    o = np.argsort(t, kind="stable")
    t, d, s = t[o], d[o], s[o]
    # Two entries of one document (from two of a task's hand-overs) don't make a token live.
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    many = np.diff(np.r_[first, len(t)])
    several = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) if len(t) else np.zeros(0, bool)
    keep = np.repeat(several, many) & (s > 0)
    t = np.concatenate([t[keep], unpack(known, "tokens", U64)])
    d = np.concatenate([d[keep], unpack(known, "docs", np.int64)])
    s = np.abs(np.concatenate([s[keep], unpack(known, "sizes", np.int32)]))
    trim()
    return pa.table({"token": pa.array(t.view(np.int64)), "doc": pa.array(d), "n": pa.array(s.astype(np.int64))})
