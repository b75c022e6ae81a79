"""One large JSON document, an object by key or an array of records, read by many tasks and written by many.

A document is cut by its reader at a character that ends small values, so that a
file's blocks go to different tasks. What a byte means depends on all bytes
before it, but of a block only this matters: whether it leaves a string open,
how deep it ends, and how many commas stand at each depth, for either case of
how it begins. So one pass sums up each block in one row, the rows are put
together in order, and a second pass, which then knows how each block begins,
cuts the entries; one that crosses blocks is put together from its pieces.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UP, _DOWN, _COMMA, _QUOTE, _BACK = (np.frombuffer(x, np.uint8) for x in (b"{[", b"}]", b",", b'"', b"\\"))


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of structural characters, how many quotes stand before each, and how each changes the depth; quotes that are escaped don't count."""
    at = np.arange(len(data))
    back = data == _BACK[0]
    quote = data == _QUOTE[0]
    if back.any():
        # A quote is escaped if an odd number of backslashes stands right before it.
        last = np.maximum.accumulate(np.where(back, -1, at))
        quote[1:] &= (at[1:] - 1 - last[:-1]) % 2 == 0
    change = np.isin(data, _UP).astype(np.int64) - np.isin(data, _DOWN)
    places = np.flatnonzero((change != 0) | (data == _COMMA[0]))
    return places, np.cumsum(quote)[places], change[places]


def _blocks(batches: Iterator[pa.RecordBatch], end: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(file, start of block, bytes) of stretches of rows, in order; what the reader cut off is put back."""
    for batch in batches:
        files, starts, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        first = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], starts[i]) != (files[first], starts[first]):
                yield files[first], starts[first], b"".join(v.encode() + end for v in values[first:i])
                first = i


def _summaries(raw: DataFrame, end: bytes) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """How each block begins: within a string, how deep, after how many commas between entries. One row per block comes to the driver."""

    def run(batches):
        seen: dict[tuple[str, int], list] = {}
        for file, start, data in _blocks(batches, end):
            own = seen.setdefault((file, start), [0, [0, 0], [Counter(), Counter()]])
            flat = np.frombuffer(data, np.uint8)
            places, quotes, change = _tokens(flat)
            for case in (0, 1):
                real = (quotes + own[0] + case) % 2 == 0
                depth = own[1][case] + np.cumsum(np.where(real, change, 0))
                comma = real & (flat[places] == _COMMA[0])
                own[2][case].update(dict(zip(*(x.tolist() for x in np.unique(depth[comma], return_counts=True)), strict=True)))
                own[1][case] = int(depth[-1]) if len(depth) else own[1][case]
            own[0] += _quotes(flat)
        rows = [[*k, v[0] % 2, *v[1], *(json.dumps(c) for c in v[2])] for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["file", "start", "odd", "d0", "d1", "c0", "c1"])

    found = defaultdict(list)
    for r in raw.mapInArrow(run, "file string, start long, odd int, d0 long, d1 long, c0 string, c1 string").collect():
        found[r.file].append(r)
    begins = {}
    for file, blocks in found.items():
        inside, depth, commas = 0, 0, 0
        for r in sorted(blocks, key=lambda r: r.start):
            begins[file, r.start] = (bool(inside), depth, commas)
            counts = json.loads(r.c1 if inside else r.c0)
            commas += counts.get(str(1 - depth), 0)
            depth += r.d1 if inside else r.d0
            inside = (inside + r.odd) % 2
    return begins


def _quotes(data: np.ndarray) -> int:
    quote = data == _QUOTE[0]
    back = data == _BACK[0]
    if back.any():
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(back, -1, at))
        quote[1:] &= (at[1:] - 1 - last[:-1]) % 2 == 0
    return int(quote.sum())


def entries(spark: SparkSession, path: str, end: str = "}") -> DataFrame:
    """(file, place, text) of the entries of JSON documents: the members of an object, or the elements of an array, one row each.

    end is the bracket at which the reader cuts: one that closes small values, so
    that no stretch between two of them is too large for a row. An entry must fit
    a row. Documents without entries have no rows.
    """
    if end not in ("}", "]"):
        raise ValueError("a document is cut at a closing bracket")
    raw = spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    mark = end.encode()
    begins = _summaries(raw, mark)

    def run(batches):
        state: dict = {}
        for file, start, data in _blocks(batches, mark):
            if state.get("block") != (file, start):
                inside, depth, place = begins[file, start]
                state = {"block": (file, start), "quotes": int(inside), "depth": depth, "place": place, "part": 0}
            flat = np.frombuffer(data, np.uint8)
            places, quotes, change = _tokens(flat)
            real = (quotes + state["quotes"]) % 2 == 0
            places, change = places[real], change[real]
            depth = state["depth"] + np.cumsum(change)
            comma = (change == 0) & (depth == 1)
            opens, closes = (change > 0) & (depth == 1), (change < 0) & (depth == 0)
            out, begin = [], 0 if state["depth"] >= 1 else None
            for k in np.flatnonzero(comma | opens | closes):
                at = int(places[k])
                if begin is not None:
                    out.append((state["place"], data[begin:at]))
                begin = None if closes[k] else at + 1
                state["place"] += int(comma[k])
            if begin is not None:
                out.append((state["place"], data[begin:]))
            state["quotes"] += _quotes(flat)
            state["depth"] = int(depth[-1]) if len(depth) else state["depth"]
            if out:
                n = len(out)
                parts = range(state["part"], state["part"] + n)
                state["part"] += n
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([o[0] for o in out], pa.int64()), pa.array([start] * n, pa.int64()), pa.array(parts, pa.int64()), pa.array([o[1].decode() for o in out], pa.string())], names=["file", "place", "start", "part", "text"])

    pieces = raw.mapInArrow(run, "file string, place long, start long, part long, text string")
    whole = pieces.groupBy("file", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "text"))), lambda p: p["text"]), "").alias("text"))
    return whole.withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).where("text <> ''")


def members(spark: SparkSession, path: str, value: str, end: str = "}") -> DataFrame:
    """(file, place, key, value) of JSON objects, value of a type given as a schema string; of a key that stands twice both."""
    parsed = F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), f"map<string,{value}>")
    return entries(spark, path, end).select("file", "place", F.explode(parsed).alias("key", "value"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON arrays, with file and place."""
    return entries(spark, path).select("file", "place", F.from_json("text", schema).alias("r")).select("file", "place", "r.*")
