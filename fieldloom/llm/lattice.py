"""Near-duplicate embeddings by lattice hashing.

Each table projects unit vectors onto 8 random orthonormal directions, scales
them and decodes them to the nearest point of the lattice E8. A vector stands
in the cell of that point and in the cells of the neighbouring points that lie
nearest to it. Vectors of equal label that share a cell are compared by cosine
in double precision, in blocks.

Equal vectors of one label are one class with a count. A pair that shares
several cells is counted only in the smallest of them, so counts are exact for
the pairs found, and only sums and a star per group leave a task.

Defined results: a vector that is null, zero, or has null or non-finite
components, and one with a null label or id, links with nothing; vectors of
different length have different labels in effect; repeated rows, and rows of
one id, are vectors of their own and link with each other; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, release, stage_table
from .components import components

LEAST_COSINE = 0.93
TABLES, NEIGHBOURS, SCALE, SEED = 8, 3, 7.0, 20260102
#: SCALE is for vectors of length 64; eight directions hold a larger share of a shorter one.
#: Members of a cell beyond which it is compared as a grid of blocks.
BLOCK = 2048
#: Pairs whose cells are compared at once.
PAIRS = 20_000


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and mend an odd sum where rounding was worst."""
    near = np.rint(x)
    gap, row = x - near, np.arange(len(x))
    worst = np.abs(gap).argmax(1)
    odd = near.sum(1) % 2 != 0
    near[row, worst] += np.where(odd, np.where(gap[row, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even integer points and those moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(x: np.ndarray, labels: np.ndarray, tables: int = TABLES, neighbours: int = NEIGHBOURS, scale: float = SCALE) -> np.ndarray:
    """Sorted 64-bit codes of the tables * (1 + neighbours) cells of each unit vector."""
    rng, roots, out = np.random.default_rng(SEED), shortest_vectors(), []
    width = x.shape[1]
    for t in range(tables):
        basis = np.linalg.qr(rng.normal(size=(max(width, 8), 8)))[0][:width]
        y = x @ basis * scale * (width / 64) ** 0.5
        point = nearest_e8(y)
        order = np.argsort(-((y - point) @ roots.T), axis=1, kind="stable")[:, :neighbours]
        around = np.concatenate([point[:, None, :], point[:, None, :] + roots[order]], axis=1)
        code = np.full(around.shape[:2], t + 1000 * width, np.uint64) + labels.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8):
            code = mix64(code ^ np.rint(2 * around[:, :, k]).astype(np.int64).astype(np.uint64))
        out.append(code)
    return np.sort(np.concatenate(out, axis=1).view(np.int64), axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; the largest component goes first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column.to_pylist()]


def _hash_classes(batches):
    """(rep, label, n, v) to the same with codes; vectors that link with nothing have been left out before."""
    for batch in batches:
        labels, rows = np.asarray(batch.column(1)), _vectors(batch.column(3))
        codes: list = [None] * len(rows)
        for width in {len(r) for r in rows}:
            at = [i for i, r in enumerate(rows) if len(r) == width]
            x = np.vstack([rows[i] for i in at])
            got = cells(unit(x), labels[at])
            for i, c in zip(at, got, strict=True):
                codes[i] = c
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(codes, pa.list_(pa.int64()))], names=["rep", "label", "n", "v", "codes"])


def links_within(cell: int, x: np.ndarray, codes: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of unit vectors with cosine of at least least whose smallest common cell is this one."""
    a_out, b_out = [], []
    rows = max(1, 4_000_000 // len(x))
    for lo in range(0, len(x), rows):
        s = x[lo : lo + rows] @ x.T
        a, b = np.nonzero(s >= least)
        a += lo
        good = a < b
        if side is not None:
            good &= side[a] != side[b]
        a, b = a[good], b[good]
        for k in range(0, len(a), PAIRS):
            p, q = a[k : k + PAIRS], b[k : k + PAIRS]
            u, w = codes[p], codes[q]
            shared = (u[:, :, None] == w[:, None, :]).any(2)
            first = np.where(shared, u, np.iinfo(np.int64).max).min(1) == cell
            a_out.append(p[first])
            b_out.append(q[first])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a_out]), np.concatenate([none, *b_out])


def stars(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n members the smallest id that it reaches by pairs."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            return low
        low = new


def _compare(least: float):
    def run(batches):
        held = None
        for batch in batches:
            table = batch if held is None else pa.concat_batches([held, batch])
            key = [np.asarray(table.column(i)) for i in range(3)]
            new = np.ones(len(table), bool)
            new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            start = np.flatnonzero(new)
            held = table.slice(int(start[-1]))  # the last group may go on
            yield from groups(table.slice(0, int(start[-1])), start)
        if held is not None:
            yield from groups(held, np.array([0, len(held)]))

    def groups(table, start):
        out = []
        for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            part = table.slice(lo, hi - lo)
            cell, i, j = (part.column(k)[0].as_py() for k in range(3))
            ids, n = np.asarray(part.column(4)), np.asarray(part.column(5))
            widths, labels = pc_lengths(part.column(6)), np.asarray(part.column(8))
            # A cell's code is a hash: of vectors that differ in length or label, each kind is compared by itself.
            kinds = sorted(set(zip(widths.tolist(), labels.tolist(), strict=True)))
            for width, label in kinds:
                at = np.flatnonzero((widths == width) & (labels == label))
                own = part if len(kinds) == 1 else part.take(pa.array(at))
                x = unit(np.asarray(own.column(6).flatten(), np.float64).reshape(len(at), -1))
                codes = np.asarray(own.column(7).flatten()).reshape(len(at), -1)
                a, b = links_within(cell, x, codes, np.asarray(own.column(3)) if i != j else None, least)
                if len(a):
                    add = np.bincount(a, weights=n[at][b], minlength=len(at)) + np.bincount(b, weights=n[at][a], minlength=len(at))
                    has = add > 0
                    out.append((ids[at][has], stars(len(at), a, b, ids[at])[has], add[has].astype(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "star", "add"])

    return run


def pc_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.list_value_length(column))


def link_embeddings(embeddings: DataFrame, least: float = LEAST_COSINE, id_column: str = "vec_id") -> DataFrame:
    """id, n_links, component_id and kept for each row."""
    spark = embeddings.sparkSession
    # Vectors travel as they are given, floats or doubles, and are compared as doubles.
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = bounded_batches(embeddings).select(F.col(id_column).cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("links", finite & F.col("label").isNotNull() & F.col("id").isNotNull())
    # + 0.0 makes a negative zero a zero, so that equal vectors group.
    able = rows.where("links").withColumn("v", F.transform("v", lambda c: c + F.lit(0.0).cast(kind)))
    key = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)
    able = able.withColumn("key", F.unhex(key))
    first = stage_table(able.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "lattice-first")
    # A class goes by its smallest id, or by a hash where that id stands for several classes.
    twice = first.groupBy("least").count().where("count > 1").select(F.col("least").alias("twice"))
    named = first.join(twice, F.col("least") == F.col("twice"), "left").withColumn("rep", F.when(F.col("twice").isNull(), F.col("least")).otherwise(F.xxhash64("key"))).drop("twice")
    classes = stage_table(named, "lattice-classes")
    hashed = stage_table(classes.select("rep", "label", "n", "v").mapInArrow(_hash_classes, f"rep long, label long, n long, v array<{kind}>, codes array<long>"), "lattice-codes")
    # Only the ids meet first; vectors go to cells that hold several of them.
    entries = hashed.select(F.explode("codes").alias("cell"), "rep")
    counts = entries.groupBy("cell").count().where("count > 1").select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    live = entries.join(counts, "cell").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = live.join(hashed, "rep").select("cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "n", "v", "codes", "label")
    compared = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_compare(least), "rep long, star long, add long")
    compared = stage_table(compared, "lattice-links")
    links = compared.groupBy("rep").agg(F.sum("add").alias("links_of_class"))
    reached = stage_table(components(compared.select(F.col("rep").alias("a"), F.col("star").alias("b")), "lattice-components"), "lattice-reach")
    reach = reached.select(F.col("id").alias("rep"), "component")
    # A component's number is the smallest id of its classes.
    least_id = reach.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = classes.select("key", "rep", "n", "least").join(links, "rep", "left").join(reach.join(least_id, "component").select("rep", "component_id"), "rep", "left")
    by_class = by_class.select("key", (F.coalesce("links_of_class", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = able.select("id", "key").join(by_class, "key").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("links")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    out = stage_table(both.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), "lattice-linked")
    release(spark, first, classes, hashed, compared, reached)
    return out
