"""How the sources of a language diverge in their terms, by corrections to a baseline.

The divergence of two sources is a sum over all terms that their language keeps,
most of which neither has. So each pair starts at V times the divergence of two
zero counts, and postings (a term's sources with their counts) add what differs
from that. A correction falls into three parts: what a count of the one source
adds where the other has none, the same the other way round, and what is left
where both have the term. The first two depend on the count alone, so a source's
numbers of terms by count give them for every other source; the third is summed
by the tasks over the postings before anything is shuffled.

All arithmetic is exact: integers, and decimals where a product or a sum may
pass 64 bits. Defined results: null text, lang and source count as ''; a text
without terms still makes its group; a language without kept terms has pairs of
value 0 and no terms; a language with one source has no pairs; repeated rows are
each a document; an empty table gives no rows; extra columns are ignored. Memory
of a task grows with its longest text and with the sources of one term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, bounded_batches, rows_of, stage_table, text_bytes, trim
from .words import LOWER, Sums, as_array, byte_class, ends_of, runs

#: A term is a run of letters and of characters beyond ASCII.
TERM = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: A language keeps terms of so many documents; shares are counted in so many parts; ranks of terms go so far.
LEAST_DOCS, PARTS, TOP = 3, 1_000_000_000, 200
#: Pairs of postings that a task takes at once.
PAIRS = 1 << 19


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs, summed within tasks: occurrences, and documents that have the term."""
    schema = pa.schema([("lang", pa.large_string()), ("source", pa.large_string()), ("term", pa.large_string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["lang", "source", "term"], ["n", "docs"], schema)
        for batch in batches:
            for part in rows_of(batch, BATCH_BYTES):
                data, offsets = text_bytes(part.column(2))
                inside = TERM[data]
                starts, ends, rows = runs(data, offsets, inside)
                if not len(starts):
                    continue
                coded = as_array(LOWER[data[inside]], ends_of(ends - starts), pa.large_string()).dictionary_encode()
                terms, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                group = pa.chunked_array([pa.StructArray.from_arrays([part.column(0), part.column(1)], ["lang", "source"])]).combine_chunks()
                names, groups = _distinct(group)
                # Each (document, term), then each (group, term) of those.
                pairs, n = np.unique(rows * size + terms, return_counts=True)
                key = groups[pairs // size] * size + pairs % size
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                of, term = key[first] // size, key[first] % size
                columns = [names[0].take(pa.array(of)), names[1].take(pa.array(of)), coded.dictionary.take(pa.array(term)), np.add.reduceat(n, first), np.diff(np.r_[first, len(key)])]
                yield from sums.add([pa.array(c, t) if isinstance(c, np.ndarray) else c.cast(t) for c, t in zip(columns, schema.types, strict=True)])
        yield from sums.rest()
        trim()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _distinct(pairs: pa.StructArray) -> tuple[list[pa.Array], np.ndarray]:
    """The distinct pairs as two arrays, and each row's place among them."""
    a, b = (pairs.field(i).dictionary_encode() for i in range(2))
    key = a.indices.to_numpy().astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy()
    seen, groups = np.unique(key, return_inverse=True)
    return [a.dictionary.take(pa.array(seen // max(1, len(b.dictionary)))), b.dictionary.take(pa.array(seen % max(1, len(b.dictionary))))], groups


def share(count: Column, total: Column, parts: int = PARTS) -> Column:
    """1 + floor(parts * (count + 1) / total), exactly; null without a total."""
    whole = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(parts).cast("decimal(10,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)"))
    return whole + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of two shares; the square of shares of PARTS parts fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def shared_corrections(postings: DataFrame) -> DataFrame:
    """lang, source, other, value: what terms that both sources have add to the corrections of either count.

    postings: lang and posts, an array of (source, p, p0): the share of its count
    and of a zero count. Each task sums by pair before it hands sums on.
    """
    schema = pa.schema([("lang", pa.large_string()), ("source", pa.large_string()), ("other", pa.large_string()), ("value", pa.int64())])
    at_once = PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["lang", "source", "other"], ["value"], schema)
        for batch in batches:
            posts = batch.column(1)
            sizes = np.diff(posts.offsets.to_numpy())
            flat = posts.flatten()
            names, sources = _distinct(pa.StructArray.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), sizes))), flat.field(0)], ["lang", "source"]))
            p, p0 = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            # Each posting meets all postings of its term, itself left out; so many at a time.
            begin, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
            meets = ends_of(size)
            at = 0
            while at < len(size):
                stop = max(at + 1, int(np.searchsorted(meets, meets[at] + at_once, side="right")) - 1)
                a = np.repeat(np.arange(at, stop), size[at:stop])
                b = np.repeat(begin[at:stop] - meets[at:stop] + meets[at], size[at:stop]) + np.arange(len(a))
                a, b = a[a != b], b[a != b]
                value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
                key = sources[a] * len(names[0]) + sources[b]
                order = np.argsort(key, kind="stable")
                key, value, at = key[order], value[order], stop
                if len(key):
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    x, y = key[first] // len(names[0]), key[first] % len(names[0])
                    columns = [names[0].take(pa.array(x)), names[1].take(pa.array(x)), names[1].take(pa.array(y)), pa.array(np.add.reduceat(value, first))]
                    yield from sums.add([c.cast(t) for c, t in zip(columns, schema.types, strict=True)])
        yield from sums.rest()

    return postings.select("lang", "posts").mapInArrow(run, "lang string, source string, other string, value long")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, parts: int = PARTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: of each source its divergence from every other, and its telling terms."""
    narrow = bounded_batches(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    # One exchange by term serves both sums.
    counted = term_counts(narrow).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stage_table(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posts")).where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
    cells = kept.select("lang", "term", F.inline("posts"))

    # One row a group: the terms that its language keeps, and its share of a count.
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("posts", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.n).cast("decimal(38,0)"))).alias("lang_n"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = narrow.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    total = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long") + F.col("terms")
    groups = stage_table(groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce(total("n"), F.lit(0)).alias("total"), F.coalesce(total("lang_n"), F.lit(0)).alias("lang_total")).withColumn("p0", share(F.lit(0), F.col("total"), parts)), "divergence-groups")
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))

    # Postings with their shares; a language's groups come to its terms as one array of totals.
    known = groups.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "p0")))).alias("of"))
    with_share = lambda x: F.struct(x.source.alias("source"), share(x.n, F.col("of")[x.source].total, parts).alias("p"), F.col("of")[x.source].p0.alias("p0"))
    shared = shared_corrections(kept.join(known, "lang").select("lang", F.transform("posts", with_share).alias("posts")))

    # What counts of the one source add where the other has none, from its numbers of terms by count.
    by_count = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups.select("lang", "source", "total", "p0"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), parts))
    against = by_count.join(other, "lang").where(F.col("source") != F.col("other"))
    times = lambda x, y: (F.col("terms").cast("decimal(18,0)") * (x - y).cast("decimal(19,0)")).alias("value")
    ahead = against.select("lang", "source", "other", times(divergence(F.col("p"), F.col("q0")), divergence(F.col("p0"), F.col("q0"))))
    back = against.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), times(divergence(F.col("q0"), F.col("p")), divergence(F.col("q0"), F.col("p0"))))
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("other"))
    baseline = pairs.select("lang", "source", "other", F.coalesce(times(divergence(F.col("p0"), F.col("q0")), F.lit(0)), F.lit(0)).alias("value"))
    summed = baseline.unionByName(ahead).unionByName(back).unionByName(shared.withColumn("value", F.col("value").cast("decimal(38,0)"))).groupBy("lang", "source", "other").agg(exact("value").alias("value"))
    pair = summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.col("value").cast("long").alias("value"))

    # A term against its language: how often all sources have it stands in its postings.
    whole = F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s + x.n)
    term = kept.select("lang", "term", whole.alias("lang_n"), F.inline("posts")).join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    term = term.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), share(F.col("n"), F.col("total"), parts).alias("p"), share(F.col("lang_n"), F.col("lang_total"), parts).alias("q"))
    term = term.where(F.col("p") > F.col("q")).select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))
