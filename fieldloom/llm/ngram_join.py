"""N-gram Jaccard join by size-banded tiles with bitmap signatures.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. Equal
sets are one class. Two sets with a Jaccard similarity of 0.8 or more have sizes
within a quarter of each other and share a shingle among the first fifth of
each, in any common order; the order here puts shingles from rarely used
hash buckets first, so that passages which many documents share make no tiles.

A tile holds the classes with one such shingle. First, each tile's size bands
are compared with one member each, and links are followed to components. Only
tiles in which more than one component is left are compared in full, in blocks,
across components. Every comparison asks the bitmaps first: bits that only one
side has bound the overlap from above. What passes is decided by intersecting
the sorted arrays of hashes.

The result is exact but for hashes: words and shingles are known by 64 bits,
equal sets by their size and two 64-bit digests, tiles of equal members by
their count and a sum of 64-bit hashes. Words of over LONG_WORD bytes are hashed
by a function without algebraic structure, since the polynomial that serves
short ones has made-up collisions of a thousand bytes and more.

Defined results: null and empty texts, and texts of white space only, have an
empty set and link with nothing; a row without id links with nothing and has no
component; rows of equal id count as one document with the links of each, and
each row has its own n_shingles; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meet
from .common import drop_shuffles, mix64, prefix_hashes, release, rows_of, span_hashes, stage_table, text_bytes, texts_of, trim
from .components import components

WORDS = 5
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Hash buckets whose shingles are counted over all rows to order shingles; a fixed size, whatever the input.
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Members of a tile beyond which it is compared as a grid of blocks.
BLOCK = 1024
#: A table of at most so many ids is broadcast; a larger one is joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of a word beyond which it is not hashed as a polynomial.
LONG_WORD = 64
#: Bits of a signature: a power of two at least twice the set's size, within these.
LEAST_BITS, MOST_BITS = 256, 16384

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block of concatenated UTF-8 bytes."""
    n = len(offsets) - 1
    low = _LOWER[data]
    solid = np.zeros(len(low) + 2, bool)
    solid[1:-1] = ~_WHITE[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    stop = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    word = mix64(span_hashes(prefix_hashes(low), start, stop))
    for i in np.flatnonzero(stop - start > LONG_WORD).tolist():
        word[i] = xxhash.xxh3_64_intdigest(low[start[i] : stop[i]].tobytes())
    first = np.searchsorted(start, offsets)  # the first word of each text
    count = np.diff(first)
    out: list[np.ndarray] = [np.zeros(0, U64)] * n
    if len(word) >= WORDS:
        mixed = word[: len(word) - WORDS + 1] * _ODD[0]
        for k in range(1, WORDS):
            mixed = mixed + word[k : len(word) - WORDS + 1 + k] * _ODD[k]
        mixed = mix64(mixed)
    for d in np.flatnonzero(count).tolist():
        a, c = int(first[d]), int(count[d])
        if c >= WORDS:
            out[d] = np.unique(mixed[a : a + c - WORDS + 1])
        else:
            h = U64(c)
            for k in range(c):
                h = h + word[a + k : a + k + 1] * _ODD[k]
            out[d] = mix64(h ^ _ODD[c])
    return out


def prefix_length(n: int) -> int:
    """How many of n shingles, in the common order, must hold one that a similar set has among its own first ones."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def signature(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of a set as 64-bit words: bit h mod width for each hash."""
    bits = LEAST_BITS
    while bits < 2 * len(hashes) and bits < MOST_BITS:
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(hashes & U64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(U64)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """A signature at a smaller width: its halves or-ed together."""
    while len(words) > width:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def could_link(n: int, sig: np.ndarray, others_n: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of others (rows of signatures of one width) the bounds don't exclude.

    Each bit set on one side only stands for an element of that side only, so
    the overlap is at most the size less the bits the other lacks.
    """
    s = sig[None, :]
    most = np.minimum(n - np.bitwise_count(s & ~others).sum(1), others_n - np.bitwise_count(others & ~s).sum(1))
    return DENOMINATOR * most >= NUMERATOR * (n + others_n - most)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct hashes have the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _sets_of(batches, *more):
    """(ids, sets, further columns) of half a megabyte of texts at a time; the columns are id, text and the rest."""
    for batch in batches:
        for part in rows_of(batch):
            yield part.column(0), shingle_sets(*text_bytes(part.column(1))), *(part.column(part.schema.get_field_index(c)) for c in more)
        trim()


def _measure(batches):
    """Size, digest and signature of each set, then the bucket counts of the task's texts."""
    seen = np.zeros(BUCKETS, np.int64)
    for ids, sets, rows in _sets_of(batches, "row"):
        k1, k2, sigs = [], [], []
        for h in sets:
            k1.append(int(np.bitwise_xor.reduce(mix64(h + _ODD[0]).view(np.int64))) if len(h) else 0)
            k2.append(int(np.add.reduce(mix64(h + _ODD[1])).astype(np.int64)) if len(h) else 0)
            sigs.append(signature(h).tobytes() if len(h) else None)
        seen += np.bincount((np.concatenate([np.zeros(0, U64), *sets]) >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, rows, pa.array([len(h) for h in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(len(ids), pa.int32()), none], names=MEASURED)
    used = np.flatnonzero(seen)
    for lo in range(0, len(used), 50_000):
        at = used[lo : lo + 50_000]
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(seen[at])], names=MEASURED)


MEASURED = ["doc_id", "row", "n", "k1", "k2", "sig", "bucket", "seen"]


def _by_range(ranges: int, order):
    """Prefix entries of a task's sets, packed by range of the shingle's hash."""

    def chosen(batches):
        counts = order.value
        for ids, sets in _sets_of(batches):
            for doc, h in zip(ids.to_pylist(), sets, strict=True):
                if len(h):
                    key = (counts[(h >> U64(64 - BUCKET_BITS)).astype(np.int64)].astype(U64) << U64(40)) | (h >> U64(24))
                    yield h[np.argsort(key, kind="stable")[: prefix_length(len(h))]], doc, len(h)

    return lambda batches: meet.packed_stream(ranges, chosen(batches))


def _bounded(batches):
    """Pairs whose bitmaps don't exclude a link; columns a, b, na, nb, sa, sb."""
    for batch in batches:
        na, nb = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        keep = []
        for n, m, x, y in zip(na, nb, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if NUMERATOR * max(n, m) > DENOMINATOR * min(n, m):
                keep.append(False)
                continue
            p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
            w = min(len(p), len(q))
            keep.append(bool(could_link(int(n), fold(p, w), np.array([m]), fold(q, w)[None, :])[0]))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _decided(batches):
    """Pairs whose arrays have the similarity; columns a, b, ha, hb."""
    for batch in batches:
        keep = [similar(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _arrays(batches):
    for ids, sets in _sets_of(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array([h.tobytes() for h in sets], pa.binary())], names=["doc", "h"])


def _across(batches):
    """Pairs of members of different components of a tile that the bounds don't exclude.

    A pair is only given by the tile of the smallest token that both share. Rows
    come sorted by (token, i, j): a tile, or two blocks of a large one; columns 3
    to 8 are side, doc, n, component, sig, tokens.
    """
    held = None
    for batch in batches:
        table = batch if held is None else pa.concat_batches([held, batch])
        key = [np.asarray(table.column(k)) for k in range(3)]
        new = np.ones(len(table), bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
        start = np.flatnonzero(new)
        held = table.slice(int(start[-1]))
        yield from _tiles(table, start)
    if held is not None:
        yield from _tiles(held, np.array([0, len(held)]))


def _tiles(table, start):
    a, b = [], []
    same = [np.asarray(table.column(k)) for k in (1, 2)]
    side, doc, n, comp = (np.asarray(table.column(k)) for k in (3, 4, 5, 6))
    sigs, lists, token = table.column(7), table.column(8), np.asarray(table.column(0))
    for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
            continue
        words = [np.frombuffer(x, U64) for x in sigs.slice(lo, hi - lo).to_pylist()]
        tokens = [np.asarray(x.values) for x in lists.slice(lo, hi - lo)]
        grid = same[0][lo] != same[1][lo]
        by_width: dict[int, np.ndarray] = {}
        for k in range(hi - lo):
            i = lo + k
            with_ = np.arange(lo, i) if not grid else np.arange(lo, hi)
            with_ = with_[(comp[with_] != comp[i]) & (NUMERATOR * n[with_] <= DENOMINATOR * n[i]) & ((NUMERATOR * n[i] <= DENOMINATOR * n[with_]))]
            if grid:
                with_ = with_[(side[with_] != side[i]) & (with_ < i)]
            if not len(with_):
                continue
            w = min([len(words[k])] + [len(words[x - lo]) for x in with_])
            if w not in by_width:
                by_width[w] = np.zeros((hi - lo, w), U64)
                for x in range(hi - lo):
                    if len(words[x]) >= w:
                        by_width[w][x] = fold(words[x], w)
            good = with_[could_link(int(n[i]), by_width[w][k], n[with_], by_width[w][with_ - lo])]
            good = np.array([x for x in good.tolist() if np.intersect1d(tokens[x - lo], tokens[k], assume_unique=True)[0] == token[lo]], np.int64)
            a += [np.minimum(doc[good], doc[i])]
            b += [np.maximum(doc[good], doc[i])]
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _side(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if there are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class representatives that link."""
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    tried = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_bounded, "a long, b long")
    tried = stage_table(tried, "ngram-tried")
    wanted = stage_table(tried.select(F.col("a").alias("doc")).union(tried.select("b")).distinct(), "ngram-wanted")
    arrays = docs.join(_side(wanted), docs["doc_id"] == wanted["doc"], "left_semi").mapInArrow(_arrays, "doc long, h binary")
    arrays = stage_table(arrays, "ngram-arrays")
    both = tried.join(arrays.select(F.col("doc").alias("a"), F.col("h").alias("ha")), "a").join(arrays.select(F.col("doc").alias("b"), F.col("h").alias("hb")), "b")
    links = stage_table(both.select("a", "b", "ha", "hb").mapInArrow(_decided, "a long, b long").distinct(), "ngram-links")
    release(pairs.sparkSession, tried, wanted, arrays)
    return links


def link_documents(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links) for each row."""
    spark = documents.sparkSession
    # A row is known by its id and a hash of its text; that tells rows of one id apart.
    docs = texts_of(documents, id_column).withColumn("row", F.xxhash64("text"))
    measured = stage_table(docs.mapInArrow(_measure, "doc_id long, row long, n long, k1 long, k2 long, sig binary, bucket int, seen long"), "ngram-measured")
    rows = measured.where("bucket is null").select("doc_id", "row", "n", "k1", "k2", "sig")
    able = rows.where("n > 0 and doc_id is not null")
    # Equal sets have equal signatures. A class goes by its smallest id, or by a hash where that id stands for several classes.
    classes = able.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "row")).alias("x"), F.first("sig").alias("sig"))
    classes = stage_table(classes.select("k1", "k2", "n", F.col("x.doc_id").alias("least"), F.col("x.row").alias("least_row"), "sig"), "ngram-first")
    twice = stage_table(classes.groupBy("least").count().where("count > 1").select(F.col("least").alias("twice")), "ngram-twice")
    drop_shuffles(spark)
    named = classes.join(_side(twice), F.col("least") == F.col("twice"), "left").withColumn("doc", F.when(F.col("twice").isNull(), F.col("least")).otherwise(F.xxhash64("least", "least_row"))).drop("twice")
    classes, whole = stage_table(named, "ngram-classes"), classes
    member = able.select("doc_id", "row", "k1", "k2", "n").join(classes.select("k1", "k2", "n", "doc", "least", "least_row"), ["k1", "k2", "n"])
    copies = stage_table(member.where("doc_id != least or row != least_row").select(F.col("doc_id").alias("copy"), F.col("row").alias("copy_row")).distinct(), "ngram-copies")
    # Classes that rows of one id belong to are linked by that id.
    shared_id = member.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a != z").select("doc_id", "a")
    by_id = stage_table(member.join(shared_id, "doc_id").where("doc != a").select("a", F.col("doc").alias("b")).distinct(), "ngram-by-id")
    own = docs.join(_side(copies), (docs["doc_id"] == copies["copy"]) & (docs["row"] == copies["copy_row"]), "left_anti").where("doc_id is not null")
    own = own.join(_side(twice), F.col("doc_id") == F.col("twice"), "left").select(F.when(F.col("twice").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "row")).alias("doc_id"), "text")
    counts = np.zeros(BUCKETS, np.int64)
    for b, n in measured.where("bucket is not null").groupBy("bucket").agg(F.sum("seen")).collect():  # at most BUCKETS rows
        counts[b] = n
    order = spark.sparkContext.broadcast(np.minimum(counts, (1 << 24) - 1).astype(np.uint32))
    entries = classes.agg(F.sum(F.col("n") / DENOMINATOR + 1)).first()[0] or 0
    ranges = max(12, int(entries / meet.RANGE_ENTRIES) + 1)
    packed = own.mapInArrow(_by_range(ranges, order), meet.PACKED)
    live = stage_table(meet.met(packed, "live", ranges, 20_000, meet.live, "token long, doc long, n long"), "ngram-live")
    drop_shuffles(spark)
    # Tiles with the same members would give the same comparisons; one of each lot stays.
    lots = live.groupBy("token").agg(F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("lot"), F.count("*").alias("members"))
    one = lots.groupBy("lot", "members").agg(F.min("token").alias("token")).select("token")
    every = live
    live = stage_table(every.join(one, "token", "left_semi"), "ngram-tiles")
    band = F.floor(F.log("n") / float(np.log(DENOMINATOR / NUMERATOR)))
    leads = live.groupBy("token", band.alias("band")).agg(F.min("doc").alias("a"))
    first = live.withColumn("band", band).join(leads, ["token", "band"]).where("doc != a").select("a", F.col("doc").alias("b")).distinct()
    sets = classes.select("doc", "n", "sig")
    links = _verify(first, sets, own)
    known = stage_table(components(links.unionByName(by_id), "ngram-components"), "ngram-known")
    drop_shuffles(spark)
    # Tiles in which more than one component is left.
    tiles = live.join(known.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    tiles = stage_table(tiles, "ngram-tiles")
    left = tiles.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    left = left.select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    # A pair counts in the tile of its smallest common token; that token is the one that stays of its lot.
    shared = every.groupBy("doc").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    dealt = tiles.join(left, "token").join(sets.select("doc", "sig"), "doc").join(shared, "doc")
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc", "n", "component", "sig", "tokens")
    second = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_across, "a long, b long").distinct()
    more = _verify(second, sets, own)
    drop_shuffles(spark)
    stars = known.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    reach = stage_table(components(stars.unionByName(more), "ngram-components"), "ngram-reach")
    # A component's number is the smallest id of its classes.
    least = reach.join(classes.select(F.col("doc").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = classes.join(reach.join(least, "component").select(F.col("id").alias("doc"), "component_id"), "doc", "left").select("k1", "k2", "n", F.coalesce("component_id", "least").alias("component_id"))
    linked = able.join(by_class, ["k1", "k2", "n"]).select("doc_id", "n", "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = stage_table(linked.unionByName(alone).select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), "component_id"), "ngram-linked")
    release(spark, measured, whole, twice, classes, copies, by_id, every, live, links, known, tiles, more, reach)
    return out


def keep_first(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of documents without those that link, directly or not, to a smaller id; all columns stay, whatever their names.

    Rows of one id stay or go together; a row without id, and one with an empty text, stays.
    """
    linked = link_documents(documents, id_column)
    gone = stage_table(linked.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("__gone")).distinct(), "ngram-gone")
    release(documents.sparkSession, linked)
    gone = _side(gone)
    return documents.join(gone, documents[id_column] == gone["__gone"], "left_anti")


def link_classes(documents: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Every link, as pairs of classes and the documents in them: (a, b) with a < b, and (id, class_id, n_shingles).

    link_documents follows links only until components are known. Here every two
    classes of a tile are compared, block by block, so no link between different
    texts is lost; documents of one class link with each other, and aren't
    expanded into pairs. The work grows with the pairs within tiles that the
    bitmaps can't exclude. Rows without id, and empty texts, are in no class.
    """
    spark = documents.sparkSession
    docs = texts_of(documents, id_column).withColumn("row", F.xxhash64("text"))
    measured = stage_table(docs.mapInArrow(_measure, "doc_id long, row long, n long, k1 long, k2 long, sig binary, bucket int, seen long"), "ngram-measured")
    able = measured.where("bucket is null and n > 0 and doc_id is not null")
    classes = able.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "row")).alias("x"), F.first("sig").alias("sig"))
    classes = stage_table(classes.select("k1", "k2", "n", "x.*", F.xxhash64("x.doc_id", "x.row").alias("class_id"), "sig"), "ngram-classes")
    first = classes.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "class_id")
    own = docs.join(_side(first), (F.col("doc_id") == F.col("__id")) & (F.col("row") == F.col("__row"))).groupBy(F.col("class_id").alias("doc_id")).agg(F.first("text").alias("text"))
    own = stage_table(own, "ngram-texts")
    counts = np.zeros(BUCKETS, np.int64)
    for b, n in measured.where("bucket is not null").groupBy("bucket").agg(F.sum("seen")).collect():  # at most BUCKETS rows
        counts[b] = n
    order = spark.sparkContext.broadcast(np.minimum(counts, (1 << 24) - 1).astype(np.uint32))
    ranges = max(12, int((classes.agg(F.sum(F.col("n") / DENOMINATOR + 1)).first()[0] or 0) / meet.RANGE_ENTRIES) + 1)
    live = stage_table(meet.met(own.mapInArrow(_by_range(ranges, order), meet.PACKED), "live", ranges, 20_000, meet.live, "token long, doc long, n long"), "ngram-live")
    # Of tiles with the same members one stays; a pair counts in the tile of its smallest common token.
    lots = live.groupBy("token").agg(F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("lot"), F.count("*").alias("members"))
    one = lots.groupBy("lot", "members").agg(F.min("token").alias("token"), F.ceil(F.first("members") / BLOCK).cast("int").alias("blocks")).where("members > 1")
    shared = live.groupBy("doc").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    sets = classes.select(F.col("class_id").alias("doc"), "n", "sig")
    dealt = live.join(one.select("token", "blocks"), "token").join(sets.select("doc", "sig"), "doc").join(shared, "doc")
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc", "n", F.col("doc").alias("component"), "sig", "tokens")
    pairs = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_across, "a long, b long").distinct()
    links = _verify(pairs, sets, own)
    members = stage_table(able.join(classes.select("k1", "k2", "n", "class_id"), ["k1", "k2", "n"]).select(F.col("doc_id").alias(id_column), "class_id", F.col("n").alias("n_shingles")).distinct(), "ngram-members")
    release(spark, measured, classes, own, live)
    return links, members


def link_counts(links: DataFrame, members: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_links): how many other documents each one links with directly, from what link_classes gives; a document in several classes counts once in each."""
    size = members.groupBy("class_id").agg(F.count("*").alias("size"))
    both = links.select("a", "b").union(links.select("b", "a")).join(size.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("size").alias("linked"))
    each = size.join(both, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n"))
    return members.join(each, "class_id").groupBy(id_column).agg(F.sum("n").alias("n_links"))
