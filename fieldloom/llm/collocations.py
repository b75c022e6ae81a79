"""Phrases whose words stand together far more often than their parts would by chance.

Rows of n-grams are aggregated per language. A phrase of 100 places has parts
of 100 places or more, so the n-grams that become rows are pruned first, level
by level: tasks hash the n-grams whose parts may be frequent, the hashes are
summed as rows, and those that reach the threshold set bits of a filter of fixed
size, which goes to every task of the next level. What the filter lets through
is then exploded as text and counted exactly, so hashes and a filter that fills
up cost work and never change a count. Prefix and suffix counts are joined,
scores are decimals, phrases are dropped by an anti-join with their one-word
extensions, and ranks come from windows.

If a longer candidate holds a phrase at as many places, so does the phrase's
extension by one word towards it, as that stands at no more places than the
phrase and no fewer than the longer one.

Defined results: null text counts as empty, null lang as ``und``; words and
phrases end at their document; repeated rows are each counted; an empty table
gives no rows; extra columns are ignored. Memory of a task grows with its
longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, U64, bounded_batches, mix64, prefix_hashes, rows_of, span_hashes, stage_table, text_bytes, trim
from .words import LOWER, Sums, as_array, byte_class, ends_of, gather, runs

#: Longest phrase, least places, rows of a language in the result.
LONGEST, LEAST, TOP = 5, 100, 2000
#: The filter has 2 ** BITS bits, 16 MB, whatever the data.
BITS = 27
#: Bits of a hash by which n-grams are summed; fewer than 64 make shorter rows, and a sum of two n-grams only lets more through.
HASH_BITS = 40
#: Hashes and phrases that a task sums up before it hands them on; parts of a language that are ranked by themselves first.
HELD_HASHES, HELD_PHRASES, DEALT = 1 << 20, 1 << 19, 16
#: So many scan partitions share a task, which then sums more before anything is shuffled, but each core has so many tasks at least.
SHARED, TASKS_A_CORE = 8, 3
#: Bytes of text that are hashed at once.
HASHED_BYTES = 1 << 20
#: What ends a piece, and what stands between words.
ENDS = byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
WORD = ~(ENDS | byte_class((0x20, 0x20), (0x09, 0x09)))
STEP = U64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: bytes in lower case, starts and ends, rows, pieces, and their hashes with and without their language."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray
    seeds: np.ndarray

    @staticmethod
    def of(langs: pa.Array, texts: pa.Array) -> Words:
        data, offsets = text_bytes(texts)
        starts, ends, rows = runs(data, offsets, WORD[data])
        pieces = np.cumsum(ENDS[data], dtype=np.int32)[starts] + rows.astype(np.int32)
        coded = langs.dictionary_encode()
        seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
        return Words(LOWER[data], starts, ends, rows, pieces, seed[coded.indices.to_numpy()][rows] if len(rows) else np.zeros(0, np.uint64))

    def levels(self, hashes: np.ndarray, bits: np.ndarray | None, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each level with its n-grams' hashes, where one stands whose parts may be frequent, and where the filter lets it through."""
        grams, stands = mix64(hashes ^ self.seeds), np.ones(len(hashes), bool)
        for level in range(1, last + 1):
            if level > 1:
                stands = np.zeros_like(passes)
                stands[:-1] = passes[:-1] & passes[1:]
                if level == 2:
                    stands[:-1] &= self.pieces[:-1] == self.pieces[1:]
                at = np.flatnonzero(stands)
                grams[at] = mix64(grams[at] * STEP + hashes[at + level - 1])
            passes = stands
            if bits is not None:
                passes, at = stands.copy(), np.flatnonzero(stands)
                passes[at] = _known(bits, grams[at])
            yield level, grams, stands, passes


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> U64(65 - (8 * len(bits)).bit_length())
    return (bits[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1


def hash_counts(docs: DataFrame, bits, first: int, last: int) -> DataFrame:
    """h and n of the n-grams of first to last words whose parts the filter (a broadcast, or None) lets through."""
    schema, held, at_once = pa.schema([("h", pa.int64()), ("n", pa.int64())]), HELD_HASHES, HASHED_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = None if bits is None else bits.value, Sums(["h"], ["n"], schema, held)
        for batch in batches:
            for part in rows_of(batch, at_once):
                words = Words.of(part.column(0), part.column(1))
                if not len(words.starts):
                    continue
                own = mix64(span_hashes(prefix_hashes(words.data), words.starts, words.ends))
                # Levels from first on share one filter, which has their parts only up to the level before.
                for level, grams, stands, _ in words.levels(own, known, first):
                    pass
                found = [grams[stands]]
                at = np.flatnonzero(stands)
                for level in range(first + 1, last + 1):
                    # A longer one stands where each of its parts stands.
                    at = at[:-1][at[1:] == at[:-1] + 1]
                    grams[at] = mix64(grams[at] * STEP + own[at + level - 1])
                    found.append(grams[at])
                h, n = np.unique(np.concatenate(found), return_counts=True)
                h >>= U64(64 - HASH_BITS)
                yield from sums.add([pa.array(h.astype(np.int64)), pa.array(n)])
            trim()
        yield from sums.rest()
        trim()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_bits(counts: DataFrame, least: int) -> np.ndarray | None:
    """The filter that has every hash of least or more; its size is fixed, so the driver may hold it. None if there is none."""
    slot = F.shiftright("h", HASH_BITS - BITS) + 1
    rows = counts.where(F.col("n") >= least).groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        at = (r.bucket - 1) * len(r.bits)
        out[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out if rows else None


def text_counts(docs: DataFrame, bits, longest: int) -> DataFrame:
    """lang, phrase, words and n, exactly, of the phrases that the filter lets through; the empty phrase counts all words."""
    schema = pa.schema([("lang", pa.large_string()), ("phrase", pa.large_string()), ("words", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = bits.value, Sums(["lang", "phrase", "words"], ["n"], schema, HELD_PHRASES)
        for batch in batches:
            for part in rows_of(batch, BATCH_BYTES):
                words = Words.of(part.column(0), part.column(1))
                if not len(words.starts):
                    continue
                langs = part.column(0).dictionary_encode()
                lang_of = langs.indices.to_numpy().astype(np.int64)[words.rows]
                n = np.bincount(lang_of, minlength=len(langs.dictionary))
                out = [(langs.dictionary, pa.array([""] * len(n), pa.large_string()), 0, n)]
                lengths = words.ends - words.starts
                bare, offsets = gather(words.data, words.starts, words.ends)
                coded = as_array(bare, offsets, pa.large_binary()).dictionary_encode()
                at = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1]
                code = coded.indices.to_numpy().astype(np.int64)
                distinct = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)[: at[-1]]
                own = mix64(span_hashes(prefix_hashes(distinct), at[:-1], at[1:]))[code]
                # All words with one blank behind each; a phrase is a stretch of them.
                places = offsets + np.arange(len(offsets))
                spaced = np.full(places[-1], ord(" "), np.uint8)
                spaced[np.arange(len(bare)) + np.repeat(np.arange(len(lengths)), lengths)] = bare
                ids = lang_of * len(coded.dictionary) + code
                for level, _, _, passes in words.levels(own, known, longest):
                    stand = np.flatnonzero(passes)
                    if not len(stand):
                        break
                    # The same language, phrase before and last word: the same phrase.
                    key = ids[stand] if level == 1 else ids[stand] * len(coded.dictionary) + code[stand + level - 1]
                    _, first, same, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    ids[stand] = same
                    first = stand[first]
                    text = as_array(*gather(spaced, places[first], places[first + level] - 1), pa.large_string())
                    out.append((langs.dictionary.take(pa.array(lang_of[first])), text, level, n))
                for lang, text, level, n in out:
                    yield from sums.add([lang.cast(pa.large_string()), text, pa.array(np.full(len(n), level, np.int32)), pa.array(n.astype(np.int64))])
            trim()
        yield from sums.rest()
        trim()

    return docs.mapInArrow(run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def in_fewer_tasks(df: DataFrame) -> DataFrame:
    """df in tasks that share scan partitions; nothing is shuffled."""
    n = df.rdd.getNumPartitions()
    return df.coalesce(max(1, min(n, max(-(-n // SHARED), TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism))))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, n: phrases of up to so many words at least places, and the empty phrase for all words of a language."""
    spark = docs.sparkSession
    narrow = in_fewer_tasks(bounded_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    # Words, pairs, and then all longer ones, of which few are left.
    for first, last in [(k, k if k < 3 else longest) for k in range(1, min(3, longest) + 1)]:
        known = spark.sparkContext.broadcast(bits) if first > 1 else None
        new = frequent_bits(hash_counts(narrow, known, first, last), least)
        if known is not None:
            known.destroy()
        if new is None:
            break
        bits |= new
    known = spark.sparkContext.broadcast(bits)
    out = stage_table(text_counts(narrow, known, longest).where((F.col("n") >= least) | (F.col("words") == 0)), "collocation-counts")
    known.destroy()
    return out


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exactly."""
    dec = lambda c, p: c.cast(f"decimal({p},0)")
    return F.call_function("div", dec(a, 17) * F.lit(1000).cast("decimal(4,0)") * dec(n, 17), dec(left, 19) * dec(right, 19))


def mine_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two or more words of each language."""
    counts = phrase_counts(docs, longest, least)
    totals = stage_table(counts.where("words = 0").select("lang", F.col("n").alias("n")).coalesce(1), "collocation-totals")
    phrases = counts.where("words > 0")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    part = F.split("phrase", " ", -1)
    cut = lambda start, length: F.array_join(F.slice(F.col("word"), start, length), " ")
    cuts = candidates.select("*", part.alias("word"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    # One word more, before or behind, at as many places.
    longer = candidates.where("words > 2").select("lang", F.explode(F.array(F.array_join(F.slice(part, 2, longest), " "), F.array_join(F.slice(part, F.lit(1), F.col("words") - 1), " "))).alias("phrase"), "a")
    most = longer.groupBy(F.col("lang").alias("of"), F.col("phrase").alias("within")).agg(F.max("a").alias("most"))
    left = best.join(most, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("within")) & (100 * F.col("most") >= 100 * F.col("a")), "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # Parts of a language are ranked first, so that no task ranks all of its phrases.
    dealt = left.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
