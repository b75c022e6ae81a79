"""Threshold-scaled sketches of documents, with DataFrame functions only.

A document's sketch holds every hash of its 5-word shingles that lies below a
fixed fraction of the hash range, whatever the document's size: a long text has
a long sketch, a short one a short one, and one without a hash below it an empty
one. So sketches of any two texts are compared as they are, the sketch of
several documents together is the union of theirs, and the share of a small
document that a much larger one holds can be told. A share estimated from k
hashes is off by the root of share * (1 - share) / k, so at a fraction of a
quarter by 0.16 at most for 40 shingles, 0.07 for 232, 0.02 for 2,500.

Defined results: null text counts as empty; an empty text has an empty sketch;
two empty sketches have likeness 1, an empty and another 0; with fewer than
five words the whole sequence is one shingle; rows of equal id follow each other
in order of their text; rows without id come last, in order of a hash of their
text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRACTION = 1 / 4
SHINGLE = 5
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows that a range of ids should hold, and the most ranges; bounds of ranges are all that the driver gets.
ROWS_PER_RANGE, MOST_RANGES = 4000, 4096


def threshold(fraction: float) -> int:
    """The hash below which a fraction of the range lies."""
    return -(1 << 63) + int((1 << 64) * fraction)


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION, words: int = SHINGLE) -> DataFrame:
    """df with the sorted sketch of a text column, an array of longs."""
    w, s = f"__{name}_w", f"__{name}_s"
    split = F.filter(F.split(F.col(text), SPACE), lambda x: x != "")
    df = df.withColumn(w, F.transform(split, lambda x: F.xxhash64(x)))
    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(words)]))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(s, F.when(F.size(w) >= words, shingles).otherwise(whole)).drop(w)
    below = F.filter(F.col(s), lambda h: h < F.lit(threshold(fraction)))
    return df.withColumn(name, F.sort_array(F.array_distinct(below))).drop(s)


def as_text(sketch: Column) -> Column:
    """The sketch's hashes in order, 16 hexadecimal digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sketches: an estimate of the Jaccard similarity; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b has too; 1 for an empty a."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(1.0))


def merge(sketches: Column) -> Column:
    """The sketch of several documents together, the same as that of all their shingles, from an array of their sketches."""
    return F.sort_array(F.array_distinct(F.flatten(sketches)))


def _ranges(docs: DataFrame, id_column: str) -> tuple[list[int], int]:
    """Lower bounds of ranges of ids with about as many rows each, and into how many powers of two the rows without id are dealt."""
    some, none = docs.agg(F.count(id_column), F.count_if(F.col(id_column).isNull())).first()
    parts = lambda rows: max(1, min(MOST_RANGES, rows // ROWS_PER_RANGE))
    bits = (parts(none) - 1).bit_length()
    n = parts(some)
    if n == 1:
        return [], bits
    at = F.percentile_approx(id_column, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(100 * n))
    return sorted(set(docs.agg(at).first()[0])), bits


def _range_of(bounds: list[int], key: Column) -> Column:
    """How many bounds are not above key, in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = F.greatest(F.size(F.filter(long([b[0] for b in blocks]), lambda b: b <= key)), F.lit(1))
    inside = F.size(F.filter(F.get(F.array(*[long(b) for b in blocks]), block - 1), lambda b: b <= key))
    return ((block - 1) * step + inside).cast("int")


def with_next(docs: DataFrame, columns: list[str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with the given columns of the next row by descending id (after the last: the first), as next_<column>.

    Rows are dealt by ranges of ids, those without id by a hash of their text; a
    range's first row also goes, as a guest, to the range that stands before it,
    so no task needs more than its range and no row crosses the driver.
    """
    bounds, bits = _ranges(docs, id_column)
    hashed, own = F.shiftrightunsigned(F.xxhash64(text), 1), F.col(id_column)
    place = F.when(own.isNotNull(), _range_of(bounds, own)).otherwise((-1 - F.shiftright(hashed, 63 - bits)).cast("int") if bits else F.lit(-1))
    dealt = docs.withColumns({"__range": place, "__key": F.coalesce(own.cast("long"), -hashed)})
    firsts = {r[0]: r[1] for r in dealt.groupBy("__range").agg(F.max("__key")).collect()}
    order = sorted(firsts, reverse=True)
    to = [(r, firsts[r], order[i - 1]) for i, r in enumerate(order)] or [(0, 0, 0)]
    heads = F.broadcast(docs.sparkSession.createDataFrame(to, "__range int, __key long, __to int"))  # a row per range
    first = F.min(F.struct(F.col(text).alias("__text"), *[F.col(c).alias(f"__{c}") for c in columns if c != text])).alias("__first")
    guests = dealt.join(heads, ["__range", "__key"]).groupBy("__to").agg(first)
    guests = guests.select(F.col("__to").alias("__range"), *[F.col("__first")["__text" if c == text else f"__{c}"].alias(c) for c in dict.fromkeys([text, *columns])], F.lit(True).alias("__guest"))
    rows = dealt.withColumn("__guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    w = Window.partitionBy("__range").orderBy("__guest", F.desc("__key"), text)
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where(~F.col("__guest")).drop("__range", "__guest", "__key")


def fingerprint_documents(docs: DataFrame, fraction: float = FRACTION, id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the next document's start."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_sketch(narrow, "text", "sketch", fraction), ["text", "sketch"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch", fraction)
    return rows.select(
        F.col("doc_id").alias(id_column),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_original"),
    )
