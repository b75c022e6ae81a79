"""License scans by ordered signature rules, with DataFrame functions only.

A gate of keywords, derived from the rules so that no match escapes it, decides
which texts become a line of words; the keywords that the line holds decide
which rules' regular expressions are tried. Each match becomes an interval of
words, and a match that a match of the same or higher priority contains is
dropped; of matches of one interval the higher priority stays, then the earlier
rule. The score says how unlikely it is that all remaining matches are mistaken.

Defined results: null and empty texts have no words, no labels and the score 0;
repeated rows are each scanned; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: The base phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Confidence in a match of each priority, from 1 on; a base phrase has that of a notice.
CONFIDENCE = (0.4, 0.6, 0.8, 0.9, 0.95)
LEVELS = len(CONFIDENCE)
#: Keywords that are parts of too many words to be a good gate; they still decide which rules are tried.
WEAK = {"under", "by", "sa", "nc", "nd", "new", "mit", "cc", "0"}
#: What may stand between two words of a raw text, and what may not stand beside a match.
GAP, LETTER = "(?:[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"


def all_rules() -> list[tuple[str, int, tuple[str, ...], str]]:
    """The hand-written rules, and behind them the base phrases as notices."""
    return [*rules(), *((label, 3, tuple(phrase.split()), f"(?<= )(?:{phrase})(?= )") for phrase, label in BASE.items())]


def cover(table: list[tuple[str, int, tuple[str, ...], str]]) -> list[str]:
    """Keywords of which every match of every rule with a keyword that isn't weak holds one: those that cover most rules first, and of these the longest."""
    parts = sorted({k for r in table for k in r[2]} - WEAK, key=lambda k: (-len(k), k))
    left, out = [r for r in table if set(r[2]) - WEAK], []
    while left:
        covered = {k: [r for r in left if any(k in q for q in r[2])] for k in parts}
        best = max(parts, key=lambda k: len(covered[k]))
        out.append(best)
        left = [r for r in left if r not in covered[best]]
    return out


def may_match(text: Column, table: list[tuple[str, int, tuple[str, ...], str]]) -> Column:
    """Whether a lower-cased text can hold a match of any rule: by keywords, and by their own expressions for rules whose keywords are all weak."""
    gate = F.lit(False)
    for k in cover(table):
        gate = gate | F.contains(text, F.lit(k))
    weak = [r for r in table if not set(r[2]) - WEAK]
    some = F.lit(False)
    for keywords in sorted({r[2] for r in weak}):
        every = F.lit(True)
        for k in keywords:
            every = every & F.contains(text, F.lit(k))
        some = some | every
    raw = "|".join(p.removeprefix("(?<= )").removesuffix("(?= )").replace(" ", GAP) for *_, p in weak)
    return gate | (some & text.rlike(f"(?<!{LETTER})(?:{raw})(?!{LETTER})"))


def _intervals(line: Column, pattern: Column) -> Column:
    """Word intervals (first, last) of a pattern's matches in a line of words, in one pass over it."""
    marked = F.split(F.regexp_replace(line, pattern, F.lit("\x01$0\x02")), " ")
    at = lambda mark: F.filter(F.transform(marked, lambda w, i: F.when(F.contains(w, F.lit(mark)), i - 1)), lambda i: i.isNotNull())
    return F.arrays_zip(at("\x01").alias("first"), at("\x02").alias("last"))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Words, base phrases, labels and a score of each document."""
    table = all_rules()
    df = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), "text", F.lower("text").alias("any_case"))
    # lower() also makes ASCII letters of some others, so it serves only where a keyword settles the matter; it never takes an ASCII letter away.
    df = df.select("doc_id", "n_words", F.when(may_match(F.col("any_case"), table), F.translate("text", UPPER, LOWER)).alias("low"))
    df = df.withColumn("line", F.concat(F.lit(" "), F.array_join(F.regexp_extract_all("low", F.lit(WORD), F.lit(0)), " "), F.lit(" "))).drop("low")
    phrases = F.lit("(?<= )(?:" + "|".join(BASE) + ")(?= )")
    df = df.withColumn("base", F.transform(_intervals(F.col("line"), phrases), lambda x: x["first"]))
    df = df.withColumn("base_set", F.filter(F.array(*[F.when(F.contains("line", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]), lambda x: x.isNotNull()))
    # Keyword prefilter: which keywords a line holds, then the rules that have all theirs.
    words = F.array(*[F.lit(k) for k in sorted({k for r in table for k in r[2]})])
    df = df.withColumn("held", F.when(F.col("line").isNotNull(), F.filter(words, lambda k: F.contains(F.col("line"), k))))
    known = F.array(*[F.struct(F.lit(a).alias("label"), F.array(*map(F.lit, k)).alias("keywords"), F.lit(p).alias("pattern"), F.lit(n).alias("priority"), F.lit(i).alias("order")) for i, (a, n, k, p) in enumerate(table)])
    tried = F.filter(known, lambda r: F.size(F.array_except(r["keywords"], F.col("held"))) == 0)
    found = F.flatten(F.transform(tried, lambda r: F.transform(_intervals(F.col("line"), r["pattern"]), lambda x: F.struct(x["first"].alias("first"), (-x["last"]).alias("back"), (-r["priority"]).alias("rank"), r["order"].alias("order"), r["label"].alias("label")))))
    # In this order whatever contains a match stands before it, so one pass that keeps each priority's farthest end settles containment.
    df = df.withColumn("found", F.when(F.size("held") > 0, F.sort_array(found)))
    none = F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda i: F.lit(-1))
    start = F.struct(none.alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("doubt"))
    doubt = F.array(*[F.lit(1 - c) for c in CONFIDENCE])

    def step(s, d):
        lost = F.exists(F.slice(s["ends"], -d["rank"], LEVELS), lambda e: e >= -d["back"])
        ends = F.transform(s["ends"], lambda e, i: F.when((i == -d["rank"] - 1) & (e < -d["back"]), -d["back"]).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(lost, s["labels"]).otherwise(F.array_union(s["labels"], F.array(d["label"]))).alias("labels"), F.when(lost, s["doubt"]).otherwise(s["doubt"] * F.get(doubt, -d["rank"] - 1)).alias("doubt"))

    df = df.withColumn("kept", F.aggregate("found", start, step))
    n_base = F.coalesce(F.size("base"), F.lit(0))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), ","), F.lit(""))
    return df.select(
        F.col("doc_id").alias(id_column),
        "n_words",
        F.when(F.col("line").isNull(), F.lit(0)).otherwise(n_base).cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        joined(F.col("base_set")).alias("base_labels"),
        joined(F.concat("base_set", F.coalesce("kept.labels", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce(F.round(1 - F.col("kept.doubt"), 9), F.lit(0.0)).alias("score"),
    )
