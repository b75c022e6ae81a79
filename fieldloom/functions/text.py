"""Text expressions: object names, label and weight text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kernel_stem(name: Column) -> Column:
    """Name of an object without folder, suffix and its number."""
    return F.regexp_extract(_plain(name), r"^(.*)_kernel_(\d+)$", 1)


def kernel_number(name: Column) -> Column:
    """The object's number; null where the name has none."""
    return F.regexp_extract(_plain(name), r"^(.*)_kernel_(\d+)$", 2).try_cast("bigint")


def _plain(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"\.[^.]*$", "")


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def image_of_kernel(name: Column) -> Column:
    """The image an object was cut from: what follows the last mark goes, the suffix stays; names without the mark stay as they are."""
    suffix = F.regexp_extract(name, r"[^./\\][^/\\]*?(\.[^./\\]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.when(F.contains(stem, F.lit("_kernel_")), F.concat(F.regexp_extract(stem, r"(?s)^(.*)_kernel_", 1), suffix)).otherwise(name)


def kernel_name(stem: Column, number: Column) -> Column:
    return F.format_string("%s_kernel_%03d.jpg", stem, number)


def short_id(name: Column, stem: Column) -> Column:
    """An object's name without its image's stem and suffix, for display."""
    return F.regexp_replace(F.replace(name, F.concat(stem, F.lit("_")), F.lit("")), r"\.jpg$", "")


def normalise_label(text: Column) -> Column:
    """Upper case, O to 0, C to 0 before a digit, separators to single hyphens, no hyphen at either end."""
    t = F.regexp_replace(F.upper(F.trim(text)), "O", "0")
    t = F.regexp_replace(t, r"C(?=\d)", "0")
    return F.regexp_replace(F.regexp_replace(t, r"[^A-Z0-9]+", "-"), r"^-+|-+$", "")


def label_valid(label: Column) -> Column:
    """Two hyphens and eight letters or digits at least."""
    return (_count(label, r"-") >= 2) & (_count(label, r"[A-Z0-9]") >= 8)


def label_score(label: Column, confidence: Column) -> Column:
    """Confidence counts most, then hyphens, then characters; a whole label gets a bonus. Null for what is no label."""
    whole = F.when(label.rlike(r"^[A-Z0-9]+(-[A-Z0-9]+){2,}$"), 20).otherwise(0)
    return F.when(label_valid(label), 100 * confidence + 12 * _count(label, "-") + _count(label, r"[A-Z0-9]") + whole)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


#: Characters that readers of weight displays confuse, and what they stand for (fixed values).
CONFUSED, MEANT = "OoIl|BS,:;", "0011185..."


def normalise_weight(text: Column) -> Column:
    """Confused characters to digits, then only digits and one dot are left, and a leading minus if there was one anywhere."""
    t = F.regexp_replace(F.translate(text, CONFUSED, MEANT), r"[^0-9.\-]", "")
    minus = F.when(F.contains(t, F.lit("-")), "-").otherwise("")
    t = F.replace(t, F.lit("-"), F.lit(""))
    dot = F.instr(t, ".")
    whole = F.when(dot > 0, F.concat(F.substring(t, F.lit(1), dot), F.replace(F.substring(t, dot + 1, F.length(t)), F.lit("."), F.lit("")))).otherwise(t)
    return F.concat(minus, whole)


def weight_candidates(text: Column, least: float, most: float) -> Column:
    """Array of (value, kind) of a normalised text: numbers with a dot, and 3 to 5 digits taken as hundredths."""
    explicit = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,3}\.\d{1,2})"), F.lit(1)), lambda x: F.struct(x.cast("double").alias("value"), F.lit("explicit_decimal").alias("kind")))
    digits = F.regexp_replace(text, r"\D", "")
    inferred = F.array(F.struct((F.when(digits.rlike(r"^\d{3,5}$"), digits).cast("double") / 100).alias("value"), F.lit("inferred_decimal").alias("kind")))
    return F.filter(F.concat(explicit, inferred), lambda c: c["value"].between(least, most))


def digits_to_weight(digits: Column) -> Column:
    """Digits of a display to text: one digit is hundredths, else a dot stands before the last two."""
    n = F.length(digits)
    return F.when(n == 1, F.concat(F.lit("0.0"), digits)).when(n >= 2, F.concat(F.substring(digits, F.lit(1), n - 2), F.lit("."), F.substring(digits, n - 1, F.lit(2))))


def sanitise(name: Column) -> Column:
    """A name fit for files: illegal characters and blanks to underscores, none of them or dots at the ends, never empty."""
    t = F.regexp_replace(F.regexp_replace(F.trim(name), r'[\\/:*?"<>|]+', "_"), r"\s+", "_")
    t = F.regexp_replace(t, r"^[._]+|[._]+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "UNKNOWN").otherwise(t)


def parse_box(text: Column) -> Column:
    """x1,y1,x2,y2 to an array of doubles; null unless there are four numbers."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()), parts)


def format_box(box: Column) -> Column:
    return F.concat_ws(",", F.transform(box, lambda v: v.cast("bigint").cast("string")))


def weight_score(kind: Column, confidence: Column, source: Column, priority: Column, place: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """Confidence counts most; numbers with a dot, treated images and surer regions add to it.

    place (x and y of the text's middle, width and height of the image), if
    known, adds for what stands in the middle from left to right, and low.
    """
    by_source = F.when(source.endswith("_binary"), 5.0).when(source.endswith("_scaled"), 2.5).otherwise(0.0)
    out = 100 * confidence + F.when(kind == "explicit_decimal", 25.0).otherwise(8.0) + by_source + 10 * priority
    if place is None:
        return out
    x, y, width, height = place
    middle = F.greatest(F.lit(-1.0), 1 - F.abs(x - width / 2) / F.greatest(width / 2, F.lit(1.0)))
    return out + F.coalesce(8 * middle + 6 * y / F.greatest(height.cast("double"), F.lit(1.0)), F.lit(0.0))
