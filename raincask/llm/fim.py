"""Fill-in-the-middle by marked units; DataFrame functions only.

A control character stands for the end of a unit. It and the escape character are escaped in the text
first, then `regexp_replace` appends it to each unit, so its number is the number of units and
`substring_index` takes ranked parts at any two of them. Parts lose the marks, get their own characters
back and are assembled behind the sentinels of the two usual orders. No row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: What the text must not hold to be transformed: prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The mark after each unit, the character that escapes, and what stands for each of the two behind it.
MARK, ESCAPE, MARK_CODE, ESCAPE_CODE = "\x1e", "\x1b", "m", "e"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE_CODE)), F.lit(MARK), F.lit(ESCAPE + MARK_CODE))


def unescaped(text: Column) -> Column:
    """Inverse of `escaped`, marks removed. An escape is always followed by a code, so codes are read one by one from the left."""
    bare = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + MARK_CODE), F.lit(MARK)), F.lit(ESCAPE + ESCAPE_CODE), F.lit(ESCAPE))


def marked(plain: Column, unit: str = r"(?s).") -> Column:
    """An escaped text with a mark behind each unit; a unit is a match of the pattern, an escape and its code counting as one."""
    return F.regexp_replace(plain, f"({ESCAPE}[{MARK_CODE}{ESCAPE_CODE}]|{unit})", f"$1{MARK}")


def units(marks: Column, plain: Column) -> Column:
    """How many marks there are: an escaped text has none of its own."""
    return (F.length(marks) - F.length(plain)).cast("long")


def draw(key: Column, k: int) -> Column:
    """The k-th group of eight hex digits, from 1, of a SHA-256 hash, as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * k - 7, 8), 16, 10).cast("long")


def _between(marks: Column, start: Column, stop: Column) -> Column:
    return unescaped(F.call_function("substring_index", F.call_function("substring_index", marks, F.lit(MARK), stop), F.lit(MARK), start - stop))


def restore(output: Column, form: Column) -> Column:
    """The text behind an output, from the output and its form alone: the text held no sentinel, so the first of each is ours."""
    p, s, m = SENTINELS
    head = F.split(F.substr(output, F.lit(len(p) + 1)), F.when(form == "psm", s).otherwise(p), 2)
    tail = F.split(F.element_at(head, 2), m, 2)
    middle = F.element_at(tail, 2)
    return F.when(form == "plain", output).when(form == "psm", F.concat(F.element_at(head, 1), middle, F.element_at(tail, 1))).otherwise(F.concat(F.element_at(tail, 1), middle, F.element_at(head, 1)))


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n, form, prefix, middle, suffix, output, restored.

    n counts the code points. Cuts and the form are drawn from a hash of the seed and the id. `plain`
    texts are those that are empty or hold a sentinel, and `plain_percent` of the others; their three
    parts are null and their output is the text. `spm_percent` of the rest have the suffix first.
    `restored` is made from output and form alone.

    A null text counts as empty. Null ids draw as an empty one; rows that repeat an id draw alike, and
    rows that repeat id and text come out as often as they are in. Parts may be empty. Very long texts
    are cut whole; marking doubles their length for a while. Other columns are ignored; an empty table
    gives no rows.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    held = F.col("text") == ""
    for sentinel in SENTINELS:
        held = held | F.col("text").contains(sentinel)
    form = F.when(held | (draw(key, 3) % 100 >= 100 - plain_percent), "plain").when(draw(key, 4) % 100 < spm_percent, "spm").otherwise("psm")
    # Texts that stay plain need no marks.
    formed = base.withColumn("form", form).withColumn("escaped", F.when(F.col("form") != "plain", escaped(F.col("text"))))
    counted = formed.withColumn("marks", marked(F.col("escaped"))).withColumn("count", F.coalesce(units(F.col("marks"), F.col("escaped")), F.length("text").cast("long")))
    one, two = draw(key, 1) % (F.col("count") + 1), draw(key, 2) % (F.col("count") + 1)
    placed = counted.select("doc_id", "text", F.col("count").alias("n"), "form", "marks", F.least(one, two).cast("int").alias("low"), F.greatest(one, two).cast("int").alias("high"))
    marks, total = F.col("marks"), F.col("n").cast("int")
    # The last mark has an empty part behind it, so the suffix is one part more than its units.
    parts = (_between(marks, F.lit(0), F.col("low")), _between(marks, F.col("low"), F.col("high")), unescaped(F.call_function("substring_index", marks, F.lit(MARK), F.col("high") - total - 1)))
    cut = placed.select("doc_id", "text", "n", "form", *(F.when(F.col("form") != "plain", part).alias(name) for name, part in zip(("prefix", "middle", "suffix"), parts)))
    p, s, m = map(F.lit, SENTINELS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    made = cut.withColumn("output", output)
    return made.select("doc_id", "n", "form", "prefix", "middle", "suffix", "output", restore(F.col("output"), F.col("form")).alias("restored"))
