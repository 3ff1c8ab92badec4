"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers, names and units become typed placeholders, case and outer punctuation go. Windows of the
resulting templates are hashed and joined between documents and benchmark items. A match then has to
fill the slots consistently: wherever the item repeats a value, the document repeats its own value
there. So a question with other numbers or names is caught, and a look-alike that mixes them is not.

What precedes a window decides whether its first word is a name or a unit. So item windows come in each
form that their first word can take; in a form other than the item's own, the document has to have the
same first word. Beside templates, each window is matched by its plain words (without case and outer
punctuation), the only way for short items and for windows of mostly slots.

Most documents share nothing with a benchmark, and templates are dear. So each item window names an
anchor, its longest adjacent pair of literal words (its longest word if it has no pair; of all words if
literal ones have no letters), and templates are made only of documents with an anchor. A document that
matches a window has its literal words, so this loses nothing. If a window has no letters at all,
templates are made of all documents.

The benchmark's windows are broadcast if there are BROADCAST_WINDOWS at most, which is counted, and
joined by a shuffle otherwise. Texts of matching documents alone shuffle for the slot check, picked by
a filter of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, may_match, text_key, text_or_empty

WORDS = r"[\x20\x09-\x0D]+"
BROADCAST_WINDOWS = 2_000_000
#: Windows with fewer literal words than this share of their length, and items of fewer words, match by their plain words only.
LITERAL_SHARE, LEAST_WORDS = 0.5, 5
#: Units of measure that follow a number (fixed values, singular; a plural s may follow).
UNITS = (
    "mm cm m km inch inches foot feet ft yard yd mile mi g kg mg gram kilogram ton tonne pound lb ounce oz ml l liter litre gallon s sec second min minute "
    "hour hr day week month year meter metre kilometer kilometre centimeter centimetre dollar euro cent usd eur percent degree celsius fahrenheit kelvin "
    "watt kw volt joule hertz hz byte kb mb gb mph kph"
).split()
#: Number words (fixed values).
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

_NAME = r"(?<=[^\s.!?:;|]\s)\p{Lu}[\p{L}'’-]*\p{Ll}[\p{L}'’-]*"
_DIGITS = r"[0-9]++(?:[.,:/][0-9]++)*+"
_NUMBER = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(NUMBERS)})(?![\p{{L}}\p{{N}}])"
_UNIT = rf"(<num>\s?)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})s?(?![\p{{L}}\p{{N}}])"
_OUTER = r"(?<=[\p{L}\p{N}>])[^\p{L}\p{N}<>\s]+(?!\S)|(?<!\S)[^\p{L}\p{N}<>\s]+(?=[\p{L}\p{N}<])"


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORDS), lambda w: w != "")


def template(text: Column) -> Column:
    """The text with typed placeholders; it has the same words in number as the text, so both line up."""
    plain = F.regexp_replace(text, "[<>]", "^")
    named = F.lower(F.regexp_replace(plain, _NAME, "<name>"))
    number = F.regexp_replace(F.regexp_replace(named, _DIGITS, "<num>"), _NUMBER, "<num>")
    unit = F.when(number.contains("<num>"), F.regexp_replace(number, _UNIT, "$1<unit>")).otherwise(number)
    return F.regexp_replace(unit, _OUTER, "")


def plain(text: Column) -> Column:
    """The text in lower case and without outer punctuation; it has the same words in number as the text."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, "[<>]", "^")), _OUTER, "")


def window_hashes(tokens: str, sign: int) -> Column:
    """Hashes of the windows of `size` (a column) words, times `sign`: 1 for templates and -1 for plain words."""
    at = F.sequence(F.lit(1), F.size(tokens) - F.col("size") + 1)
    return F.when(F.size(tokens) >= F.col("size"), F.transform(at, lambda i: F.xxhash64(F.slice(F.col(tokens), i, F.col("size")), F.col("size") * sign)))


def letter_runs(text: Column) -> Column:
    """Maximal runs of letters in lower case: equal literal words give equal runs."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def pair_hashes(runs: str) -> Column:
    return F.when(F.size(runs) > 1, F.transform(F.sequence(F.lit(1), F.size(runs) - 1), lambda i: F.xxhash64(F.element_at(runs, i), F.element_at(runs, i + 1))))


def single_hashes(runs: str) -> Column:
    return F.transform(runs, lambda w: F.xxhash64(w))


def anchors(items: DataFrame) -> DataFrame:
    """(h, single): one anchor for each item window; h is null for windows without letters."""
    # Slots break the window into stretches of literal words; pairs within a stretch are adjacent in a match.
    stretches = F.filter(F.split(F.array_join(F.transform("own", lambda w: F.when(w.contains("<"), F.lit("\u0000")).otherwise(w)), " "), "\u0000"), lambda x: x.rlike(r"\p{L}"))
    each = items.select("key", "own", "plain").distinct().withColumn("stretches", stretches)
    each = each.select("key", F.explode(F.when(F.size("stretches") > 0, F.col("stretches")).otherwise(F.array(F.array_join("plain", " ")))).alias("stretch"))
    runs = each.select("key", letter_runs(F.col("stretch")).alias("runs"))
    # Long words are rare ones; of equally long anchors the least hash is taken, so that neighbouring windows agree.
    pair = F.transform(pair_hashes("runs"), lambda h, i: F.struct((-F.length(F.element_at("runs", i + 1)) - F.length(F.element_at("runs", i + 2))).alias("rank"), h.alias("h")))
    single = F.transform("runs", lambda w: F.struct((-F.length(w)).alias("rank"), F.xxhash64(w).alias("h")))
    best = runs.groupBy("key").agg(F.min(F.array_min(pair)).alias("pair"), F.min(F.array_min(single)).alias("single"))
    return best.select(F.coalesce("pair.h", "single.h").alias("h"), F.col("pair").isNull().alias("single")).distinct()


def suspects(base: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of base (th, text, ...) that may hold an item window: those with an anchor and few others, or all."""
    marks = materialise(anchors(items), "anchors")
    if marks.where("h IS NULL").limit(1).count():
        return base
    runs = base.select("th", letter_runs(F.col("text")).alias("runs"))
    found = None
    for single in sorted(r["single"] for r in marks.select("single").distinct().collect()):  # two values at most
        mine = marks.where(F.col("single") == single).select("h")
        each = runs.select("th", F.explode(single_hashes("runs") if single else pair_hashes("runs")).alias("h"))
        part = each.join(F.broadcast(mine) if mine.count() <= BROADCAST_WINDOWS else mine, "h", "left_semi").select("th")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.limit(0)
    found = materialise(found.distinct(), "suspects")
    return may_match(base, found.select(F.col("th").alias("key")), F.col("th"))


def item_windows(benchmark: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, raw, plain, own, key, how, form, h): each window of each item in each of its forms.

    A shorter item is one window of its own size. `own` is the window's template within the item and `key`
    its hash. `how` is 0 for that template, 1 for one with its first word as other contexts have it and
    2 for plain words.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_or_empty(text_col).alias("t")).select("item_id", words(F.col("t")).alias("raw"), words(plain(F.col("t"))).alias("plain"), words(template(F.col("t"))).alias("own"))
    sized = items.where(F.size("raw") > 0).withColumn("size", F.least(F.size("raw"), F.lit(length)))
    each = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("raw") - F.col("size") + 1)))
    each = each.select("item_id", "size", *(F.slice(c, F.col("at"), F.col("size")).alias(c) for c in ("raw", "plain", "own"))).withColumn("key", F.xxhash64("raw", "own"))
    word, rest = F.element_at("raw", 1), F.slice("own", F.lit(2), F.col("size"))
    # The first word at the start of a sentence, within one, and after a number.
    firsts = F.array(*(F.element_at(words(template(F.concat(F.lit(before), word))), -1) for before in ("", "x ", "1 ")))
    others = F.transform(F.filter(F.array_distinct(firsts), lambda w: w != F.element_at("own", 1)), lambda w: F.struct(F.lit(1).alias("how"), F.concat(F.array(w), rest).alias("form")))
    own, bare = F.struct(F.lit(0).alias("how"), F.col("own").alias("form")), F.struct(F.lit(2).alias("how"), F.col("plain").alias("form"))
    formed = each.withColumn("one", F.explode(F.concat(F.array(own, bare), others))).select(*each.columns, "one.how", "one.form")
    literal = F.size(F.filter("form", lambda w: ~w.contains("<")))
    kept = formed.where((F.col("how") == 2) | ((F.col("size") >= LEAST_WORDS) & (literal >= F.col("size") * LITERAL_SHARE)))
    return kept.withColumn("h", F.xxhash64("form", F.when(F.col("how") == 2, -F.col("size")).otherwise(F.col("size")))).distinct()


def _fits() -> Column:
    """Whether a window (doc_raw, doc_form, doc_plain) has the item window's form, slots filled by a function of the item's values."""
    mine = F.when(F.col("how") == 2, F.col("doc_plain")).otherwise(F.col("doc_form"))
    slots = F.filter(F.arrays_zip("form", F.col("raw").alias("item"), F.col("doc_raw").alias("doc")), lambda z: z["form"].contains("<"))
    pairs = F.array_distinct(F.transform(slots, lambda z: F.struct(F.lower(z["item"]).alias("item"), F.lower(z["doc"]).alias("doc"))))
    first = (F.col("how") != 1) | (F.element_at("doc_plain", 1) == F.element_at("plain", 1))
    return (mine == F.col("form")) & first & (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda z: z["item"]))))


def _same() -> Column:
    return F.lower(F.array_join("doc_raw", " ")) == F.lower(F.array_join("raw", " "))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", with_key: bool = False) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_windows, n_verbatim, items (sorted ids of the items found).

    n_windows counts (window, item window) matches with consistent slots, n_verbatim those of them
    with the item's own words but for case. A name counts by its capital within a sentence, so a text all
    in capitals matches only by its plain words. Null texts have no words. Items of fewer than `length`
    words match as a whole, those of fewer than LEAST_WORDS by their plain words only; items without words never. Ids may be null or repeat: rows
    with the same id and text get the same answer. Empty tables give no matches or no rows. Other
    columns are ignored. With `with_key`, the `text_key` of each row follows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("th", text_key("doc_id", "text"))
    more = [F.col("th").alias("key")] if with_key else []
    items = materialise(item_windows(benchmark, length, item_col, "text"), "item-windows")
    prints = items.select("h", "size").distinct()
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # `length` values at most
    found = None
    some = suspects(base, items) if sizes else base
    for tokens, sign in (("form", 1), ("plain", -1)) if sizes else ():
        made = template(F.col("text")) if sign > 0 else plain(F.col("text"))
        windows = some.select("th", words(made).alias(tokens)).select("th", tokens, F.explode(F.array(*map(F.lit, sizes))).alias("size"))
        windows = windows.select("th", "size", F.posexplode(window_hashes(tokens, sign)).alias("at", "h"))
        part = windows.join(F.broadcast(prints) if prints.count() <= BROADCAST_WINDOWS else prints, ["h", "size"]).select("th", (F.col("at") + 1).alias("at"), "h", "size")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select("doc_id", F.lit(False).alias("contaminated"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("n_verbatim"), F.array().cast("array<long>").alias("items"), *more)
    found = materialise(found.distinct(), "template-matches")
    broadcast_items = F.broadcast(items) if items.count() <= BROADCAST_WINDOWS // 10 else items
    # A document's places are never more than its windows; item windows join them a row each.
    places = found.groupBy("th").agg(F.collect_list(F.struct("at", "size", "h")).alias("places"))
    hit = may_match(base, found.select(F.col("th").alias("key")), F.col("th")).dropDuplicates(["th"])
    tokens = hit.join(places, "th").select("th", "places", words(F.col("text")).alias("raw"), words(template(F.col("text"))).alias("form"), words(plain(F.col("text"))).alias("plain"))
    tokens = materialise(tokens, "matching-words")  # else each use in a lambda would make its template anew
    cut = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), p["h"].alias("h"), *(F.slice(c, p["at"], p["size"]).alias(f"doc_{c}") for c in ("raw", "form", "plain"))))
    fit = tokens.select("th", F.inline(cut)).join(broadcast_items, ["h", "size"]).where(_fits())
    # A window that fits in several forms counts once; `key` stands for the item window's words.
    once = fit.groupBy("th", "at", "size", "item_id", "key").agg(F.max(_same()).alias("same"))
    told = once.groupBy("th").agg(F.count("*").alias("n_windows"), F.count_if("same").alias("n_verbatim"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return base.select("doc_id", "th").join(told, "th", "left").select("doc_id", F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("n_verbatim", F.lit(0)).cast("long").alias("n_verbatim"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), *more)
