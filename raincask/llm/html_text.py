"""Main text of web pages by flat text blocks and a decision tree.

A page is read once into flat text blocks. A block is what lies between two tags that are not inline;
it has its text, its number of words, the share of them in links, and two facts about where it lies:
inside an element that says it holds the article, or inside one that says it is something else (by its
tag, or by a word of its class, id or role). The tree sees each block with its two neighbours. It is
trained by Spark on the blocks of a small table of labelled pages, read in the same way, and applied as
one expression; no page leaves its partition.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

BLOCKS = "array<struct<text: string, words: int, links: int, inside: int, aside: int, heading: int>>"
#: Tags (fixed values): inline ones, which end no block; those without an end tag; those whose content is no text at all.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags whose start ends an open paragraph, and those that end an open one of their own name.
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split())
ENDS_LIKE = frozenset("li dt dd tr td th option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button".split())
#: Of those, the ones whose content is not markup.
RAW = frozenset("script style title textarea iframe noscript".split())
#: Tags and roles of what surrounds an article, and words of a class or id that say so (fixed values).
AROUND = frozenset("nav header footer aside form dialog menu".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices alert alerts nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside footer header masthead comment comments discussion disqus reply replies respond related recommended recommendations share sharing social newsletter subscribe "
    "subscription signup login popup modal overlay widget toolbar pagination pager copyright legal disclaimer skip search form".split()
)
ARTICLE = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article articlebody post postbody entry content story main maincontent".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _place(tag: str, attributes: str) -> tuple[int, int, bool]:
    """Whether an element says it holds the article, says it is something else, or is hidden."""
    inside, aside, hidden = int(tag in ARTICLE), int(tag in AROUND), False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name == "role":
                aside |= int(value.lower() in AROUND_ROLES)
                inside |= int(value.lower() in ARTICLE)
            elif name in ("class", "id"):
                words = {w.lower() for w in _WORDS.findall(value)} | {w.lower() for w in value.split()}
                aside |= int(bool(words & AROUND_WORDS))
                inside |= int(bool(words & ARTICLE_WORDS))
            elif name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden |= value.lower() == "true"
            else:
                hidden |= "display:none" in value.replace(" ", "").lower()
    return inside * (1 - aside), aside, hidden


def read_blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, inside, aside, heading) of the blocks of a page that have text, in page order.

    A tag that never closes runs to the end of the page and is no text. End tags close the nearest open
    element of their name, and none if there is none.
    """
    out: list[tuple[str, int, int, int, int, int]] = []
    open_tags: list[tuple[str, int, int, bool, str]] = []  # name, how often inside, aside, whether hidden up to here, the last name that is not inline
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    in_link, heading, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal heading
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, inside, aside, *_ = open_tags[-1] if open_tags else ("", 0, 0)
                words = text.count(" ") + 1
                out.append((text, words, min(words, len(" ".join(linked).split())), int(inside > 0), int(aside > 0), heading))
            pieces.clear()
            linked.clear()

    def keep(text: str) -> None:
        if text and not (open_tags and open_tags[-1][3]):
            pieces.append(html.unescape(text) if "&" in text else text)
            if in_link:
                linked.append(pieces[-1])

    def close(tag: str) -> None:
        while opened[tag]:
            name = open_tags.pop()[0]
            opened[name] -= 1
            if name == tag:
                break

    def innermost() -> str:
        """The innermost open element that is not inline."""
        return open_tags[-1][4] if open_tags else ""

    while at < end:
        less = page.find("<", at)
        if less < 0:
            keep(page[at:])
            break
        follow = page[less + 1 : less + 2]
        if not (follow.isalpha() and follow.isascii() or follow in ("/", "!", "?") and follow):
            keep(page[at : less + 1])  # a bare sign
            at = less + 1
            continue
        keep(page[at:less])
        if follow in ("!", "?"):
            comment = page.startswith("<!--", less)
            stop = page.find("-->" if comment else ">", less + (4 if comment else 1))
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        m = _TAG.match(page, less)
        if m is None:
            stop = page.find(">", less) if follow == "/" and not page[less + 2 : less + 3].isalpha() else -1
            at = end if stop < 0 else stop + 1
            continue
        at, tag = m.end(), m.group(2).lower()
        if m.group(1):
            if tag == "a":
                in_link = 0
            if tag not in INLINE:
                flush()
            close(tag)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = 0
            continue
        if tag not in INLINE:
            flush()
        if tag == "br":
            keep(" ")
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end if stop is None else stop.start()
        if tag == "a":
            in_link = 1
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if tag in ENDS_PARAGRAPH and innermost() == "p":
            close("p")
        if tag in ENDS_LIKE and innermost() == tag:
            close(tag)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = 1
        if tag in INLINE and not m.group(3):
            continue  # nothing depends on it
        inside, aside, hidden = _place(tag, m.group(3))
        _, was_inside, was_aside, was_hidden, was_in = open_tags[-1] if open_tags else ("", 0, 0, False, "")
        opened[tag] += 1
        open_tags.append((tag, was_inside + inside, was_aside + aside, was_hidden or hidden or tag in SKIPPED, was_in if tag in INLINE else tag))
    flush()
    return out


# ---------------------------------------------------------------- the classifier
#: What the tree sees of a block.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "inside", "aside", "heading", "declared")
#: The labelled table: pages of our own making. A block that begins with + is main text, one with - is not; {n} stands for n words.
LABELLED = (
    "<header><h1>-{3}</h1></header><nav><ul><li><a>-{1}</a><li><a>-{1}</a><li><a>-{2}</a></ul></nav><div class=ad>-{9}</div><article><h1>+{9}</h1><p>+{60}<p>+{2}<p>+{35}<p>+{1}</article><footer>-{12} <a>{2}</a></footer>",
    "<nav><a>-{1}</a> <a>{1}</a> <a>{2}</a></nav><main><h1>+{5}</h1><p>+{4}</p><p>+{90} <a>{3}</a> {20}</p><p><a>+{6}</a></p><aside><h3>-{3}</h3><p>-{40}</p></aside><p>+{1}</p><form><p>-{12}</p></form></main><div class=comments><p>-{30}</p><p>-{55}</p></div><footer><p>-{25}</p></footer>",
    "<div id=cookie-banner><p>-{28} <a>{2}</a></p></div><article><p>+{1}</p><ul><li>+{3}<li>+{5}<li><a>+{4}</a></ul><div class=newsletter><p>-{22}</p></div><table><tr><td>+{2}<td>+{1}</table><blockquote>+{18}</blockquote><section id=comments><h3>-{2}</h3><p>-{80}</p></section></article><div><p>-{14}</p></div><div><p>-{45}</p></div>",
    "<p>-{6}</p><div class=promo><p>-{35}</p></div><div class=post-content><h2>+{4}</h2><p>+{70}</p><p>+{3}</p><div class=share><a>-{1}</a> <a>{1}</a></div><p>+{12}</p><div class=related><ul><li><a>-{8}</a><li><a>-{7}</a></ul></div></div><div><p>-{30}</p><a>-{4}</a></div>",
    "<article><h1>+{2}</h1><p>+{2}</p></article><p>-{50}</p><p>-{3}</p><ul><li><a>-{7}</a><li><a>-{9}</a></ul><p>-{20}</p>",
    "<div><a>-{1}</a> <a>{1}</a> <a>{1}</a></div><h1>+{7}</h1><p>+{50}</p><p>+{4}</p><p>+{41} <a>{2}</a></p><p>+{33}</p><div><a>-{3}</a></div><div><a>-{2}</a> | <a>{2}</a></div><div>-{5}</div>",
    "<ul><li><a>-{2}</a><li><a>-{1}</a><li><a>-{3}</a></ul><h2>+{5}</h2><p>+{28}</p><p>+{64}</p><h2>+{3}</h2><p>+{37}</p><p>+{6}</p><p>+{52}</p><ul><li><a>-{5}</a><li><a>-{6}</a><li><a>-{4}</a></ul><div>-{7} <a>{1}</a></div>",
    "<div>-{2}</div><div><a>-{2}</a></div><div><a>-{1}</a></div><p>+{120}</p><p>+{80} <a>{4}</a> {10}</p><p>+{9}</p><p>+{75}</p><div><a>-{9}</a></div><div><a>-{11}</a></div><div>-{4}</div>",
    "<div>-{3} <a>{3}</a></div><div class=sidebar><p>-{60}</p><a>-{2}</a></div><h1>+{6}</h1><p>+{45}</p><div class=advert><p>-{26}</p></div><p>+{48}</p><p>+{22}</p><div class=footer><p>-{33}</p></div>",
    "<div><a>-{4}</a></div><div><a>-{5}</a></div><div><a>-{6}</a></div><div>-{3}</div><div><a>-{4}</a></div><div>-{2}</div>",
    "<nav><p>-{30}</p></nav><article><p>+{15} <a>{14}</a></p><p><a>+{2}</a> <a>{3}</a></p><h2>+{1}</h2><p>+{200}</p></article><footer><p>-{70}</p><p>-{2}</p></footer>",
    "<article><h1>+{3}</h1><div class=notice><p>-{16}</p></div><p>+{8}</p><p>+{1}</p><p>+{1}</p><p>+{25}</p><footer><p>-{10}</p></footer></article><div><p>-{18}</p></div><h2>-{4}</h2><p>-{38}</p>",
    "<nav><a>-{1}</a> <a>{2}</a></nav><article><h1>+{4}</h1><p>+{30}<p>+{3}",
    "<header>-{2}</header><main><p>+{7}<p>+{1}<p>+{19}<p><a>+{2}</a>",
    "<main><h1>+{3}</h1><p>+{11}</p></main>",
    "<div>-{9}</div><article><p>+{21}<ul><li>+{2}<li>+{1}",
    "+{16}",
    "<p>+{44}</p>",
    "<h1>+{6}</h1><p>+{47}</p><p>+{58}</p>",
    "<div><a>-{2}</a></div><h1>+{8}</h1><p>+{95}</p><p>+{24}</p><p>+{66}</p><div>-{3}</div>",
    "<div>-{2}</div><p>+{32}</p><p>+{12}</p><p>+{27}</p><div>-{6}</div><div>-{4}</div>",
)


def page_blocks(pages: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and `blocks` of each page. Pages go to Python some at a time, by number and bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), *((c, pa.int32()) for c in ("words", "links", "inside", "aside", "heading"))]))
        names = ("text", "words", "links", "inside", "aside", "heading")
        for batch in batches:
            for part in slices(batch, "_html", 8 << 20):
                blocks = pa.array([[dict(zip(names, b)) for b in read_blocks(page or "")] for page in part.column(len(keep)).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), blocks], [*keep, "blocks"])

    sent = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[:-1]]
    return sent.mapInArrow(run, ", ".join([*schema, f"blocks {BLOCKS}"]))


def with_features(blocks: Column) -> Column:
    """Each block with its FEATURES: its own, those of its two neighbours (zero beyond the ends), and whether any block lies inside an article."""
    def one(b: Column, i: Column) -> Column:
        density = lambda x: F.coalesce(x["links"] / x["words"], F.lit(0.0))
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        declared = F.exists(blocks, lambda x: (x["inside"] == 1) & (x["aside"] == 0)).cast("int")
        values = (b["words"], density(b), F.coalesce(before["words"], F.lit(0)), density(before), F.coalesce(after["words"], F.lit(0)), density(after), b["inside"], b["aside"], b["heading"], declared)
        return F.struct(b["text"].alias("text"), *(v.cast("double").alias(name) for name, v in zip(FEATURES, values)))

    return F.transform(blocks, one)


def train_tree(spark: SparkSession, labelled: tuple[str, ...] = LABELLED, depth: int = 6):
    """A decision tree of Spark's, fitted to the blocks of the labelled pages."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    pages = spark.createDataFrame([(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m.group(1))), p),) for p in labelled], "html string")
    rows = page_blocks(pages, "html", []).select(F.explode(with_features(F.col("blocks"))).alias("b")).select("b.*").withColumn("label", F.col("text").startswith("+").cast("double"))
    return DecisionTreeClassifier(featuresCol="features", maxDepth=depth, minInstancesPerNode=1, seed=1).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))


def tree_expression(model, block: Column) -> Column:
    """The class that a fitted tree gives to a block with FEATURES, as an expression."""
    def told(node) -> Column:
        if not node.getClass().getSimpleName().startswith("Internal"):
            return F.lit(node.prediction())
        split = node.split()
        return F.when(block[FEATURES[split.featureIndex()]] <= split.threshold(), told(node.leftChild())).otherwise(told(node.rightChild()))

    return told(model._java_obj.rootNode())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = 6) -> DataFrame:
    """One row per input row: page_id, url, text (its main blocks, joined by line ends), n_chars, n_blocks (all that were read).

    Null and empty pages have an empty text. Ids and urls may be null or repeat; rows that repeat come
    out as often as they are in. Pages of any length are read whole; broken markup is read as it comes.
    Other columns are ignored; an empty table gives no rows.
    """
    model = train_tree(pages.sparkSession, depth=depth)
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    with_blocks = page_blocks(named, "html", ["page_id", "url"])
    kept = F.filter(with_features(F.col("blocks")), lambda b: tree_expression(model, b) == 1.0)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return with_blocks.select("page_id", "url", text.alias("text"), F.size("blocks").cast("long").alias("n_blocks")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
