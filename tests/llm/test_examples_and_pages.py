"""Fill-in-the-middle, hard negatives and page text, against brute force."""

import hashlib
import html
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("raincask.llm")
from pyspark.sql import functions as F  # noqa: E402

from raincask.llm import fim, hard_negatives, html_text  # noqa: E402

R = random.Random(11)


def fim_by_hand(i, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (i, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}", text) if h[3] % 100 < 20 else (i, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}", text)


def test_fill_in_middle(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (5, "<P>x"), (None, "zé"), (None, None), (7, "<S<P<M" * 30), (7, "a"), (7, "a"), (8, "😀" * 40), (9, fim.ESCAPE * 5), (10, fim.MARK * 3 + "me" + fim.ESCAPE + "m\r\n"), (11, "long é " * 30_000)]
    rows += [(i, "".join(R.choice(f"ab{fim.MARK}{fim.ESCAPE}me<PSM>😀\n") for _ in range(R.randint(0, 60)))) for i in range(20, 300)]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, marks string").repartition(3)
    got = [tuple(r) for r in fim.fill_in_middle(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr(fim_by_hand(*r)) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def negatives_by_hand(rows, every=100):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (label, tuple(math.floor(256 * x) for x in v))
        best[i] = min(best.get(i, one), one)
    ids = np.array(list(best))
    labels, q = np.array([best[i][0] for i in best]), np.array([best[i][1] for i in best], dtype=np.int64)
    out = set()
    for i in best:
        if i % every:
            continue
        scores = q @ np.array(best[i][1])
        order = np.lexsort((ids, -scores))
        for p in [k for k in order if labels[k] == best[i][0] and ids[k] != i][:5]:
            top = int(scores[p])
            for rank, k in enumerate([k for k in order if labels[k] != best[i][0] and 80 * top <= 100 * scores[k] <= 100 * top][:5]):
                out.add((i, int(ids[p]), rank + 1, int(ids[k]), top, int(scores[k])))
    return out


@pytest.mark.parametrize("shape", ["ties", "decaying"])
def test_hard_negatives(spark, monkeypatch, shape):
    for name, value in (("LEAST_ROWS", 100), ("STEP", 64), ("SUB", 5), ("QUERIES", 6)):
        monkeypatch.setattr(hard_negatives, name, value)
    if shape == "ties":  # few values, so many equal scores; one label has most rows
        rows = [(i, R.choice([0, 0, 0, 1, 2]), [R.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)]) for i in range(900)]
    else:
        rows = [(i, R.randrange(4), [R.gauss(0, 1) / (k + 1) for k in range(6)]) for i in range(900)]
    bad = [(1201, None, [0.1] * 6), (1300, 2, None), (1400, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (1500, 1, [float("nan")] * 6), (1600, 1, [float("inf")] * 6), (None, 1, [0.1] * 6)]
    rows += bad + [(300, 0, [0.5] * 6), (300, 3, [0.5] * 6), (7, 1, [1.0] * 6), (7, 1, [1.0] * 6)]
    extra = [(2000, 1, [1.0] * 3, 1, "z"), (2100, 1, [], 1, "z"), (2200, 1, [1e30] * 6, 1, "z")]  # another length, too large
    table = spark.createDataFrame([(*r, 1, "z") for r in rows] + extra, "vec_id long, label int, embedding array<double>, block int, query string")
    got = [tuple(r) for r in hard_negatives.hard_negatives(table).collect()]
    want = negatives_by_hand(rows)
    assert len(got) == len(want) and set(got) == want
    assert hard_negatives.hard_negatives(table.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(table.where("vec_id % 100 != 0")).count() == 0


def test_bounds_discard_and_lose_nothing():
    rng = np.random.default_rng(5)
    rows = rng.integers(-400, 400, (3000, 24)) // (1 + np.arange(24))
    axes, cuts = hard_negatives.rotation((rows.T @ rows).astype(float))
    a, r = hard_negatives.Rotated(rows[:40], axes, cuts), hard_negatives.Rotated(rows, axes, cuts)
    whole = rows[:40] @ rows.T
    floor = np.sort(whole, axis=1)[:, -8]
    i, j, score = hard_negatives.survivors(a, r, None, floor, None, 5)
    found = set(zip(i.tolist(), j.tolist()))
    assert all((k, n) in found for k in range(40) for n in np.argsort(-whole[k], kind="stable")[:5])
    assert (score == whole[i, j]).all() and len(i) < 0.05 * whole.size


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="page"><header>Site</header><nav><a href=/>menu</a></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Title &amp; more</h1><p>Para&nbsp;one <em>it</em>al<sup>1</sup>, two<br>lines.</p><aside>side</aside><script>if(a<b)x="</p><p>no</p>"</script><!-- <p>no</p> --><p>5 < 6</p>
<pre>x  y
z</pre><form><label>Name</label></form><div id="comments"><p>bad comment</p></div><p>last<p class="ad">buy<p>end</article></main><footer>f</footer><a "unclosed"""


def test_main_text(spark):
    deep = "<p>" + "<div>" * 3000 + "word " * 30 + "<a '" * 2000
    broken = ["<", "</", "</>", "<p", "<p>a</b></i>b", "&#0;&bogus;&lt;p&gt; <article>x &amp;lt; y", "<script>never closed <p>x", "<article><p>" + "é " * 40_000 + "</article>", "<!-- never closed", "<article hidden>no</article>"]
    rows = [(1, "u", PAGE), (2, None, None), (None, "x", ""), (None, "x", ""), (4, "d", deep), (5, "y", "plain text of a few words that make up one paragraph without any markup at all")] + [(10 + k, "b", p) for k, p in enumerate(broken)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, blocks string, words int")
    got = html_text.main_text(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[1] == "Title & more\nPara one ital1, two lines.\n5 < 6\nx y z\nlast\nend"
    assert text[2] == "" and text[None] == "" and text[4] == " ".join(["word"] * 30) and text[5] == rows[5][2]
    assert text[14] == "ab" or text[14] == "" and text[15] == "x &lt; y" or "x &lt; y" in text[15]
    assert text[16] == "" and text[17].split() == ["é"] * 40_000 and text[18] == "" and text[19] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_tree_without_structural_tags_and_on_its_own_table(spark):
    para = " ".join(["word"] * 40)
    plain = f"<div><a href=/>one</a> <a href=/>two</a></div><h1>A headline of some words</h1><p>{para}</p><p>{para} more</p><p>{para}</p><div><a href=/>next page of it</a></div><div>2024 Site</div>"
    got = html_text.main_text(spark.createDataFrame([(1, "u", plain)], "page_id long, url string, html string")).first()
    assert got.text == f"A headline of some words\n{para}\n{para} more\n{para}"
    filled = [re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m.group(1))), p) for p in html_text.LABELLED]
    told = html_text.main_text(spark.createDataFrame([(k, "u", p) for k, p in enumerate(filled)], "page_id long, url string, html string")).collect()
    lines = [line for r in told for line in r.text.split("\n") if line]
    blocks = [b for p in filled for b in html_text.read_blocks(p)]
    right = sum(line.startswith("+") for line in lines) + sum(b[0].startswith("-") for b in blocks) - sum(line.startswith("-") for line in lines)
    assert right / len(blocks) > 0.97


def test_pages_of_the_tables_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1).replace("<br>", " "))
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
    assert pages.where(F.col("html").isNull()).count() == 0
