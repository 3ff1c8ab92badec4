"""Texts with very long repeats of each group that a pattern repeats, and with many spans: answers, and in time."""

import re
import time

import pytest

pytest.importorskip("raincask.llm")
from pyspark.sql import functions as F  # noqa: E402

from raincask.llm import decontamination, pii  # noqa: E402

N = 50_000
LONG = [
    "a@b" + ".c" * N, "a@" + "b-" * N + "b.c", "." * N + "@b.c", "1" + ".1" * N, "1" + ",1:2/3" * N, "4 " * N, "4-" * N, "+1" + "(2)" * N, "a1" + "-b2" * N, "ab1/" * N, "x_" * N + "1",
    "a" + "-b" * N, "(at)" * N, "a[at]b" + "[dot]c" * N, "AB" * N, "<" * N, "Word " * N, "0x" + "1f " * N, "1:2:3:" * N, "12/" * N + "3", "A’b" * N, "=" * N, "six " * N, "3 kg " * N,
]


def test_pii_on_long_repeats(spark):
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    got = {r.doc_id: r.base for r in pii.find_pii(docs).collect()}
    assert [tuple(s) for s in got[0]] == [(0, 0, 3 + 2 * N)] and got[21] == []
    assert [(s["start"], s["stop"]) for s in got[3]] == [m.span() for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", LONG[3])]
    for i, text in enumerate(LONG[:3]):
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", text)]
        assert [(s["start"], s["stop"]) for s in got[i] if s["kind"] == 0] == want


def test_decontamination_on_long_repeats(spark):
    item = "the orchard keeper counted forty baskets of pears before noon and sold twelve"
    docs = spark.createDataFrame([(i, f"{item} {text}") for i, text in enumerate(LONG)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.contaminated for r in decontamination.decontaminate(docs, benchmark).collect()} == {True}


def test_many_spans_in_one_text(spark):
    """Positions by hand, in a time that grows with the spans and not with their square."""
    mails = "é a@b.cd (212) 555-0199 " * 20_000
    docs = spark.createDataFrame([(1, mails), (2, "a@b.cd" * 3)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert time.time() - began < 60
    assert [(s["start"], s["stop"]) for s in got[1].base] == [(24 * k + 2, 24 * k + 8) for k in range(20_000)]
    assert all(24 * k + 9 == s["start"] for k, s in enumerate([s for s in got[1].spans if s["kind"] == 3]))


def test_scan(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        row = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).cast("array<long>").alias("a") if n else F.array().cast("array<long>").alias("a"))
        got = row.select(pii.scan(F.col("a"), lambda x, y: x + y, F.lit(0).cast("long")).alias("s")).first().s
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_failed_checksums_are_never_taken():
    votes = [(2, (-1, 1, 1, 1), 500.0), (2, (1, 1, 0, 1), 20.0), (0, (-1, 1, 1, 1), 5.0)]
    assert all(v[0] >= 0 for k, v in pii.accepted(votes) if k in pii.NUMBERS)
