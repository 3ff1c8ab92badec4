"""Near copies of documents whose ids are null, or stand for several texts."""

import random

import pytest

pytest.importorskip("raincask.llm")
from raincask.llm import near_dedup  # noqa: E402
from raincask.llm.common import text_key  # noqa: E402

R = random.Random(6)


def prose(n):
    return " ".join("".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(n))


def edited(text):
    words = text.split()
    words[len(words) // 2] = "edited"
    return " ".join(words)


def test_null_and_repeated_ids_take_part(spark):
    a, b, c, d, e = (prose(120) for _ in range(5))
    rows = [(1, a), (None, edited(a)), (2, b), (2, c), (3, edited(c)), (2, edited(b)), (None, d), (None, edited(d)), (4, e), (4, e), (None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, number int").repartition(3)
    gone = {(r.doc_id, r.key): r.keep_id for r in near_dedup.near_copies(docs).collect()}
    key = {(r.doc_id, r.text): r.key for r in docs.select("doc_id", "text", text_key().alias("key")).collect()}
    name = {v: k for k, v in key.items()}
    told = {name[k]: keep for (_, k), keep in gone.items()}
    assert told.pop((None, edited(a))) == 1 and told.pop((3, edited(c))) == 2 and told.pop((None, None)) == 5
    pair = [(2, b), (2, edited(b))]
    assert told.pop(max(pair, key=lambda p: key[p])) == 2
    assert told.pop(max([(None, d), (None, edited(d))], key=lambda p: key[p])) is None
    assert told == {}
