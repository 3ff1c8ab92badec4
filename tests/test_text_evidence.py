"""Evidence in texts against its SQL, on texts whose words, spaces and letters are not of ASCII."""

import pytest

from raincask.plans import q_sources  # noqa: F401
from raincask.plans.book import ORACLES
from raincask.sources import profile

duckdb = pytest.importorskip("duckdb")


def test_evidence_is_that_of_sql(spark):
    words = ["ist", "IST", "08 30", "08\x0b30", "03 z", "0300", "3 00 utc", "ending", "ending at", "starting", "ſtarting", "aſtarting", "previouſ day", "next day", "preceding", "24 - hr", "24\x0bhr", "accumulated", "valid", "obſervation time", "bıst", "İST"]
    texts = [a + w + b for w in words for a in ("", " ", "x", "é", "_", "́", "ी", "\n") for b in ("", ".", "x", "é", "́", "7", "中")]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    want = dict(con.execute(ORACLES["k15_text_evidence"]).fetchall())
    got = {r.doc_id: r.pattern for r in profile.text_evidence(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (texts[k], want.get(k), got.get(k)) for k in want.keys() | got.keys() if want.get(k) != got.get(k)} == {}
